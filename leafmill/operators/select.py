"""Choosing pages of documents with range expressions.

Page tables are ``doc_id, page_no, text`` with pages numbered 1..total without gaps. Spec tables
are ``doc_id, spec`` with one row per document. The ranges of an expression become rows, cut at
blocks of ``FINE`` pages, and meet the pages of their block: a page is compared with the ranges that
touch its block alone, so the work follows what is chosen, with any number of ranges and pages. Ranges
that overlap are united first where a page counts once, by running maxima over their edges, and the
new number of a page follows from the running totals of the united ranges.

Page totals (``doc_id, total``) are counted from the page table unless they are given; whoever
made the pages from documents knows them without a shuffle. When they are counted, pages that are
missing, repeated or without a number are noticed: such a document has the status ``gaps``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.ranges import is_every_page, listed_ranges
from leafmill.plans.scale import PAGES_PER_BLOCK, page_block

#: Pages of a block in which pages and ranges meet.
FINE = 64


def page_totals(doc_pages: DataFrame) -> DataFrame:
    """``doc_id, total, gaps``; ``gaps`` says that the pages are not numbered 1..total."""
    numbered = doc_pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("total"),
        F.count_distinct("page_no").alias("_numbers"),
        F.min("page_no").alias("_first"),
        F.max("page_no").alias("_last"),
    )
    whole = (F.col("_first") == 1) & (F.col("_last") == F.col("total")) & (F.col("_numbers") == F.col("total"))
    return numbered.select("doc_id", "total", (~F.coalesce(whole, F.lit(False))).alias("gaps"))


def _parsed(specs: DataFrame, totals: DataFrame, how: str) -> DataFrame:
    """``doc_id, spec, total, gaps, each, ranges``; ``ranges`` is NULL when invalid or every page."""
    if "gaps" not in totals.columns:
        totals = totals.withColumn("gaps", F.lit(False))
    return (
        specs.join(totals.select("doc_id", "total", "gaps"), "doc_id", how)
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("each", is_every_page(F.col("spec")))
        .withColumn(
            "ranges",
            F.when(~F.col("each"), listed_ranges(F.col("spec"), F.col("total"))),
        )
    )


def parse_page_ranges(specs: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per range in the order written, or one row without range when there is none.

    Expressions for every page give one row per page; those are made block by block, so that no
    array grows with the document.
    """
    block = F.col("_block") * PAGES_PER_BLOCK
    singles = F.transform(
        F.sequence(block + 1, F.least(block + PAGES_PER_BLOCK, F.col("total"))),
        lambda p: F.struct(p.alias("range_no"), p.alias("a"), p.alias("b")),
    )
    listed = F.transform(
        F.col("ranges"), lambda r, i: F.struct((i + 1).alias("range_no"), r["a"].alias("a"), r["b"].alias("b"))
    )
    expand = F.col("each") & (F.col("total") > 0)
    return (
        _parsed(specs, totals, "left")
        .withColumn(
            "_block",
            F.explode(
                F.when(expand, F.sequence(F.lit(0), page_block(F.col("total")))).otherwise(
                    F.array(F.lit(0))
                )
            ),
        )
        .withColumn("_range", F.explode_outer(F.when(expand, singles).otherwise(listed)))
        .select(
            "doc_id",
            "spec",
            "total",
            (F.col("each") | F.col("ranges").isNotNull()).alias("valid"),
            "_range.range_no",
            "_range.a",
            "_range.b",
        )
    )


def _block(page: Column) -> Column:
    return F.floor((page - 1) / FINE)


def _meet(doc_pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages with every range (``doc_id, first, last`` and more) of their document that holds them."""
    touched = F.sequence(_block(F.col("first")), _block(F.col("last")))
    cut = ranges.filter("first <= last").withColumn("_block", F.explode(touched))
    pages = doc_pages.select("doc_id", F.col("page_no").alias("_page"), "text").withColumn("_block", _block(F.col("_page")))
    return pages.join(cut, ["doc_id", "_block"]).filter(F.col("_page").between(F.col("first"), F.col("last")))


def split_by_ranges(
    doc_pages: DataFrame, specs: DataFrame, totals: DataFrame | None = None
) -> DataFrame:
    """One output document per distinct range; a page may go to several of them.

    Invalid expressions give no output, and neither do documents with gaps; ``split_report`` names
    both.
    """
    plan = _parsed(specs, page_totals(doc_pages) if totals is None else totals, "inner").filter(~F.col("gaps"))
    # a range as one number, so that repeats are found by hashing
    packed = F.transform("ranges", lambda r: F.shiftleft(r["a"].cast("long"), 32).bitwiseOR(r["b"].cast("long")))
    listed = plan.filter(~F.col("each")).select("doc_id", F.explode(F.array_distinct(packed)).alias("_range"))
    first, last = F.shiftright("_range", 32).cast("int"), F.col("_range").bitwiseAND(0x7FFFFFFF).cast("int")
    listed = listed.select("doc_id", first.alias("first"), last.alias("last"), F.lit(False).alias("each"))
    every = plan.filter("each").select("doc_id", F.lit(1).alias("first"), F.col("total").alias("last"), F.lit(True).alias("each"))
    page, each = F.col("_page"), F.col("each")
    start, end = F.when(each, page).otherwise(F.col("first")), F.when(each, page).otherwise(F.col("last"))
    name = F.concat(
        F.col("doc_id").cast("string"),
        F.lit("_p"),
        start.cast("string"),
        F.when(start == end, F.lit("")).otherwise(F.concat(F.lit("-"), end.cast("string"))),
    )
    return _meet(doc_pages, listed.unionByName(every)).select(
        "doc_id", name.alias("out_name"), (page - start + 1).alias("page_no"), page.alias("src_page_no"), "text"
    )


def split_report(doc_pages: DataFrame, specs: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """``doc_id, status`` of every expression: ``ok``, ``invalid``, ``gaps`` or ``missing``."""
    plan = _parsed(specs, page_totals(doc_pages) if totals is None else totals, "left")
    return plan.select("doc_id", _status(plan).alias("status"))


def _status(plan: DataFrame) -> Column:
    return (
        F.when(plan["gaps"].isNull(), "missing")
        .when(plan["gaps"], "gaps")
        .when(~plan["each"] & plan["ranges"].isNull(), "invalid")
        .otherwise("ok")
    )


def _united(plan: DataFrame) -> DataFrame:
    """``doc_id, total, a, b, before, picked, following``: the chosen pages as ranges apart from each other,
    with the chosen pages ahead of each, those of the document, and the start of the next."""
    listed = plan.filter(~F.col("each")).select("doc_id", "total", F.inline("ranges"))
    by_start = Window.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    starts = listed.withColumn("_new", F.coalesce((F.col("a") > reach + 1).cast("int"), F.lit(1)))
    islands = starts.withColumn("_island", F.sum("_new").over(by_start))
    united = islands.groupBy("doc_id", "total", "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")
    every = plan.filter(F.col("each") & (F.col("total") > 0)).select("doc_id", "total", F.lit(1).alias("a"), F.col("total").alias("b"))
    size, order = F.col("b") - F.col("a") + 1, Window.partitionBy("doc_id").orderBy("a")
    return united.unionByName(every).select(
        "*",
        F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum(size).over(Window.partitionBy("doc_id")).alias("picked"),
        F.lead("a").over(order).alias("following"),
    )


def _choose(
    doc_pages: DataFrame, specs: DataFrame, totals: DataFrame | None, drop: bool
) -> DataFrame:
    plan = _parsed(specs, page_totals(doc_pages) if totals is None else totals, "left")
    plan = plan.withColumn("status", _status(plan))
    picks = _united(plan.filter("status = 'ok'"))
    if drop:
        # what lies behind each range, and ahead of the first
        behind = picks.select(
            "doc_id", (F.col("b") + 1).alias("first"),
            F.coalesce(F.col("following") - 1, "total").alias("last"),
            (F.col("before") + F.col("b") - F.col("a") + 1).alias("shift"),
        )
        ahead = picks.filter("before = 0").select("doc_id", F.lit(1).alias("first"), (F.col("a") - 1).alias("last"), F.lit(0).cast("long").alias("shift"))
        kept = behind.unionByName(ahead)
        refused = picks.filter("picked = total AND before = 0").select("doc_id", F.lit("refused").alias("status"))
    else:
        kept = picks.select("doc_id", F.col("a").alias("first"), F.col("b").alias("last"), (F.col("a") - 1 - F.col("before")).alias("shift"))
        refused = plan.filter("false").select("doc_id", "status")
    none = F.lit(None).cast("int")
    # the one row of a document whose request was not carried out
    told = plan.filter("status <> 'ok'").select("doc_id", "status").unionByName(refused).select(
        "doc_id", "status", none.alias("page_no"), none.alias("src_page_no"), F.lit(None).cast("string").alias("text")
    )
    page = F.col("_page")
    return _meet(doc_pages, kept).select(
        "doc_id", F.lit("ok").alias("status"), (page - F.col("shift")).cast("int").alias("page_no"), page.alias("src_page_no"), "text"
    ).unionByName(told)


def extract_pages(
    doc_pages: DataFrame, specs: DataFrame, totals: DataFrame | None = None
) -> DataFrame:
    """The chosen pages of each document, ascending, each once, renumbered.

    A document whose request is ``invalid``, or whose pages have ``gaps`` or are ``missing``, has one
    row that says so.
    """
    return _choose(doc_pages, specs, totals, drop=False)


def delete_pages(
    doc_pages: DataFrame, specs: DataFrame, totals: DataFrame | None = None
) -> DataFrame:
    """All other pages, renumbered; ``refused`` when none would be left, and statuses as above."""
    return _choose(doc_pages, specs, totals, drop=True)
