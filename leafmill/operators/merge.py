"""Joining documents and cutting them at breaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import let, lines
from leafmill.operators.select import page_totals
from leafmill.plans.scale import page_block, running_totals, spread_join


def merge_documents(
    doc_pages: DataFrame, manifest: DataFrame, totals: DataFrame | None = None, missing: str = "refuse"
) -> DataFrame:
    """Concatenate documents: ``manifest`` is ``out_id, seq, doc_id``.

    Inputs follow ``seq``; a repeated input counts once, at its first place; an output with a
    single input is not made. An output with an input that has no pages is not made either; with
    ``missing="skip"`` the other inputs are merged, with ``"raise"`` the whole request is refused.
    ``merge_report`` names every output and what became of it.

    Only page counts are ordered and added up. The pages themselves meet their offset in one join,
    whose key is a block of pages of one document.
    """
    if missing not in ("refuse", "skip", "raise"):
        raise ValueError("missing is 'refuse', 'skip' or 'raise'")
    totals = (page_totals(doc_pages) if totals is None else totals).select("doc_id", "total")
    inputs = manifest.groupBy("out_id", "doc_id").agg(F.min("seq").alias("seq"))
    sized = spread_join(inputs, totals, ["doc_id"], ["out_id"])
    if missing != "skip":
        lacking = inputs.join(totals, "doc_id", "left_anti").select("out_id").distinct()
        if missing == "raise" and not lacking.isEmpty():
            raise ValueError("the manifest names documents without pages")
        sized = sized.join(lacking, "out_id", "left_anti")
    placed = (
        running_totals(sized, "out_id", ["seq", "doc_id"], "total")
        .filter(F.col("_group_size") >= 2)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), page_block(F.col("total")))))
        .select("out_id", "seq", "doc_id", "_before", "_block")
    )
    blocked = doc_pages.select(
        "doc_id", F.col("page_no").alias("_page"), "text"
    ).withColumn("_block", page_block(F.col("_page")))
    return spread_join(placed, blocked, ["doc_id", "_block"], ["out_id"]).select(
        "out_id", "seq", "doc_id", (F.col("_before") + F.col("_page")).alias("page_no"), "text"
    )


def merge_report(doc_pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """``out_id, inputs, missing, status`` of every output that ``manifest`` names.

    An input without pages is ``missing``; the status is ``ok``, ``missing`` where inputs lack, which
    ``merge_documents`` refuses, or ``single`` where fewer than two inputs are left.
    """
    there = doc_pages.select("doc_id").distinct().withColumn("_there", F.lit(1))
    inputs = manifest.select("out_id", "doc_id").distinct().join(there, "doc_id", "left")
    counted = inputs.groupBy("out_id").agg(
        F.count(F.lit(1)).alias("inputs"), F.count_if(F.col("_there").isNull()).alias("missing")
    )
    status = (
        F.when(F.col("inputs") - F.col("missing") < 2, F.lit("single"))
        .when(F.col("missing") > 0, F.lit("missing"))
        .otherwise(F.lit("ok"))
    )
    return counted.withColumn("status", status)


def number_within(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """1-based rank of ``order`` in ``group``; used to derive manifests."""
    return running_totals(df, group, [order]).withColumn(
        name, F.col("_position").cast("int")
    ).drop("_position", "_group_size")


def split_on_breaks(docs: DataFrame, is_break: Callable[[Column], Column]) -> DataFrame:
    """Cut each document after every line that is a break: ``doc_id, part, i, line``.

    Parts are numbered from 1, an empty last part is dropped, and a document without a break
    gives no output. Lines are numbered from 1. All of it happens inside the row.
    """

    def parts(all_lines: Column, ends: Column) -> Column:
        edges = F.zip_with(
            F.concat(F.array(F.lit(0)), ends),
            F.concat(ends, F.array(F.size(all_lines))),
            lambda s, e: F.struct((s + 1).alias("first"), e.alias("last")),
        )
        return F.transform(
            F.filter(edges, lambda c: c["first"] <= c["last"]),
            lambda c: F.transform(
                F.slice(all_lines, c["first"], c["last"] - c["first"] + 1),
                lambda line, j: F.struct((c["first"] + j).alias("i"), line.alias("line")),
            ),
        )

    def break_ends(all_lines: Column) -> Column:
        marked = F.transform(all_lines, lambda line, i: F.when(is_break(line), i + 1))
        return F.filter(marked, lambda at: at.isNotNull())

    cut = let(
        lines(F.col("text")),
        lambda all_lines: let(
            break_ends(all_lines),
            lambda ends: F.when(F.size(ends) > 0, parts(all_lines, ends)),
        ),
    )
    return (
        docs.select("doc_id", F.posexplode(cut).alias("_part", "_lines"))
        .select("doc_id", (F.col("_part") + 1).alias("part"), F.inline("_lines"))
    )
