"""Checking and repairing the structure of pages, blank pages, size reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import html as h
from leafmill.functions.text import has_dominant_char, kilobytes, largest_char_share, saved_percent

# Result codes of a check and the share from which a page counts as blank.
CLEAN, ERROR, WARNING = 0, 2, 3
BLANK_SHARE = 0.9995

ERROR_TAGS = ("html", "body")
WARN_TAGS = ("p", "b", "article", "div", "ul", "a")


def _open(balance: Column, tag: str) -> Column:
    return F.filter(balance, lambda b: b["tag"] == tag)[0]["open"]


def _code(balance: Column, error_tags: tuple[str, ...]) -> Column:
    off = F.filter(balance, lambda b: b["open"] != 0)
    return (
        F.when(F.exists(off, lambda b: b["tag"].isin(*error_tags)), F.lit(ERROR))
        .when(F.size(off) > 0, F.lit(WARNING))
        .otherwise(F.lit(CLEAN))
    )


def _issues(balance: Column) -> Column:
    off = F.filter(balance, lambda b: b["open"] != 0)
    return F.array_join(
        F.transform(
            off,
            lambda b: F.concat(
                b["tag"],
                F.lit(": "),
                F.abs(b["open"]).cast("string"),
                F.when(b["open"] > 0, F.lit(" not closed")).otherwise(F.lit(" not opened")),
            ),
        ),
        "; ",
    )


def structure_check(
    page_table: DataFrame,
    error_tags: tuple[str, ...] = ERROR_TAGS,
    warn_tags: tuple[str, ...] = WARN_TAGS,
) -> DataFrame:
    """Result code and issues of each page; an error outranks a warning."""
    balance = h.tag_balance(h.markup(F.col("html")), (*error_tags, *warn_tags))
    return page_table.select("page_id", balance.alias("_balance")).select(
        "page_id",
        _code(F.col("_balance"), error_tags).alias("code"),
        _issues(F.col("_balance")).alias("issues"),
    )


def structure_summary(checks: DataFrame) -> DataFrame:
    """Pages per result code."""
    return checks.groupBy("code").agg(F.count(F.lit(1)).alias("pages"))


def blank_page_check(doc_pages: DataFrame, threshold: float = BLANK_SHARE) -> DataFrame:
    """Share of the most frequent character of each page; blank from ``threshold`` on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return doc_pages.select("doc_id", "page_no", largest_char_share(text).alias("share")).withColumn(
        "blank", F.col("share") >= threshold
    )


def _last(pieces: Column) -> Column:
    """The piece of markup in which the page is cut off; NULL when in none."""
    last = F.try_element_at(pieces, F.lit(-1))
    whole = (
        F.when(last.startswith("<!--"), last.endswith("-->"))
        .when(last.rlike(r"(?i)^<script(?=[\s/>])"), last.rlike(r"(?is)</script\s*+>$"))
        .when(last.rlike(r"(?i)^<style(?=[\s/>])"), last.rlike(r"(?is)</style\s*+>$"))
        .otherwise(last.endswith(">"))
    )
    return F.when((F.size(pieces) > 0) & ~whole, last)


def _closed(html: Column, balance: Column, last: Column) -> Column:
    """Append what a cut-off page lacks at its end; nothing else is made up."""
    name = F.coalesce(h.name_of(last), F.lit(""))
    end_of_block = (
        F.when(name == "<!--", F.lit("-->"))
        .when(name == "<script", F.lit("</script>"))
        .when(name == "<style", F.lit("</style>"))
        .otherwise(F.lit(""))
    )
    whole_tags = F.when(
        last.isNotNull() & ~name.isin(*h.HIDDEN),
        F.substring(html, F.lit(1), F.length(html) - F.length(last)),
    ).otherwise(html)
    missing = [
        F.repeat(F.lit(f"</{tag}>"), F.greatest(_open(balance, tag), F.lit(0)))
        for tag in ("body", "html")
    ]
    return F.concat(whole_tags, end_of_block, *missing)


def repair_pages(page_table: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Close pages that were cut off, check them again and report pages that show nothing.

    Pages without an issue are passed through. Everything is one narrow pass over the pages.
    ``keep`` names further columns to carry along.
    """
    tags = (*ERROR_TAGS, *WARN_TAGS)
    found = page_table.select("page_id", *keep, "html", h.markup(F.col("html")).alias("_pieces"))
    checked = found.select(
        "page_id",
        *keep,
        "html",
        h.tag_balance(F.col("_pieces"), tags).alias("_before"),
        _last(F.col("_pieces")).alias("_last"),
    ).withColumn("code_before", _code(F.col("_before"), ERROR_TAGS))
    faulty = F.col("code_before") != CLEAN
    repaired = checked.select(
        "page_id",
        *keep,
        "code_before",
        "html",
        F.when(faulty, _closed(F.col("html"), F.col("_before"), F.col("_last")))
        .otherwise(F.col("html"))
        .alias("_after"),
    ).withColumn("repaired", F.col("_after") != F.col("html"))
    again = repaired.withColumn(
        "_again", F.when(F.col("repaired"), h.tag_balance(h.markup(F.col("_after")), tags))
    )
    return again.withColumn("_text", h.visible_text(F.col("_after"))).select(
        "page_id",
        *keep,
        "code_before",
        F.when(F.col("repaired"), _code(F.col("_again"), ERROR_TAGS))
        .otherwise(F.col("code_before"))
        .alias("code_after"),
        "repaired",
        has_dominant_char(F.col("_text"), BLANK_SHARE).alias("blank_after"),
        F.col("_after").alias("html"),
    )


def size_report(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Size of ``column`` in two versions of a table, per key; only sizes are shuffled."""
    sizes = [
        df.select(F.col(key).alias("key"), kilobytes(F.octet_length(column)).alias(name))
        for df, name in ((before, "before_kb"), (after, "after_kb"))
    ]
    return sizes[0].join(sizes[1], "key").withColumn(
        "saved_pct", saved_percent(F.col("before_kb"), F.col("after_kb"))
    )


def size_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.sum("before_kb").alias("before_kb"), F.sum("after_kb").alias("after_kb")
    ).withColumn("saved_pct", saved_percent(F.col("before_kb"), F.col("after_kb")))
