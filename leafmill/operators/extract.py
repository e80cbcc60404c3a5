"""Links, assets and tables taken out of pages and documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.html import attribute_values, markup
from leafmill.functions.text import let, lines
from leafmill.functions.urls import link_kind, resolve
from leafmill.sources.tables import LINES_PER_PAGE, with_host, with_page_no

LINK_KINDS = ("external", "mail")
LINK_TAGS = ("a",)


def _references(page_table: DataFrame, names: tuple[str, ...], attribute: str) -> DataFrame:
    """``page_id, host, url, ord, href``: non-empty attribute values in page order."""
    values = attribute_values(markup(F.col("html")), names, attribute)
    return (
        with_host(page_table)
        .select("page_id", "host", "url", F.posexplode(values).alias("_at", "href"))
        .filter(F.col("href") != "")
        .select("page_id", "host", "url", (F.col("_at") + 1).alias("ord"), "href")
    )


def page_links(page_table: DataFrame, kinds: tuple[str, ...] = LINK_KINDS) -> DataFrame:
    """Every link with its absolute target and kind, duplicates kept; no page numbers yet."""
    url, href = F.col("url"), F.col("href")
    return (
        _references(page_table, LINK_TAGS, "href")
        .withColumn("kind", link_kind(url, href))
        .filter(F.col("kind").isin(*kinds))
        .select("page_id", "host", "ord", "href", resolve(url, href).alias("uri"), "kind")
    )


def extract_links(
    page_table: DataFrame,
    kinds: tuple[str, ...] = LINK_KINDS,
    numbers: DataFrame | None = None,
) -> DataFrame:
    """Links of each site with the page they stand on.

    Extraction is narrow; only the links, not the pages, meet the page numbers.
    """
    return with_page_no(page_links(page_table, kinds), page_table, numbers).select(
        "page_id", "host", "page_no", "ord", "href", "uri", "kind"
    )


def link_totals(links: DataFrame) -> DataFrame:
    """Links and distinct targets per site, both pre-aggregated before the shuffle."""
    return links.groupBy("host").agg(
        F.count(F.lit(1)).alias("links"), F.count_distinct("uri").alias("distinct_targets")
    )


def extract_assets(
    page_table: DataFrame,
    tag: str = "img",
    attribute: str = "src",
    numbers: DataFrame | None = None,
) -> DataFrame:
    """Each asset once per site, named after the page and position where it is seen first.

    The first sight on a page is found inside the row; over pages it is a minimum, which is
    combined before the shuffle however often an asset occurs.
    """
    values = attribute_values(markup(F.col("html")), (tag,), attribute)
    uris = F.transform(values, lambda v: F.when(v != "", resolve(F.col("url"), v)))
    first_on_page = let(
        uris,
        lambda all_uris: F.transform(
            F.filter(F.array_distinct(all_uris), lambda u: u.isNotNull()),
            lambda u: F.struct(
                u.alias("asset"), F.array_position(all_uris, u).cast("int").alias("ord")
            ),
        ),
    )
    seen = (
        with_host(page_table)
        .select("host", "page_id", F.inline(first_on_page))
        .groupBy("host", "asset")
        .agg(F.min("page_id").alias("page_id"), F.min_by("ord", "page_id").alias("ord"))
    )
    # Fixed value: the name pattern of extracted assets.
    name = F.format_string("page%03d_img%02d", "page_no", "ord")
    return with_page_no(seen, page_table, numbers).select(
        "host", "asset", "page_no", "ord", name.alias("name")
    )


def _tables(text: Column, delimiter: str) -> Column:
    """``array<struct<first, cells>>``: every run of delimited lines, split into cells."""
    cut = re.sub(r"([^\w\s])", r"\\\1", delimiter)

    def edges(marks: Column, step: int) -> Column:
        at = F.transform(
            marks,
            lambda m, i: F.when(m & ~F.coalesce(F.get(marks, i + step), F.lit(False)), i + 1),
        )
        return F.filter(at, lambda i: i.isNotNull())

    return let(
        lines(text),
        lambda all_lines: let(
            F.transform(all_lines, lambda line: F.contains(line, F.lit(delimiter))),
            lambda marks: F.zip_with(
                edges(marks, -1),
                edges(marks, 1),
                lambda s, e: F.struct(
                    s.alias("first"),
                    F.transform(
                        F.slice(all_lines, s, e - s + 1), lambda line: F.split(line, cut)
                    ).alias("cells"),
                ),
            ),
        ),
    )


def _table_runs(docs: DataFrame, delimiter: str) -> DataFrame:
    widths = F.transform("_table.cells", F.size)
    return (
        docs.filter(F.contains("text", F.lit(delimiter)))
        .select("doc_id", F.posexplode(_tables(F.col("text"), delimiter)).alias("_at", "_table"))
        .select(
            "doc_id",
            (F.col("_at") + 1).alias("table_num"),
            F.col("_table.first").alias("first_line"),
            F.array_max(widths).alias("cols"),
            F.col("_table.cells").alias("cells"),
        )
    )


def detect_tables(
    docs: DataFrame, delimiter: str = " | ", lines_per_page: int = LINES_PER_PAGE
) -> DataFrame:
    """Tables of each document, numbered, with page, first line, rows and widest row."""
    page = (F.floor((F.col("first_line") - 1) / F.lit(lines_per_page)) + 1).cast("int")
    return _table_runs(docs, delimiter).select(
        "doc_id",
        "table_num",
        page.alias("page_no"),
        "first_line",
        F.size("cells").alias("rows"),
        "cols",
    )


def table_rows(
    docs: DataFrame, delimiter: str = " | ", lines_per_page: int = LINES_PER_PAGE
) -> DataFrame:
    """One row per table line, short ones padded: ``doc_id, table_num, page_no, row, cells``."""
    page = (F.floor((F.col("first_line") - 1) / F.lit(lines_per_page)) + 1).cast("int")
    runs = _table_runs(docs, delimiter)
    row = F.posexplode("cells").alias("_row", "_cells")
    missing = F.array_repeat(F.lit(""), F.col("cols") - F.size("_cells"))
    return runs.select("doc_id", "table_num", page.alias("page_no"), "cols", row).select(
        "doc_id",
        "table_num",
        "page_no",
        (F.col("_row") + 1).alias("row"),
        F.concat("_cells", missing).alias("cells"),
    )


def table_cells(docs: DataFrame, delimiter: str = " | ") -> DataFrame:
    """Long form: ``doc_id, table_num, row, col, value``; missing cells are empty text."""
    return (
        table_rows(docs, delimiter)
        .select("doc_id", "table_num", "row", F.posexplode("cells").alias("_col", "value"))
        .select("doc_id", "table_num", "row", (F.col("_col") + 1).alias("col"), "value")
    )
