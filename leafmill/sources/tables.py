"""Documents, pages and the page tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import line_count, pages_of
from leafmill.functions.urls import host_of
from leafmill.plans.scale import running_totals

LINES_PER_PAGE = 5


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, text, lang, source, n_chars``."""
    return spark.read.parquet(f"{folder}/documents.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, html``."""
    return spark.read.parquet(f"{folder}/pages.parquet")


def paginate(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Ordered pages of each document, numbered from 1: ``doc_id, page_no, text``.

    Narrow: a document is cut inside its row.
    """
    if lines_per_page < 1:
        raise ValueError("a page holds at least one line")
    return docs.select(
        "doc_id", F.posexplode(pages_of(F.col("text"), lines_per_page)).alias("_at", "text")
    ).select("doc_id", (F.col("_at") + 1).alias("page_no"), "text")


def page_totals_of(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """``doc_id, total`` of the pages ``paginate`` makes, without making them."""
    pages_made = F.ceil(line_count(F.col("text")) / F.lit(lines_per_page)).cast("int")
    return docs.select("doc_id", pages_made.alias("total"))


def doc_pages(spark: SparkSession, folder: str, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    return paginate(documents(spark, folder), lines_per_page)


def with_host(page_table: DataFrame) -> DataFrame:
    """Web pages with the site they belong to; a site is treated as one document."""
    return page_table.withColumn("host", host_of(F.col("url")))


def page_numbers(page_table: DataFrame) -> DataFrame:
    """``page_id, host, page_no``: the rank of every page within its site.

    Only the identifiers are moved, and a site of any size is spread over many tasks.
    """
    keys = with_host(page_table).select("host", "page_id")
    return running_totals(keys, "host", ["page_id"]).select(
        "page_id", "host", F.col("_position").cast("int").alias("page_no")
    )


def with_page_no(
    rows: DataFrame, page_table: DataFrame, numbers: DataFrame | None = None
) -> DataFrame:
    """``rows`` with the ``page_no`` of their ``page_id``.

    ``numbers`` is the result of ``page_numbers`` where it is at hand; several operators over the
    same pages then rank them once.
    """
    if numbers is None:
        numbers = page_numbers(page_table)
    return rows.join(numbers.select("page_id", "page_no"), "page_id")


def site_pages(page_table: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """``host, page_no, page_id, html``."""
    rows = with_host(page_table).select("host", "page_id", "html")
    return with_page_no(rows, page_table, numbers).select(
        "host", "page_no", "page_id", "html"
    )
