"""From markup to text, and from pages to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import html as h
from leafmill.functions.text import is_blank
from leafmill.sources.tables import with_host, with_page_no

PAGES_PER_PART = 64


def html_to_text(page_table: DataFrame) -> DataFrame:
    return page_table.select("page_id", h.visible_text(F.col("html")).alias("text"))


def html_to_markdown(page_table: DataFrame) -> DataFrame:
    return page_table.select("page_id", h.markdown(F.col("html")).alias("markdown"))


def page_texts(page_table: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """``host, page_no, text`` of every page; text, not markup, goes through the join."""
    texts = with_host(page_table).select(
        "page_id", "host", h.visible_text(F.col("html")).alias("text")
    )
    return with_page_no(texts, page_table, numbers).select("host", "page_no", "text")


def assemble_document(texts: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """Page texts joined in page order with a blank line between.

    A document longer than ``pages_per_part`` pages comes as several numbered parts, so no row
    and no task ever holds a document without bound; the parts joined the same way are the
    whole document.
    """
    part = (F.floor((F.col("page_no") - 1) / F.lit(pages_per_part)) + 1).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return (
        texts.withColumn("part", part)
        .groupBy("host", "part")
        .agg(
            F.count(F.lit(1)).alias("n_pages"),
            F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"),
        )
    )


def empty_page_report(page_table: DataFrame) -> DataFrame:
    """Pages without any text per site: likely scans, whose text cannot be taken out."""
    return (
        with_host(page_table)
        .select("host", is_blank(h.visible_text(F.col("html"))).alias("_empty"))
        .groupBy("host")
        .agg(F.count_if("_empty").alias("empty_pages"), F.count(F.lit(1)).alias("total_pages"))
    )
