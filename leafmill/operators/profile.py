"""Profiles of documents, web pages and whole corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import html as h
from leafmill.functions.text import is_blank, kilobytes, line_count, word_count
from leafmill.plans.scale import spread_join
from leafmill.sources.tables import with_host


def _size(text: str):
    return F.octet_length(F.coalesce(F.col(text), F.lit("")))


def doc_profile(docs: DataFrame) -> DataFrame:
    """Words, paragraphs and size of each document."""
    return docs.select(
        "doc_id",
        F.coalesce(word_count(F.col("text")), F.lit(0)).alias("words"),
        line_count(F.col("text")).alias("paragraphs"),
        _size("text").alias("bytes"),
    ).withColumn("size_kb", kilobytes(F.col("bytes")))


def corpus_profile(docs: DataFrame) -> DataFrame:
    """Totals by language and source with subtotals; ``gid`` tells the level.

    Documents are counted once per (lang, source); the subtotals are made from those few rows.
    """
    per_doc = docs.select(
        "lang",
        "source",
        F.coalesce(word_count(F.col("text")), F.lit(0)).alias("words"),
        line_count(F.col("text")).alias("paragraphs"),
        _size("text").alias("bytes"),
        is_blank(F.col("text")).cast("int").alias("blank"),
    )
    leaves = per_doc.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("words").alias("words"),
        F.sum("paragraphs").alias("paragraphs"),
        F.sum("bytes").alias("bytes"),
        F.sum("blank").alias("blank_docs"),
    )
    return leaves.rollup("lang", "source").agg(
        F.grouping_id().cast("int").alias("gid"),
        *[F.sum(c).alias(c) for c in ("docs", "words", "paragraphs", "bytes", "blank_docs")],
    )


def page_profile(page_table: DataFrame) -> DataFrame:
    """Active parts, images, elements, title and size of each web page."""
    pieces = F.col("_pieces")
    return page_table.select("page_id", "html", h.markup(F.col("html")).alias("_pieces")).select(
        "page_id",
        h.title(pieces).alias("title"),
        (F.size(h.tags(pieces, "script")) > 0).alias("has_javascript"),
        F.size(h.tags(pieces, "iframe", "object", "embed")).alias("n_attachments"),
        F.size(h.tags(pieces, "img")).alias("n_images"),
        F.size(h.element_names(pieces)).alias("n_resources"),
        F.octet_length("html").alias("bytes"),
    )


def resource_catalog(page_table: DataFrame) -> DataFrame:
    """Distinct element names of each site, one row per name, with their number per site.

    The names of a site are never gathered into one list, so a site with any number of them is
    only rows. Names are made distinct per page before the shuffle, and one shuffle of them
    serves the totals as well: the totals read ``n_pages`` to need the same columns.
    """
    used = with_host(page_table).select(
        "host", F.explode(h.element_names(h.markup(F.col("html")))).alias("resource")
    )
    names = used.groupBy("host", "resource").agg(F.count(F.lit(1)).alias("n_pages"))
    totals = names.groupBy("host").agg(F.count_if(F.col("n_pages") > 0).alias("n_resources"))
    return spread_join(names, totals, ["host"], ["resource"], rows="n_resources").select(
        "host", "resource", "n_pages", "n_resources"
    )
