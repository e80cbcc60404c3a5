"""Searching and destroying terms on document pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.masking import count_term, mask_terms, parse_terms
from leafmill.plans.scale import page_block


def redact_find(doc_pages: DataFrame, terms: str | list[str]) -> DataFrame:
    """Matches per page and term, case-insensitive; pages without a match are left out.

    Narrow: the terms are part of the expression, the text meets no join.
    """
    counts = F.array(
        *[
            F.struct(F.lit(t).alias("term"), count_term(F.col("text"), t).alias("n"))
            for t in parse_terms(terms)
        ]
    )
    return doc_pages.select(
        "doc_id", "page_no", F.inline(F.filter(counts, lambda c: c["n"] > 0))
    )


def redact_page_counts(doc_pages: DataFrame, terms: str | list[str]) -> DataFrame:
    """Matches per page over all terms, with the total of the document.

    Pages are placed once by document and block; their counts are added up per block, and the
    few block totals per document. No task holds all pages of a document, and the text is
    searched once: both uses read the same shuffle.
    """
    matches = sum((count_term(F.col("text"), t) for t in parse_terms(terms)), F.lit(0))
    found = F.filter(F.array(F.struct(matches.alias("matches"))), lambda c: c["matches"] > 0)
    hits = (
        doc_pages.select("doc_id", "page_no", F.inline(found))
        .repartition(F.col("doc_id"), page_block(F.col("page_no")))
        .withColumn("_block", page_block(F.col("page_no")))
    )
    blocks = hits.groupBy("doc_id", "_block").agg(F.sum("matches").alias("_in_block"))
    totals = blocks.select(
        "doc_id",
        "_block",
        F.sum("_in_block").over(Window.partitionBy("doc_id")).alias("doc_matches"),
    )
    return hits.join(totals, ["doc_id", "_block"]).select(
        "doc_id", "page_no", "matches", "doc_matches"
    )


def redact_apply(doc_pages: DataFrame, terms: str | list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages with every matched character destroyed; pages without a match are untouched.

    ``keep`` names further columns to carry along.
    """
    masked = mask_terms(F.col("text"), parse_terms(terms))
    return doc_pages.select("doc_id", "page_no", *keep, "text", masked.alias("_masked")).select(
        "doc_id", "page_no", *keep, F.coalesce(F.col("_masked") != F.col("text"), F.lit(False)).alias("redacted"),
        F.col("_masked").alias("text"),
    )
