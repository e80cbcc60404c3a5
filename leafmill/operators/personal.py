"""Counting strings that look like personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each kind looks like. Card numbers get no checksum test.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    # a run of characters is tried once, from its beginning or from where the last match ended
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}",
    "ipv4": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b",
    "card": r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b",
    "phone": r"\+[0-9][0-9 ().-]{8,}[0-9]",
}
#: A character without which a kind cannot occur; most texts need no closer look.
NEEDED = {"email": "@", "phone": "+"}


def _counted(text: Column, kind: str) -> Column:
    found = F.regexp_count(text, F.lit(PATTERNS[kind]))
    needed = NEEDED.get(kind)
    has = F.contains(text, F.lit(needed)) if needed else text.rlike("[0-9]")
    return F.when(has, found).otherwise(F.lit(0))


def pii_counts(docs: DataFrame) -> DataFrame:
    """Matches per document and kind: ``doc_id, source, kind, n``; kinds without a match are left out.

    Narrow: a text is looked at inside its row; null texts have no matches.
    """
    counts = F.array(
        *[F.struct(F.lit(k).alias("kind"), _counted(F.col("text"), k).cast("long").alias("n")) for k in PATTERNS]
    )
    return docs.select("doc_id", "source", F.inline(F.filter(counts, lambda c: c["n"] > 0)))


def pii_scan(docs: DataFrame) -> DataFrame:
    """Documents with a match and number of matches, by source and kind; only counts are shuffled,
    and they are added up before."""
    return pii_counts(docs).groupBy("source", "kind").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("matches")
    )
