"""Look, report, rewrite: the flows that end in a new version of a dataset.

Each flow looks first and writes nothing when there is nothing to do. It never asks; a caller who
wants to decide in between calls the operators one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.hygiene import (
    active_content_summary,
    page_findings,
    scan_metadata,
    strip_active_content,
    strip_metadata,
)
from leafmill.operators.quality import repair_pages, structure_check, structure_summary
from leafmill.operators.redact import redact_apply, redact_find, redact_page_counts
from leafmill.session import durable
from leafmill.sinks.files import write_derived


def _rewritten(table: DataFrame, used: tuple[str, ...], operator: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """``table`` with the columns that ``operator`` gives anew, and all others as they were.

    The others travel as one column, so that none can clash with what the operator adds.
    """
    rest = [c for c in table.columns if c not in used]
    if not rest:
        return operator(table.select(*used), ()).select(*table.columns)
    packed = table.select(*used, F.struct(*rest).alias("_rest"))
    found = operator(packed, ("_rest",))
    return found.select(*[F.col("_rest").getField(c).alias(c) if c in rest else F.col(c) for c in table.columns])


def sanitize_dataset(spark: SparkSession, src: str, out: str) -> DataFrame:
    """Write the pages of ``src`` without active content; returns the summary of what was found."""
    pages = spark.read.parquet(src)
    findings = durable(page_findings(pages))
    if not findings.isEmpty():
        write_derived(_rewritten(pages, ("page_id", "html"), strip_active_content), src, out)
    return active_content_summary(findings)


def clean_metadata_dataset(spark: SparkSession, src: str, out: str) -> DataFrame:
    """Write the pages of ``src`` without metadata; returns the fields that were found."""
    pages = spark.read.parquet(src)
    fields = scan_metadata(pages)
    if not fields.isEmpty():
        write_derived(_rewritten(pages, ("page_id", "html"), strip_metadata), src, out)
    return fields


def redact_dataset(spark: SparkSession, src: str, out: str, terms: str | list[str]) -> DataFrame:
    """Write the document pages of ``src`` redacted; returns the matches per page."""
    pages = spark.read.parquet(src)
    if not redact_find(pages, terms).isEmpty():
        clean = _rewritten(pages, ("doc_id", "page_no", "text"), lambda df, keep: redact_apply(df, terms, keep))
        write_derived(clean, src, out)
    return redact_page_counts(pages, terms)


def repair_dataset(spark: SparkSession, src: str, out: str) -> DataFrame:
    """Write the pages of ``src`` repaired; returns the pages per result code of the outcome."""
    pages = spark.read.parquet(src)
    checks = structure_check(pages)
    if checks.filter("code <> 0").isEmpty():
        return structure_summary(checks)
    write_derived(_rewritten(pages, ("page_id", "html"), repair_pages), src, out)
    return structure_summary(structure_check(spark.read.parquet(out)))
