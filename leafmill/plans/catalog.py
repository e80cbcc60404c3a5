"""The registered queries: every operator on the whole given tables, with fixed parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import convert, extract, hygiene, lock, merge, personal, profile, quality, redact, select
from leafmill.session import fresh_path
from leafmill.sinks import files as sinks
from leafmill.sources import tables
from leafmill.sources.files import table_files

Query = Callable[[SparkSession, str], DataFrame]

#: What is put before the pages, by ``page_id``, for the queries whose name ends in ``_planted``: the
#: given pages hold no refresh, handler, frame or form.
PLANTED = (
    "",
    '<meta http-equiv="refresh" content="0;url=/x">',
    '<p onclick="go()">x</p>',
    '<iframe src="/f"></iframe>',
    '<form action="/g"></form>',
    '<body onload="x()">',
    '<object data="/o"></object><embed>',
    '<a href="javascript:y()">z</a><meta http-equiv="refresh" content="9">',
)

TERMS = "the, there, from, "
BREAK_LENGTH = 20
BLANK_SHARE = 0.25
LINKS = ("internal", "external")
TABLES = ("documents", "pages", "embeddings", "conversations", "labels", "events", "orders", "lineitem")


def _specs(docs: DataFrame) -> DataFrame:
    """A range expression for every document."""
    kind = F.col("doc_id") % 6
    return docs.select(
        "doc_id",
        F.when(kind == 0, "")
        .when(kind == 1, "1")
        .when(kind == 2, "1-2,2")
        .when(kind == 3, "2-3")
        .when(kind == 4, "1 - 2")
        .otherwise("all")
        .alias("spec"),
    )


def _manifest(docs: DataFrame) -> DataFrame:
    """Every source becomes one output, its documents in order."""
    keys = docs.select(F.col("source").alias("out_id"), "doc_id")
    return merge.number_within(keys, "out_id", "doc_id", "seq").select("out_id", "seq", "doc_id")


def _keys(spark: SparkSession, seeds: list[str]) -> DataFrame:
    """Key table for the demonstration; real keys come from a protected table."""
    names = ["key", "owner_key"][: len(seeds)]
    row = spark.createDataFrame([tuple(seeds)], ", ".join(f"{n} string" for n in names))
    return row.select(*[F.unhex(F.sha2(n, 256)).alias(n) for n in names])


def _on_docs(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(tables.documents(spark, folder))


def _on_doc_pages(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(tables.doc_pages(spark, folder))


def _on_pages(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(tables.pages(spark, folder))


def _on_planted(operator: Callable[[DataFrame], DataFrame]) -> Query:
    """``operator`` on all pages, each with active content of some kind before its own."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        before = F.element_at(F.array(*map(F.lit, PLANTED)), (F.col("page_id") % len(PLANTED) + 1).cast("int"))
        return operator(tables.pages(spark, folder).withColumn("html", F.concat(before, "html")))

    return run


def _with_specs(operator: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        docs = tables.documents(spark, folder)
        return operator(tables.paginate(docs), _specs(docs), tables.page_totals_of(docs))

    return run


def _parse_page_ranges(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.documents(spark, folder)
    return select.parse_page_ranges(_specs(docs), tables.page_totals_of(docs))


def _merge_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.documents(spark, folder)
    return merge.merge_documents(tables.paginate(docs), _manifest(docs), tables.page_totals_of(docs))


def _protect_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Locked and opened again, and what the locked value was like."""
    keys = _keys(spark, ["a user key"])
    docs = tables.documents(spark, folder).select("doc_id", "text", F.col("text").cast("binary").alias("plain"))
    locked = lock.protect_columns(docs, ["text"], keys).select(
        "*", F.octet_length("text").alias("locked_bytes"), (F.col("text") != F.col("plain")).alias("hidden")
    )
    opened = lock.unprotect_columns(locked, ["text"], keys)
    return opened.select("doc_id", F.col("text").cast("string").alias("text"), "locked_bytes", "hidden")


def _unprotect_columns(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.documents(spark, folder).select("doc_id", F.col("text").cast("binary").alias("text"))
    right, other = _keys(spark, ["a user key"]), _keys(spark, ["another key"])
    kind = F.col("doc_id") % 3
    keep = docs.filter(kind == 2).withColumn("locked", F.lit(False))
    mixed = (
        lock.protect_columns(docs.filter(kind == 0), ["text"], right)
        .unionByName(lock.protect_columns(docs.filter(kind == 1), ["text"], other))
        .unionByName(keep)
    )
    opened = lock.unprotect_columns(mixed, ["text"], right)
    readable = F.when(~F.col("locked"), F.col("text").cast("string"))
    return opened.select("doc_id", "status", readable.alias("text"))


def _lock_report(spark: SparkSession, folder: str) -> DataFrame:
    return lock.lock_report(_unprotect_columns(spark, folder))


def _size_totals(spark: SparkSession, folder: str) -> DataFrame:
    return quality.size_totals(_size_report(spark, folder))


def _merge_report(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of the merge, where some outputs also name a document that is not there."""
    docs = tables.documents(spark, folder)
    absent = docs.filter("doc_id % 97 = 0").select(
        F.col("source").alias("out_id"), F.lit(0).alias("seq"), (-1 - F.col("doc_id")).alias("doc_id")
    )
    return merge.merge_report(tables.paginate(docs), _manifest(docs).unionByName(absent))


def _assemble_in_parts(spark: SparkSession, folder: str) -> DataFrame:
    return convert.assemble_document(convert.page_texts(tables.pages(spark, folder)), pages_per_part=3)


def _file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Files and rows of the given tables, from what comes with their rows."""
    found = None
    for name in TABLES:
        own = table_files(spark.read.parquet(f"{folder}/{name}.parquet"), [".parquet"])
        own = own.groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows")).select(F.lit(name).alias("name"), "*")
        found = own if found is None else found.unionByName(own)
    return found


def _compact_clustered(spark: SparkSession, folder: str) -> DataFrame:
    """What is read back of every level, with rows placed by source and size at once."""
    found = None
    for level in sinks.LEVELS:
        out = fresh_path(spark, f"clustered-{level}")
        sinks.compact_dataset(spark, f"{folder}/documents.parquet", out, level, ["source", "n_chars"])
        own = spark.read.parquet(out).groupBy("source", "lang").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.sum("doc_id").alias("ids")
        ).select(F.lit(level).alias("level"), "*")
        found = own if found is None else found.unionByName(own)
    return found


def _size_report(spark: SparkSession, folder: str) -> DataFrame:
    pages = tables.pages(spark, folder)
    return quality.size_report(pages, hygiene.strip_active_content(pages), "page_id", "html")


def _write_derived(spark: SparkSession, folder: str) -> DataFrame:
    out = fresh_path(spark, "redacted")
    pages = redact.redact_apply(tables.doc_pages(spark, folder), TERMS)
    sinks.write_derived(pages, f"{folder}/documents.parquet", out)
    return spark.read.parquet(out)


def _export_tables_csv(spark: SparkSession, folder: str) -> DataFrame:
    out = fresh_path(spark, "tables")
    sinks.export_tables_csv(extract.table_rows(tables.documents(spark, folder)), out)
    return spark.read.text(out)


def _export_links_txt(spark: SparkSession, folder: str) -> DataFrame:
    out = fresh_path(spark, "links")
    sinks.export_links_txt(extract.extract_links(tables.pages(spark, folder), LINKS), out)
    return spark.read.text(out)


def _compact_dataset(spark: SparkSession, folder: str) -> DataFrame:
    reports = [
        sinks.compact_dataset(
            spark, f"{folder}/documents.parquet", fresh_path(spark, f"compact-{level}"), level
        )
        for level in sinks.LEVELS
    ]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


QUERIES: dict[str, Query] = {
    # scans, sources, sinks
    "file_inventory": _file_inventory,
    "paginate": _on_docs(tables.paginate),
    "write_derived": _write_derived,
    "export_tables_csv": _export_tables_csv,
    "export_links_txt": _export_links_txt,
    "compact_dataset": _compact_dataset,
    "compact_clustered": _compact_clustered,
    # profiles and conversion
    "doc_profile": _on_docs(profile.doc_profile),
    "page_profile": _on_pages(profile.page_profile),
    "corpus_profile": _on_docs(profile.corpus_profile),
    "resource_catalog": _on_pages(profile.resource_catalog),
    "html_to_text": _on_pages(convert.html_to_text),
    "html_to_markdown": _on_pages(convert.html_to_markdown),
    "assemble_document": _on_pages(lambda p: convert.assemble_document(convert.page_texts(p))),
    "assemble_in_parts": _assemble_in_parts,
    "empty_page_report": _on_pages(convert.empty_page_report),
    # page selection
    "parse_page_ranges": _parse_page_ranges,
    "split_by_ranges": _with_specs(select.split_by_ranges),
    "extract_pages": _with_specs(select.extract_pages),
    "delete_pages": _with_specs(select.delete_pages),
    "merge_documents": _merge_documents,
    "merge_report": _merge_report,
    "split_on_breaks": _on_docs(
        lambda d: merge.split_on_breaks(d, lambda line: F.length(line) < BREAK_LENGTH)
    ),
    # extraction
    "extract_links": _on_pages(lambda p: extract.extract_links(p, LINKS)),
    "link_totals": _on_pages(lambda p: extract.link_totals(extract.page_links(p, LINKS))),
    "extract_assets": _on_pages(lambda p: extract.extract_assets(p, "a", "href")),
    "detect_tables": _on_docs(extract.detect_tables),
    "table_cells": _on_docs(extract.table_cells),
    # privacy and hygiene
    "scan_metadata": _on_pages(hygiene.scan_metadata),
    "strip_metadata": _on_pages(hygiene.strip_metadata),
    "redact_find": _on_doc_pages(lambda p: redact.redact_find(p, TERMS)),
    "redact_page_counts": _on_doc_pages(lambda p: redact.redact_page_counts(p, TERMS)),
    "redact_apply": _on_doc_pages(lambda p: redact.redact_apply(p, TERMS)),
    "scan_active_content": _on_pages(hygiene.scan_active_content),
    "active_content_summary": _on_pages(
        lambda p: hygiene.active_content_summary(hygiene.page_findings(p))
    ),
    "strip_active_content": _on_pages(hygiene.strip_active_content),
    "scan_active_planted": _on_planted(hygiene.scan_active_content),
    "active_summary_planted": _on_planted(
        lambda p: hygiene.active_content_summary(hygiene.page_findings(p))
    ),
    "strip_active_planted": _on_planted(hygiene.strip_active_content),
    "protect_columns": _protect_columns,
    "unprotect_columns": _unprotect_columns,
    "lock_report": _lock_report,
    "pii_scan": _on_docs(personal.pii_scan),
    # quality and repair
    "structure_check": _on_pages(quality.structure_check),
    "structure_summary": _on_pages(lambda p: quality.structure_summary(quality.structure_check(p))),
    "blank_page_check": _on_doc_pages(lambda p: quality.blank_page_check(p, BLANK_SHARE)),
    "repair_pages": _on_pages(quality.repair_pages),
    "size_report": _size_report,
    "size_totals": _size_totals,
}
