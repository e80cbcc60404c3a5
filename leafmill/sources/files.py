"""Listing of files with their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import kilobytes

EXTENSION = r"(\.[^./]*)$"


def _sizes(extension: Column) -> list[Column]:
    return [
        extension.alias("ext"),
        F.col("length"),
        kilobytes(F.col("length")).alias("size_kb"),
        (kilobytes(F.col("length")) / 1024.0).alias("size_mb"),
        F.col("modificationTime").alias("modified"),
    ]


def table_files(table: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Files that the rows of a table read from files come from, as below, and ``rows`` of each.

    What is known of its file comes with every row; the rows are counted per file before the shuffle,
    and no data column is read.
    """
    place = table.metadataColumn("_metadata")
    files = table.select(
        place["file_path"].alias("path"), place["file_size"].alias("length"), place["file_modification_time"].alias("modificationTime")
    )
    counted = files.groupBy("path", "length", "modificationTime").agg(F.count(F.lit(1)).alias("rows"))
    extension = F.lower(F.regexp_extract("path", EXTENSION, 1))
    if extensions is not None:
        counted = counted.filter(extension.isin(*(e.lower() for e in extensions)))
    return counted.select("path", *_sizes(extension), "rows")


def file_inventory(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """Files below ``folder`` whose extension, in any case, is one of ``extensions``.

    Only the listing is read, never the content.
    """
    wanted = [e.lower() for e in extensions]
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select("path", "length", "modificationTime")
    )
    extension = F.lower(F.regexp_extract("path", EXTENSION, 1))
    return listing.filter(extension.isin(*wanted)).select("path", *_sizes(extension))
