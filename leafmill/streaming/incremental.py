"""Incremental runs: every new file of a folder goes through an operator once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def run_incrementally(
    spark: SparkSession,
    folder: str,
    schema: StructType | str,
    operator: Callable[[DataFrame], DataFrame],
    out: str,
    progress: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Append ``operator`` of the Parquet files not seen before to ``out``, then stop.

    For operators without shuffle (profiles, conversion, pagination, redaction, stripping,
    checks): they hold no state, so a stream of files gives the rows a batch over all files gives.
    ``progress`` remembers what was done; it belongs on shared storage, like ``out``.
    """
    arriving = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )
    return (
        operator(arriving)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
