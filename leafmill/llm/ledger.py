"""Exact duplicates by a stream with keyed state on disk, every hit checked on its full bytes.

A structured stream over the files of a table keeps one state row per SHA-256 digest of a text: how
many rows had it, and the row that stays, with its identifier and a content locator (file and row
number in it). The state lives in RocksDB, its versions in the shared folder; there is no watermark,
so nothing ever expires, and a stream started again on the same ledger goes on with the files that
came since. Equal digests are counted before the shuffle, so that a group of any size is one state
row per task.

``decisions`` reads the state back and checks hits on content: the text of the row that stays is
fetched by its locator and compared byte by byte with every other text of its digest. Groups with
more than ``HEAVY_ROWS`` rows are cut into ``SLICES`` slices, each with its own copy of the text that
stays. Texts that differ under one digest become groups of their own, by their full bytes.

Everything on this path is DataFrame or SQL functions.

Defined results: null is the empty text, and empty texts are equal; of equal texts the row with the
largest doc_id stays, a null doc_id being smaller than any, and of repeated rows of that doc_id the one
with the largest locator; every row of the table gives one row; texts of any length are read whole;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.batches import written
from leafmill.session import fresh_path

#: Groups with more rows than this are compared in slices; the bound on how many there are of them
#: at most is that of ``HEAVY_GROUPS``, which bounds the broadcast of their digests and locators.
HEAVY_ROWS = 2048
HEAVY_GROUPS = 1000
SLICES = 64

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # or every partition's store takes 4 MB of disk in advance, whatever it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(rows: DataFrame) -> DataFrame:
    """``doc_id, text, file, at`` of rows read from Parquet files, batch or stream."""
    place = rows.metadataColumn("_metadata")
    return rows.select(
        rows["doc_id"],
        F.coalesce(rows["text"], F.lit("")).alias("text"),
        place["file_path"].alias("file"),
        place["row_index"].alias("at"),
    )


def arriving(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the Parquet files at ``path``, a folder or a single file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a pattern that only this name matches, as a stream takes no path of a single file
    return reader.parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]")


class Ledger:
    """Digests seen so far, kept as the state of a stream in ``folder`` (shared by all executors)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.digest = spark, digest
        self.folder = folder or fresh_path(spark, "ledger")

    def absorb(self, rows: DataFrame) -> None:
        """Takes in what is new in the stream ``rows`` (``located``), and ends."""
        groups = rows.select(self.digest(F.col("text")).alias("digest"), "doc_id", "file", "at").groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "at")).alias("stays")
        )
        before = {key: self.spark.conf.get(key, None) for key in STATE}
        for key, value in STATE.items():
            self.spark.conf.set(key, value)
        try:
            stream = (
                groups.writeStream.outputMode("update")
                .format("noop")
                .option("checkpointLocation", self.folder)
                .trigger(availableNow=True)
                .start()
            )
            stream.awaitTermination()
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)

    def groups(self) -> DataFrame:
        """``digest, n, stays`` of every digest in the state; ``stays`` is ``doc_id, file, at``."""
        return self.spark.read.format("statestore").load(self.folder).select(
            "key.digest", F.col("value.count").alias("n"), F.col("value.max").alias("stays")
        )

    def decisions(self, rows: DataFrame) -> DataFrame:
        """``doc_id, keep_id, group_size, kept, digest`` of ``rows`` (``located``) that were absorbed."""
        known = written(self.groups(), "groups")
        own = F.struct("doc_id", "file", "at")
        heavy = known.filter(F.col("n") > HEAVY_ROWS).orderBy(F.desc("n")).limit(HEAVY_GROUPS)
        heavy = F.broadcast(heavy.select("digest", F.col("stays").alias("first")))
        every = F.sequence(F.lit(0), F.lit(SLICES - 1))

        marked = rows.withColumn("digest", self.digest(F.col("text"))).join(heavy, "digest", "left")
        is_heavy = F.col("first").isNotNull()
        slice_no = F.when(is_heavy, F.pmod(F.xxhash64("file", "at"), F.lit(SLICES)).cast("int")).otherwise(0)
        # the row that stays goes to every slice, and counts in its own
        spread = F.when(F.col("first") == own, every).otherwise(F.array("home"))
        dealt = marked.withColumn("home", slice_no).withColumn("slice", F.explode(spread)).drop("first")
        slices = F.when(is_heavy, every).otherwise(F.array(F.lit(0)))
        repeated = known.join(heavy, "digest", "left").withColumn("slice", F.explode(slices)).drop("first")

        met = dealt.join(repeated.hint("merge"), ["digest", "slice"])
        stays_first = Window.partitionBy("digest", "slice").orderBy(F.desc("leads")).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        compared = met.withColumn("leads", F.col("stays") == own).withColumn(
            "same", (F.col("n") == 1) | (F.col("text") == F.first("text").over(stays_first))
        )
        judged = written(
            compared.filter("home = slice").select(
                "doc_id", "file", "at", "digest", "n", "stays", "same", F.when(~F.col("same"), F.col("text")).alias("text")
            ),
            "judged",
        )
        result = judged.filter("same")
        if not judged.filter("NOT same").isEmpty():  # different texts under one digest
            result = self._parted(judged)
        return result.select(
            "doc_id",
            F.col("stays.doc_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("stays") == own).alias("kept"),
            "digest",
        )

    @staticmethod
    def _parted(judged: DataFrame) -> DataFrame:
        """``judged`` with the rows whose text differs from the one that stays in groups by full text."""
        apart = judged.filter("NOT same")
        gone = apart.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
        by_text = apart.groupBy("digest", "text").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "at")).alias("stays")
        )
        same = judged.filter("same").join(gone, "digest", "left").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0)))
        return same.drop("gone").unionByName(apart.drop("n", "stays").join(by_text, ["digest", "text"]))


def exact_duplicates(spark: SparkSession, path: str, ledger: Ledger | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of the table at ``path``."""
    ledger = ledger or Ledger(spark)
    ledger.absorb(located(arriving(spark, path)))
    found = ledger.decisions(located(spark.read.parquet(path)))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")
