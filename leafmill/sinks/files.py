"""Derived tables, text and CSV exports, dataset compaction.

Exports hold the content of one file per document, in order. With ``layout="sorted"`` the
documents follow each other in sorted part files, which suits any number of documents and splits
a very large one over several files. ``layout="folders"`` makes one folder per document; it is
meant for a selection, as a file system bears only so many folders.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.text import kilobytes, saved_percent
from leafmill.session import durable

TARGET_FILE_BYTES = 256 * 1024 * 1024
#: Bits of every column in a clustering of several, and rows from which their bounds are taken.
CLUSTER_BITS, SAMPLE_ROWS = 6, 10_000
#: Slices that a clustered file consists of, at least.
SLICES_PER_FILE = 4

# Codec and level behind each compaction level.
LEVELS = {
    "low": ("snappy", None),
    "medium": ("zstd", 3),
    "high": ("zstd", 9),
}


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def full_path(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme and store, without ``.``, ``..``, links or mounts as far as it exists."""
    fs, at = _file_system(spark, path)
    at = fs.makeQualified(at)
    rest: list[str] = []
    while at.getParent() is not None and not fs.exists(at):
        rest.append(at.getName())
        at = at.getParent()
    at = fs.resolvePath(at) if fs.exists(at) else at
    found = at.toString()
    if at.toUri().getScheme() == "file":  # links of the local file system are not seen above
        found = "file:" + os.path.realpath(at.toUri().getPath())
    return "/".join([found.rstrip("/"), *reversed(rest)])


def refuse_in_place(spark: SparkSession, src: str, out: str) -> None:
    """Refuses an output that is the input, lies in it or holds it, however either is written."""
    a, b = full_path(spark, src), full_path(spark, out)
    if a == b or a.startswith(b + "/") or b.startswith(a + "/"):
        raise ValueError("the output must not be the input or overlap it")


def replace_with(spark: SparkSession, out: str, write: Callable[[str], None]) -> None:
    """Lets ``write`` fill a folder beside ``out`` and puts it there when that is done.

    What was at ``out`` before goes only then; if writing fails, it stays as it was.
    """
    fs, at = _file_system(spark, out)
    at = fs.makeQualified(at)
    mark = uuid.uuid4().hex
    path = spark._jvm.org.apache.hadoop.fs.Path
    staged, old = (path(at.getParent(), f".{at.getName()}.{kind}-{mark}") for kind in ("staged", "old"))
    try:
        write(staged.toString())
        if fs.exists(at) and not fs.rename(at, old):
            raise OSError(f"{out} cannot be replaced")
        if not fs.rename(staged, at):
            fs.rename(old, at)
            raise OSError(f"{out} cannot be written")
    finally:
        fs.delete(staged, True)
    fs.delete(old, True)


def write_derived(df: DataFrame, src: str, out: str) -> None:
    """Write a new version of ``src`` beside it; an older one goes when the new one is complete."""
    spark = df.sparkSession
    refuse_in_place(spark, src, out)
    replace_with(spark, out, lambda staged: df.write.parquet(staged))


def _csv_field(value: Column) -> Column:
    quoted = F.concat(
        F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"')
    )
    return F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)


def csv_line(cells: Column) -> Column:
    """One CSV line from an array of any length; quotes only where needed."""
    return F.array_join(F.transform(cells, lambda c: _csv_field(F.coalesce(c, F.lit("")))), ",")


def _write_lines(df: DataFrame, out: str, layout: str, folders: list[str], order: list[str]) -> None:
    if layout == "sorted":
        df.orderBy(*order).select("value").write.mode("overwrite").text(out)
    elif layout == "folders":
        (
            df.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .select(*folders, "value")
            .write.partitionBy(*folders)
            .mode("overwrite")
            .text(out)
        )
    else:
        raise ValueError("layout is 'sorted' or 'folders'")


def export_tables_csv(rows: DataFrame, out: str, layout: str = "sorted") -> None:
    """CSV of every table from ``table_rows``.

    ``folders`` gives ``doc_id=../name=table_NN_page_NN.csv``; ``sorted`` puts document, table,
    page and row in front of the cells, as the lines of all tables then share files.
    """
    # Fixed value: the name pattern of exported tables.
    name = F.format_string("table_%02d_page_%02d.csv", "table_num", "page_no")
    place = ["doc_id", "table_num", "page_no", "row"]
    line = csv_line(F.col("cells"))
    if layout == "sorted":
        line = F.concat_ws(",", *[F.col(c).cast("string") for c in place], line)
    _write_lines(
        rows.select(*place, name.alias("name"), line.alias("value")),
        out, layout, ["doc_id", "name"], ["doc_id", "table_num", "row"],
    )


def link_report_lines(links: DataFrame) -> DataFrame:
    """Lines of the text report of each site: ``host, page_no, ord, value``.

    The head comes from a pre-aggregated count and is put in front by its page number 0; no
    window and no join is needed.
    """
    # The wording of the report.
    head = F.array(
        F.concat(F.lit("Source Document : "), F.col("host")),
        F.concat(F.lit("Total URLs Found: "), F.col("n").cast("string")),
        F.lit("=" * 50),
        F.lit(""),
    )
    totals = links.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    heads = totals.select("host", F.lit(0).alias("page_no"), F.posexplode(head).alias("ord", "value"))
    page = F.col("page_no").cast("string")
    entry = F.concat(
        F.lit("Page "), F.rpad(page, F.greatest(F.length(page), F.lit(4)), F.lit(" ")), F.lit(" : "), F.col("uri")
    )
    return heads.unionByName(links.select("host", "page_no", "ord", entry.alias("value")))


def export_links_txt(links: DataFrame, out: str, layout: str = "sorted") -> None:
    """Text report of the links of every site; links are found once, for heads, lines and their order."""
    found = durable(links.select("host", "page_no", "ord", "uri"))
    _write_lines(link_report_lines(found), out, layout, ["host"], ["host", "page_no", "ord"])


def dataset_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row with the summed file size below ``path``, from the listing alone."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .filter(~F.element_at(F.split("path", "/"), -1).rlike("^[._]"))
        .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    )


def _rank_bits(df: DataFrame, columns: list[str]) -> dict[str, list]:
    """Bounds that cut the values of every column into ``1 << CLUSTER_BITS`` parts of like size.

    They come from a sample of a fixed number of rows; the placing is the better the truer they are,
    and the rows are the same with any.
    """
    parts = 1 << CLUSTER_BITS
    sampled = df.select(*columns).sample(min(1.0, SAMPLE_ROWS / max(1, df.count())), seed=1).limit(2 * SAMPLE_ROWS)
    held = sampled.agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        values = held[c]
        out[c] = sorted({values[k * len(values) // parts] for k in range(1, parts)}) if values else []
    return out


def interleaved(df: DataFrame, columns: list[str]) -> Column:
    """Place of a row on a curve that keeps rows close in all ``columns`` together: the bits of its
    rank in each column, taken in turn."""
    def rank(column: str, bounds: list) -> Column:
        """How many bounds a value has reached; a missing value, none."""
        kind = f"array<{df.schema[column].dataType.simpleString()}>"
        reached = F.filter(F.array(*map(F.lit, bounds)).cast(kind), lambda b: b <= F.col(column))
        return F.coalesce(F.size(reached), F.lit(0))

    ranks = [rank(c, bounds) for c, bounds in _rank_bits(df, columns).items()]
    place = F.lit(0).cast("long")
    for bit in range(CLUSTER_BITS - 1, -1, -1):
        for rank in ranks:
            place = F.shiftleft(place, 1).bitwiseOR(F.shiftright(rank, bit).bitwiseAND(1))
    return place


def _row_bytes(df: DataFrame) -> Column:
    """About how large a row is: the bytes of its strings, and of other values as text if they are nested."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        column, kind = F.col("`" + field.name.replace("`", "``") + "`"), field.dataType.typeName()
        if kind in ("array", "map", "struct"):
            column = F.to_json(F.struct(column))
        elif kind not in ("string", "binary", "char", "varchar"):
            size = size + 8
            continue
        size = size + F.coalesce(F.octet_length(column), F.lit(0))
    return size


def clustered(df: DataFrame, columns: list[str], files: int) -> DataFrame:
    """Rows by their place on the curve (``interleaved``), in ``files`` partitions of like size in bytes.

    Neither a place with many rows nor one with long rows makes a large partition: a place is cut into
    slices of a ``SLICES_PER_FILE``-th of a partition, and the slices follow each other until a
    partition is full.
    """
    bits = CLUSTER_BITS * len(columns)
    at = df.metadataColumn("_metadata")  # where a row stands, which no two rows share
    spread = F.xxhash64(at["file_path"], at["row_index"])
    placed = df.select("*", interleaved(df, columns).alias("_place"), spread.alias("_spread"), _row_bytes(df).alias("_bytes"))
    # the first bits alone, so that there are 4,096 sums at most for any number of columns
    coarse = F.shiftright("_place", max(0, bits - 2 * CLUSTER_BITS))
    sums = placed.groupBy(coarse.alias("_coarse")).agg(F.sum("_bytes").alias("_bytes"))
    earlier = Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(1.0), F.sum("_bytes").over(Window.partitionBy()) / files)  # bytes of a partition
    cuts = sums.select(
        "_coarse",
        (F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)) / part).alias("_start"),
        (F.col("_bytes") / part).alias("_share"),
        F.greatest(F.lit(1), F.ceil(F.col("_bytes") / part * SLICES_PER_FILE)).alias("_slices"),
    )
    slice_no = F.pmod("_spread", F.col("_slices"))
    file_no = F.least(F.lit(files - 1), F.floor(F.col("_start") + F.col("_share") * slice_no / F.col("_slices"))).cast("int")
    dealt = placed.drop("_bytes").withColumn("_coarse", coarse).join(F.broadcast(cuts), "_coarse").withColumn("_file", file_no)
    order = columns if len(columns) == 1 else ["_place"]
    sorted_ = dealt.repartitionById(files, "_file").sortWithinPartitions(*order)
    return sorted_.drop("_place", "_spread", "_coarse", "_start", "_share", "_slices", "_file")


def compact_dataset(
    spark: SparkSession, path: str, out: str, level: str = "medium", cluster_by: list[str] | None = None
) -> DataFrame:
    """Rewrite a Parquet dataset without loss and report the sizes.

    The number of files follows from the size before; rows are dealt to them by a shuffle, so that
    as many tasks read as the input has splits. With ``cluster_by`` rows close in those columns, in
    several at once by a curve through them, come into the same files and row groups, which a
    filter on any of them then skips by their statistics; the files are of like size before compression.
    """
    refuse_in_place(spark, path, out)
    codec, codec_level = LEVELS[level]
    before = dataset_bytes(spark, path).first()["bytes"]
    files = max(1, math.ceil(before / TARGET_FILE_BYTES))
    df = spark.read.parquet(path)
    placed = clustered(df, cluster_by, files) if cluster_by else df.repartition(files)

    def write(staged: str) -> None:
        writer = placed.write.option("compression", codec)
        if codec_level is not None:
            writer = writer.option("parquet.compression.codec.zstd.level", str(codec_level))
        writer.parquet(staged)

    replace_with(spark, out, write)
    after = dataset_bytes(spark, out)
    return after.select(
        F.lit(level).alias("level"),
        kilobytes(F.lit(before)).alias("before_kb"),
        kilobytes(F.col("bytes")).alias("after_kb"),
    ).withColumn("saved_pct", saved_percent(F.col("before_kb"), F.col("after_kb")))
