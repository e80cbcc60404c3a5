"""Exact duplicates by a stream: against a plain grouping, with collisions, hot groups and later files."""

import os
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from leafmill.llm import ledger

ROWS = [
    (1, "same text", "x"), (9, "same text", "y"), (4, "same text", None), (9, "same text", "again"),
    (2, None, "x"), (3, "", "x"), (5, " ", "x"), (6, "Same text", "x"), (7, "same text ", "x"),
    (None, "same text", "x"), (None, "nobody else", "x"), (None, "nobody else", "y"),
    (8, "long " * 200_000, "x"), (10, "long " * 200_000, "x"), (11, "long " * 200_000 + "er", "x"),
]


def plain(rows):
    """doc_id, keep_id, group_size of every row, by a dictionary."""
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    best = {k: max((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((doc, best[text or ""], len(groups[text or ""])) for doc, text, *_ in rows), key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    """Rows in several files, with columns whose names the operator uses itself."""
    path = str(tmp_path / "documents.parquet")
    df = spark.createDataFrame(ROWS, "doc_id long, text string, digest string").withColumn("file", F.lit("f")).withColumn("n", F.lit(3))
    df.repartition(4).write.parquet(path)
    return path


def test_as_plain_grouping(spark, table):
    df = ledger.exact_duplicates(spark, table)
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found(df) == plain(ROWS)
    # one row of every group stays, also where rows of one doc_id repeat
    rows = df.collect()
    assert sum(r.kept for r in rows) == len({t or "" for _, t, _ in ROWS})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_colliding_digests_are_told_apart_by_their_bytes(spark, table, monkeypatch):
    monkeypatch.setattr(ledger, "HEAVY_ROWS", 2)
    monkeypatch.setattr(ledger, "SLICES", 5)
    for weak in (lambda t: F.lit(b"1"), lambda t: F.encode(F.substring(t, 1, 1), "UTF-8")):
        log = ledger.Ledger(spark, digest=weak)
        log.absorb(ledger.located(ledger.arriving(spark, table)))
        df = log.decisions(ledger.located(spark.read.parquet(table)))
        assert found(df) == plain(ROWS)
        assert df.filter("kept").count() == len({t or "" for _, t, _ in ROWS})


def test_hot_group_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "HEAVY_ROWS", 50)
    path = str(tmp_path / "documents.parquet")
    rows = [(i, "copied" if i % 3 == 0 else f"text {i}") for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    assert found(ledger.exact_duplicates(spark, path)) == plain(rows)


def test_state_goes_on_with_later_files(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = [(1, "a"), (2, "b")], [(3, "a"), (4, "c")]
    log = ledger.Ledger(spark, str(tmp_path / "ledger"))
    for n, part in enumerate(rows):
        spark.createDataFrame(part, "doc_id long, text string").write.mode("append").parquet(path)
        log = ledger.Ledger(spark, log.folder)  # as after a restart
        result = found(ledger.exact_duplicates(spark, path, log))
        assert result == plain([r for p in rows[: n + 1] for r in p])
    assert log.groups().count() == 3
    # files taken one by one give the same state
    slow = ledger.Ledger(spark)
    slow.absorb(ledger.located(ledger.arriving(spark, path, files_per_batch=1)))
    key = lambda g: sorted((bytes(r.digest), r.n, r.stays.doc_id) for r in g.groups().collect())
    assert key(slow) == key(log)


def test_open_stores_take_no_disk_in_advance(spark, table):
    local = Path(SparkFiles.getRootDirectory()).parent  # where this session's executor works
    before = set(local.glob("StateStoreId*"))
    ledger.Ledger(spark).absorb(ledger.located(ledger.arriving(spark, table)))
    stores = set(local.glob("StateStoreId*")) - before
    assert stores
    for store in stores:
        assert sum(os.lstat(f).st_blocks * 512 for f in store.rglob("*")) < 1 << 20


def test_empty_table_and_single_file(spark, tmp_path, small):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert ledger.exact_duplicates(spark, path).collect() == []
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert found(ledger.exact_duplicates(spark, f"{small}/documents.parquet")) == plain(docs)


def test_no_python_on_the_path(spark, table):
    log = ledger.Ledger(spark)
    log.absorb(ledger.located(ledger.arriving(spark, table)))
    plan = log.decisions(ledger.located(spark.read.parquet(table)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
