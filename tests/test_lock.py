import contextlib
import io

import pytest
from pyspark.sql import functions as F

from leafmill.operators.lock import lock_report, protect_columns, unprotect_columns

USER, OTHER, OWNER = b"u" * 32, b"x" * 32, b"o" * 32


def keys(spark, key, owner=None):
    if owner is None:
        return spark.createDataFrame([(bytearray(key),)], "key binary")
    return spark.createDataFrame([(bytearray(key), bytearray(owner))], "key binary, owner_key binary")


def docs(spark):
    return spark.createDataFrame(
        [(1, "one", "a"), (2, "zwei ü", "b"), (3, None, "c"), (4, "", "d")], "id bigint, text string, note string"
    )


def plain(df):
    return {r["id"]: (r["status"], r["t"]) for r in df.withColumn("t", F.col("text").cast("string")).collect()}


def test_round_trip_and_wrong_key(spark):
    locked = protect_columns(docs(spark), ["text", "note"], keys(spark, USER))
    raw = {r["id"]: (bytes(r["text"]) if r["text"] is not None else None) for r in locked.collect()}
    assert raw[1] != b"one" and raw[3] is None
    opened = plain(unprotect_columns(locked, ["text", "note"], keys(spark, USER)))
    assert opened == {1: ("unlocked", "one"), 2: ("unlocked", "zwei ü"), 3: ("unlocked", None), 4: ("unlocked", "")}

    fixed = spark.createDataFrame(locked.collect(), locked.schema)
    refused = unprotect_columns(fixed, ["text", "note"], keys(spark, OTHER))
    assert {tuple(r) for r in lock_report(refused).collect()} == {("wrong key", 4)}
    assert {r["id"]: r["text"] for r in refused.collect()} == {r["id"]: r["text"] for r in fixed.collect()}
    assert all(r["locked"] for r in refused.collect())


def test_locked_rows_are_skipped(spark):
    once = protect_columns(docs(spark), ["text"], keys(spark, USER))
    fixed = spark.createDataFrame(once.collect(), once.schema)
    twice = protect_columns(fixed, ["text"], keys(spark, OTHER))
    assert {r["id"]: r["text"] for r in twice.collect()} == {r["id"]: r["text"] for r in fixed.collect()}


def test_open_rows(spark):
    df = docs(spark).withColumn("text", F.col("text").cast("binary")).withColumn("locked", F.lit(False))
    assert {s for s, _ in plain(unprotect_columns(df, ["text"], keys(spark, USER))).values()} == {"open"}


def test_owner_opens_too(spark):
    locked = protect_columns(docs(spark), ["text"], keys(spark, USER, OWNER))
    fixed = spark.createDataFrame(locked.collect(), locked.schema)
    for key in (USER, OWNER):
        opened = unprotect_columns(fixed, ["text"], keys(spark, key))
        assert plain(opened)[2] == ("unlocked", "zwei ü")
        assert {r["owner_slot"] for r in opened.collect()} == {None}
    assert plain(unprotect_columns(fixed, ["text"], keys(spark, OTHER)))[2][0] == "wrong key"


@pytest.mark.parametrize(
    "key, owner, message",
    [(b"", None, "blank"), (b"short", None, "32 bytes"), (USER, USER, "differ"), (USER, b"", "blank")],
)
def test_refused_keys(spark, key, owner, message):
    with pytest.raises(Exception, match=message):
        protect_columns(docs(spark), ["text"], keys(spark, key, owner)).collect()


def test_plan_does_not_show_the_key(spark):
    df = protect_columns(docs(spark), ["text"], keys(spark, USER, OWNER))
    df.collect()
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("extended")
    text = shown.getvalue() + df._jdf.queryExecution().toString()
    for key in (USER, OWNER):
        assert key.decode() not in text and key.hex() not in text.lower()


def test_a_key_table_without_rows_is_refused(spark):
    none = spark.createDataFrame([], "key binary")
    for job in (protect_columns(docs(spark), ["text"], none), unprotect_columns(docs(spark).withColumn("text", F.col("text").cast("binary")).withColumn("locked", F.lit(True)), ["text"], none)):
        with pytest.raises(Exception, match="key table has no row"):
            job.collect()
