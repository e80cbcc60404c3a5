"""Skew-proof plan shapes against brute force, with one group holding most rows."""

import random

from pyspark.sql import functions as F

from leafmill.plans.scale import running_totals, spread_join


def skewed(spark, n=3000):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(40)}", i, rng.randrange(9)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, k bigint, v int").repartition(7)


def test_running_totals(spark, many_partitions):
    rows, df = skewed(spark)
    want, sizes = {}, {}
    for g, k, v in sorted(rows):
        n, total = sizes.get(g, (0, 0))
        want[(g, k)] = (n + 1, total)
        sizes[g] = (n + 1, total + v)
    got = running_totals(df, "g", ["k"], "v").collect()
    assert {(r["g"], r["k"]): (r["_position"], r["_before"]) for r in got} == want
    assert all(r["_group_size"] == sizes[r["g"]][0] for r in got)
    assert len(got) == len(rows)


def test_running_totals_spread_a_hot_group(spark, many_partitions):
    _, df = skewed(spark)
    placed = df.repartitionByRange("g", "k").withColumn("part", F.spark_partition_id())
    parts = placed.filter("g = 'hot'").groupBy("part").count().collect()
    assert len(parts) > 3


def test_positions_only(spark):
    rows, df = skewed(spark, 200)
    got = running_totals(df.select("g", "k"), "g", ["k"])
    assert set(got.columns) == {"g", "k", "_position", "_group_size"}
    assert got.count() == 200


def test_spread_join_gives_the_plain_join(spark, eager_salting):
    rows, df = skewed(spark)
    few = spark.createDataFrame(
        [("hot", "a"), ("hot", "b")] + [(f"g{i}", f"x{i}") for i in range(0, 60, 2)], "g string, w string"
    )
    got = sorted(map(tuple, spread_join(df, few, ["g"], ["k"]).select("g", "k", "v", "w").collect()))
    want = sorted(map(tuple, df.join(few, "g").select("g", "k", "v", "w").collect()))
    assert got == want


def test_spread_join_with_known_counts(spark, eager_salting):
    rows, df = skewed(spark)
    few = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    got = sorted(map(tuple, spread_join(df, few, ["g"], ["k"], rows="n").select("g", "k", "n").collect()))
    want = sorted(map(tuple, df.join(few, "g").select("g", "k", "n").collect()))
    assert got == want


def test_a_missing_group_is_a_group(spark, many_partitions):
    df = spark.createDataFrame([(None, i, 2) for i in range(9)] + [("a", 1, 5)], "g string, k int, v int")
    rows = {(r.g, r.k): (r._position, r._group_size, r._before) for r in running_totals(df, "g", ["k"], "v").collect()}
    assert rows == {**{(None, i): (i + 1, 9, 2 * i) for i in range(9)}, ("a", 1): (1, 1, 0)}


def test_slices_follow_the_rows(spark, monkeypatch, many_partitions):
    """A hot key's largest task is bounded by a slice, with 64 as with 5,000 heavy keys."""
    from leafmill.plans import scale

    monkeypatch.setattr(scale, "SLICE_ROWS", 20)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for keys, hot in ((64, 30_000), (5_000, 2_000)):
            many = spark.range(hot).selectExpr("0L g", "id k").unionByName(spark.range(keys * 25).selectExpr(f"1 + id % {keys} g", "id k"))
            few = spark.range(keys + 1).selectExpr("id g", "id * 10 w")
            joined = spread_join(many, few, ["g"], ["k"])
            tasks = joined.filter("g = 0").groupBy(F.spark_partition_id()).count()
            assert joined.filter("w = g * 10").count() == hot + keys * 25
            # hashing the slices deals them unevenly, by a few times their mean at most
            assert tasks.agg({"count": "max"}).first()[0] <= max(6 * hot / 200, 8 * 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
