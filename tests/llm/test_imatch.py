"""Fingerprints against a plain reading of the whole small table."""

from __future__ import annotations

import hashlib
import math

from leafmill.llm import imatch


def plain(docs: list[tuple[int, str]], upper: float = imatch.UPPER, lower: float = imatch.LOWER):
    texts = {d: t or "" for d, t in docs}
    df: dict[bytes, int] = {}
    for t in texts.values():
        for w in set(t.encode().lower().split()):
            df[w] = df.get(w, 0) + 1
    n = len(texts)
    made = imatch.Fingerprints(w for w, k in df.items() if lower <= math.log(n / k) <= upper)
    ids = sorted(texts)
    out = {}
    for i, d in enumerate(ids):
        a, b = texts[d], texts[ids[(i + 1) % len(ids)]]
        half = len(a) // 2
        edited = (a[: len(a) - half] + b[:half]).encode()
        x, y, z = made.of(a.encode()), made.of(edited), made.of(b.encode())
        out[d] = (len(a), hashlib.sha256(edited).hexdigest(), x, y, imatch.likeness(x, y), imatch.likeness(x, z))
    return out


def found(df):
    return {r[0]: tuple(r[1:]) for r in imatch.edit_report(df).collect()}


def test_report_equals_a_plain_reading(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = plain([tuple(r) for r in docs.collect()])
    got = found(docs.repartition(7))
    assert got == want
    # a half edit is still like the text, the next document is not
    assert sum(x[4] for x in got.values()) > 3 * sum(x[5] for x in got.values()) > 0


def test_equal_texts_nulls_and_long_texts(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (5, "x " * 200_000), (6, "é🎉 z")]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == plain(rows)
    assert got[1][2] == got[2][2] and got[1][5] == 1.0
    assert got[3][:2] == (0, hashlib.sha256(b"").hexdigest()) and got[3][4] == 1.0


def test_one_row_repeated_rows_and_none(spark):
    kind = "doc_id long, text string"
    one = found(spark.createDataFrame([(9, "only one")], kind))
    assert one[9][1] == hashlib.sha256(b"onlyonly").hexdigest()
    twice = imatch.edit_report(spark.createDataFrame([(1, "p q"), (1, "p q")], kind))
    assert twice.count() == 2 and twice.distinct().count() == 1
    assert imatch.edit_report(spark.createDataFrame([], kind)).count() == 0


def test_lexicon_is_bounded_by_the_band(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    terms = imatch.lexicon(docs, upper=math.log(20))
    mean = sum(len(set((r.text or "").lower().split())) for r in docs.collect()) / docs.count()
    assert 0 < len(terms) <= mean * 20
    mark = imatch.fingerprints(docs.limit(5), terms=terms).collect()
    assert len(mark) == 5 and all(len(r.fingerprint.split(".")) == len(imatch.RATES) * imatch.SUBSETS for r in mark)


def test_ranges_are_chosen_without_texts(spark):
    """Sampling for the ranges projects the sort keys, which hold no text."""
    docs = spark.createDataFrame([(i, f"text {i}", "x", 1, b"y") for i in range(20)], "doc_id long, text string, mark string, part long, data binary")
    plan = imatch.edit_report(docs)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "rangepartitioning" in line]
    assert keys and not any("data" in k.split("rangepartitioning(")[1].split(")")[0] for k in keys)
    assert found(docs.select("doc_id", "text")) == found(docs) == plain([(i, f"text {i}") for i in range(20)])


def test_neighbours_across_many_partitions(spark):
    rows = [(i * 3, " ".join(f"w{(i * k) % 17}" for k in range(9))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert found(docs.repartition(4)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_fingerprints_by_hand():
    """Sorted in-band terms, hashed per subset; a change outside the band changes nothing."""
    made = imatch.Fingerprints([b"apple", b"pear", b"plum"])
    assert made.of(b"Apple the PEAR") == made.of(b"pear of apple pear") != made.of(b"apple plum")
    groups = [[t for t in (b"apple", b"pear") if k in made.places[t]] for k in range(imatch.SUBSETS * len(imatch.RATES))]
    want = [hashlib.blake2b(b"\n".join(g), digest_size=4).hexdigest() if g else imatch.NONE for g in groups]
    assert made.of(b"pear apple") == ".".join(want)
