import pytest
from pyspark.sql import functions as F

from leafmill.operators.merge import merge_documents, merge_report, number_within, split_on_breaks


def test_merge(spark, small_blocks, eager_salting, many_partitions):
    totals = {1: 9, 2: 1, 3: 5, 4: 2}
    pages = spark.createDataFrame(
        [(d, p, f"{d}/{p}") for d, n in totals.items() for p in range(1, n + 1)],
        "doc_id bigint, page_no int, text string",
    )
    manifest = {
        "a": [3, 1, 3, 2],  # a repeated input counts once, at its first place
        "b": [1],  # a single input is no merge
        "c": [4, 1],
        "d": [2, 2],  # the same input twice is a single one
    }
    wide = [(f"w{i:02}", [1, 2, 4]) for i in range(30)]  # documents used very often
    manifest |= dict(wide)
    rows = [(o, s, d) for o, ds in manifest.items() for s, d in enumerate(ds, 1)]
    df = spark.createDataFrame(rows, "out_id string, seq int, doc_id bigint")
    want = set()
    for out, docs in manifest.items():
        order = list(dict.fromkeys(docs))
        if len(order) < 2:
            continue
        at = 0
        for d in order:
            for p in range(1, totals[d] + 1):
                at += 1
                want.add((out, docs.index(d) + 1, d, at, f"{d}/{p}"))
    got = [tuple(r) for r in merge_documents(pages, df).collect()]
    assert len(got) == len(want) and set(got) == want


def test_number_within(spark, many_partitions):
    rows = [("a", 5), ("a", 2), ("b", 9), ("a", 7)]
    df = spark.createDataFrame(rows, "g string, k int")
    got = {(r["g"], r["k"]): r["n"] for r in number_within(df, "g", "k", "n").collect()}
    assert got == {("a", 2): 1, ("a", 5): 2, ("a", 7): 3, ("b", 9): 1}


def test_breaks(spark):
    texts = {
        1: "no break\nat all",
        2: "--\nfirst\nsecond",
        3: "first\n--",
        4: "a\n--\n--\nb\n--\nc",
        5: "--",
        6: "",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {}
    for r in split_on_breaks(df, lambda line: line == "--").collect():
        got.setdefault(r["doc_id"], {}).setdefault(r["part"], []).append((r["i"], r["line"]))
    assert {d: {p: sorted(v) for p, v in parts.items()} for d, parts in got.items()} == {
        2: {1: [(1, "--")], 2: [(2, "first"), (3, "second")]},
        3: {1: [(1, "first"), (2, "--")]},
        4: {1: [(1, "a"), (2, "--")], 2: [(3, "--")], 3: [(4, "b"), (5, "--")], 4: [(6, "c")]},
        5: {1: [(1, "--")]},
    }


def test_merge_keeps_all_pages(spark, small):
    from leafmill.sources import tables

    docs = tables.documents(spark, small)
    pages = tables.paginate(docs)
    manifest = docs.select(F.col("source").alias("out_id"), F.col("doc_id").alias("seq"), "doc_id")
    assert merge_documents(pages, manifest).count() == pages.count()


def test_report_names_what_is_missing(spark):
    pages = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "doc_id long, page_no int, text string")
    manifest = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("y", 1, 1), ("y", 2, 7), ("z", 1, 1), ("z", 2, 2), ("z", 3, 9)], "out_id string, seq int, doc_id long")
    rows = {r.out_id: (r.inputs, r.missing, r.status) for r in merge_report(pages, manifest).collect()}
    assert rows == {"x": (2, 0, "ok"), "y": (2, 1, "single"), "z": (3, 1, "missing")}


def test_outputs_with_absent_inputs_are_refused(spark):
    pages = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c")], "doc_id long, page_no int, text string")
    rows = [("x", 1, 1), ("x", 2, 2), ("y", 1, 1), ("y", 2, 7), ("y", 3, 2), ("z", 1, 8), ("z", 2, 9)]
    manifest = spark.createDataFrame(rows, "out_id string, seq int, doc_id long")
    made = lambda **k: {(r.out_id, r.doc_id, r.page_no) for r in merge_documents(pages, manifest, **k).collect()}
    assert made() == {("x", 1, 1), ("x", 2, 2)}
    assert made(missing="skip") == {("x", 1, 1), ("x", 2, 2), ("y", 1, 1), ("y", 2, 2)}
    with pytest.raises(ValueError):
        made(missing="raise")
    with pytest.raises(ValueError):
        made(missing="ignore")
    told = {r.out_id: r.status for r in merge_report(pages, manifest).collect()}
    assert told == {"x": "ok", "y": "missing", "z": "single"}
