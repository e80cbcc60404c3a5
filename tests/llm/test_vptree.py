"""Vantage-point search: exact at factor one, fewer leaves at a stated recall otherwise."""

import numpy as np
import pytest

from leafmill.llm import vptree
from leafmill.llm.batches import importable
from leafmill.llm.vptree import Tree

SCHEMA = "vec_id long, embedding array<float>"


def clustered(rng, n, size=16, lots=12):
    centres = rng.normal(size=(lots, size)) * 3
    return (centres[rng.integers(lots, size=n)] + rng.normal(size=(n, size))).astype(np.float32)


def truth(ids, data, q, k=10):
    gap = np.sqrt(((data.astype(float) - data[list(ids).index(q)].astype(float)) ** 2).sum(axis=1))
    return [(int(ids[i]), float(gap[i])) for i in np.lexsort((ids, gap)) if ids[i] != q][:k]


def test_factor_one_is_exact_and_smaller_ones_read_less():
    rng = np.random.default_rng(2)
    data = clustered(rng, 4000)
    tree = Tree(np.arange(4000), data)
    read = {}
    for factor in (1.0, 0.5, 0.25, 0.1):
        found = [tree.nearest(data[q].astype(float), q, 10, factor) for q in range(0, 4000, 100)]
        read[factor] = sum(n for _, n in found)
        if factor == 1.0:
            assert [[i for _, i in f] for f, _ in found] == [[i for i, _ in truth(range(4000), data, q)] for q in range(0, 4000, 100)]
    assert read[0.1] < read[0.25] < read[0.5] < read[1.0] < 40 * tree.leaves


def test_the_given_table_is_searched_with_fewer_leaves(spark):
    importable(spark)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = vptree.shards(vectors, 1, "vec_id", "embedding")
    queries = vectors.filter("vec_id % 100 = 0")
    curve = vptree.recall_curve(index, queries, 10, "vec_id", "embedding")
    by_factor = {r.factor: r for r in curve.collect()}
    factor = vptree.chosen_factor(curve)
    assert by_factor[factor].recall >= 0.95 and by_factor[factor].leaves < 0.95
    recalls = [by_factor[f].recall for f in sorted(by_factor)]
    assert recalls == sorted(recalls)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect() if r.embedding is not None and None not in r.embedding]
    ids, data = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32)
    got = {}
    for r in vptree.search(vectors, queries).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {int(q): truth(ids, data, q) for q in ids[ids % 100 == 0]}
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    true = {(q, i): g for q in want for i, g in want[q]}
    assert all(abs(g - true[q, i]) < 1e-12 for q in got for i, g in got[q] if (q, i) in true)


def test_shards_blocks_and_repeated_rows(spark, monkeypatch):
    """Many shards and blocks; a third of the rows share an id and a vector; clashing columns."""
    importable(spark)
    monkeypatch.setattr(vptree, "SHARD", 100)
    monkeypatch.setattr(vptree, "BLOCK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(rng, 400, 6))]
    rows += [(777, [0.25] * 6)] * 200 + [(None, [1.0] * 6), (900, [1.0, 2.0]), (1000, [2.0, 1.0])]
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 shard", "2 size", "'x' ids", "3 kind", "4 score").repartition(5)
    index = vptree.shards(vectors, 6, "vec_id", "embedding")
    assert max(len(r.ids) for r in index.collect()) < 200
    queries = vectors.filter("vec_id % 50 = 0 OR vec_id = 777")
    got = {}
    for r in vptree.search(vectors, queries, factor=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    ids = np.array([i for i, v in rows if i is not None and len(v) == 6])
    data = np.array([v for i, v in rows if i is not None and len(v) == 6], np.float32)
    want = {int(q): [(i, round(g, 9)) for i, g in truth(ids, data, q)] for q in [*range(0, 400, 50), 777]}
    want |= {900: [(1000, round(2**0.5, 9))], 1000: [(900, round(2**0.5, 9))]}
    assert got == want


def test_nothing_to_search(spark):
    importable(spark)
    empty = spark.createDataFrame([], SCHEMA)
    assert vptree.search(empty, empty).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0])], SCHEMA)
    assert vptree.search(one, one).count() == 0
    with pytest.raises(ValueError):
        vptree.search(one, one, factor=0)
