"""Whitening: the incremental spectrum and the whole result against numpy's eigenvalues."""

import math

import numpy as np
import pytest

from leafmill.llm import whitening
from leafmill.llm.whitening import Spectrum, Whitening, roots, whitened

NAN, INF = float("nan"), float("inf")


def scatter(rows):
    centred = rows - rows.mean(axis=0)
    return centred.T @ centred


def close(found, rows, size):
    want = scatter(rows)
    again = found.basis @ np.diag(found.values) @ found.basis.T
    scale = max(np.abs(want).max(), 1e-300)
    assert np.abs(again - want).max() < 1e-11 * scale
    assert np.abs(found.basis.T @ found.basis - np.eye(size)).max() < 1e-11
    assert found.n == len(rows) and np.allclose(found.mean, rows.mean(axis=0))


@pytest.mark.parametrize("seed", range(20))
def test_secular_roots(seed):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(1, 30))
    poles = np.cumsum(10.0 ** rng.uniform(-6, 2, m))
    z = 10.0 ** rng.uniform(-5, 0, m) * rng.choice([-1, 1], m)
    rho = 10.0 ** rng.uniform(-3, 3)
    found, gaps = roots(poles, z, rho)
    want = np.linalg.eigvalsh(np.diag(poles) + rho * np.outer(z, z))
    assert np.abs(found - want).max() <= 1e-13 * m * want[-1]
    # between the poles
    assert (np.diagonal(gaps) > 0).all() and (gaps[1:, :-1].diagonal() <= 0).all()


@pytest.mark.parametrize("kind", ["plain", "few rows", "repeats", "one direction", "constant", "equal spread"])
def test_rank_one_updates_and_combination(kind):
    rng = np.random.default_rng(3)
    rows = np.floor(1024 * rng.normal(size=(400, 12)) * np.linspace(0.01, 3, 12)) + 100_000
    if kind == "few rows":
        rows = rows[:5]
    elif kind == "repeats":
        rows = rows[rng.integers(0, 7, 400)]
    elif kind == "one direction":
        rows = 100_000 + np.outer(rng.integers(-9, 9, 400), np.arange(12.0))
    elif kind == "constant":
        rows[:, 3:] = 100_000.0
    elif kind == "equal spread":
        rows = np.concatenate([np.eye(12), -np.eye(12)]) * 1024 + 100_000
    whole, parts = Spectrum(12), [Spectrum(12) for _ in range(4)]
    for k, row in enumerate(rows):
        whole.add(row)
        parts[k % 3].add(row)  # one of the parts stays empty
    close(whole, rows, 12)
    first = parts[3]
    for other in parts[:3]:
        first.combine(other)
    close(first, rows, 12)


def plain(vectors, components=8):
    """Rows by id: deviation and whitened values; explained shares."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums.tolist(), strict=True)) for r in x.tolist()]
    centred = (n * x - sums) / n
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    return deviation, centred @ basis[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(cov)


def compare(df, ids, vectors):
    deviation, white, share = plain(vectors)
    rows = df.orderBy("vec_id", "component").collect()
    k = len(share)
    assert len(rows) == len(ids) * k
    order = np.argsort(ids, kind="stable")
    got = np.array([r.whitened for r in rows]).reshape(-1, k)
    want = white[order]
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-7
    for at, r in enumerate(rows):
        i = order[at // k]
        assert (r.vec_id, r.component, r.n, r.deviation) == (ids[i], at % k + 1, len(ids), deviation[i])
        assert abs(r.explained / share[at % k] - 1) < 1e-9
        assert r.identity_error == rows[0].identity_error < 1e-9


def test_whole_table(spark, small, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 150)  # several tasks, and more than one round of combination
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    held = [(r.vec_id, r.embedding) for r in vectors.collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    df = whitened(vectors)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(df, [i for i, _ in held], [v for _, v in held])


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=4).round(3).tolist()) for i in range(40)]
    good += [(100, [0.0] * 4), (101, [7.0] * 4), (102, [7.0] * 4)]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [NAN, 0.0, 0.0, 0.0]), (203, [0.0, -INF, 0.0, 0.0]), (204, []), (205, [1.0, 2.0]), (206, [1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").selectExpr("*", "'x' id", "1 v", "2 part", "3 n")
    compare(whitened(df.repartition(5)), [i for i, _ in good], [v for _, v in good])
    null = spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    repeated = null.union(null.filter("vec_id = 2"))
    assert [r.vec_id for r in whitened(repeated).filter("component = 1").orderBy("vec_id").collect()] == [None, 1, 2, 2]


def test_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)]):
        assert whitened(spark.createDataFrame(rows, schema)).collect() == []
    # as many components as there are directions
    line = whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema))
    assert {r.component for r in line.collect()} == {1}


def test_deviations_beyond_a_long():
    model = Whitening(10**6, np.array([5 * 10**6, 0]), np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[5, 0], [2005, 1000], [10**6, 0]])
    assert model.deviations(x).to_pylist() == [0, 10**12 * (2000**2 + 1000**2), None]
