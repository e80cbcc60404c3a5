"""Whitening of embeddings by an incremental eigendecomposition.

Every task holds the spectrum of the rows it has read: their number, mean, and the eigenvalues and
eigenvectors of their scatter matrix. A row changes the scatter matrix by a centred rank-one term, so
the new eigenvalues are the roots of a secular equation between the old ones. Directions the row has no
part in, and equal eigenvalues but one, are deflated first: they stay as they are. Spectra of tasks are
combined pairwise by rank-one terms too, one per eigenvector of the other and one for the difference of
the means, ``FAN_IN`` at a time until one is left.

Rounding adds up over millions of updates, so a last pass projects all rows on the orthonormalised
basis and solves the small problem in it (Rayleigh-Ritz). The basis is a full one, which makes the
result the eigenvectors of the whole covariance to double precision.

Sums are exact integers. What a task, a message or the driver holds is at most some matrices of the
square of the vectors' length, whatever the number of rows.

Defined results: vectors that are null or hold null or non-finite entries take no part, nor do those with
an entry beyond ``LARGEST``, where the scaled entry is no exact integer in double precision, and those
whose length is not the commonest (of equally common ones the longest); zero vectors and repeated rows
take part; a null id stays null; components without variance are left out, so that equal vectors, a
single one or an empty table give no rows; a deviation that does not fit a long is null; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.batches import written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**42
#: Rows a task updates its spectrum with, unless that makes more tasks than ``WAVES`` per core.
ROWS, WAVES = 2048, 64
FAN_IN = 8
EPS = np.finfo(np.float64).eps


def roots(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z**2 / (poles - x))`` for rising ``poles``, ``z`` without zeros, rho > 0.

    Returns the roots and ``gaps[i, j] = root j - pole i``, both exact relative to the nearest pole.
    Every root is sought from that pole by interpolation with two poles, kept in a bracket.
    """
    m = len(poles)
    weight = rho * z * z
    right = np.append(poles[1:], poles[-1] + weight.sum())
    width = right - poles
    middle = poles + width / 2
    upper = 1 + (weight[:, None] / (poles[:, None] - middle)).sum(axis=0) < 0
    upper[-1] = False
    origin = np.where(upper, right, poles)
    shift = poles[:, None] - origin  # of every pole, seen from the origin of each root
    near, far = poles - origin, right - origin
    low = np.where(upper, -width / 2, 0.0)
    high = np.where(upper, 0.0, np.where(np.arange(m) < m - 1, width / 2, width))
    x = (low + high) / 2
    left = np.arange(m)[:, None] <= np.arange(m)
    for _ in range(120):
        away = shift - x
        term = weight[:, None] / away
        value = 1 + term.sum(axis=0)
        open_ = np.abs(value) > 4 * EPS * (1 + np.abs(term).sum(axis=0))
        open_ &= (high - low) > 2 * EPS * np.maximum(np.abs(low), np.abs(high))
        if not open_.any():
            break
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        slope = term / away
        one, two = near - x, far - x
        below = np.where(left, slope, 0.0).sum(axis=0)
        above = slope.sum(axis=0) - below
        a = (one + two) * value - one * two * (below + above)
        b = one * two * value
        c = value - one * below - two * above
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            best = x + step
        inside = (best > low) & (best < high)
        x = np.where(open_, np.where(inside, best, (low + high) / 2), x)
    return origin + x, x - shift


class Spectrum:
    """Eigendecomposition of the scatter matrix of the rows seen, eigenvalues rising."""

    def __init__(self, size: int):
        self.n = 0
        self.mean = np.zeros(size)
        self.values = np.zeros(size)
        self.basis = np.eye(size)

    def add(self, row: np.ndarray) -> None:
        delta = row - self.mean
        if self.n:
            self.update(delta, self.n / (self.n + 1))
        self.n += 1
        self.mean += delta / self.n

    def combine(self, other: Spectrum) -> None:
        if other.n == 0:
            return
        n = self.n + other.n
        delta = other.mean - self.mean
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.update(vector, float(value))
        if self.n:
            self.update(delta, self.n * other.n / n)
        self.mean = self.mean + delta * (other.n / n)
        self.n = n

    def update(self, vector: np.ndarray, rho: float) -> None:
        """Adds ``rho * vector * vector'`` to the matrix."""
        length = np.sqrt(vector @ vector)
        rho *= length * length
        if not rho > 0:
            return
        z = self.basis.T @ (vector / length)
        # beside the largest number around, changes below this are rounding
        least = 8 * EPS * max(self.values[-1], rho)
        z = self._gathered(z, least)
        active = np.flatnonzero(rho * np.abs(z) > least)
        if len(active) == 0:
            return
        poles, z = self.values[active], z[active]
        found, gaps = roots(poles, z, rho)
        turned = self._vectors(poles, z, gaps)
        self.values[active] = found
        self.basis[:, active] = self.basis[:, active] @ turned
        order = np.argsort(self.values, kind="stable")
        self.values, self.basis = self.values[order], self.basis[:, order]

    def _gathered(self, z: np.ndarray, least: float) -> np.ndarray:
        """Turns the eigenvectors of (nearly) equal eigenvalues so that ``z`` has one entry in each lot."""
        close = np.diff(self.values) <= least
        if not close.any():
            return z
        z, at = z.copy(), 0
        while at < len(z):
            end = at + 1
            while end < len(z) and close[end - 1] and self.values[end] - self.values[at] <= least:
                end += 1
            if end - at > 1:
                mirror = z[at:end].copy()
                length = np.copysign(np.sqrt(mirror @ mirror), mirror[-1])
                mirror[-1] += length
                square = mirror @ mirror
                if square > 0:
                    lot = self.basis[:, at:end]
                    self.basis[:, at:end] = lot - np.outer(lot @ mirror, mirror * (2 / square))
                    z[at:end] = 0
                    z[end - 1] = -length
            at = end
        return z

    @staticmethod
    def _vectors(poles: np.ndarray, z: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Eigenvectors, orthogonal to rounding: of the vector for which the roots found are exact."""
        m = len(poles)
        i, j = np.arange(m)[:, None], np.arange(m)
        # every root but the last is paired with another pole beside it
        beside = np.where(j < i, poles, np.append(poles[1:], poles[-1])) - poles[:, None]
        beside[:, -1] = 1.0
        fitted = np.copysign(np.sqrt(np.abs(np.prod(gaps / beside, axis=1))), z)
        vectors = fitted[:, None] / -gaps
        return vectors / np.sqrt((vectors * vectors).sum(axis=0))

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "mean": self.mean.tobytes(), "values": self.values.tobytes(), "basis": self.basis.tobytes()}

    @classmethod
    def of(cls, row) -> Spectrum:
        mean = np.frombuffer(row.mean).copy()
        found = cls(len(mean))
        found.n, found.mean, found.values = int(row.n), mean, np.frombuffer(row.values).copy()
        found.basis = np.frombuffer(row.basis).reshape(len(mean), -1).copy()
        return found


@dataclass
class Moments:
    """Number, mean and scatter matrix of rows, added up centred."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of_rows(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(axis=0)
        return cls(len(rows), mean, (rows - mean).T @ (rows - mean))

    def plus(self, other: Moments) -> Moments:
        n = self.n + other.n
        delta = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
        return Moments(n, self.mean + delta * (other.n / n), scatter)


@dataclass
class Whitening:
    """What whitens a vector: sums of the scaled entries, and the components, falling."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums // self.n) - (self.sums % self.n) / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.components) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n * x - sums)**2, null where one does not fit a long."""
        rough = ((float(self.n) * x - self.sums.astype(np.float64)) ** 2).sum(axis=1)
        small = rough < 2.0**61
        out: list[int | None] = [None] * len(x)
        exact = ((self.n * x[small] - self.sums) ** 2).sum(axis=1)
        for at, value in zip(np.flatnonzero(small).tolist(), exact.tolist(), strict=True):
            out[at] = value
        for at in np.flatnonzero(~small & (rough < 2.0**64)).tolist():
            value = sum((self.n * a - s) ** 2 for a, s in zip(x[at].tolist(), self.sums.tolist(), strict=True))
            out[at] = value if value < 2**63 else None
        return pa.array(out, pa.int64())


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def scaled(batch: pa.RecordBatch) -> np.ndarray:
    """Entries of the vectors of a batch as integers, a row each."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(batch.num_rows, -1)


def rows_of(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id, v``: the vectors that take part."""
    good = vectors.select(vectors[vec_id].alias("id"), vectors[embedding].alias("v")).filter(usable(F.col("v")))
    common = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return good.filter(F.size("v") == (common["size"] if common else 0))


def exact_sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and the sum of every entry as an exact integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = scaled(batch)
                n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total)], names=["k", "n", "s"])

    parts = rows.select("v").mapInArrow(run, "k int, n bigint, s bigint")
    found = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("k").collect()
    return (found[0]["n"], np.array([r["s"] for r in found], np.int64)) if found else (0, np.zeros(0, np.int64))


def _one(parts: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame], name: str):
    """The single row that ``merge`` leaves of ``parts``, ``FAN_IN`` at a time; None without parts."""
    parts = written(parts, name)
    while (most := parts.agg(F.max("part")).first()[0] or 0) > 0:
        place = F.floor(F.col("part") / FAN_IN).cast("int")
        grouped = parts.withColumn("part", place).repartition(min(most // FAN_IN + 1, 1000), "part").groupBy("part")
        parts = written(grouped.applyInPandas(merge, parts.schema), name)
    return parts.first()


def spectrum(rows: DataFrame, n: int) -> Spectrum | None:
    """Spectrum of all ``rows`` (``v``), of which there are ``n``."""
    spark = rows.sparkSession
    tasks = max(1, min(-(-n // ROWS), WAVES * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, part = None, None
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                x = scaled(batch).astype(np.float64)
                found = found or Spectrum(x.shape[1])
                for row in x:
                    found.add(row)
        if found:
            yield pa.RecordBatch.from_pylist([found.row(part)], schema=schema)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        first, *rest = (Spectrum.of(r) for r in group.sort_values("n").itertuples())
        for other in rest:
            first.combine(other)
        return pd.DataFrame([first.row(int(group["part"].iloc[0]))])

    schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("values", pa.binary()), ("basis", pa.binary())])
    dealt = rows.select("v").repartition(tasks).select("v", F.spark_partition_id().alias("part"))
    parts = dealt.mapInArrow(run, "part int, n bigint, mean binary, values binary, basis binary")
    found = _one(parts, merge, "spectra")
    return None if found is None else Spectrum.of(found)


def moments(rows: DataFrame, project: Callable[[np.ndarray], np.ndarray]) -> Moments:
    """Moments of ``project`` of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, part = None, None
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                now = Moments.of_rows(project(scaled(batch)))
                found = now if found is None else found.plus(now)
        if found:
            yield pa.RecordBatch.from_pylist([{"part": part, "n": found.n, "mean": found.mean.tobytes(), "scatter": found.scatter.tobytes()}], schema=schema)

    def held(r) -> Moments:
        mean = np.frombuffer(r.mean)
        return Moments(int(r.n), mean, np.frombuffer(r.scatter).reshape(len(mean), -1))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        first, *rest = (held(r) for r in group.sort_values("n").itertuples())
        for other in rest:
            first = first.plus(other)
        return pd.DataFrame([{"part": int(group["part"].iloc[0]), "n": first.n, "mean": first.mean.tobytes(), "scatter": first.scatter.tobytes()}])

    schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("scatter", pa.binary())])
    parts = rows.select("v", F.spark_partition_id().alias("part")).mapInArrow(run, "part int, n bigint, mean binary, scatter binary")
    return held(_one(parts, merge, "moments"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (``v``); None without rows or without variance."""
    n, sums = exact_sums(rows)
    if n == 0:
        return None
    found = spectrum(rows, n)
    basis, _ = np.linalg.qr(found.basis[:, ::-1])
    start = Whitening(n, sums, np.ones(len(sums)), basis, 0.0)
    ritz = moments(rows, lambda x: start.centred(x) @ basis)
    values, turned = np.linalg.eigh(ritz.scatter / n)
    values, turned = values[::-1], turned[:, ::-1]
    trace = float(np.trace(ritz.scatter) / n)
    kept = int((values[:components] > len(sums) * EPS * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    return Whitening(n, sums, values[:kept], basis @ turned[:, :kept], trace) if kept else None


def whiten(rows: DataFrame, model: Whitening, identity_error: float) -> DataFrame:
    """A row of ``rows`` (``id, v``) per component of ``model``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        share = model.values / model.trace
        for batch in batches:
            if batch.num_rows:
                x = scaled(batch)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, model.n)),
                        model.deviations(x).take(each),
                        pa.array(model.apply(x).ravel()),
                        pa.array(np.tile(share, len(x))),
                        pa.array(np.full(len(x) * k, identity_error)),
                    ],
                    names=names,
                )

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.select("id", "v").mapInArrow(
        run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )


def whitened(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every vector that takes
    part and every component; the last is how far the covariance of the whitened rows is from identity."""
    rows = rows_of(vectors, vec_id, embedding)
    model = fit(rows, components)
    if model is None:
        none = Whitening(1, np.zeros(1, np.int64), np.zeros(0), np.zeros((1, 0)), 1.0)
        return whiten(rows.filter("false"), none, 0.0)
    after = moments(rows, model.apply)
    error = float(np.abs(after.scatter / after.n - np.eye(len(model.values))).max())
    return whiten(rows, model, error)
