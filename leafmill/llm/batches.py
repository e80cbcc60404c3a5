"""Arrow helpers shared by the operators that work on whole texts inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from leafmill.session import fresh_path

SLICE_BYTES = 1 << 20


def fresh(name: str) -> str:
    """A working column name that no input column has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``limit`` bytes of text each, so that memory is bounded by
    ``limit`` and the longest single text, whatever number of rows Spark puts into a batch."""
    yield from size_slices(batch, pc.binary_length(batch.column(column)), limit)


def size_slices(batch: pa.RecordBatch, sizes: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose ``sizes`` (null: 0) come to about ``limit``, or one row that is larger."""
    if batch.num_rows == 0:
        return
    share = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of the texts of a batch; null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """List array of consecutive runs of ``values``."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes ``starts[i], starts[i] + 1, ...``, ``counts[i]`` of them, for every i."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe when executors are lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def give_back() -> None:
    """Returns memory this worker no longer uses to the machine; a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system's library can
        ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Written tables that are removed when their last reader has run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        table = self.spark.read.parquet(path)
        self.paths[id(table)] = table, path
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Removes tables this has written; others are left alone."""
        for table in tables:
            if id(table) in self.paths:
                _, path = self.paths.pop(id(table))
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop_all(self, *but: DataFrame) -> None:
        kept = {id(t) for t in but}
        self.drop(*(t for i, (t, _) in list(self.paths.items()) if i not in kept))


def shared_bytes(spark: SparkSession, path: str) -> Callable[[], bytes]:
    """Content of a vocabulary file, read once on the driver and shared with the tasks.

    Its size is that of the file, a parameter, and never depends on the data.
    """
    with open(path, "rb") as f:
        value = spark.sparkContext.broadcast(f.read())
    return lambda: value.value


class WordIds:
    """Ids of words, each distinct word encoded once as long as it is kept.

    ``encode`` gets a list of words and returns a list of id lists, or all ids and their numbers by
    word. Beyond ``limit`` words, or ``IDS_A_WORD`` times as many ids, between
    calls the less used half is forgotten, which bounds memory; ids never depend on what is kept.
    """

    IDS_A_WORD = 16

    def __init__(self, encode: Callable[[list], Sequence[Sequence[int]] | tuple[np.ndarray, np.ndarray]], limit: int = 400_000, kind: type = np.int32):
        self.encode, self.limit, self.kind = encode, limit, kind
        self.number: dict = {}
        self.flat = np.zeros(0, dtype=kind)
        self.start, self.count, self.hits = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, len(a) * 3 // 2, 1 << 14) - len(a), a.dtype)])

    def _forget(self) -> None:
        known = len(self.number)
        best = np.sort(np.argpartition(self.hits[:known], known // 2)[known // 2 :])
        words = list(self.number)
        self.number = {words[i]: n for n, i in enumerate(best.tolist())}
        counts = self.count[best]
        self.flat = self.flat[runs(self.start[best], counts)]
        self.start, self.count, self.hits = np.cumsum(counts) - counts, counts, self.hits[best] // 2
        self.used = len(self.flat)

    def _learn(self, words: list) -> None:
        found = self.encode(words)
        if isinstance(found, tuple):
            values, sizes = found
        else:
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            values = np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum()))
        total, known = len(values), len(self.number)
        old = known - len(words)
        self.flat = self._room(self.flat, self.used + total)
        self.start, self.count, self.hits = (self._room(a, known) for a in (self.start, self.count, self.hits))
        self.flat[self.used : self.used + total] = values
        self.start[old:known] = self.used + np.cumsum(sizes) - sizes
        self.count[old:known] = sizes
        self.hits[old:known] = 0
        self.used += total

    def numbers(self, words: list) -> np.ndarray:
        """Numbers of words, new ones learnt; valid until the next call."""
        if len(self.number) > self.limit or self.used > self.limit * self.IDS_A_WORD:
            self._forget()
        number, new = self.number, []
        at = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(at < 0).tolist():
            w = words[i]
            n = number.get(w)
            if n is None:
                n = number[w] = len(number)
                new.append(w)
            at[i] = n
        if new:
            self._learn(new)
        return at

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all numbered words in order, and the number of ids of each."""
        if len(at) * 8 > len(self.number):
            self.hits[: len(self.number)] += np.bincount(at, minlength=len(self.number))
        else:
            np.add.at(self.hits, at, 1)
        counts = self.count[at]
        return self.flat[runs(self.start[at], counts)], counts

    def of(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the number of ids of each word."""
        return self.ids(self.numbers(words))

    def of_array(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """As ``of``, for many words of which most repeat; they are known as bytes."""
        coded = words.dictionary_encode()
        each = self.numbers(coded.dictionary.cast(pa.binary()).to_pylist())
        return self.ids(each[coded.indices.to_numpy(zero_copy_only=False)])
