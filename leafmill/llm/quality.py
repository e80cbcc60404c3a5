"""Quality classification of documents by hierarchical empirical Bayes.

The evidence of a document is the log odds of a logistic model over its whole text, fitted on labelled
rows: its words and word pairs, hashed into ``LEXICAL`` slots, and some counts of its surface. The prior
of a document is that of its path, which is shrunk towards its host, which is shrunk towards all
documents: at each level the mean of the members' probabilities counts as much as there are members,
and the level above as much as its variance between sites says (method of moments). A document is left
out of the means it is judged by. Sites are aggregated in groups, and met in slices where one of them
owns many documents.

The model is fitted by Newton steps over at most ``LABELLED`` labelled documents, those whose hashed
doc_id is lowest: every step is a job over their features, and the driver gets sums of the square of the
number of features. All else covers all documents.

Defined results: null, empty and blank texts have the features of no words; texts of any length are
read whole; null hosts and paths are sites of that name; repeated rows count and stay, and their labels
are averaged; labels that are null or of unknown documents are ignored; a null doc_id is judged like any
other; without labels of both kinds no text is evidence and all is kept; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.batches import WordIds, bytes_of, lists, text_slices, written
from leafmill.plans.scale import spread_join

LABELLED = 20_000
#: Slots of hashed words, and as many of pairs of neighbours, and parts in which the fit adds up.
LEXICAL, PARTS = 128, 4
MIX = np.uint64(0x9E3779B97F4A7C15)
KEEP_FROM = 0.5
RIDGE = 1.0
FEATURES = ("words", "distinct", "repeated", "capitals", "symbols", "exclaimed", "digits", "word_length", "repeated_lines", "columns")
# places of byte kinds: capitals, small letters, digits, symbols that prose hardly has
KINDS = np.zeros(256, np.int64)
KINDS[65:91], KINDS[97:123], KINDS[48:58] = 1, 2, 3
KINDS[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = 4
SHOUT = re.compile(rb"[!?]{2}").findall


def surface(text: bytes) -> list[float]:
    """Values of ``FEATURES``, each of moderate size for texts of any length."""
    words = text.split()
    n = len(words)
    kinds = np.bincount(KINDS[np.frombuffer(text, np.uint8)], minlength=5).astype(float)
    letters = max(1.0, kinds[1] + kinds[2])
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        len(set(words)) / max(1, n) if n else 1.0,
        sum(map(eq, words, words[1:])) / max(1, n),
        kinds[1] / letters,
        float(np.sqrt(kinds[4] / max(1, len(text)))),
        float(np.sqrt(len(SHOUT(text)) / max(1, n))),
        kinds[3] / max(1, len(text)),
        min(20.0, len(text) / max(1, n)) / 10,
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        text.count(b" | ") / max(1, n),
    ]


class Features:
    """Features of texts: shares of the slots of words and of word pairs, and the surface."""

    SIZE = 2 * LEXICAL + len(FEATURES)

    def __init__(self) -> None:
        self.known = WordIds(lambda words: [(xxhash.xxh3_64_intdigest(w),) for w in words], kind=np.uint64)

    def of(self, batch: pa.RecordBatch, column: str = "text") -> np.ndarray:
        n = batch.num_rows
        texts = pc.ascii_lower(pc.fill_null(batch.column(column), ""))
        found = pc.ascii_split_whitespace(texts)
        words, row = found.flatten(), np.repeat(np.arange(n), found.value_lengths().to_numpy(zero_copy_only=False))
        there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        code, _ = self.known.of_array(words)
        code, row = code[there], row[there]
        shift = np.uint64(64 - (LEXICAL.bit_length() - 1))
        pair = row[1:] == row[:-1]
        second = ((code[:-1] * MIX + code[1:]) * MIX >> shift)[pair].astype(np.int64)
        counts = [
            np.bincount(r * LEXICAL + slot, minlength=n * LEXICAL).reshape(n, LEXICAL)
            for r, slot in ((row, (code * MIX >> shift).astype(np.int64)), (row[1:][pair], second))
        ]
        size = np.maximum(1, np.bincount(row, minlength=n))[:, None]
        return np.hstack([*(np.sqrt(c / size) for c in counts), np.array([surface(t) for t in bytes_of(batch, column)]).reshape(n, -1)])


def fit(rows: DataFrame, ridge: float = RIDGE, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic model of ``rows`` (``x, y``), the last one constant, by Newton steps.

    ``y`` may be fractional. All zero where one kind of label is missing. A step is one pass over the
    rows; features are brought to equal spread first.
    """
    size = Features.SIZE

    def pass_over(work, width: int) -> np.ndarray:
        """Sum of what ``work`` gives for the rows of every task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
                    total += work(x, batch.column("y").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["t"])

        found = rows.coalesce(PARTS).mapInArrow(run, "t binary").collect()  # one row per part
        return np.sum([np.frombuffer(r.t) for r in found], axis=0) if found else np.zeros(width)

    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(y), y.sum(), (y > 0).sum(), (y < 1).sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    n, positive, some, others, *rest = pass_over(moments, 4 + 2 * size)
    if n == 0 or some == 0 or others == 0:
        return np.zeros(size + 1)
    mean = np.array(rest[:size]) / n
    spread = np.sqrt(np.maximum(np.array(rest[size:]) / n - mean * mean, 0.0))
    spread[spread < 1e-9] = 1.0
    w, penalty = np.zeros(size + 1), np.full(size + 1, ridge)
    w[-1], penalty[-1] = np.log((positive + 0.5) / (n - positive + 0.5)), 1e-6
    for _ in range(rounds):
        now = w.copy()

        def newton(x: np.ndarray, y: np.ndarray, now: np.ndarray = now) -> np.ndarray:
            z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
            p = 1 / (1 + np.exp(-np.clip(z @ now, -30, 30)))
            return np.concatenate([z.T @ (y - p), ((z * (p * (1 - p) + 1e-9)[:, None]).T @ z).ravel()])

        sums = pass_over(newton, (size + 1) * (size + 2))
        step = np.linalg.solve(sums[size + 1 :].reshape(size + 1, -1) + np.diag(penalty), sums[: size + 1] - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    raw = w[:-1] / spread
    return np.append(raw, w[-1] - raw @ mean)


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``x, y`` of at most ``most`` labelled documents; their ids are sent to the texts, not the texts."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for batch in batches:
            for part in text_slices(batch, "text"):
                x = made.of(part)
                flat = lists(x.ravel().astype(np.float32), np.full(len(x), x.shape[1]), pa.float32())
                yield pa.RecordBatch.from_arrays([flat, part.column("y")], names=["x", "y"])

    return written(texts.mapInArrow(run, "x array<float>, y double"), "labelled")


def evidence_of(docs: DataFrame, host: Column, path: Column, weights: np.ndarray) -> DataFrame:
    """``doc_id, host, path, odds``: the log odds of every whole text by the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for batch in batches:
            for part in text_slices(batch, "text"):
                odds = np.clip(made.of(part) @ weights[:-1] + weights[-1], -30, 30) if weights.any() else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "host", "path")), pa.array(odds)], names=["doc_id", "host", "path", "odds"])

    used = docs.select("doc_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "text")
    return used.mapInArrow(run, "doc_id bigint, host string, path string, odds double")


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _level(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum("p").alias(f"{name}_sum"), F.count(F.lit(1)).alias(f"{name}_n"))


def _strength(sites: DataFrame, name: str, mean: Column) -> float:
    """How many documents the level above counts for, from the variance between sites."""
    n, m = F.col(f"{name}_n"), F.col(f"{name}_sum") / F.col(f"{name}_n")
    r = sites.select(
        F.sum(n * (m - mean) ** 2).alias("between"), F.sum(mean * (1 - mean)).alias("within"),
        F.sum(n).alias("n"), F.sum(n * n).alias("squares"), F.avg(mean * (1 - mean)).alias("spread"),
    ).first()
    room = (r.n or 0) - (r.squares or 0) / r.n if r.n else 0
    variance = ((r.between or 0.0) - (r.within or 0.0)) / room if room > 0 else 0.0
    return min(1e4, max(1.0, r.spread / variance - 1)) if variance > 0 and r.spread else 1e4


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
             label: str = "quality", keep_from: float = KEEP_FROM, labelled: int = LABELLED) -> DataFrame:
    """``doc_id, evidence, host_prior, path_prior, quality, kept`` of every document.

    ``evidence`` is in log odds, the others are probabilities of good quality. By default the host
    of ``documents`` is the source and its path the source's language.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", "source", "lang") if path is None else path
    sample = labelled_features(docs, labels, label, labelled)
    w = fit(sample)
    sums = sample.agg(F.sum("y").alias("y"), F.count("y").alias("n")).first()
    usual = float(np.log((sums.y + 0.5) / (sums.n - sums.y + 0.5))) if w.any() else 0.0
    rows = evidence_of(docs, host, path, w).withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))
    rows = written(rows, "evidence")
    mean = rows.agg(F.avg("p")).first()[0]
    mean = min(1 - 1e-6, max(1e-6, 0.5 if mean is None else mean))

    hosts = _level(rows, "host", "host")
    a = _strength(hosts, "host", F.lit(mean))
    paths = _level(rows.select(F.struct("host", "path").alias("at"), "p"), "at", "path").select("at.*", "path_sum", "path_n").join(hosts, "host")
    host_mean = (F.col("host_sum") + a * mean) / (F.col("host_n") + a)
    paths = written(paths, "sites")
    b = _strength(paths, "path", host_mean)
    joined = spread_join(rows, paths, ["host", "path"], ["doc_id", "odds"], rows="path_n")
    host_prior = (F.col("host_sum") - F.col("p") + a * mean) / (F.col("host_n") - 1 + a)
    path_prior = (F.col("path_sum") - F.col("p") + b * F.col("host_prior")) / (F.col("path_n") - 1 + b)
    judged = joined.withColumn("host_prior", host_prior).withColumn("path_prior", path_prior)
    evidence = F.col("odds") - usual
    quality = 1 / (1 + F.exp(-(evidence + logit(F.col("path_prior")))))
    out = judged.select("doc_id", evidence.alias("evidence"), "host_prior", "path_prior", quality.alias("quality"))
    kept = F.col("quality") >= keep_from if w.any() else F.lit(True)
    return out.withColumn("kept", kept)
