"""I-Match fingerprints: hashes of the sorted in-band terms of several random lexicon subsets.

Terms are the words between ASCII blanks, A-Z in lower case. The lexicon is every term whose
inverse document frequency ln(N / df) lies in a band. Its upper end bounds the lexicon whatever
the corpus: a term occurs in at least N * exp(-upper) documents, so there are at most exp(upper)
times the mean number of distinct terms of a document. That bound is what is broadcast.

A subset keeps each term by the term's own hash, at one of several rates, so that long and short
texts alike have subsets with a few terms. A subset hash covers the sorted distinct terms that a
text has of the subset; the fingerprint joins them. Likeness is the share of equal hashes among
the subsets in which either text has terms. A text without terms in the band uses all its terms.

Defined results: null is the empty text, whose fingerprint is that of no terms; two such texts are
alike (1). Equal texts have equal fingerprints. Repeated rows stay; the order of equal doc_ids is
by a hash of the text. Texts of any length are read whole. Other columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.batches import bytes_of, text_slices, written

#: Band of ln(N / df): no words of every second text, no words of fewer than one text in 1,000.
LOWER, UPPER = math.log(2), math.log(1000)
#: Rates at which subsets keep terms, and the number of subsets of each rate.
RATES, SUBSETS = (1 / 2, 1 / 8, 1 / 32, 1 / 128), 8
NONE = "-"
#: Distinct terms a task adds up before it sends them on.
KEPT_TERMS = 800_000
#: Bytes of text in a partition of neighbouring documents, unless the session asks for more partitions.
PART_BYTES = 64 << 20


def terms_of(text: bytes) -> set[bytes]:
    return set(text.lower().split())


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, df`` over all documents; each task adds up what it has read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for part in text_slices(batch, text):
                for data in bytes_of(part, text):
                    for term in terms_of(data):
                        held[term] = held.get(term, 0) + 1
                if len(held) > KEPT_TERMS:
                    yield out()
                    held.clear()
        yield out()

    partial = docs.select(text).mapInArrow(run, "term binary, n bigint")
    return partial.groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, text: str = "text", lower: float = LOWER, upper: float = UPPER) -> list[bytes]:
    """Sorted terms of the band; bounded by ``upper`` and the mean size of a text, see above."""
    total = docs.count()
    within = document_frequencies(docs, text).filter(
        (F.col("df") >= total * math.exp(-upper)) & (F.col("df") <= total * math.exp(-lower))
    )
    return sorted(bytes(r.term) for r in within.select("term").toLocalIterator())


class Fingerprints:
    """Fingerprints of texts over one lexicon."""

    def __init__(self, terms: Iterable[bytes]):
        self.places = {t: self._member(t) for t in terms}

    @staticmethod
    def _member(term: bytes) -> list[int]:
        """Subsets that keep the term."""
        raw = np.frombuffer(hashlib.blake2b(term, digest_size=SUBSETS * len(RATES) * 2).digest(), "<u2")
        limits = np.repeat([r * 65536 for r in RATES], SUBSETS)
        return np.flatnonzero(raw < limits).tolist()

    def of(self, text: bytes) -> str:
        own = terms_of(text)
        kept = sorted(own & self.places.keys())
        members = self.places
        if not kept:
            kept, members = sorted(own), None
        groups: list[list[bytes]] = [[] for _ in range(SUBSETS * len(RATES))]
        for term in kept:
            for k in members[term] if members is not None else self._member(term):
                groups[k].append(term)
        return ".".join(hashlib.blake2b(b"\n".join(g), digest_size=4).hexdigest() if g else NONE for g in groups)


def likeness(a: str, b: str) -> float:
    """Share of equal subset hashes among the subsets in which either text has terms."""
    if a == b:
        return 1.0
    pairs = [(x, y) for x, y in zip(a.split("."), b.split("."), strict=True) if x != NONE or y != NONE]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", terms: list[bytes] | None = None) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text) if terms is None else terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Fingerprints(shared.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [made.of(t) for t in bytes_of(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    used = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return used.mapInArrow(run, f"doc_id {used.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and how like they and the next text are.

    Texts, compressed, are placed once by ranges of ``doc_id`` and a hash of the text, so that Spark's
    sampling of these keys carries no text to the driver. Each task pairs neighbours as it reads; only
    the first and last text of every partition are paired across partitions.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(lexicon(docs))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array(map(pack, bytes_of(part, "text")), pa.binary())],
                    names=["doc_id", "mark", "data"],
                )

    # a fixed number of partitions: both readers below see the same ones
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    marked = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    packed = marked.mapInArrow(compress, f"doc_id {kind}, mark bigint, data binary")
    ranged = packed.repartitionByRange(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "data")

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Rows of a batch with their texts unpacked one by one."""
        unpack = zstandard.ZstdDecompressor().decompress
        for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
            yield key, unpack(data).decode("utf-8", "surrogatepass")

    def report(made: Fingerprints, a: tuple, b: tuple, marks: tuple[str, str]) -> tuple:
        edited = edited_text(a[1], b[1])
        data = edited.encode("utf-8", "surrogatepass")
        mark = made.of(data)
        return a[0], len(a[1]), hashlib.sha256(data).hexdigest(), marks[0], mark, likeness(marks[0], mark), likeness(*marks)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), REPORT, strict=True)], schema=REPORT)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, last, mark = Fingerprints(shared.value), None, ""
        for batch in batches:
            rows = []
            for item in read(batch):
                new = made.of(item[1].encode("utf-8", "surrogatepass"))
                if last is not None:
                    rows.append(report(made, last, item, (mark, new)))
                last, mark = item, new
            if rows:
                yield table(rows)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.slice(0, 1) if first is None else first
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([at]), first.column("data"), last.column("doc_id"), last.column("data")], names=["part", "first", "doc_id", "data"])

    # a row per partition: its first and last text, and, by the numbers alone, which one is next
    borders = written(ranged.mapInArrow(ends, f"part bigint, first binary, doc_id {kind}, data binary"), "borders")
    order = Window.orderBy("part")
    after = F.coalesce(F.lead("part").over(order), F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    nexts = borders.select("part").select("part", after.alias("next"))
    firsts = borders.select(F.col("part").alias("next"), F.col("first").alias("following"))
    pairs = borders.select("part", "doc_id", "data").join(nexts, "part").join(firsts, "next").select("doc_id", "data", "following")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, unpack = Fingerprints(shared.value), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for item, data in zip(read(batch), batch.column("following").to_pylist(), strict=True):
                raw = unpack(data)
                marks = made.of(item[1].encode("utf-8", "surrogatepass")), made.of(raw)
                rows.append(report(made, item, (None, raw.decode("utf-8", "surrogatepass")), marks))
            if rows:
                yield table(rows)

    fields = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ranged.mapInArrow(inner, fields).unionByName(pairs.mapInArrow(across, fields))


REPORT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
