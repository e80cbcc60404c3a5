"""Packing of token sequences with a controlled mixture of sources.

Every source is a queue of tokens. Windows of ``size`` tokens are filled by a deficit round-robin
over the queues in quanta: a queue earns its target share of every quantum given out, and the next
quantum goes to the queue with the oldest unpaid claim, so that what one window owes is carried to
the next. The j-th quantum of a queue with weight w falls due at (2j + 1) / 2w; the place of every
quantum in the whole output therefore follows from the queue totals alone, by integer arithmetic,
and each task cuts its own documents without knowing the others. Where a queue runs dry, the
others share its part. What earlier partitions hold of a queue is added from one small table.

All tokens are packed, each once; only the last sequence may be short. With the default weights,
each source's share of all tokens, every window keeps the proportions to within a quantum a queue.

Every source has its own queue. The ``MAX_QUEUES - 1`` largest are scheduled by their totals alone, as
above. The others, of which there may be millions, wait in one more queue, whose weight is the sum of
theirs and whose order comes from a second schedule of the same kind: their quanta are sorted by due
time in ranges and given their places by running totals, so that a window has a source's share of it
however small the source is. Weights of all sources are kept to, and a weight for a source that is not
there, or that is not above zero, is refused.

Defined results: a null text is empty and gives its end id alone; a null source is the empty
source; repeated rows are packed as often as they occur; texts of any length are packed whole; other
columns are ignored, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm.batches import WordIds, lists, runs, shared_bytes, text_slices, written
from leafmill.plans.scale import running_totals, spread_join

SIZE = 2048
QUANTUM = 128
END_ID = 1
MAX_QUEUES = 64
KEPT_WORDS = 600_000
#: Rows of the table of queue sizes up to which it is broadcast; beyond, texts are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Words that are encoded in one go, and what stands between them.
JOINED, MARK = 64, b"|"
# Marks at the end of a word, which the tokenizer keeps together and apart from letters
# and digits, as it does with a blank between.
POINTS = r"([a-z0-9])([.,!?;:*%$#&]+)(\s|$)"
SLICE_BYTES = 4 << 20
WEIGHT_UNITS = 1 << 20


class TextIds:
    """Ids of whole texts by a tokenizer whose pre-tokenizer drops white space.

    No token crosses white space, so that the words between blanks are encoded once each. The
    tokenizer must not tell capitals A-Z from small letters.
    """

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(definition.decode())
        if [x.ids for x in tokenizer.encode_batch(["a b", "A \n\tb"], add_special_tokens=False)] != [
            [i for w in "ab" for i in tokenizer.encode(w, add_special_tokens=False).ids]
        ] * 2:
            raise ValueError("the tokenizer must drop white space between words")
        self.tokenizer = tokenizer
        mark = tokenizer.encode(f"a {MARK.decode()} b", add_special_tokens=False).ids
        self.mark = mark[1] if len(mark) == 3 else -1
        self.words = WordIds(self.library, limit=KEPT_WORDS)

    def library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words by the tokenizer and the number of ids of each; many words are encoded in
        one text, with marks between them."""
        between, text = b" " + MARK + b" ", MARK.decode()
        own = [i for i, w in enumerate(words) if self.mark < 0 or MARK in w]
        apart = set(own)
        rest = [w for i, w in enumerate(words) if i not in apart] if own else words
        lots = [between.join(rest[i : i + JOINED]).decode() + " " + text for i in range(0, len(rest), JOINED)]
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(lots, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))
        ends = np.flatnonzero(flat == self.mark)
        counts = np.diff(np.concatenate([[-1], ends])) - 1
        flat = flat[flat != self.mark]
        if own:
            found = [x.ids for x in self.tokenizer.encode_batch_fast([words[i].decode() for i in own], add_special_tokens=False)]
            place = np.array(own) - np.arange(len(own))
            starts = np.concatenate([[0], np.cumsum(counts)])[place]
            sizes = [len(x) for x in found]
            flat = np.insert(flat, np.repeat(starts, sizes), np.fromiter(chain.from_iterable(found), np.int32, sum(sizes)))
            counts = np.insert(counts, place, sizes)
        return flat, counts

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each text."""
        texts = pc.fill_null(texts, "")
        # letters lose their case anyway, but names of special tokens must not gain one
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        # the word before the marks is often known already
        found = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, POINTS, r"\1 \2\3"))
        ids, per_word = self.words.of_array(found.flatten())
        ends = np.concatenate([[0], np.cumsum(per_word)])
        sizes = found.value_lengths().to_numpy(zero_copy_only=False)
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])])


def _text_ids(model: Callable[[], bytes], kept: dict = {}) -> TextIds:  # noqa: B006  one per worker process
    data = model()
    if kept.get("data") is not data:
        kept.update(data=data, ids=TextIds(data))
    return kept["ids"]


def token_queues(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, source, part, before, n, ids``: all texts as ids, written to the shared folder once.

    ``ids`` are little-endian unsigned 32-bit. ``before`` counts the tokens of the same source earlier
    in the same partition ``part``.
    """
    model = shared_bytes(docs.sparkSession, tokenizer_path)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _text_ids(model), TaskContext.get().partitionId()
        passed: dict[str, int] = {}
        for batch in batches:
            for piece in text_slices(batch, "text", SLICE_BYTES):
                ids, counts = encode(piece.column("text"))
                data = np.insert(ids, np.cumsum(counts), end_id).astype("<u4").tobytes()
                counts = counts + 1
                sources, before = piece.column("source"), []
                for source, n in zip(sources.to_pylist(), counts.tolist(), strict=True):
                    at = passed.get(source, 0)
                    before.append(at)
                    passed[source] = at + n
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 4
                kept = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), sources, pa.array([part] * len(before), pa.int32()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), kept],
                    names=["doc_id", "source", "part", "before", "n", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    queued = rows.mapInArrow(run, f"doc_id {kind}, source string, part int, before bigint, n bigint, ids binary")
    return written(queued, "token-queues")


class Schedule:
    """Place of every quantum of every queue, from the queues' totals and weights."""

    def __init__(self, totals: list[int], weights: list[float], quantum: int):
        self.quantum = quantum
        self.total = np.array(totals, np.int64)
        self.slots = -(-self.total // quantum)
        self.short = self.slots * quantum - self.total
        share = np.array(weights, float) / (sum(weights) or 1)
        self.weight = np.maximum(1, np.rint(share * WEIGHT_UNITS)).astype(np.int64)

    def place(self, queue: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """First token place of each quantum in the whole output."""
        at = np.zeros(len(slot), np.int64)
        odd, own = 2 * slot + 1, self.weight[queue]
        for q, (w, n, short) in enumerate(zip(self.weight, self.slots, self.short, strict=True)):
            # quanta of q that fall due before this one; on equal claims the lower queue goes first
            due = odd * w - (q >= queue)
            before = np.where(queue == q, slot, np.minimum((due // own + 1) // 2, n))
            at += before * self.quantum - np.where(before == n, short, 0)
        return at


def _pieces(schedule: Schedule, size: int, queue: np.ndarray, begin: np.ndarray, count: np.ndarray):
    """Pieces of token runs ``[begin, begin + count)`` of queues: row, start in it, length, place."""
    q = schedule.quantum
    first, last = begin // q, (begin + count - 1) // q
    row = np.repeat(np.arange(len(begin)), last - first + 1)
    slot = runs(first, last - first + 1)
    a = np.maximum(begin[row], slot * q)
    b = np.minimum((begin + count)[row], (slot + 1) * q)
    at = schedule.place(queue[row], slot) + a - slot * q
    # cut where a window ends
    inner = np.minimum(b - a, size - at % size)
    over = np.flatnonzero(inner < b - a)
    row, a, at, n = (
        np.insert(x, over + 1, y)
        for x, y in ((row, row[over]), (a, (a + inner)[over]), (at, (at + inner)[over]), (inner, (b - a - inner)[over]))
    )
    # join what lies side by side in the same window
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + n[:-1]) | (at[1:] % size == 0)
    heads = np.flatnonzero(new)
    return row[heads], (a - begin[row])[heads], np.add.reduceat(n, heads) if len(heads) else n, at[heads]


def _mixed(rows: DataFrame, weights: DataFrame, quantum: int) -> DataFrame:
    """``rows`` (``source, part, before, begin, n``) with their ``runs`` (``start, n, begin``) in one queue
    that holds all their sources, mixed by ``weights`` (``source, weight``).

    ``begin`` is a place in the source's own queue before, and in the common one after. Where many
    sources weigh alike, their quanta would fall due at once: each has a phase of its own instead.
    """
    slot, q = F.col("slot"), F.lit(quantum).cast("long")
    cut = rows.withColumn("slot", F.explode(F.sequence(F.floor(F.col("begin") / q), F.floor((F.col("begin") + F.col("n") - 1) / q))))
    first, last = F.greatest("begin", slot * q), F.least(F.col("begin") + F.col("n"), (slot + 1) * q)
    phase = (F.pmod(F.xxhash64("source"), F.lit(WEIGHT_UNITS)) + 0.5) / WEIGHT_UNITS
    quanta = spread_join(cut, weights, ["source"], ["slot"]).select(
        "source", "part", "before", F.lit(0).alias("_all"), ((slot + phase) / F.col("weight")).alias("due"), "slot",
        (first - F.col("begin")).alias("start"), (last - first).alias("size"), first.alias("first"),
    )
    placed = running_totals(quanta, "_all", ["due", "source", "slot", "first"], "size")
    one = F.struct("start", F.col("size").alias("n"), F.col("_before").alias("begin"))
    return placed.groupBy("source", "part", "before").agg(F.array_sort(F.collect_list(one)).alias("runs"))


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, quantum: int = QUANTUM,
         weights: dict[str, float] | None = None, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pieces of sequences: ``doc_id, source, start, length, doc_tokens, sequence_id, offset,
    ids_crc32`` and, with ``keep_ids``, their ``ids``.

    ``weights`` gives target proportions by source (sources not named share what their tokens
    weigh); by default all are weighted by their tokens. ``quantum`` must not exceed ``size``.
    """
    if not 0 < quantum <= size:
        raise ValueError("a quantum has at least one token and at most a window")
    given = weights or {}
    if not all(w > 0 for w in given.values()):
        raise ValueError("a weight is above zero")
    spark = docs.sparkSession
    queued = token_queues(docs, tokenizer_path, end_id)
    sizes = written(queued.groupBy("part", "source").agg(F.sum("n").alias("n")), "queue-sizes")
    totals = sizes.groupBy("source").agg(F.sum("n").alias("n"))
    if given:
        absent = given.keys() - {r.source for r in totals.filter(F.col("source").isin(*given)).select("source").collect()}
        if absent:
            raise ValueError(f"weights for sources that are not there: {', '.join(sorted(absent))}")
    all_tokens, sources = (x or 0 for x in totals.agg(F.sum("n"), F.count("*")).first())
    largest = totals.orderBy(F.desc("n"), "source").limit(MAX_QUEUES - 1).collect()
    own = {r.source: at for at, r in enumerate(largest)}
    counts = [r.n for r in largest]
    targets = [given.get(r.source, r.n / max(all_tokens, 1)) for r in largest]

    bases = running_totals(sizes, "source", ["part"], "n").select("part", "source", F.col("_before").alias("base"))
    if sizes.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    begun = queued.join(bases, ["part", "source"]).withColumn("begin", F.col("base") + F.col("before"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), "n", "begin"))
    placed = begun.withColumn("runs", whole)
    if own:
        known = F.create_map(*(F.lit(x) for pair in own.items() for x in pair))
        placed = placed.withColumn("queue", F.coalesce(known[F.col("source")], F.lit(len(own))))
    else:
        placed = placed.withColumn("queue", F.lit(0))
    if sources > len(own):
        few = placed.filter(F.col("queue") == len(own))
        named = spark.createDataFrame([(k, float(w)) for k, w in given.items()], "source string, given double") if given else None
        natural = F.col("n") / all_tokens
        tail = totals.filter(~F.col("source").isin(*own))
        tail = tail.join(F.broadcast(named), "source", "left").withColumn("weight", F.coalesce("given", natural)) if given else tail.withColumn("weight", natural)
        tail = written(tail.select("source", "n", "weight"), "small-queues")
        rest = tail.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
        counts.append(rest.n)
        targets.append(rest.weight)
        mixed = _mixed(few.select("source", "part", "before", "begin", "n"), tail.select("source", "weight"), quantum)
        placed = placed.filter(F.col("queue") < len(own)).unionByName(few.drop("runs").join(mixed, ["source", "part", "before"]).select(*placed.columns))
    schedule = Schedule(counts or [0], targets or [1.0], quantum)
    placed = placed.select("doc_id", "source", "n", "ids", "queue", "runs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, source string, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                column = part.column("runs")
                each = np.repeat(np.arange(part.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
                held = column.flatten()
                inside, many, begin = (held.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "begin"))
                queue = part.column("queue").to_numpy(zero_copy_only=False).astype(np.int64)
                count = part.column("n").to_numpy(zero_copy_only=False)
                span, start, length, place = _pieces(schedule, size, queue[each], begin, many)
                row, start = each[span], start + inside[span]
                ids = [memoryview(x) for x in part.column("ids").to_pylist()]
                cut = [ids[r][4 * a : 4 * (a + n)] for r, a, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                new = [start, length, count[row], place // size, place % size, np.array([*map(zlib.crc32, cut)], np.int64)]
                taken = pa.array(row)
                out = [part.column("doc_id").take(taken), part.column("source").take(taken), *map(pa.array, new)]
                if keep_ids:
                    out.append(lists(np.frombuffer(b"".join(cut), "<u4").astype(np.int32), length, pa.int32()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"][: len(out)])

    return placed.mapInArrow(run, fields + (", ids array<int>" if keep_ids else ""))


def sequences(pieces: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids, n_tokens``: pieces put together and padded to ``size``.

    A sequence whose length is a power of two is left as it is.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))
    n = F.size("ids")
    padding = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(size) - n)
    return joined.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), padding)).alias("ids"), n.cast("long").alias("n_tokens"))
