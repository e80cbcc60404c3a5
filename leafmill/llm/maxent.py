"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is that of its class after the two tokens before it, times that of the word
within its class after the word before. Classes: the end and the most frequent words have one each,
all other words share classes by a hash of their ending, and one class stands for every word that
training has not seen; its mass comes from words seen once.

The class scores are a maximum-entropy model over features of the history: the word before (n-gram),
the class two back (skip), and both as classes together, hashed into weights. The ``MOST_HISTORY`` most
frequent words are themselves features of what follows them, rarer ones by their class. What training
needs of the text are sums: how often each history occurs, and each class after each feature.

Within a class, words that are among the most frequent, one of ``PER_OWN`` distinct words and ``MOST_OWN``
at most, have a feature for every such word they follow ``LEAST_PAIR`` times or more. These do not
overlap, so that their maximum-entropy weights have a closed form: after the word before, the words
with a feature get their share of the counts less a discount, and the rest of the class shares what is
left in proportion to its own counts. All pairs count: the most frequent ones, ``MOST_PAIRS`` at most, are
sent out, and the tokens of all others meet their weights in a join, summed up by text. Either softmax
sums to one over the whole vocabulary and the unknown word.

Training sums over all training text, by grouped aggregation, which loses nothing for these features,
and then takes gradient steps: every step is a Spark job over the table of histories, each task
adding up its part of the gradient. Texts are scored in batches, in which every distinct history is
worked out once.

Words never meet in one place: a block of texts numbers its own words, the distinct words of each
block are joined with the corpus counts, and come back to their block.

Defined results: a null text is empty and holds the end alone; texts of any length are read whole;
repeated rows count as often as they occur; a null doc_id is hashed as the empty text; equally frequent
words are ordered by their key; other columns are ignored, whatever their names; without training text
every token is unknown. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.batches import Scratch, bytes_of, give_back, lists, text_slices, written

FOLDS, HELD_OUT = 7, 2
#: Classes: the end, the unknown, frequent words, endings.
END, UNKNOWN, FREQUENT, ENDINGS = 0, 1, 46, 48
CLASSES = 2 + FREQUENT + ENDINGS
#: Words with pairs of their own: one of so many distinct ones, and so many at most; and words that are
#: features of the class after them.
PER_OWN, MOST_OWN, MOST_HISTORY = 8, 8192, 1024
#: Occurrences from which pairs of them have a feature within the class, how many of those pairs are sent
#: out at most (the others are joined), and what their counts are lowered by.
LEAST_PAIR, MOST_PAIRS, DISCOUNT = 4, 1 << 20, 0.5
#: Bytes of text in a block that shares word numbers.
BLOCK_BYTES = 12 << 20
STEPS, RATE, DECAY, PARTS = 8, 0.3, 1e-7, 8
END_WORD = b"\n"  # no word holds white space


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def ending_of(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % ENDINGS


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == HELD_OUT


def blocks(docs: DataFrame, write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """Texts as word numbers of their block, and each block's distinct words with training counts.

    ``block, doc_id, held_out, ids`` (little-endian 32 bit) and, in the last row of a block, with
    null ``ids``, ``keys, counts, endings`` by word number. Written to the shared folder once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 16
        number: dict[bytes, int] = {}
        counts = np.zeros(1 << 16, np.int64)
        size = 0

        def last() -> pa.RecordBatch:
            n = len(number)
            keys = np.fromiter(map(word_key, number), np.int64, n)
            endings = np.fromiter(map(ending_of, number), np.int32, n)
            one = np.array([n])
            held = [lists(keys, one, pa.int64()), lists(counts[:n], one, pa.int64()), lists(endings, one, pa.int32())]
            none = [pa.nulls(1, f.type) for f in list(SCHEMA)[1:4]]
            return pa.RecordBatch.from_arrays([pa.array([block]), *none, *held], schema=SCHEMA)

        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = {"doc_id": part.column("doc_id").to_pylist(), "held_out": [], "ids": []}
                for doc_id, text in zip(rows["doc_id"], bytes_of(part, "text"), strict=True):
                    words = text.lower().split()
                    words.append(END_WORD)
                    ids = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
                    for i in np.flatnonzero(ids < 0).tolist():
                        ids[i] = number.setdefault(words[i], len(number))
                    if len(number) > len(counts):
                        counts = np.concatenate([counts, np.zeros(max(len(counts), len(number) - len(counts)), np.int64)])
                    out = held_out(doc_id)
                    if not out:
                        counts[: len(number)] += np.bincount(ids, minlength=len(number)) if len(ids) * 8 > len(number) else 0
                        if len(ids) * 8 <= len(number):
                            np.add.at(counts, ids, 1)
                    rows["held_out"].append(out)
                    rows["ids"].append(ids.tobytes())
                    size += len(text) + 1
                n = part.num_rows
                none = [None] * n
                yield pa.RecordBatch.from_pydict({"block": [block] * n, **rows, "keys": none, "counts": none, "endings": none}, SCHEMA)
                if size > BLOCK_BYTES:
                    yield last()
                    block, size = block + 1, 0
                    number.clear()
                    counts[:] = 0
        if number:
            yield last()
        number.clear()
        give_back()

    fields = "block bigint, doc_id bigint, held_out boolean, ids binary, keys array<bigint>, counts array<bigint>, endings array<int>"
    return write(docs.select("doc_id", "text").mapInArrow(run, fields), "word-blocks")


SCHEMA = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()),
    ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("endings", pa.list_(pa.int32())),
])


class Vocabulary:
    """Counts of all training words, and what follows from them for the model.

    A word's row stands for it in features: those of own words come after ``CLASSES`` rows for the
    others by their class, and as many for words seen once.
    """

    def __init__(self, numbered: DataFrame):
        flat = numbered.filter("ids IS NULL").select("block", F.posexplode(F.arrays_zip("keys", "counts", "endings")).alias("number", "w"))
        self.words = flat.select("block", "number", F.col("w.keys").alias("key"), F.col("w.counts").alias("n"), F.col("w.endings").alias("ending"))
        counted = self.words.groupBy("key").agg(F.sum("n").alias("c"), F.first("ending").alias("ending")).filter("c > 0")
        self.counts = written(counted, "word-counts")
        others = self.counts.filter(F.col("key") != word_key(END_WORD))
        many = min(MOST_OWN, others.count() // PER_OWN)
        top = others.orderBy(F.desc("c"), "key").limit(FREQUENT + many).collect()  # bounded by MOST_OWN
        special = [(word_key(END_WORD), END, END)]
        special += [(r.key, 2 + i, 2 + i) for i, r in enumerate(top[:FREQUENT])]
        own = [(r.key, r.ending + 2 + FREQUENT, 2 * CLASSES + i) for i, r in enumerate(top[FREQUENT:])]
        self.kind_of_row = np.array([*range(CLASSES), *range(CLASSES), *(kind for _, kind, _ in own)], np.int64)
        self.own_counts = np.array([r.c for r in top[FREQUENT:]], np.float64)
        table = numbered.sparkSession.createDataFrame(special + own, "key bigint, _class int, _row int")
        kind = F.coalesce("_class", F.col("ending") + 2 + FREQUENT)
        row = F.coalesce("_row", kind + F.when(F.col("c") == 1, CLASSES).otherwise(0))
        self.classed = self.counts.join(F.broadcast(table), "key", "left").select("key", "c", kind.alias("class"), row.alias("row"))
        weight = F.when(F.col("c") == 1, 0.5).otherwise(F.col("c").cast("double"))
        sums = self.classed.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(weight).alias("w")).collect()
        self.total = sum(r.n for r in sums)
        self.distinct = sum(r.v for r in sums)
        self.mass = np.ones(CLASSES)
        for r in sums:
            self.mass[r["class"]] = r.w

    @property
    def rows(self) -> int:
        return len(self.kind_of_row)

    @property
    def past(self) -> np.ndarray:
        """Row as which each row is history of the classes: its own for the most frequent words."""
        row = np.arange(self.rows)
        return np.where(row < 2 * CLASSES + MOST_HISTORY, row, self.kind_of_row)

    @property
    def histories(self) -> int:
        return min(self.rows, 2 * CLASSES + MOST_HISTORY)


def row_sequences(numbered: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Texts as rows, with all that counts alone decide: ``at, doc_id, held_out, n_tokens, n_known,
    base_score, within_score, rows`` (little-endian 16 bit); ``at`` is another number for every text."""
    total, distinct, mass = vocabulary.total, vocabulary.distinct, vocabulary.mass
    found = vocabulary.words.select("block", "number", "key").join(vocabulary.classed, "key", "left").select(
        "block", "number", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", F.lit(UNKNOWN)).cast("int").alias("class"),
        F.coalesce("row", F.lit(UNKNOWN)).cast("int").alias("row"),
    )
    texts = numbered.filter("ids IS NOT NULL").select("block", "doc_id", "held_out", "ids")
    # a block has less than 1 << 24 texts, as each takes a byte at least

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        give_back()  # what the block before has left
        c, kind, row = np.zeros(words.num_rows, np.int64), np.zeros(words.num_rows, np.int64), np.zeros(words.num_rows, "<u2")
        at = words.column("number").to_numpy()
        c[at], kind[at], row[at] = (words.column(x).to_numpy() for x in ("c", "class", "row"))
        base = np.log10((c + 1) / (total + distinct + 1))
        within = np.where(c > 0, np.log10(np.where(c == 1, 0.5, np.maximum(c, 1)) / mass[kind]), 0.0)
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "within_score", "rows")}
        for data in texts.column("ids").to_pylist():
            ids = np.frombuffer(data, "<i4")
            out["n_tokens"].append(len(ids))
            out["n_known"].append(int((c[ids] > 0).sum()))
            out["base_score"].append(float(base[ids].sum()))
            out["within_score"].append(float(within[ids].sum()))
            out["rows"].append(row[ids].tobytes())
        numbers = pc.add(pc.shift_left(texts.column("block"), 24), pa.array(np.arange(texts.num_rows)))
        return pa.table({"at": numbers, "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), **out}, schema=CODED)

    grouped = texts.groupBy("block").cogroup(found.withColumnRenamed("block", "of_block").groupBy("of_block")).applyInArrow(
        run, "at bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, within_score double, rows binary"
    )
    return written(grouped, "row-sequences")


CODED = pa.schema([
    ("at", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("within_score", pa.float64()), ("rows", pa.binary()),
])


def tokens_of(texts: list[bytes], kind_of_row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all tokens: class two back, row before, own row, seen once; tokens per text.

    Before a text stands its end, twice.
    """
    data = np.frombuffer(b"".join(bytes(4) + t for t in texts), "<u2").astype(np.int64)
    sizes = np.array([len(t) // 2 for t in texts], np.int64)
    once = (data >= CLASSES) & (data < 2 * CLASSES)
    # as history, a word seen once is like one never seen
    past = np.where(once, UNKNOWN, data)
    tokens = np.ones(len(data), bool)
    starts = np.cumsum(sizes + 2) - sizes - 2
    tokens[starts] = tokens[starts + 1] = False
    at = np.flatnonzero(tokens)
    return kind_of_row[past[at - 2]], past[at - 1], data[at], once[at], sizes


class Sums:
    """Sums by integer code, of any number of codes; ``out`` gives them on and starts anew."""

    def __init__(self, most: int = 1_200_000):
        self.most, self.held = most, 0
        self.codes: list[np.ndarray] = []
        self.values: list[np.ndarray] = []

    def add(self, codes: np.ndarray, values: np.ndarray) -> bool:
        """Whether there are now so many codes that they should go out."""
        once, at = np.unique(codes, return_inverse=True)
        self.codes.append(once)
        self.values.append(np.bincount(at, values, minlength=len(once)))
        self.held += len(once)
        if self.held > self.most:
            codes, values = np.concatenate(self.codes), np.concatenate(self.values)
            once, at = np.unique(codes, return_inverse=True)
            self.codes, self.values, self.held = [once], [np.bincount(at, values, minlength=len(once))], len(once)
        return self.held > self.most // 2 and len(self.codes) == 1

    def out(self, name: str) -> Iterator[pa.RecordBatch]:
        if self.codes:
            codes, values = np.concatenate(self.codes), np.concatenate(self.values)
            for at in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + 100_000]), pa.array(values[at : at + 100_000])], names=[name, "n"])
        self.codes, self.values, self.held = [], [], 0
        give_back()


def _summed(coded: DataFrame, codes: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]], name: str) -> DataFrame:
    """``name, n``: sums of what ``codes`` gives for all training texts; added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for found, weight in codes(batch.column("rows").slice(at, 1024).to_pylist()):
                    if sums.add(found, weight):
                        yield from sums.out(name)
        yield from sums.out(name)

    cells = coded.filter("NOT held_out").select("rows").mapInArrow(run, f"{name} bigint, n double")
    return cells.groupBy(name).agg(F.sum("n").alias("n"))


def history_counts(coded: DataFrame, vocabulary: Vocabulary) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """What the class scores are trained on, from all training text: ``place, n`` of every history, and
    the weight of every class after each row (histories x classes) and each two classes.

    A place is ``class two back * histories + row before``.
    """
    kinds, past, most = vocabulary.kind_of_row, vocabulary.past, vocabulary.histories
    after_row = CLASSES * most  # codes of places, then of classes after rows, then after two classes
    after_two = after_row + most * CLASSES

    def codes(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        two, one, own, once, _ = tokens_of(texts, kinds)
        one, weight, kind = past[one], np.where(once, 0.5, 1.0), kinds[own]
        both = two * CLASSES + kinds[one]
        out = [(two * most + one, np.ones(len(own))), (after_row + one * CLASSES + kind, weight), (after_two + both * CLASSES + kind, weight)]
        if once.any():  # half of a word seen once is the unknown word
            half = np.full(int(once.sum()), 0.5)
            out += [(after_row + one[once] * CLASSES + UNKNOWN, half), (after_two + both[once] * CLASSES + UNKNOWN, half)]
        return out

    summed = written(_summed(coded, codes, "code"), "history-sums")
    held = summed.filter(F.col("code") >= after_row).toArrow()  # bounded by the numbers of classes and histories
    sums = np.zeros(most * CLASSES + CLASSES**3)
    sums[held.column("code").to_numpy() - after_row] = held.column("n").to_numpy()
    places = summed.filter(F.col("code") < after_row).select(F.col("code").alias("place"), "n").repartition(PARTS, "place")
    return written(places, "histories"), sums[: most * CLASSES].reshape(most, CLASSES), sums[most * CLASSES :].reshape(CLASSES, CLASSES, CLASSES)


class Pairs:
    """Weights of word pairs within a class: natural logs to add to what counts alone give.

    ``late`` has the pairs that are not sent out, ``pair, gain``: what to add to ``gain`` for each of
    their tokens. ``late_bits`` has a bit for each of them.
    """

    def __init__(self, codes: np.ndarray, gains: np.ndarray, groups: np.ndarray, rests: np.ndarray, kind_of_row: np.ndarray,
                 late: DataFrame | None = None, late_bits: np.ndarray | None = None):
        self.codes, self.gains, self.groups, self.rests = codes, gains, groups, rests
        self.kind_of_row, self.late, self.late_bits = kind_of_row, late, late_bits

    def sent(self) -> Pairs:
        """What tasks need."""
        return Pairs(self.codes, self.gains, self.groups, self.rests, self.kind_of_row, None, self.late_bits)

    @staticmethod
    def _found(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_codes, codes), max(0, len(sorted_codes) - 1))
        return at, sorted_codes[at] == codes if len(sorted_codes) else np.zeros(len(codes), bool)

    def gain(self, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What the word before adds to each word, given its class; for late pairs, as if they had no feature."""
        out = np.zeros(len(own))
        at, has = self._found(self.groups, before * CLASSES + self.kind_of_row[own])
        out[has] = self.rests[at[has]]
        at, has = self._found(self.codes, before * len(self.kind_of_row) + own)
        out[has] = self.gains[at[has]]
        return out

    def is_late(self, pairs: np.ndarray) -> np.ndarray:
        return (self.late_bits[pairs >> 6] >> (pairs & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def pair_weights(coded: DataFrame, vocabulary: Vocabulary) -> Pairs:
    """Weights of all pairs of an own or frequent word and an own word after it, from all training text."""
    kinds, rows, spark = vocabulary.kind_of_row, vocabulary.rows, coded.sparkSession
    scratch = Scratch(spark)

    def codes(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        _, one, own, once, _ = tokens_of(texts, kinds)
        # the row before decides; words after it without a row of their own count for their class alone
        return [(one * rows + own, np.where(once, 0.5, 1.0))]

    counted = scratch.written(_summed(coded, codes, "pair"), "pairs")
    plain = np.zeros(rows)
    plain[2 * CLASSES :] = vocabulary.own_counts / vocabulary.mass[kinds[2 * CLASSES :]]
    of_rows = spark.createDataFrame(list(zip(range(rows), kinds.tolist(), plain.tolist(), strict=True)), "row bigint, kind bigint, plain double")
    placed = counted.withColumn("row", F.pmod("pair", F.lit(rows))).join(F.broadcast(of_rows), "row").select(
        "pair", "n", "plain", (F.floor(F.col("pair") / rows) * CLASSES + F.col("kind")).alias("group"),
        ((F.col("row") >= 2 * CLASSES) & (F.col("n") >= LEAST_PAIR)).alias("strong"),
    )
    # of each class after each row that has such a pair; a class that is covered as a whole keeps to its counts
    taken, covered = F.sum(F.when(F.col("strong"), F.col("n") - DISCOUNT)), F.sum(F.when(F.col("strong"), F.col("plain")))
    whole = placed.groupBy("group").agg(F.sum("n").alias("total"), taken.alias("taken"), covered.alias("covered")).filter(F.col("covered") < 1 - 1e-6)
    rest = F.log((1 - F.col("taken") / F.col("total")) / (1 - F.col("covered")))
    whole = written(whole.select("group", "total", rest.alias("rest")), "pair-groups")
    strong = placed.filter("strong").join(whole, "group")
    gain = F.log((F.col("n") - DISCOUNT) / F.col("total") / F.col("plain"))
    size = F.floor(F.log2("n") * 16).alias("size")
    strong = written(strong.select("pair", size, gain.alias("gain"), (gain - F.col("rest")).alias("more")), "strong-pairs")
    scratch.drop_all()

    sizes = sorted(((r["size"], r["count"]) for r in strong.groupBy("size").count().collect()), reverse=True)
    least, room = math.inf, MOST_PAIRS
    for of_size, n in sizes:
        room -= n
        if room < 0:
            break
        least = of_size

    def held(table: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order and their values."""
        found = table.select(key, value).toArrow()
        keys, values = (found.column(c).to_numpy() for c in (key, value))
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]

    late = late_bits = None
    if room < 0:
        late = strong.filter(F.col("size") < least).select("pair", F.col("more").alias("gain"))
        bit = F.expr("bit_or(shiftleft(1L, CAST(pair & 63 AS INT)))")
        words, bits = held(late.groupBy(F.shiftright("pair", 6).alias("word")).agg(bit.alias("bits")), "word", "bits")
        late_bits = np.zeros(rows * rows // 64 + 1, np.uint64)  # a bit for each pair of rows
        late_bits[words] = bits.view(np.uint64)
    return Pairs(*held(strong.filter(F.col("size") >= least), "pair", "gain"), *held(whole, "group", "rest"), kinds, late, late_bits)


def late_gains(coded: DataFrame, late: DataFrame, pairs: Broadcast[Pairs]) -> DataFrame:
    """``at, late``: by text, the sum of what the pairs in ``late`` add; texts without such pairs are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pairs.value.kind_of_row
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                _, one, own, _, sizes = tokens_of(part.column("rows").to_pylist(), kinds)
                codes = one * len(kinds) + own
                found = np.flatnonzero(pairs.value.is_late(codes))
                at = np.repeat(part.column("at").to_numpy(), sizes)[found]
                for k in range(0, len(found), 100_000):
                    some = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(at[some]), pa.array(codes[found[some]])], names=["at", "pair"])

    met = coded.select("at", "rows").mapInArrow(run, "at bigint, pair bigint").join(late, "pair")
    return met.groupBy("at").agg(F.sum("gain").alias("late"))


class Weights:
    """Bias, n-gram, skip and hashed weights as one vector, for so many rows of the word before."""

    def __init__(self, kind_of_row: np.ndarray, values: np.ndarray | None = None):
        n, self.kinds, self.rows = CLASSES, kind_of_row, len(kind_of_row)
        self.bits = max(17, math.ceil(math.log2(self.rows * n)))  # follows the words
        self.size = n + self.rows * n + n * n + (1 << self.bits)
        self.values = np.zeros(self.size) if values is None else values
        self.bias, self.before = self.values[:n], self.values[n : n + self.rows * n].reshape(self.rows, n)
        self.skip = self.values[n + self.rows * n : n + self.rows * n + n * n].reshape(n, n)
        self.hashed = self.values[n + self.rows * n + n * n :]

    def slots(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Hashed weights of two classes and every class after them."""
        cell = (two * CLASSES + one)[:, None].astype(np.uint64) * np.uint64(CLASSES) + np.arange(CLASSES, dtype=np.uint64)
        return ((cell * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def scores(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of every class after each history, and the hashed weights they use."""
        two, one = places // self.rows, places % self.rows
        slots = self.slots(two, self.kinds[one])
        return self.bias + self.before[one] + self.skip[two] + self.hashed[slots], slots

    def log_softmax(self, places: np.ndarray) -> np.ndarray:
        """Natural log probability of every class after each history."""
        s, _ = self.scores(places)
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    def add_expected(self, into: Weights, places: np.ndarray, n: np.ndarray) -> float:
        """Adds what the model expects after ``n`` times each history; gives the sum of the log
        normalisers."""
        s, slots = self.scores(places)
        top = s.max(axis=1, keepdims=True)
        raised = np.exp(s - top)
        whole = raised.sum(axis=1, keepdims=True)
        expected = raised * (n[:, None] / whole)
        into.bias += expected.sum(axis=0)
        np.add.at(into.before, places % self.rows, expected)
        np.add.at(into.skip, places // self.rows, expected)
        into.hashed += np.bincount(slots.ravel(), expected.ravel(), minlength=1 << self.bits)
        return float((n * (np.log(whole) + top)[:, 0]).sum())


def train(places: DataFrame, after_row: np.ndarray, after_two: np.ndarray, kind_of_row: np.ndarray, steps: int | None = None,
          rate: float = RATE, decay: float = DECAY) -> tuple[Weights, list[float]]:
    """The best weights of ``steps`` (``STEPS``) gradient steps over all histories, and the likelihood
    of the best ones at each.

    The start is the smoothed model of the word before. Each step sends the weights out, and
    brings back one gradient of their size per task, ``PARTS`` of them. Steps are scaled per weight,
    and taken back and shortened where they make things worse.
    """
    context = places.sparkSession.sparkContext
    seen_ = Weights(kind_of_row)
    seen_.bias += after_row.sum(axis=0)
    seen_.before += after_row
    seen_.skip += after_two.sum(axis=1)
    two, one = np.divmod(np.arange(CLASSES * CLASSES), CLASSES)
    seen_.hashed += np.bincount(seen_.slots(two, one).ravel(), after_two.ravel(), minlength=len(seen_.hashed))

    def expected(weights: Weights) -> tuple[np.ndarray, float]:
        shared = context.broadcast(weights.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total, normal = Weights(kind_of_row, shared.value), Weights(kind_of_row), 0.0
            for batch in batches:
                if batch.num_rows:
                    normal += now.add_expected(total, batch.column("place").to_numpy(), batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([total.values.tobytes()], pa.binary()), pa.array([normal])], names=["g", "s"])

        total, normal = np.zeros(weights.size), 0.0
        for row in places.coalesce(PARTS).mapInArrow(run, "g binary, s double").toLocalIterator():
            total, normal = total + np.frombuffer(row.g), normal + row.s
        shared.destroy()
        return total, normal

    share = (seen_.bias + 0.5) / (seen_.bias.sum() + 0.5 * CLASSES)
    weights = Weights(kind_of_row)
    weights.bias += np.log(share)
    weights.before += np.log((after_row + 5 * share) / (after_row.sum(axis=1, keepdims=True) + 5)) - np.log(share)
    n, squares, seen = max(1.0, seen_.bias.sum()), np.full(weights.size, 1e-12), []
    best, step = weights, np.zeros(weights.size)
    for _ in range(STEPS if steps is None else steps):
        total, normal = expected(weights)
        likelihood = (float(seen_.values @ weights.values) - normal) / n
        if not seen or likelihood >= seen[-1]:
            seen.append(likelihood)
            best, g = weights, (seen_.values - total) / n - decay * weights.values
            squares += g * g
            step = g / np.sqrt(squares)
        else:  # too far: back, and a shorter step the same way
            seen.append(seen[-1])
            rate /= 4
        weights = Weights(kind_of_row, best.values + rate * step)
    return best, seen


def score_texts(texts: list[bytes], weights: Weights, past: np.ndarray, pairs: Pairs) -> np.ndarray:
    """Natural log, by text, of the probabilities of all classes and of what the pairs add to the words."""
    two, one, own, _, sizes = tokens_of(texts, pairs.kind_of_row)
    if not len(sizes):
        return np.zeros(0)
    places, at = np.unique(two * weights.rows + past[one], return_inverse=True)
    kinds, gained = pairs.kind_of_row[own], np.zeros(len(own))
    order = np.argsort(at, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(places)))])
    for k in range(0, len(places), 4096):
        part = order[ends[k] : ends[min(k + 4096, len(places))]]
        gained[part] = weights.log_softmax(places[k : k + 4096])[at[part] - k, kinds[part]]
    return np.add.reduceat(gained + pairs.gain(one, own), np.cumsum(sizes) - sizes)


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text."""
    scratch = Scratch(docs.sparkSession)
    numbered = blocks(docs, scratch.written)
    vocabulary = Vocabulary(numbered)
    coded = row_sequences(numbered, vocabulary)
    scratch.drop_all()
    known = vocabulary.kind_of_row[: vocabulary.histories]
    weights, _ = train(*history_counts(coded, vocabulary), known)
    past, context = vocabulary.past, docs.sparkSession.sparkContext
    weighed = pair_weights(coded, vocabulary)
    values, pairs = context.broadcast(weights.values), context.broadcast(weighed.sent())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Weights(known, values.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                gained = score_texts(part.column("rows").to_pylist(), model, past, pairs.value) / math.log(10)
                names = ["at", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]
                total = part.column("within_score").to_numpy() + gained
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(total)], names=[*names, "score"])

    scored = coded.mapInArrow(run, "at bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    if weighed.late is not None:
        added = late_gains(coded, weighed.late, pairs)
        total = F.col("score") + F.coalesce("late", F.lit(0.0)) / math.log(10)
        scored = scored.join(added, "at", "left").withColumn("score", total)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")
