"""Near duplicates by an LSH forest over MinHash signatures, every link confirmed on full sets.

A text's set holds its distinct shingles of five words. Texts with equal sets form a class, which
its smallest doc_id represents; only representatives go on. A signature of ``TREES * LEAST``
minima is read as a ring, and each tree sorts the representatives by the ring from its own start.
In each sorted order, neighbours whose common prefix is at least ``LEAST`` minima are candidates:
where texts are sparse that prefix is short, in crowded regions neighbours share long ones, so
that the depth follows the region. The first member of every run of equal prefixes, at several
depths, is a candidate of all its members and so holds crowded regions together.

Two sets of similarity 0.75 share no prefix in any tree with a chance of (1 - 0.75**4)**32, about
5 in a million. Candidates are confirmed exactly. Those most trees agree on go first; of the rest,
only pairs that are not yet in one component are looked at.

Sorted orders are cut by ranges, so that a crowded region spreads over tasks like any other rows.
Runs of the shortest prefix that are longer than the neighbours looked at, or that a cut may have
divided, are settled afterwards, exactly and in one pass. As far as such a run has members of several
components, those outside its largest one ask, and all its members answer. Two sets of similarity
``t`` share one of the first ``n - ceil(t * n) + 1`` of their ``n`` shingles, in any order that is the
same for all sets. So only members that share a shingle among their rarest ones meet, which members of
a crowd that differ in many places do not, however much they have in common; places in that order and
sizes bound the rest they can share, and only pairs that may reach ``t`` are confirmed. Pairs of
different components alone are made, each task once. The order goes by counts in a table of
``1 << COUNT_BITS`` slots: collisions there change what it costs, not what is found.

Defined results: null, empty and blank texts have no shingle and link with nothing; fewer than
five words are one shingle; repeated rows of a doc_id share its result; a null doc_id takes part
without representing; texts of any length are read whole; other columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.batches import Scratch, WordIds, bytes_of, lists, text_slices, written
from leafmill.llm.links import components
from leafmill.plans.scale import spread_join

WORDS = 5
THRESHOLD = 75  # of 100
TREES, LEAST, DEEPEST = 32, 4, 12
AHEAD = 3  # neighbours looked at in each order
PIVOT_DEPTHS = (4, 8)
#: Of the minima that a tree sorts by beyond ``LEAST``, how many must be equal at least: two sets of
#: similarity 0.75 have fewer with a chance of 0.004, and then still other trees.
EQUAL = 3
#: Slots in which shingles of crowded runs are counted, which bounds what the driver gets and sends.
COUNT_BITS = 20
#: Members that ask, or answer, in one task for one shingle; more are cut into blocks.
BLOCK = 4096
HEAVY_SHINGLES = 1000
MIX = np.uint64(0x9E3779B97F4A7C15)
_seeds = np.random.default_rng(20)
FACTORS = _seeds.integers(1, 2**63, TREES * LEAST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _seeds.integers(0, 2**63, TREES * LEAST, dtype=np.uint64)


class Shingler:
    """Distinct 64-bit shingle hashes of texts."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known = WordIds(lambda ws: [(h,) for h in map(xxhash.xxh3_64_intdigest, ws)], kind=np.uint64)

    @staticmethod
    def _stir(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * MIX
        return x ^ (x >> np.uint64(29))

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Sorted distinct shingles of each text."""
        for text in texts:
            found = text.lower().split()
            if not found:
                yield np.zeros(0, np.uint64)
                continue
            word, _ = self.known.of(found)
            k = min(self.words, len(word))
            value = np.full(len(word) - k + 1, k, np.uint64)
            for i in range(k):
                value = self._stir(value + word[i : len(word) - k + 1 + i])
            yield np.unique(value)


def signature(shingles: np.ndarray) -> bytes:
    """16 bits of the minimum under each of the hash functions."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        np.minimum(least, (part[None, :] * FACTORS[:, None] + OFFSETS[:, None]).min(axis=1), out=least)
    return ((least * MIX) >> np.uint64(48)).astype(">u2").tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_key, signature`` of every whole text; keys are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in text_slices(batch, "text"):
                sizes, keys, marks = [], [], []
                for s in shingler.sets(bytes_of(part, "text")):
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    marks.append(signature(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, signature binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, shingles`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = list(shingler.sets(bytes_of(part, "text")))
                values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists(values, np.array([len(x) for x in found]), pa.int64())], names=["doc_id", "shingles"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, shingles array<bigint>")


class Neighbours:
    """Candidates of one sorted order, read batch by batch."""

    def __init__(self) -> None:
        self.tail: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.pivot: dict[int, tuple[int, int, np.ndarray]] = {}

    @staticmethod
    def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x[:, LEAST + 1 :] == y[:, LEAST + 1 :]).sum(axis=1)

    def of(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(smaller id, larger id)`` that end in the given rows; keys begin with the tree."""
        old = 0
        if self.tail is not None:
            old = len(self.tail[1])
            keys, ids, sizes = (np.concatenate(x) for x in zip(self.tail, (keys, ids, sizes), strict=True))
        found = []
        for d in range(1, AHEAD + 1):
            if len(ids) > d:
                near = (keys[d:, : LEAST + 1] == keys[:-d, : LEAST + 1]).all(axis=1)
                near[: max(0, old - d)] = False
                at = np.flatnonzero(near)
                found.append((ids[at], ids[at + d], sizes[at], sizes[at + d], self._equal(keys[at], keys[at + d])))
        index = np.arange(len(ids))
        for depth in PIVOT_DEPTHS:
            new = np.ones(len(ids), bool)
            new[1:] = (keys[1:, : depth + 1] != keys[:-1, : depth + 1]).any(axis=1)
            if old:
                new[:old] = False
            first = np.maximum.accumulate(np.where(new, index, -1))
            pid, psize, pkey = self.pivot.get(depth, (-1, 0, keys[0]))
            held = (first >= 0)[old:]
            first = first[old:]
            pivots, weights = np.where(held, ids[first], pid), np.where(held, sizes[first], psize)
            heads = np.where(held[:, None], keys[first], pkey)
            other = pivots != ids[old:]
            found.append((pivots[other], ids[old:][other], weights[other], sizes[old:][other], self._equal(heads[other], keys[old:][other])))
            self.pivot[depth] = int(pivots[-1]), int(weights[-1]), heads[-1]
        self.tail = keys[-AHEAD:], ids[-AHEAD:], sizes[-AHEAD:]
        a, b, m, n, equal = (np.concatenate(x) for x in zip(*found, strict=True))
        alike = (100 * np.minimum(m, n) >= THRESHOLD * np.maximum(m, n)) & (equal >= EQUAL)
        return np.minimum(a, b)[alike], np.maximum(a, b)[alike]


class Crowds:
    """Members of the runs of one sorted order that ``Neighbours`` may not compare in full."""

    def __init__(self) -> None:
        self.open: np.ndarray | None = None  # prefix of the run being given out
        self.held: tuple[np.ndarray, np.ndarray] | None = None  # last run, as long as it is short

    def of(self, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefixes and ids; a task's first run counts, as it may have begun in the task before."""
        keys = keys[:, : LEAST + 1]
        if self.open is None:
            self.open = keys[0]
        if self.held is not None:
            keys, ids = (np.concatenate(x) for x in zip(self.held, (keys, ids), strict=True))
        new = np.ones(len(ids), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        run = np.cumsum(new) - 1
        crowded = np.bincount(run) > AHEAD + 1
        crowded[0] |= (keys[0] == self.open).all()
        last = np.flatnonzero(new)[-1]
        self.held = None
        if crowded[-1]:
            self.open = keys[-1]
        else:
            self.held = keys[last:], ids[last:]
        out = crowded[run]
        return keys[out], ids[out]

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """The last run, which may go on in the task after."""
        return self.held if self.held is not None else (np.zeros((0, LEAST + 1), np.uint16), np.zeros(0, np.int64))


def candidates(heads: DataFrame) -> DataFrame:
    """``a, b, votes, run``: pairs of representatives near each other in some tree, and in how many.

    Rows with a ``run``, which is a tree and a prefix, name its members ``a`` instead: those of
    crowded and cut runs.
    """
    trees = heads.select("rep", "n_shingles", F.concat("signature", F.substring("signature", 1, 2 * DEEPEST)).alias("ring"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    keyed = trees.select(
        "rep",
        F.col("n_shingles").cast("int").alias("n"),
        F.concat(F.unhex(F.lpad(F.hex("tree"), 4, "0")), F.substring(F.col("ring"), F.col("tree") * (2 * LEAST) + 1, F.lit(2 * DEEPEST))).alias("key"),
    )
    ordered = keyed.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, crowds = Neighbours(), Crowds()

        def members(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            data, width = keys.astype(">u2").tobytes(), 2 * (LEAST + 1)
            names = pa.array([data[i : i + width] for i in range(0, len(data), width)], pa.binary())
            none = pa.nulls(len(ids), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), none, none, names], names=["a", "b", "votes", "run"])

        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u2").reshape(batch.num_rows, DEEPEST + 1)
                ids, sizes = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "n"))
                keys = keys.astype(np.uint16)
                a, b = order.of(keys, ids, sizes)
                pairs, votes = np.unique(np.stack([a, b], axis=1), axis=0, return_counts=True)
                none = pa.nulls(len(votes), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(votes), none], names=["a", "b", "votes", "run"])
                yield members(*crowds.of(keys, ids))
        yield members(*crowds.rest())

    return ordered.mapInArrow(run, "a bigint, b bigint, votes bigint, run binary").groupBy("a", "b", "run").agg(F.sum("votes").alias("votes"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose full sets are similar enough.

    Sets are sorted to their pairs by the same plan at every size.
    """
    joined = (
        pairs.select("a", "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    )
    both = F.size(F.array_intersect("x", "y"))
    return joined.select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), both.alias("both")).filter(
        100 * F.col("both") >= THRESHOLD * (F.col("sizes") - F.col("both"))
    ).select("a", "b")


def open_members(members: DataFrame, place: DataFrame, scratch: Scratch) -> DataFrame:
    """``rep, root, asks`` of the members of runs (``run, rep``) that are not yet one component.

    Members outside the largest component of one of their runs ask.
    """
    found = members.join(place.select(F.col("node").alias("rep"), "root"), "rep", "left").select("run", "rep", F.coalesce("root", "rep").alias("root"))
    found = scratch.written(found, "members")
    parts = found.groupBy("run", "root").agg(F.count("*").alias("n")).groupBy("run").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
    runs = scratch.written(parts.filter("parts > 1").select("run", "n", F.col("top.root").alias("main")), "runs")
    met = spread_join(found, runs, ["run"], ["rep"], rows="n")
    return met.groupBy("rep").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("asks"))


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each slot occur in ``sets``."""
    slots = F.transform("shingles", lambda s: F.shiftrightunsigned(s, 64 - COUNT_BITS).cast("int"))
    found = sets.select(F.explode(slots).alias("slot")).groupBy("slot").agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int32)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def rarest(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """``shingle, rep, root, asks, n, at``: of the ``n`` shingles of each of ``sets`` the rarest, so many
    that two similar sets share one, and their places; those that surely occur once are left out."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                own = row.column("shingles").flatten().to_numpy(zero_copy_only=False)
                n = len(own)
                seen = table[own.view(np.uint64) >> np.uint64(64 - COUNT_BITS)]
                first = np.lexsort((own, seen))[: n - -(-n * THRESHOLD // 100) + 1]
                place = np.flatnonzero(seen[first] > 1)
                if len(place):
                    each = np.zeros(len(place), np.int64)
                    rest = [row.column(c).take(pa.array(each)) for c in ("rep", "root", "asks")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[first[place]]), *rest, pa.array(np.full(len(place), n, np.int32)), pa.array(place.astype(np.int32))], names=names
                    )

    names = ["shingle", "rep", "root", "asks", "n", "at"]
    return sets.select("rep", "root", "asks", "shingles").mapInArrow(run, "shingle bigint, rep bigint, root bigint, asks boolean, n int, at int")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (``rarest``) with ``answers`` and the block ``i, j`` of their shingle.

    The shingles of the most rows, at most ``HEAVY_SHINGLES``, are cut into blocks of askers ``i`` and
    of answers ``j``; every asker meets every answer in one block.
    """
    sizes = rows.groupBy("shingle").agg(F.count("*").alias("size"), F.count_if("asks").alias("askers"))
    large = sizes.filter((F.col("size") > BLOCK) & (F.col("askers") > 0)).orderBy(F.desc("size")).limit(HEAVY_SHINGLES)
    count = lambda c: F.ceil(F.col(c) / BLOCK)
    marked = rows.join(F.broadcast(large.select("shingle", count("askers").alias("asking"), count("size").alias("blocks"))), "shingle", "left")
    zero = F.lit(0).cast("long")
    plain = marked.filter("blocks IS NULL").select(*rows.columns, F.lit(True).alias("answers"), zero.alias("i"), zero.alias("j"))
    heavy, own = marked.filter("blocks IS NOT NULL"), F.xxhash64("rep")
    upto = lambda c: F.explode(F.sequence(zero, F.col(c) - 1))
    kept = [c for c in rows.columns if c != "asks"]
    asking = heavy.filter("asks").select(*kept, F.lit(True).alias("asks"), F.lit(False).alias("answers"), F.pmod(own, "asking").alias("i"), upto("blocks").alias("j"))
    answering = heavy.select(*kept, F.lit(False).alias("asks"), F.lit(True).alias("answers"), upto("asking").alias("i"), F.pmod(own, "blocks").alias("j"))
    return plain.unionByName(asking).unionByName(answering)


def _possible(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Pairs of one shingle's rows that may be similar: different components, one of them asks, and
    what follows the shingle in both is long enough."""
    found = []
    answers = np.flatnonzero(rows["answers"])
    n, at, root, rep = (rows[c][answers] for c in ("n", "at", "root", "rep"))
    for part in np.array_split(np.flatnonzero(rows["asks"]), -(-int(rows["asks"].sum()) * len(answers) // 1_000_000) or 1):
        m, p = rows["n"][part, None], rows["at"][part, None]
        may = (rows["root"][part, None] != root) & (np.minimum(m, n) * 100 >= THRESHOLD * np.maximum(m, n))
        may &= (np.minimum(m - p, n - at)) * (100 + THRESHOLD) >= THRESHOLD * (m + n)
        x, y = np.nonzero(may)
        found.append(np.stack([rows["rep"][part[x]], rep[y]], axis=1))
    return np.concatenate(found)


def rare_pairs(rows: DataFrame) -> DataFrame:
    """``a, b``: pairs of ``rows`` (``dealt``) that meet in a shingle and may be similar."""
    keys = ["shingle", "i", "j"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: dict[str, np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
            found = [np.zeros((0, 2), np.int64)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y - x > 1 and rows["asks"][x:y].any():
                    found.append(_possible({c: v[x:y] for c, v in rows.items()}))
            once = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["a", "b"])

        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
                held = new if held is None else {c: np.concatenate([held[c], v]) for c, v in new.items()}
                differs = np.zeros(len(held["rep"]), bool)
                for c in keys:
                    differs[1:] |= held[c][1:] != held[c][:-1]
                starts = np.flatnonzero(differs)
                if len(starts):
                    yield pairs(held, np.concatenate([[0], starts]))
                    held = {c: v[starts[-1] :] for c, v in held.items()}
        if held is not None:
            yield pairs(held, np.array([0, len(held["rep"])]))

    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def settled(members: DataFrame, sets: DataFrame, tried: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` and all other links between ``members`` (``run, rep``) of one run that join two of the
    components of ``links``. Pairs of ``tried`` need no second look."""
    place = components(links)
    open_ = scratch.written(open_members(members, place, scratch), "open")
    if open_.isEmpty():
        return links
    crowd = scratch.written(sets.withColumnRenamed("doc_id", "rep").join(open_.hint("merge"), "rep"), "open-sets")
    rows = scratch.written(rarest(crowd, shingle_counts(crowd)), "rarest")
    new = scratch.written(rare_pairs(dealt(rows)).join(tried, ["a", "b"], "left_anti"), "chosen")
    return links.unionByName(scratch.written(confirmed(new, sets), "more-links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    scratch = Scratch(docs.sparkSession)
    marked = written(signatures(docs), "signatures")
    heads = scratch.written(
        marked.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
        ),
        "heads",
    )
    near = scratch.written(candidates(heads), "pairs")
    pairs = near.filter("run IS NULL").select("a", "b", "votes")
    members = near.filter("run IS NOT NULL").select("run", F.col("a").alias("rep"))
    ends = near.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select("doc_id", "text").join(ends.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = scratch.written(shingle_sets(texts), "sets")

    # the partner most trees name, of each document
    named = pairs.select("a", "b", "votes").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "votes"))
    best = named.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    best = scratch.written(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "best")
    strong = scratch.written(confirmed(best, sets), "strong")
    place = components(strong)
    rest = (
        pairs.select("a", "b")
        .join(place.select(F.col("node").alias("a"), F.col("root").alias("p")), "a", "left")
        .join(place.select(F.col("node").alias("b"), F.col("root").alias("q")), "b", "left")
        .filter(F.coalesce("p", "a") != F.coalesce("q", "b"))
        .select("a", "b")
        .join(best, ["a", "b"], "left_anti")
    )
    links = strong.unionByName(scratch.written(confirmed(rest, sets), "weak"))
    linked = components(settled(members, sets, pairs.select("a", "b"), links, scratch))
    reached = heads.join(linked, heads["rep"] == linked["node"], "left").select("set_key", F.coalesce("root", "rep").alias("component_id"))
    found = written(reached, "reached")
    scratch.drop_all()
    return marked.join(found, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
