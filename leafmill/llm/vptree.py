"""Nearest neighbours by vantage-point trees, one per shard of bounded size.

A tree splits its vectors at the median distance from a vantage point, chosen for its spread, and
keeps for both halves the least and largest distance. By the triangle inequality a half's vectors are
further from the query than the query's distance lies outside that range, and further than every such
bound on the way down. With tau the distance of the worst of the k best so far, a half is skipped if its
bound exceeds ``factor * tau``. Factor one restores exact search: the bound is then the largest one on
the way. A smaller factor lets all bounds on the way add up in part, as independent directions do, and
skips more.

Where no factor is given it is measured: a sample of queries searches the trees of a few shards with
each of ``FACTORS``, beside brute force, and the least factor whose recall reaches ``RECALL`` is used
(``recall_curve``). How much a factor saves depends on the vectors: where all are nearly as far from
each other, most leaves must be read for the same recall.

Every shard goes to one task once, followed by the queries in blocks; its tree is built once and holds
as many vectors as a shard has. Each shard gives its k best per query, and those are ranked per query,
so that neither the index nor the queries are ever whole anywhere.

Defined results: vectors that are null, all zero or hold null or non-finite components take no
part; vectors of another length than the query's are no candidates; equal distances go by the
smaller id; repeated rows of an id are candidates of their own, but never of the same id's query, and
a repeated query id has its neighbours once; null ids take no part; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.batches import written

K = 10
#: Vectors of a shard, and queries of a block: what one task holds.
SHARD, BLOCK = 8_192, 1_024
LEAF = 64
#: Factors that are tried, the recall one must reach, and the queries and shards it is measured with.
FACTORS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8)
RECALL, SAMPLED_QUERIES, SAMPLED_SHARDS = 0.95, 64, 4
SPREAD_OF, SPREAD_BY = 5, 100


class Tree:
    """Vantage-point tree over the rows of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 1):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.nodes: list[tuple] = []
        self.leaves = 0
        self._build(np.arange(len(ids)), np.random.default_rng(seed))

    def _vantage(self, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Of a few vectors the one whose distances to others differ most."""
        some = self.vectors[rng.choice(rows, SPREAD_BY)]
        points = self.vectors[rng.choice(rows, SPREAD_OF)]
        return max(points, key=lambda p: float(np.sqrt(((some - p) ** 2).sum(axis=1)).std()))

    def _build(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= LEAF:
            self.nodes[at] = (np.sort(rows),)
            self.leaves += 1
            return at
        point = self._vantage(rows, rng)
        far = np.sqrt(((self.vectors[rows] - point) ** 2).sum(axis=1))
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        sides = []
        for part in (order[:half], order[half:]):
            sides.append((float(far[part[0]]), float(far[part[-1]]), self._build(rows[part], rng)))
        self.nodes[at] = (point, *sides)
        return at

    def nearest(self, query: np.ndarray, own_id: int, k: int, factor: float) -> tuple[list[tuple[float, int]], int]:
        """The k best as (distance, id), nearest first, and the number of leaves read."""
        best: list[tuple[float, int]] = []  # the worst on top: (-distance, -id)
        queue = [(0.0, 0, 0, 0.0, 0.0)]  # reach, order, node, largest bound on the way, their squares' sum
        count = read = 0
        while queue:
            reach, _, node, largest, squares = heapq.heappop(queue)
            if len(best) == k and reach > -best[0][0] * factor * (1 + 1e-12):
                break
            held = self.nodes[node]
            if len(held) == 1:
                read += 1
                rows = held[0]
                gaps = np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))
                ids = self.ids[rows]
                use = ids != own_id
                if len(best) == k:
                    use &= gaps <= -best[0][0]
                for gap, i in zip(gaps[use].tolist(), ids[use].tolist(), strict=True):
                    item = (-gap, -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                continue
            point, *sides = held
            away = float(np.sqrt(((query - point) ** 2).sum()))
            for low, high, child in sides:
                bound = max(0.0, low - away, away - high)
                top, sum_ = max(largest, bound), squares + bound * bound
                count += 1
                heapq.heappush(queue, (top + (1 - factor) * (sum_**0.5 - top), count, child, top, sum_))
        return [(-g, -i) for g, i in sorted(best, reverse=True)], read

    def exact(self, query: np.ndarray, own_id: int, k: int) -> set[int]:
        gaps = np.sqrt(((self.vectors - query) ** 2).sum(axis=1))
        rows = [i for i in np.lexsort((self.ids, gaps))[: k + 1 + int((self.ids == own_id).sum())].tolist() if self.ids[i] != own_id]
        return set(self.ids[rows[:k]].tolist())


def usable(vector: Column) -> Column:
    """All components finite, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def shards(vectors: DataFrame, count: int, vec_id: str, embedding: str) -> DataFrame:
    """``shard, size, ids, rows``: the vectors of one length in each shard, flat in one row.

    Rows are dealt by their id, their vector and their place in the input, so that no id and no vector
    can fill a shard, however often it is repeated.
    """
    keyed = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    place = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(count)).cast("int")
    dealt = keyed.select("id", "v", F.size("v").alias("size"), place.alias("shard"))
    return dealt.groupBy("shard", "size").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("rows"))


def _rows_of(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    row = batch.slice(at, 1)
    ids, flat = (row.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "rows"))
    return ids, flat.reshape(len(ids), -1).astype(np.float64)


def _blocks(queries: DataFrame, count: int, vec_id: str, embedding: str) -> DataFrame:
    """``size, ids, rows`` of the queries, each id once, in blocks."""
    asked = queries.select(F.col(vec_id).alias("q"), F.col(embedding).alias("v")).filter(usable(F.col("v")) & F.col("q").isNotNull())
    asked = asked.dropDuplicates(["q"]).withColumn("size", F.size("v"))
    return asked.groupBy("size", F.pmod(F.xxhash64("q"), F.lit(count)).alias("block")).agg(
        F.collect_list("q").alias("ids"), F.flatten(F.collect_list("v")).alias("rows")
    )


def recall_curve(index: DataFrame, queries: DataFrame, k: int, vec_id: str, embedding: str) -> DataFrame:
    """``factor, recall, leaves``: the share of the k nearest in a shard that are found, and the share
    of its leaves that are read for it, by factor; of a bounded sample of queries and shards."""
    asked = queries.filter(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("q"), F.col(embedding).alias("v"))
    sample = asked.orderBy(F.xxhash64("q")).limit(SAMPLED_QUERIES).collect()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, rows = _rows_of(batch, at)
                own = [(r.q, np.array(r.v, np.float64)) for r in sample if len(r.v) == rows.shape[1]]
                tree = Tree(ids, rows)
                true = [tree.exact(v, q, k) for q, v in own]
                for factor in FACTORS:
                    found = [tree.nearest(v, q, k, factor) for q, v in own]
                    hit = sum(len({i for _, i in f} & t) for (f, _), t in zip(found, true, strict=True))
                    values = [factor, float(hit), float(sum(map(len, true))), float(sum(n for _, n in found)), float(tree.leaves * len(own))]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=["factor", "hit", "near", "read", "leaves"])

    some = index.orderBy(F.desc(F.size("ids")), "shard").limit(SAMPLED_SHARDS).repartition(SAMPLED_SHARDS, "shard")
    found = some.select("ids", "rows").mapInArrow(run, "factor double, hit double, near double, read double, leaves double")
    share = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(1.0))
    return found.groupBy("factor").agg(share("hit", "near").alias("recall"), share("read", "leaves").alias("leaves"))


def chosen_factor(curve: DataFrame, recall: float = RECALL) -> float:
    """The least factor of a ``recall_curve`` that reaches ``recall``; one, which is exact, if none does."""
    return curve.filter(F.col("recall") >= recall).agg(F.min("factor")).first()[0] or 1.0


def search(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float | None = None, vec_id: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of every query, score the distance."""
    if factor is not None and not 0 < factor <= 1:
        raise ValueError("factor lies between 0 and 1; 1 is exact")
    count = max(1, -(-vectors.count() // SHARD))
    index = written(shards(vectors, count, vec_id, embedding), "vp-shards")
    if factor is None:
        factor = chosen_factor(recall_curve(index, queries, k, vec_id, embedding))
    relaxed = factor
    blocks = _blocks(queries, max(1, -(-queries.count() // BLOCK)), vec_id, embedding)
    # every block goes to every shard of its length: a stated query set against all rows
    sent = index.select("shard", "size").join(blocks, "size").select("shard", "size", F.lit(1).alias("kind"), "ids", "rows")
    own = index.select("shard", "size", F.lit(0).alias("kind"), "ids", "rows")
    met = own.unionByName(sent).repartition(max(count, 1), "shard", "size").sortWithinPartitions("shard", "size", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            for at in range(batch.num_rows):
                ids, rows = _rows_of(batch, at)
                if kinds[at] == 0:
                    tree = Tree(ids, rows)
                    continue
                q, i, d = [], [], []
                for asked, vector in zip(ids.tolist(), rows, strict=True):
                    found, _ = tree.nearest(vector, asked, k, relaxed)
                    q += [asked] * len(found)
                    d += [gap for gap, _ in found]
                    i += [other for _, other in found]
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
