"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.batches import Scratch, written
from leafmill.plans.scale import spread_join


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A link to the smallest member for every other member, of what this task has read."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        path = []
        while above.setdefault(x, x) != x:
            path.append(x)
            x = above[x]
        for y in path:
            above[y] = x
        return x

    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in "ab"), strict=True):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
        if len(above) > 1_000_000:
            yield _table(above, top)
            above.clear()
    yield _table(above, top)


def _table(above: dict[int, int], top) -> pa.RecordBatch:
    nodes = [x for x in above if top(x) != x]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``); root is the smallest node reachable.

    Every task first reduces its links to stars. Then, in rounds, every node goes to the
    neighbour (or itself) whose hash is lowest, and links between the same places vanish. Random
    order makes long chains unlikely, so that a few rounds suffice; every round is written to the
    shared folder, and the tables of the round before are removed. No group of rows is gathered: a
    node of any degree is an aggregate, and joins on nodes of many links are cut into slices.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.written(links.select("a", "b").mapInArrow(_stars, "a bigint, b bigint"), "links")
    nodes = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min(F.struct(F.xxhash64("b").alias("h"), "b"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        step = both.groupBy("a").agg(least.alias("n")).select(F.col("a").alias("node"), F.least("n", own)["b"].alias("to"))
        step = scratch.written(step, "steps")
        if nodes is None:
            places = step
        else:
            # places that have no more links stay
            stays = nodes.join(step.select(F.col("node").alias("to")), "to", "left_anti").select("node", "to")
            goes = spread_join(nodes, step.select(F.col("node").alias("to"), F.col("to").alias("next")), ["to"], ["node"])
            places = scratch.written(stays.unionByName(goes.select("node", F.col("next").alias("to"))), "places")
        once = spread_join(edges, step.select(F.col("node").alias("a"), F.col("to").alias("x")), ["a"], ["b"])
        twice = spread_join(once, step.select(F.col("node").alias("b"), F.col("to").alias("y")), ["b"], ["a"])
        moved = twice.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        moved = scratch.written(moved, "links")
        scratch.drop_all(places, moved)
        nodes, edges = places, moved
    if nodes is None:
        scratch.drop_all()
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    roots = nodes.groupBy("to").agg(F.min("node").alias("least"))
    placed = written(spread_join(nodes, roots, ["to"], ["node"]).select("node", F.least("least", "to").alias("root")), "components")
    scratch.drop_all()
    return placed
