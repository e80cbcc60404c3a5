"""Settling of crowded runs: equal to all pairs, whatever the crowd looks like."""

import os
import random

import numpy as np
import pytest

from leafmill.llm import forest
from leafmill.llm.batches import Scratch, importable
from leafmill.llm.links import components
from leafmill.session import shared_folder


def similar(a, b):
    both = len(a & b)
    return 100 * both >= 75 * (len(a) + len(b) - both)


def crowd(rng, size, words=120):
    """Sets that have much in common, many of them close to the threshold, and a hub with copies."""
    base = rng.sample(range(10**6), words)
    out = {}
    for i in range(size):
        own = set(base)
        if i % 3 == 0:  # a copy in a few places
            change = rng.randrange(0, words // 7)
        else:  # near the threshold, above and below it
            change = rng.randrange(words // 9, words // 3)
        for x in rng.sample(base, change):
            own.discard(x)
            own.add(rng.randrange(10**6, 10**9))
        if i % 5 == 0:
            own |= {rng.randrange(10**6, 10**9) for _ in range(rng.randrange(40))}
        out[i] = own
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_settled_finds_every_link_between_components(spark, monkeypatch, block):
    importable(spark)
    monkeypatch.setattr(forest, "BLOCK", block)  # many blocks of one shingle
    rng = random.Random(7)
    sets = crowd(rng, 240) | {1000: {1}, 1001: {1}, 1002: {1, 2, 3}, 1003: {1, 2, 3, 4}, 1004: set(range(5000)), 1005: set(range(600, 5000))}
    # spread over 64 bits, as hashes are
    spread = {i: sorted(int(np.uint64(x * 0x9E3779B97F4A7C15 % 2**64).astype(np.int64)) for x in s) for i, s in sets.items()}
    table = spark.createDataFrame(list(spread.items()), "doc_id long, shingles array<long>")
    members = spark.createDataFrame([(b"r", i) for i in sets] + [(b"q", i) for i in sets if i % 2], "run binary, rep long").repartition(5)
    known = spark.createDataFrame([(0, 3)], "a long, b long") if similar(sets[0], sets[3]) else spark.createDataFrame([], "a long, b long")
    none = spark.createDataFrame([], "a long, b long")
    links = {tuple(sorted(r)) for r in forest.settled(members, table, none, known, Scratch(spark)).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])}
    assert links == want and len(want) > 200


def test_runs_of_one_component_are_left_alone(spark):
    importable(spark)
    place = spark.createDataFrame([(i, 0) for i in range(9)] + [(20, 20), (21, 20)], "node long, root long")
    members = spark.createDataFrame([(b"a", i) for i in range(9)] + [(b"b", 20), (b"b", 21), (b"b", 3), (b"b", 77)], "run binary, rep long")
    got = {r.rep: (r.root, r.asks) for r in forest.open_members(members, place, Scratch(spark)).collect()}
    assert got == {20: (20, False), 21: (20, False), 3: (0, True), 77: (77, True)}


def test_chain_of_near_copies_and_a_crowd_below_the_threshold(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):  # each like the next, the ends unlike
        rows.append((i, " ".join(words[i * 6 : i * 6 + 100])))
    base = [f"b{i}" for i in range(200)]
    for i in range(100, 180):  # much in common, but never enough
        own = list(base)
        for at in rng.sample(range(200), 12):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    own = {i: shingles(t) for i, t in rows}
    root = {i: i for i in own}
    for a in own:
        for b in own:
            if a < b and similar(own[a], own[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, component_id string, n_shingles long")
    got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in forest.near_duplicates(importable(spark) and df).collect()}
    assert got == {i: (root[i], len(own[i]), root[i] == i) for i in own}
    assert len({root[i] for i in range(40)}) == 1 and len({root[i] for i in range(100, 180)}) > 40


def test_finished_tables_are_removed(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}", 1) for i in range(20)], "doc_id long, text string, kept long")
    folder = shared_folder(importable(spark))
    before = set(os.listdir(folder))
    found = forest.near_duplicates(docs)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before if "-" in x and not x.count("-") > 3}
    assert left <= {"signatures", "reached"}
    assert found.count() == 20
    before = set(os.listdir(folder))
    links = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    assert {r.root for r in components(links).collect()} == {0}
    assert len(set(os.listdir(folder)) - before) == 1
