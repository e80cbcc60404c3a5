"""Merkle manifest: against hashlib and zlib over the same rows, whatever the group sizes."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from leafmill.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    for level in tree[:-1]:
        first = at // 16 * 16
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 16])
        at //= 16


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf((*r[:4], lower(r[4]))) if changed else leaf(r)
            for a, b in path:
                now = sha(a + now + b)
            proof = sha("".join(a + b for a, b in path))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    result = found(merkle.verification(docs))
    assert result == plain(rows)
    assert 0 < sum(not r[-1] for r in result) < len(rows)


@pytest.mark.parametrize("share", [5, 64])
def test_hot_group_many_groups_and_odd_rows(spark, monkeypatch, share):
    """A group of over 256 leaves, over 16 groups, lone leaves, nulls, repeated keys and rows."""
    monkeypatch.setattr(merkle, "SHARE", share)
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(300)]
    rows += [(1000 + i, f"s{i % 19}", None, None, f"Ab {i}" if i % 3 else None) for i in range(45)]
    rows += [(2000, "lone", "de", 1, "X"), (2001, "", "de", 1, ""), (2002, None, None, None, None), (None, None, "en", 2, "AB")]
    rows += [(7, "hot", "en", 7, "other text of that key"), (8, "hot", "en", 8, "Text 8"), (2003, "Ä|1.2", "en", 5, "ÄÖ É Z")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' leaf", "1 at", "'y' tree", "'z' share")
    assert found(merkle.verification(df.repartition(7))) == plain(rows)


def test_one_leaf_one_group_and_none(spark):
    one = [(5, "s", "en", 1, "A")]
    assert found(merkle.verification(spark.createDataFrame(one, SCHEMA))) == plain(one)
    group = [(i, None, "en", 1, "A" * 100_000) for i in range(17)]
    assert found(merkle.verification(spark.createDataFrame(group, SCHEMA))) == plain(group)
    empty = spark.createDataFrame([], SCHEMA)
    assert found(merkle.verification(empty)) == []
    assert merkle.manifest(merkle.tampered_leaves(empty)).roots.collect() == []


def test_nodes_are_linked_and_bounded(spark, monkeypatch):
    """Following the parents from any node ends at the root; copies follow the shares."""
    monkeypatch.setattr(merkle, "SHARE", 32)
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", "en", 1, str(i)) for i in range(600)]
    tree = merkle.manifest(merkle.tampered_leaves(spark.createDataFrame(rows, SCHEMA)))
    nodes = tree.nodes.collect()
    parent = {r.node: r.parent for r in nodes}
    for node in parent:
        for _ in range(10):
            node = parent[node] if node is not None else None
        assert node is None
    assert len({(r.node, r.share) for r in nodes}) == len(nodes)
    upward = tree.runs.filter("parent IS NOT NULL")
    at = (tree.runs["parent"] == tree.nodes["node"]) & (tree.runs["share"] == tree.nodes["share"])
    assert tree.runs.join(tree.nodes, at).count() == upward.count() > 40
    assert tree.runs.selectExpr("sum(size(leaves))").first()[0] == 600
    most = tree.runs.groupBy("share").count().agg({"count": "max"}).first()[0]
    assert most <= 2  # runs of 16 in a share of 32
    proofs = {r.doc_id: sha(r.proof.hex()) for r in merkle.climbed(tree).collect()}
    assert proofs == {r[0]: r[4] for r in plain(rows)}
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"
