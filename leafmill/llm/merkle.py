"""Merkle manifest of a table: a tree of digests per group, one over the groups, and proofs per row.

Every row is a leaf. Per group (``source``), the leaves in order of their key are hashed level by level,
``FAN`` neighbours at a time, down to the group's subroot; the subroots in order of their group likewise
give the root. The levels are kept as parent-linked node rows: what a node is called, the digests of its
children, its parent, and its place among the parent's children.

Proofs come from one recursive query. Starting at a leaf's parent it climbs from node to node, appends
the siblings it passes to the proof and folds every leaf's digest with them, until there is no parent.
Fold a digest of what a row holds now, and it ends at the root only if nothing was changed. The leaves
of one run have the same siblings from their parent on: they climb in one row, each folding its own
digest, so that these siblings are carried once and not once per leaf.

Nodes near the top are met by many runs, so each is stored once per share of ``SHARE`` consecutive
leaves below it: no join key is met by more runs than a share has, however large a group is. Positions
come from range-partitioned running totals, and no level is gathered anywhere.

Defined results: a null value is ``-`` in its leaf, so that it differs from an empty text; a null group
is a group, the first one; rows of one key stand in order of their digests, and repeated rows have a
leaf each; a lone leaf is its group's subroot and a lone subroot the root, without siblings; a null key
is never taken for tampered; texts of any length are hashed whole; other columns are ignored, whatever
their names; an empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.batches import written
from leafmill.plans.scale import running_totals, spread_join

BITS = 4
FAN = 1 << BITS
DIGEST = 32  # bytes
#: Leaves that meet the same copy of a node.
SHARE = FAN**4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

CLIMB = """
    WITH RECURSIVE climb (leaves, share, node, place, proof, subroot, root) AS (
        SELECT leaves, share, parent, place, CAST('' AS BINARY), subroot, root FROM {runs}
        UNION ALL
        SELECT
            transform(leaves, x -> named_struct(
                'doc_id', x.doc_id, 'leaf', x.leaf,
                'folded', unhex(sha2(lower(hex(concat(before, x.folded, after))), 256))
            )),
            share, parent, next_place, concat(proof, before, after),
            coalesce(subroot, node_subroot), coalesce(root, node_root)
        FROM (
            SELECT
                c.*, n.parent, n.place AS next_place, n.subroot AS node_subroot, n.root AS node_root,
                substring(n.children, 1, c.place * {digest}) AS before,
                substring(n.children, (c.place + 1) * {digest} + 1) AS after
            FROM climb c JOIN {nodes} n ON c.node = n.node AND c.share = n.share
        )
    )
    SELECT leaves, proof, subroot, root FROM climb WHERE node IS NULL
"""


@dataclass
class Manifest:
    """``runs`` (``leaves, share, parent, place, subroot, root``) of up to ``FAN`` leaves (``doc_id, leaf,
    folded``, the last folded with the others of its run), ``nodes`` (``level, node, share, children,
    parent, place, subroot, root``) and ``roots``, of one row (``digest``)."""

    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame


def hashed(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """What a value adds to its leaf: its length and itself, or ``-``."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(row: DataFrame, fields: Sequence[str] = FIELDS, **changed: Column) -> Column:
    """Digest of the row's fields, some of them as ``changed``."""
    return hashed(F.concat(*[field(changed.get(name, row[name])) for name in fields]))


def lower_cased(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def named(level: Column, at: Column, tree: Column) -> Column:
    return F.concat(level.cast("string"), F.lit("."), at.cast("string"), F.lit("."), tree)


def joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda x, y: F.concat(x, y))


def without(digests: Column, place: Column) -> tuple[Column, Column]:
    """What stands before and after one of some joined digests."""
    before = F.substring(digests, F.lit(1), place * DIGEST)
    return before, F.substring(digests, (place + 1) * DIGEST + 1, F.length(digests))


def _runs(placed: DataFrame) -> DataFrame:
    """Runs of leaves (``doc_id, tree, leaf, folded, at, n``) as nodes, each with its leaves.

    A lone leaf is a run whose digest is its own.
    """
    own = F.struct("at", "doc_id", "leaf", "folded")
    runs = placed.groupBy("tree", F.shiftright("at", BITS).alias("at"), F.col("n").alias("leaves_below")).agg(
        F.array_sort(F.collect_list(own)).alias("run")
    )
    runs = runs.withColumn("children", joined(F.transform("run", lambda x: x["leaf"])))
    several = F.col("leaves_below") > 1

    def folded(x: Column, place: Column) -> Column:
        before, after = without(F.col("children"), place)
        up = F.when(several, hashed(hex_text(F.concat(before, x["folded"], after)))).otherwise(x["folded"])
        return F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), up.alias("folded"))

    return runs.select(
        "tree",
        "at",
        F.ceil(F.col("leaves_below") / FAN).alias("n"),
        "leaves_below",
        "children",
        F.when(several, hashed(hex_text(F.col("children")))).otherwise(F.col("children")).alias("digest"),
        F.transform("run", folded).alias("leaves"),
    )


def _grown(base: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``base`` (``tree, at, n, leaves_below, digest``), and the top of every tree.

    ``n`` is the number of nodes of the tree in that level, ``leaves_below`` that of its leaves.
    """
    kept = ["tree", "leaves_below", "digest"]
    levels, tops, below = [], base.filter("n = 1").select(*kept), base
    while not below.filter("n > 1").isEmpty():
        child = F.struct(F.col("at").alias("k"), F.col("digest"))
        runs = below.filter("n > 1").groupBy("tree", F.shiftright("at", BITS).alias("at"), "n", "leaves_below").agg(
            F.array_sort(F.collect_list(child)).alias("run")
        )
        children = joined(F.transform("run", lambda x: x["digest"]))
        above = runs.select("tree", "at", F.ceil(F.col("n") / FAN).alias("n"), "leaves_below", children.alias("children"))
        below = written(above.withColumn("digest", hashed(hex_text(F.col("children")))), name)
        levels.append(below)
        tops = tops.unionByName(below.filter("n = 1").select(*kept))
    return levels, tops


def _link(level: int) -> tuple[Column, Column]:
    """Parent and place of a node of ``level`` that is not its tree's top."""
    up = named(F.lit(level + 1), F.shiftright("at", BITS), F.col("tree"))
    return F.when(F.col("n") > 1, up), F.when(F.col("n") > 1, F.col("at").bitwiseAND(FAN - 1).cast("int"))


def _hung(rows: DataFrame, groups: DataFrame, level: int) -> DataFrame:
    """``rows`` (``tree, at, n, digest``) with ``parent, place, subroot, root``; tops hang in the upper tree."""
    up, place = _link(level)
    inner = rows.filter("n > 1").withColumns({"parent": up, "place": place, "subroot": F.lit(None).cast("binary"), "root": F.lit(None).cast("binary")})
    own = groups.select("tree", F.col("at").alias("_at"), F.col("n").alias("_n"))
    first = named(F.lit(1), F.shiftright("_at", BITS), F.lit(""))
    tops = rows.filter("n = 1").join(own, "tree").withColumns(
        {
            "parent": F.when(F.col("_n") > 1, first),
            "place": F.when(F.col("_n") > 1, F.col("_at").bitwiseAND(FAN - 1).cast("int")),
            "subroot": F.col("digest"),
            "root": F.when(F.col("_n") == 1, F.col("digest")),
        }
    )
    return inner.unionByName(tops.drop("_at", "_n"))


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "source") -> Manifest:
    """Manifest of ``rows`` (``key, group, leaf, folded``): the leaves and what is to be folded for each."""
    tree = F.when(F.col(group).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group)))
    once = written(
        rows.select(F.col(key).alias("doc_id"), tree.alias("tree"), "leaf", "folded").withColumn("_row", F.monotonically_increasing_id()), "leaves"
    )
    ranked = running_totals(once, "tree", ["doc_id", "leaf", "_row"])
    n = F.col("_group_size")
    placed = ranked.select("doc_id", "tree", "leaf", "folded", (F.col("_position") - 1).alias("at"), n.alias("n"))
    runs = written(_runs(placed), "runs")
    levels, subroots = _grown(runs, "level")

    # the upper tree, over the groups
    numbered = running_totals(subroots.withColumn("_all", F.lit(0)), "_all", ["tree"])
    groups = written(
        numbered.select("tree", F.col("leaves_below").alias("rows"), "digest", (F.col("_position") - 1).alias("at"), n.alias("n")), "groups"
    )
    upper, roots = _grown(groups.select(F.lit("").alias("tree"), "at", "n", F.col("n").alias("leaves_below"), "digest"), "upper")

    share = lambda k: F.concat(k.cast("string"), F.lit("."), F.col("tree"))
    kept = ["level", "node", "share", "children", "parent", "place", "subroot", "root"]
    nodes, climbing = [], None
    for level, part in enumerate([runs, *levels], 1):
        first = F.shiftleft("at", BITS * level)
        last = F.least("leaves_below", F.shiftleft(F.col("at") + 1, BITS * level)) - 1
        copies = F.explode(F.sequence(F.floor(first / SHARE), F.floor(last / SHARE)))
        hung = _hung(part, groups, level).withColumns({"level": F.lit(level), "node": named(F.lit(level), F.col("at"), F.col("tree"))})
        if level == 1:
            climbing = hung.withColumn("share", share(F.floor(first / SHARE))).select("leaves", "share", "parent", "place", "subroot", "root")
        nodes.append(hung.withColumn("k", copies).withColumn("share", share(F.col("k"))).select(*kept))
    shares = groups.select("tree", F.col("at").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / SHARE))).alias("k"))
    for level, part in enumerate(upper, 1):
        up, place = _link(level)
        hung = part.select(
            "at",
            F.lit(level).alias("level"),
            "children",
            named(F.lit(level), F.col("at"), F.lit("")).alias("node"),
            up.alias("parent"),
            place.alias("place"),
            F.lit(None).cast("binary").alias("subroot"),
            F.when(F.col("n") == 1, F.col("digest")).alias("root"),
        )
        met = spread_join(shares.withColumn("at", F.shiftright("g", BITS * level)), hung, ["at"], ["tree", "k"])
        nodes.append(met.withColumn("share", share(F.col("k"))).select(*kept))
    linked = nodes[0]
    for part in nodes[1:]:
        linked = linked.unionByName(part)
    return Manifest(climbing, written(linked, "nodes"), roots.select("digest"))


def climbed(tree: Manifest, told: Callable[[Column], Column] | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded`` of every leaf: its siblings on the way up, or what
    ``told`` makes of them, and the digest that ``folded`` gives with them."""
    spark = tree.nodes.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # rows of a table; the depth has its own limit
    try:
        # runs start at their own node and meet only those above: names in the upper tree end so
        above = tree.nodes.filter((F.col("level") > 1) | F.col("node").endswith("."))
        met = spark.sql(CLIMB, runs=tree.runs, nodes=above, digest=DIGEST)
        each = met.withColumn("own", joined(F.transform("leaves", lambda x: x["leaf"]))).select(
            F.posexplode("leaves").alias("at", "x"), "own", "proof", "subroot", "root"
        )
        proof = F.concat(*without(F.col("own"), F.col("at")), "proof")
        found = each.select("x.doc_id", "x.leaf", "subroot", "root", (told(proof) if told else proof).alias("proof"), "x.folded")
        return written(found, "proofs")
    finally:
        spark.conf.set(limit, before)


def tampered_leaves(docs: DataFrame, every: int = 5) -> DataFrame:
    """``doc_id, source, leaf, folded``: ``folded`` is the leaf of the row after its tampering, if any."""
    odd = F.crc32(docs["doc_id"].cast("string")) % every == 0
    changed = leaf_of(docs, text=lower_cased(docs["text"]))
    leaf = leaf_of(docs)
    return docs.select(docs["doc_id"], docs["source"], leaf.alias("leaf"), F.when(odd, changed).otherwise(leaf).alias("folded"))


def verification(docs: DataFrame) -> DataFrame:
    """Digests and proof of every row, and whether what it holds after tampering still leads to the root."""
    found = climbed(manifest(tampered_leaves(docs)), lambda proof: F.sha2(hex_text(proof), 256))
    return found.select(
        "doc_id",
        *[hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.col("proof").alias("proof_sha256"),
        hex_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
