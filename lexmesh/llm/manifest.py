"""Operator 11, a Merkle manifest of a dataset by slot pivot.

Every row is a leaf. The leaves of a group stand in order; a parent's children are spread into one column a slot by conditional
aggregates, the columns' concatenation is hashed, and the columns but a child's own are its siblings. What remains of each
group, its subroot, is a node of the tree of groups, which ends in the root.

A block of fanout ** LEVELS consecutive nodes is folded in one stage (its levels need no further shuffle), and each of its
leaves carries the siblings that it met. The blocks' tops are the nodes of the next round. On the way down a block is joined
to its top's path, so siblings are written once a block and a hot group is as many blocks as its rows need.

Defined cases: a null is hashed as ``-``, an empty string as ``0:``. Null groups are one group, the first. Null order keys
come first; rows of one key stand by their leaves, and rows alike in everything have the same leaf at places of their own.
A lone leaf is its subroot, a lone subroot the root; both have no siblings, and a proof of none is the hash of the empty
string. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, settle

FANOUT = 3
LEVELS = 4  # folded in one stage: a block has fanout ** LEVELS nodes
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ENTRY = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Hash of parts one after the other, as hex text; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(values: list[Column]) -> Column:
    """A row's digest: each value as the count of its bytes, a colon and itself, or a dash."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(*(one(v.cast("string")) for v in values))


def _blocks(nodes: DataFrame, fanout: int) -> DataFrame:
    """(g, block, n, digest, leaves) of nodes (g, pos, n, digest, load): leaves have their load and path, n is the nodes' count in g."""
    start = nodes.select("g", "n", F.expr(f"pos div {fanout**LEVELS}").alias("block"), "pos", F.struct("digest", F.array(F.struct("load", F.expr(f"cast(array() as array<{ENTRY}>)").alias("path"))).alias("leaves")).alias("node"))
    level_rows = start.repartition("g", "block")
    for level in range(LEVELS):
        several = F.col("n") > fanout**level  # whether the group has more than one node here
        slot = F.col("pos") % fanout
        slots = [F.max(F.when(slot == j, F.col("node"))).alias(f"s{j}") for j in range(fanout)]
        pivot = level_rows.groupBy("g", "n", "block", F.expr(f"pos div {fanout}").alias("pos")).agg(*slots)
        digests = [F.col(f"s{j}.digest") for j in range(fanout)]

        def met(j: int, several: Column = several, digests: list[Column] = digests) -> Column:
            entry = F.struct(F.concat_ws("", *digests[:j]).alias("left"), F.concat_ws("", *digests[j + 1 :]).alias("right"))
            added = F.when(several, F.array(entry)).otherwise(F.expr(f"cast(array() as array<{ENTRY}>)"))
            return F.coalesce(F.transform(F.col(f"s{j}.leaves"), lambda x: F.struct(x["load"].alias("load"), F.concat(x["path"], added).alias("path"))), F.array())

        folded = F.when(several, digest(*digests)).otherwise(digests[0])
        level_rows = pivot.select("g", "n", "block", "pos", F.struct(folded.alias("digest"), F.concat(*(met(j) for j in range(fanout))).alias("leaves")).alias("node"))
    return level_rows.select("g", "block", "n", "node.digest", "node.leaves")


def _rounds(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and (g, digest) of what remains of each group."""
    size, most, rounds = fanout**LEVELS, nodes.agg(F.max("n")).first()[0] or 0, []
    while most > 1 or not rounds:
        rounds.append(settle(_blocks(nodes, fanout)))
        most = -(-most // size)
        nodes = rounds[-1].select("g", F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), "digest", F.col("block").alias("load"))
    return rounds, nodes.select("g", "digest")


def _down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(g, load, subroot, root, path) of the first round's nodes; tops (g, subroot, root, path) are of the groups."""
    upper = tops.withColumn("load", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        on = blocks.select("g", F.col("block").alias("load"), "leaves").join(upper, ["g", "load"])
        each = on.select("g", "subroot", "root", F.col("path").alias("above"), F.explode("leaves").alias("x"))
        upper = each.select("g", F.col("x.load").alias("load"), "subroot", "root", F.concat("x.path", "above").alias("path"))
    return upper


def prove(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(g, load, subroot, root, path) of leaves (g, pos, n, digest, load): path has, from the leaf up, the joined digests left and right of it."""
    rounds, subroots = _rounds(leaves, fanout)
    one = numbered(subroots.select(F.lit(0).alias("all"), F.struct("g", F.col("digest").alias("subroot")).alias("load"), "digest", "g"), "all", F.col("g"))
    top_rounds, roots = _rounds(one.select(F.lit("").alias("g"), "pos", "n", "digest", "load"), fanout)
    root = roots.select("g", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.expr(f"cast(array() as array<{ENTRY}>)").alias("path"))
    tops = _down(top_rounds, root).select("load.g", "load.subroot", "root", "path")
    return _down(rounds, settle(tops))


def proof(path: Column) -> Column:
    """Hash of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def fold(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf_digest, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def manifest(docs: DataFrame, changed: Column | None = None, columns: tuple[str, ...] = COLUMNS, group: str = "source", order: str = "doc_id", text: str = "text", fanout: int = FANOUT) -> DataFrame:
    """(order key, leaf, claimed, subroot, root, path) of every row; claimed is the leaf with ``changed`` in text's place, which ``fold`` can hold against root."""
    values = [F.col(c) for c in columns]
    claimed = leaf([changed if c == text and changed is not None else F.col(c) for c in columns])
    g = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    rows = docs.select(g.alias("g"), F.col(order).alias("key"), leaf(values).alias("leaf"), claimed.alias("claimed"))
    placed = numbered(rows, "g", F.asc_nulls_first("key"), F.col("leaf"))
    proved = prove(placed.select("g", "pos", "n", F.col("leaf").alias("digest"), F.struct("key", "leaf", "claimed").alias("load")), fanout)
    return proved.select(F.col("load.key").alias(order), "load.leaf", "load.claimed", "subroot", "root", "path")
