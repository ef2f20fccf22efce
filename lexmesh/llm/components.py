"""Connected components of links by alternating large and small stars: every round is joins and minima, cut at the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF))
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, cls) for every id in links, cls the smallest id of its component. Loops and repeated links do no harm.

    The minima are combined before the shuffle and a hot centre's links are on the side of the join that Spark can split,
    so no task gathers a component. Raises after ``rounds``; the rounds needed grow with the logarithm of the size.
    """
    u, v = F.col(a), F.col(b)
    edges = settle(links.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        # large star: neighbours above a node go to the least of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = settle(large)
        # small star: neighbours below a node, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = settle(down.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        now = _state(new)
        edges = new
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("cls")).unionByName(roots.select("id", F.col("id").alias("cls")))
