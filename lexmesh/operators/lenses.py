"""The anomaly lenses (L1-L6) and their histograms (A16). Ranks go by rounded scores, then ids, so ties have one order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_junk_gloss
from ..functions.vectors import cosine, unit
from ..ranks import numbered
from ..storage import settle
from .knn import matrix, nearest
from .lookup import displacement


def histogram(values: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) over half-open bins, the last one closed; values outside are left out, empty bins stay."""
    x = F.col(value)
    at = F.least(F.floor((x - low) / F.lit((high - low) / bins) + 1e-9), F.lit(bins - 1)).cast("int")
    found = values.filter(x.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def lens1(anchors: DataFrame, source: DataFrame, target: DataFrame, top: int = 50, filtered: bool = False, min_confidence: float = 0.5, min_length: int = 2) -> DataFrame:
    """Anchors whose translation lies farthest away: cosine ascending, then source."""
    if filtered:  # P8
        w = F.col("target_word")
        anchors = anchors.filter(~is_junk_gloss(w) & (F.length("source_token") >= min_length) & (F.col("confidence") >= min_confidence))
    return displacement(anchors, source, target).select("source_token", "target_word", "confidence", "cos").orderBy("cos", "source_token").limit(top)


def lens2(queries: DataFrame, anchored: DataFrame, target: DataFrame, frequency: DataFrame | Column, top: int = 50) -> DataFrame:
    """Tokens without an anchor, by frequency times distance to their best target: score descending, then id.

    frequency is (id, n), where ids that it lacks count 0 (J5), or a column over id.
    """
    free = queries.join(anchored.select("id"), "id", "left_anti")
    best = nearest(free.select("id", "vec"), target.select("id", "vec"), 1)
    scored = best.select(F.col("qid").alias("id"), F.col("id").alias("best_id"), F.col("score").alias("cos"))
    if isinstance(frequency, DataFrame):
        scored, frequency = scored.join(frequency.select("id", F.col("n").alias("_n")), "id", "left"), F.coalesce("_n", F.lit(0))
    scored = scored.withColumn("score", F.round(frequency * (1 - F.col("cos")), 6)).select("id", "best_id", "cos", "score")
    return scored.orderBy(F.desc("score"), "id").limit(top)


def isolation(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """L3: (id, distance, nearest5): distance to the k-th other row, and the five nearest ids; ids with fewer than k others are left out."""
    near = nearest(queries, rows, k, other=True)
    five = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["rank"] <= 5), lambda s: s["id"].cast("string")), ",")
    got = near.groupBy(F.col("qid").alias("id")).agg(F.count("*").alias("n"), F.round(1 - F.min("score"), 6).alias("distance"), five.alias("nearest5"))
    return got.filter(F.col("n") == k).drop("n")


def divergence(queries_a: DataFrame, a: DataFrame, queries_b: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """L4: (id, jaccard): Jaccard distance of a token's neighbours in two spaces."""
    x = nearest(queries_a, a, k, other=True).select("qid", "id")
    y = nearest(queries_b, b, k, other=True).select("qid", "id").withColumn("both", F.lit(1))
    shared = x.join(y, ["qid", "id"], "left").groupBy(F.col("qid").alias("id")).agg(F.count("both").alias("shared"))
    return shared.select("id", F.round(1 - F.col("shared") / (2 * k - F.col("shared")), 6).alias("jaccard"))


def centroids(rows: DataFrame, group: str) -> DataFrame:
    """(group, vec) unit mean vectors, by partial sums."""
    mean = rows.groupBy(group).agg(Summarizer.mean(array_to_vector("vec")).alias("m"))
    return mean.select(group, unit(vector_to_array("m")).alias("vec"))


def bridges(rows: DataFrame, centers: DataFrame, group: str, limit: int = 4096) -> DataFrame:
    """(id, nearest, second, bridge): the ratio of a row's distances to its two nearest centers; 1 where the second is 0.

    centers must be few (at most limit): they are sent to every task.
    """
    c = centers.select(F.col(group).cast("long").alias("g"), "vec").orderBy("g").limit(limit + 1).toArrow()
    if c.num_rows > limit:
        raise ValueError(f"more than {limit} centers")
    sent = rows.sparkSession.sparkContext.broadcast((c.column("g").to_numpy(), matrix(c.column("vec"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, m = sent.value
        if len(g) < 2:
            return
        for b in batches:
            if not b.num_rows:
                continue
            d = np.round(1 - np.clip(matrix(b.column(1)) @ m.T, -1, 1), 6)
            order = np.argsort(d, axis=1, kind="stable")[:, :2]
            d1, d2 = (np.take_along_axis(d, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
            ratio = np.where(d2 > 0, d1 / np.where(d2 > 0, d2, 1), 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(g[order[:, 0]]), pa.array(g[order[:, 1]]), pa.array(np.round(ratio, 6))], ["id", "nearest", "second", "bridge"])

    return rows.select("id", "vec").mapInArrow(work, "id long, nearest long, second long, bridge double")


def members(assigned: DataFrame, group: str, first: int = 5) -> DataFrame:
    """(group, members): the first ids of each group in id order; parts of a group are cut to their first ids before they meet."""
    parts = assigned.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = parts.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_s").orderBy("id"))).filter(F.col("_r") <= first)
    ids = F.transform(F.slice(F.array_sort(F.collect_list("id")), 1, first), lambda x: x.cast("string"))
    return some.groupBy(group).agg(F.array_join(ids, ",").alias("members"))


def spread(rows: DataFrame, group: str) -> DataFrame:
    """(group, n, spread): the mean cosine distance of a group's rows to its centroid."""
    c = centroids(rows, group).withColumnRenamed("vec", "_c")
    return rows.join(c, group).groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(1 - cosine(F.col("vec"), F.col("_c"))), 6).alias("spread"))


def merges_splits(grid: DataFrame, ratio: float = 2.0, least: float = 0.01) -> DataFrame:
    """(a, b, kind) of pairs (a, b, da, db) whose distances in two spaces differ by the ratio; pairs nearer than least are left out."""
    merged, split = F.col("db") / F.col("da") >= ratio, F.col("da") / F.col("db") >= ratio
    g = grid.filter((F.col("da") >= least) & (F.col("db") >= least))
    return g.filter(merged | split).select("a", "b", F.when(merged, "merge").otherwise("split").alias("kind"))


def rank_domains(domains: DataFrame, pairs: DataFrame, similar: DataFrame) -> DataFrame:
    """(domain, merges, splits, score) with score = 2 merges + 2 splits + 5 (1 - mean similarity); pairs as from merges_splits."""
    each = pairs.select(F.explode(F.array("a", "b")).alias("label"), "kind")
    counts = each.groupBy("label").agg(F.count_if(F.col("kind") == "merge").alias("merges"), F.count_if(F.col("kind") == "split").alias("splits"))
    x = domains.join(counts, "label", "left").join(similar, "label", "left").fillna({"merges": 0, "splits": 0, "similarity": 0.0})
    score = 2 * F.col("merges") + 2 * F.col("splits") + 5 * (1 - F.col("similarity"))
    return x.select(F.col("label").alias("domain"), "merges", "splits", F.round(score, 6).alias("score"))


def permutation_test(rows: DataFrame, rounds: int = 999, seed: int = 42) -> DataFrame:
    """(grp, n, mean, p_value) for rows (grp, id, value): the share of random relabellings whose mean for the group is at least its own.

    A relabelling orders all rows by a seeded hash of round and id and hands the groups out again in that order, so every group
    keeps its size and every value is dealt once. Values count in millionths, which makes sums exact; p counts the observed
    labels, too. Rows without a group or a value are left out. No task holds a round: ranks come from a global sort.
    """
    known = rows.filter(F.col("grp").isNotNull() & F.col("value").isNotNull()).select("grp", "id", F.round(F.col("value") * 1e6).cast("long").alias("v"))
    known = settle(known)
    own = known.groupBy("grp").agg(F.count("*").alias("n"), F.sum("v").alias("own"))
    slots = numbered(known.select("grp", "id", F.lit(0).alias("all")), "all", F.col("grp"), F.col("id")).select("pos", "grp")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.col("id").cast("string")).cast("binary"))
    each = known.select("id", "v", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("h", h)
    dealt = numbered(each, "round", F.col("h"), F.col("id"), F.col("v")).select("round", "pos", "v").join(slots, "pos")
    sums = dealt.groupBy("grp", "round").agg(F.sum("v").alias("drawn"))
    beat = sums.join(own, "grp").groupBy("grp").agg(F.count_if(F.col("drawn") >= F.col("own")).alias("k"))
    return own.join(beat, "grp").select("grp", "n", F.round(F.col("own") / F.col("n") / 1e6, 6).alias("mean"), F.round((F.col("k") + 1) / (rounds + 1), 6).alias("p_value"))
