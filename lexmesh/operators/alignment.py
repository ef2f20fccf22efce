"""One source space aligned with a target space in four modes (as given with glosses or bare, and both of these whitened), with reports that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, unit
from ..ranks import numbered
from ..storage import settle
from . import linalg

MODES = ("gloss", "bare", "whitened", "bare_whitened")


def whitened(rows: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Rows (id, vec, ...) with vec whitened by the rows' own mean and covariance; their own sums, in one pass, decide."""
    mean, w = linalg.whitening(linalg.gram(rows, "vec"), floor)
    return linalg.apply_linear(rows, "vec", w.T, -mean @ w, "white").drop("vec").withColumnRenamed("white", "vec")


def random_cosine(rows: DataFrame, pairs: int = 1000, seed: int = 42) -> DataFrame:
    """(pairs, mean) of the cosine between rows (id, vec) that a seeded hash picks; a row is never paired with itself."""
    placed = numbered(rows.select(F.lit(0).alias("all"), "id", "vec"), "all", F.col("id")).select("pos", "n", unit(F.col("vec")).alias("vec"))
    placed = settle(placed)
    n = placed.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if n < 2:
        return rows.sparkSession.createDataFrame([(0, None)], "pairs long, mean double")
    drawn = rows.sparkSession.range(pairs).select("id", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("a"), (1 + F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(n - 1))).alias("step"))
    drawn = drawn.select("a", F.pmod(F.col("a") + F.col("step"), F.lit(n)).alias("b"))
    at = lambda name: placed.select(F.col("pos").alias(name), F.col("vec").alias(f"v{name}"))
    return drawn.join(at("a"), "a").join(at("b"), "b").agg(F.count("*").alias("pairs"), F.avg(cosine(F.col("va"), F.col("vb"))).alias("mean"))


def aligned(source: DataFrame, target: DataFrame, anchors: DataFrame, test: Column, alpha: float = 100.0, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(k, n, accuracy, train, test, valid, total) of one mode.

    source and target are (id, vec), anchors (source_id, target_id); anchors that a space lacks are not valid. test, over
    source_id, holds anchors out. Accuracy is the percent of held-out anchors whose target is among the k nearest to the
    projected source.
    """
    x, y = source.select(F.col("id").alias("source_id"), F.col("vec").alias("x")), target.select(F.col("id").alias("target_id"), F.col("vec").alias("y"))
    valid = settle(anchors.select("source_id", "target_id", test.alias("held")).join(x, "source_id").join(y, "target_id"))
    coef, bias = linalg.ridge(linalg.gram(valid.filter(~F.col("held")), "x", "y"), alpha)
    held = valid.filter("held").select(F.col("source_id").alias("id"), F.col("x").alias("vec"), F.col("target_id").alias("gold"))
    made = settle(linalg.apply_linear(held, "vec", coef, bias).select("id", unit(F.col("projected")).alias("vec"), "gold"))
    counts = valid.agg(F.count_if(~F.col("held")).alias("train"), F.count_if("held").alias("test"), F.count("*").alias("valid"))
    total = anchors.agg(F.count("*")).scalar()
    return linalg.accuracy(made, settle(target.select("id", unit(F.col("vec")).alias("vec"))), ks).crossJoin(F.broadcast(counts)).withColumn("total", total)


def modes(source: DataFrame, spaces: dict[str, DataFrame], anchors: DataFrame, test: Column, alpha: float = 100.0) -> DataFrame:
    """``aligned`` in every mode that spaces (gloss and bare) allow, with the column mode."""
    out = None
    for mode in MODES:
        base = "bare" if mode.startswith("bare") else "gloss"
        if base not in spaces:
            continue
        target = spaces[base].select("id", "vec")
        own = aligned(source, settle(whitened(target)) if mode.endswith("whitened") else target, anchors, test, alpha).select(F.lit(mode).alias("mode"), "*")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("spaces must have gloss or bare")
    return out


def merged(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, baseline, delta) of two runs' reports (key, value), also of keys that one of them lacks, without a delta."""
    a, b = left.select(F.col(key).alias("_a"), value), right.select(F.col(key).alias("_b"), F.col(value).alias("baseline"))
    both = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full")
    return both.select(F.coalesce("_a", "_b").alias(key), value, "baseline", F.round(F.col(value) - F.col("baseline"), 6).alias("delta"))
