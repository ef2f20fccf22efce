"""The atlas of lenses over any pair of spaces, from one configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lenses
from .knn import pair_report


@dataclass(frozen=True)
class AtlasConfig:
    """The inputs and thresholds of an atlas.

    source and target are (id, vec) of one space with unit vectors, second the source's (id, vec) in another space or None;
    anchors is (source_id, source_token, target_id, target_word, confidence), clusters (label, vec) the unit centres of lens 6.
    queries picks the rows that lenses 2 to 4 ask about; frequency is the weight of a token in lens 2.
    """

    source: DataFrame
    target: DataFrame
    anchors: DataFrame
    clusters: DataFrame
    second: DataFrame | None = None
    queries: Column = field(default_factory=lambda: F.lit(True))
    frequency: Column = field(default_factory=lambda: F.lit(1))
    top: int = 50
    neighbours: int = 10
    isolation_range: tuple[float, float, int] = (0.0, 2.0, 20)
    pair_threshold: float = 0.95
    pair_range: tuple[float, float, int] = (0.85, 1.0, 15)
    min_confidence: float = 0.5
    min_length: int = 2


def run(c: AtlasConfig) -> dict[str, DataFrame]:
    """The lenses' rows by name; lens 4 is left out without a second space."""
    asked = c.source.filter(c.queries)
    anchored = c.anchors.select(F.col("source_id").alias("id")).distinct()
    alone = lenses.isolation(asked, c.source, c.neighbours)
    pairs, bins = pair_report(c.source, c.top, *c.pair_range)
    made = {
        "lens1": lenses.lens1(c.anchors, c.source, c.target, c.top),
        "lens1_filtered": lenses.lens1(c.anchors, c.source, c.target, c.top, True, c.min_confidence, c.min_length),
        "lens2": lenses.lens2(asked, anchored, c.target, c.frequency, c.top),
        "lens3": alone.orderBy(F.desc("distance"), "id").limit(c.top),
        "lens3_histogram": lenses.histogram(alone, "distance", *c.isolation_range),
        "lens5": with_flags(pairs.filter(F.col("score") >= c.pair_threshold), anchored),
        "lens5_histogram": bins,
        "lens6": lenses.bridges(c.source, c.clusters, "label").orderBy(F.desc("bridge"), "id").limit(c.top),
    }
    if c.second is not None:
        made["lens4"] = lenses.divergence(asked, c.source, c.second.filter(c.queries), c.second, c.neighbours).orderBy(F.desc("jaccard"), "id").limit(c.top)
    return made


def with_flags(pairs: DataFrame, anchored: DataFrame) -> DataFrame:
    """pairs (a, b, score) with whether each side has an anchor (id)."""
    own = anchored.select("id").distinct()
    for side in ("a", "b"):
        marks = own.select(F.col("id").alias(f"_{side}"), F.lit(True).alias(f"{side}_anchored"))
        pairs = pairs.join(marks, F.col(side) == F.col(f"_{side}"), "left").withColumn(f"{side}_anchored", F.coalesce(f"{side}_anchored", F.lit(False))).drop(f"_{side}")
    return pairs


#: By lens: its item, its value, and the sign by which the least comes first.
FIRST: dict[str, tuple[Callable[[], Column], str, int]] = {
    "lens1": (lambda: F.col("source_token"), "cos", 1), "lens2": (lambda: F.col("id").cast("string"), "score", -1), "lens3": (lambda: F.col("id").cast("string"), "distance", -1),
    "lens4": (lambda: F.col("id").cast("string"), "jaccard", -1), "lens5": (lambda: F.concat_ws("-", "a", "b"), "score", -1), "lens6": (lambda: F.col("id").cast("string"), "bridge", -1),
}


def summary(made: dict[str, DataFrame]) -> DataFrame:
    """(lens, item, value): each lens's first entry; n/a for a lens without rows."""
    out = None
    for name, (item, value, sign) in FIRST.items():
        if name not in made:
            continue
        rows = made[name].select(item().alias("item"), F.col(value).alias("value"), (sign * F.col(value)).alias("o"))
        first = rows.agg(F.min(F.struct("o", F.length("item").alias("n"), "item", "value")).alias("t"))
        row = first.select(F.lit(name).alias("lens"), F.coalesce("t.item", F.lit("n/a")).alias("item"), F.col("t.value").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def stamp(inputs: dict[str, DataFrame]) -> DataFrame:
    """(input, n, sha256) of the rows of each input, whatever their order: the hash is over sums of row hashes."""
    out = None
    for name, df in inputs.items():
        cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
        sums = [F.sum(F.xxhash64(F.lit(k), *cols).cast("decimal(38,0)")) for k in (1, 2)]
        row = df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", F.count("*"), *sums), 256).alias("sha256")).select(F.lit(name).alias("input"), "n", "sha256")
        out = row if out is None else out.unionByName(row)
    return out
