"""Writers and report rendering (K1-K7). Rows are written by Spark; reports hold short tables only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_texts(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """K1, K3: texts, anchors or vectors as Parquet or JSON lines."""
    df.write.mode("overwrite").format(kind).save(path)


def write_corpus(df: DataFrame, path: str, text: str = "text") -> None:
    """K2: one text a line."""
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """K5, K6: rows as JSON, fields in order of their names."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def markdown(df: DataFrame, most: int = 50) -> str:
    """K7: the first rows as a Markdown table; numbers with four decimals, bars escaped."""
    rows = df.limit(most).collect()
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])


def bars(histogram: DataFrame, width: int = 40) -> DataFrame:
    """K7: a histogram (bin, n) with a bar of at most width marks."""
    topped = histogram.withColumn("top", histogram.agg(F.max("n").alias("top")).scalar())
    size = F.when(F.col("top") > 0, F.floor(F.col("n") / F.col("top") * width)).otherwise(0).cast("int")
    return topped.select("bin", "n", F.repeat(F.lit("█"), size).alias("bar"))


def fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 of binary files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def metadata(shared: dict, spaces: dict[str, dict], accuracy: dict[str, DataFrame] | None = None) -> dict:
    """K4: an export's description: schema version, what the spaces share, and each space's provenance with its defaults and accuracy (k, accuracy)."""
    defaults = {"ridge_alpha": 100, "dtype": "float16", "accuracy": None}
    out = {"schema_version": 2, "shared": {"random_state": 42} | shared, "spaces": {}}
    for name, own in spaces.items():
        scores = (accuracy or {}).get(name)
        found = None if scores is None else {f"top{r['k']}": r["accuracy"] for r in scores.select("k", "accuracy").orderBy("k").limit(100).collect()}
        out["spaces"][name] = defaults | own | ({"accuracy": found} if found else {})
    return out


def write_metadata(spark: SparkSession, made: dict, path: str) -> None:
    """K4: metadata as one line of JSON, keys in order."""
    spark.range(1).select(F.lit(json.dumps(made, sort_keys=True)).alias("value")).write.mode("overwrite").text(path)
