"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing, each stage reading the last one's Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmesh.llm import stages
from lexmesh.storage import distilled

#: (name, function of (spark, docs, sf_dir)), in order.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("packing", stages.packing),
]

#: Tokens, near-duplicate classes and line classes have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written to the shared folder and read again, and what it needed meanwhile goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = distilled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
