"""Whole reports: the atlas of lenses, the anchor audit and the coverage diagnosis, written as Parquet and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import atlas
from ..sources.sinks import bars, markdown
from . import audit_queries, vector_queries
from .registry import QUERIES, table

AUDIT = ("anchor_audit_buckets", "anchor_audit_venn", "anchor_audit_examples")
COVERAGE = ("coverage_causes", "sim_ascii_normalize", "sim_lower_min_count", "sim_lemma_expansion", "sim_morpheme", "sim_subword", "ranked_interventions")

assert audit_queries and vector_queries  # they register the queries named here


def _report(spark: SparkSession, out: str, title: str, made: dict[str, DataFrame], inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows under out, a Markdown page of the first rows of each and one of all, and metadata: date, hashes of report and inputs."""
    written, parts = {}, [f"# {title}"]
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        written[name] = spark.read.parquet(f"{out}/{name}")
        shown = bars(written[name]).orderBy("bin") if name.endswith("histogram") else written[name]
        page = f"## {name}\n\n{markdown(shown, 50)}"
        spark.range(1).select(F.lit(page).alias("value")).write.mode("overwrite").text(f"{out}/pages/{name}")
        parts.append(page)
    report = spark.range(1).select(F.lit("\n\n".join(parts)).alias("value"))
    report.write.mode("overwrite").text(f"{out}/report")
    stamps = F.array_sort(F.collect_list(F.struct("input", "n", "sha256"))).alias("inputs")
    hashed = atlas.stamp(inputs).agg(stamps) if inputs else spark.range(1).select(F.lit(None).cast("array<struct<input:string,n:bigint,sha256:string>>").alias("inputs"))
    head = report.select(F.lit(title).alias("report"), F.current_date().alias("date"), F.sha2(F.col("value"), 256).alias("sha256"), F.lit(1).alias("schema_version"))
    head.withColumn("inputs", hashed.scalar()).write.mode("overwrite").json(f"{out}/metadata")
    return written


def _write(spark: SparkSession, sf_dir: str, out: str, names: tuple[str, ...], title: str) -> dict[str, DataFrame]:
    """Each named query's rows as a report."""
    inputs = {name: table(spark, sf_dir, name) for name in ("documents", "conversations", "benchmark")}
    return _report(spark, out, title, {name: QUERIES[name](spark, sf_dir) for name in names}, inputs)


def write_atlas(spark: SparkSession, config: atlas.AtlasConfig, out: str) -> dict[str, DataFrame]:
    """All lenses of a configuration and their summary as a report with the inputs' hashes; lens 4 needs a second space."""
    made = atlas.run(config)
    inputs = {"source": config.source, "target": config.target, "anchors": config.anchors} | ({"second": config.second} if config.second is not None else {})
    written = _report(spark, out, "Anomaly atlas", made, inputs)
    atlas.summary(written).write.mode("overwrite").parquet(f"{out}/summary")
    return written | {"summary": spark.read.parquet(f"{out}/summary")}


def run_atlas(spark: SparkSession, sf_dir: str, out: str) -> dict[str, DataFrame]:
    return write_atlas(spark, vector_queries.atlas_config(spark, sf_dir), out)


def run_audit(spark: SparkSession, sf_dir: str, out: str) -> dict[str, DataFrame]:
    return _write(spark, sf_dir, out, AUDIT, "Anchor audit")


def run_diagnostic(spark: SparkSession, sf_dir: str, out: str) -> dict[str, DataFrame]:
    return _write(spark, sf_dir, out, COVERAGE, "Coverage diagnosis")
