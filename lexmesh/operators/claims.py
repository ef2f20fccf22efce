"""Checks of a written report against the numbers and signs it rests on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The range of cuneiform signs.
SIGNS = r"[\x{12000}-\x{123FF}]"


def numeric_claims(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines' columns with value and context, one row for each decimal from -1 to 1; context is the line's first 120 characters."""
    found = lines.withColumns({"context": F.substring(F.trim(line), 1, 120), "value": F.explode(F.regexp_extract_all(line, F.lit(r"(-?\d+\.\d{1,4})"), 1))}).drop(line)
    return found.withColumn("value", F.col("value").cast("double")).filter(F.col("value").between(-1, 1))


def supported(claims: DataFrame, metrics: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """P20: claims with supported: whether some metric (value) is within tolerance.

    Values meet by bands of that width: a claim looks into its own band and those beside it, so the join is on equality.
    """
    band = lambda c: F.floor(c / tolerance).cast("long")
    known = metrics.select(F.col("value").alias("_v")).distinct().withColumn("_band", band(F.col("_v")))
    values = claims.select(F.col("value").alias("_c")).distinct()
    near = values.withColumn("_band", F.explode(F.array(*[band(F.col("_c")) + k for k in (-1, 0, 1)])))
    hit = near.join(known, "_band").filter(F.abs(F.col("_v") - F.col("_c")) <= tolerance).select("_c").distinct().withColumn("_hit", F.lit(True))
    return claims.join(hit, F.col("value") == F.col("_c"), "left").withColumn("supported", F.coalesce("_hit", F.lit(False))).drop("_c", "_hit")


def provenance(documents: DataFrame, key: str, text: str, signs: str = SIGNS) -> DataFrame:
    """(key, codepoint, covered) for the signs before a document's provenance appendix: whether that has the sign or its U+ number."""
    heading = r"(?is)##\s*appendix[^\n]*?provenance[^\n]*?\n"
    parts = F.split(F.col(text), heading, 2)
    appendix = F.coalesce(F.get(parts, 1), F.lit(""))
    each = documents.select(key, appendix.alias("_a"), F.explode(F.array_distinct(F.regexp_extract_all(F.get(parts, 0), F.lit(f"({signs})"), 1))).alias("codepoint"))
    number = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("codepoint")), 5, "0"))
    return each.select(key, "codepoint", (F.col("_a").contains(F.col("codepoint")) | F.col("_a").contains(number)).alias("covered"))
