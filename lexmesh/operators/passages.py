"""Passages around a token, and the preflight check of concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, normalize_token


def find_passages(queries: DataFrame, lines: DataFrame, most: int = 3, context: int = 2) -> DataFrame:
    """(query, rank, text_id, line_no, line, context): for each query token the first matching line of a text, the first texts.

    queries (query), lines (text_id, line_no, line). A line matches if the normalised query is among its normalised tokens.
    """
    tokens = lines.select("text_id", "line_no", F.explode(F.array_distinct(F.transform(F.split("line", SPACE), normalize_token))).alias("token"))
    q = queries.select("query", normalize_token(F.col("query")).alias("token")).filter("token <> ''")
    first = tokens.join(q, "token").groupBy("query", "text_id").agg(F.min("line_no").alias("line_no"))
    # the first texts of a query: partial top lists, not all its texts in one task
    spread = first.withColumn("_s", F.pmod(F.xxhash64("text_id"), F.lit(64)))
    some = F.row_number().over(Window.partitionBy("query", "_s").orderBy("text_id"))
    ranked = spread.withColumn("_r", some).filter(F.col("_r") <= most)
    chosen = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("text_id"))).filter(F.col("rank") <= most).select("query", "rank", "text_id", "line_no")
    near = lines.select("text_id", F.col("line_no").alias("_n"), F.col("line").alias("_l"))
    full = chosen.join(near, "text_id").filter(F.col("_n").between(F.col("line_no") - context, F.col("line_no") + context))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_l"))), lambda s: s["_l"]), "\n")
    line = F.max(F.when(F.col("_n") == F.col("line_no"), F.col("_l")))
    return full.groupBy("query", "rank", "text_id", "line_no").agg(line.alias("line"), text.alias("context"))


def search_passages(queries: DataFrame, lines: DataFrame, inside: Column, most: int = 3) -> DataFrame:
    """(query, rank, text_id, line_no, score): the lines with most of a query's tokens; a line outside the wanted texts counts half.

    queries (query, token), lines (text_id, line_no, line, ...); inside is a boolean of lines. Ties go by text and line.
    """
    tokens = lines.withColumn("_in", inside).select("text_id", "line_no", "_in", F.explode(F.array_distinct(F.transform(F.split("line", SPACE), normalize_token))).alias("token"))
    asked = queries.select("query", normalize_token(F.col("token")).alias("token")).filter("token <> ''").distinct()
    hits = tokens.join(asked, "token").groupBy("query", "text_id", "line_no", "_in").agg(F.count("*").alias("n"))
    scored = hits.withColumn("score", F.col("n") * F.when(F.col("_in"), 1.0).otherwise(0.5)).withColumn("_s", F.pmod(F.xxhash64("text_id", "line_no"), F.lit(64)))
    order = (F.desc("score"), "text_id", "line_no")
    some = scored.withColumn("_r", F.row_number().over(Window.partitionBy("query", "_s").orderBy(*order))).filter(F.col("_r") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.select("query", "rank", "text_id", "line_no", "score")


def flat_passages(queries: DataFrame, lines: DataFrame, context: int = 2) -> DataFrame:
    """W1 over flat lines (line_no, line), which have no texts: (query, line_no, line, context) of every matching line, the context across all lines."""
    tokens = lines.select("line_no", "line", F.explode(F.array_distinct(F.transform(F.split("line", SPACE), normalize_token))).alias("token"))
    asked = queries.select("query", normalize_token(F.col("query")).alias("token")).filter("token <> ''")
    found = tokens.join(asked, "token").select("query", "line_no", "line", F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("_n"))
    near = found.join(lines.select(F.col("line_no").alias("_n"), F.col("line").alias("_l")), "_n")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_l"))), lambda s: s["_l"]), "\n")
    return near.groupBy("query", "line_no", "line").agg(text.alias("context"))


def preflight(concepts: DataFrame, vocabulary: DataFrame, spaces: dict[str, DataFrame], neighbours: DataFrame, passages: DataFrame) -> DataFrame:
    """Concepts (source_token, target_word) with what was found, status, failure reasons and warnings.

    spaces: by name, the target words (word) that a space has; neighbours (target_word, token): the first five answers of every
    space; one of up to two characters is degenerate, and a concept without any counts as wholly so. passages (source_token):
    one row a matching line. A missing source, both spaces missing or no passage fail; the rest are warnings.
    """
    sources = vocabulary.select(F.col("word").alias("source_token")).distinct().withColumn("in_vocabulary", F.lit(True))
    x = concepts.join(sources, "source_token", "left").withColumn("in_vocabulary", F.coalesce("in_vocabulary", F.lit(False)))
    for name, words in spaces.items():
        own = words.select(F.lower("word").alias("_w")).distinct().withColumn(f"in_{name}", F.lit(True))
        x = x.join(own, F.lower("target_word") == F.col("_w"), "left").drop("_w").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    n = neighbours.groupBy("target_word").agg(F.avg((F.length("token") <= 2).cast("double")).alias("degenerate"))
    p = passages.groupBy("source_token").agg(F.count("*").alias("n_passages"))
    x = x.join(n, "target_word", "left").join(p, "source_token", "left").fillna({"degenerate": 1.0, "n_passages": 0})
    missing = [~F.col(f"in_{name}") for name in spaces]
    all_missing = missing[0]
    for m in missing[1:]:
        all_missing = all_missing & m
    listed = lambda *tests: F.array_compact(F.array(*[F.when(test, what) for test, what in tests]))
    reasons = listed((~F.col("in_vocabulary"), "sumerian_vocab_miss"), (all_missing, "english_missing_both_spaces"), (F.col("n_passages") == 0, "zero_etcsl_passages"))
    warnings = listed((F.col("degenerate") > 0.5, "degenerate_top5"), *[(m, f"english_missing_{name}") for m, name in zip(missing, spaces)])
    return x.select(
        "source_token", "target_word", "in_vocabulary", *(f"in_{name}" for name in spaces), "n_passages", F.round("degenerate", 3).alias("degenerate"),
        F.when(F.size(reasons) > 0, "fail").otherwise("pass").alias("status"), F.array_join(reasons, ";").alias("reasons"), F.array_join(warnings, ";").alias("warnings"),
    )
