"""Weighted translation pairs from dictionary counts and from parallel lines (A1-A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_junk_gloss, normalize_token, source_words, target_words


def dictionary_anchors(lemmas: DataFrame, least: int = 5) -> DataFrame:
    """A1: (source_token, target_word, frequency, confidence, provenance) from lemmas (form, cf, gw).

    A lemma counts for its citation form and, where it differs, for its written form.
    """
    tokens = F.array_distinct(F.transform(F.array("cf", "form"), normalize_token))
    pairs = lemmas.filter(~is_junk_gloss(F.col("gw"))).select(F.explode(tokens).alias("source_token"), F.lower(F.trim("gw")).alias("target_word"))
    counted = pairs.filter("source_token <> ''").groupBy("source_token", "target_word").agg(F.count("*").alias("frequency")).filter(F.col("frequency") >= least)
    return counted.withColumns({"confidence": F.round(F.least(F.lit(0.95), 0.5 + F.col("frequency") / 100), 4), "provenance": F.lit("DICT")})


def cooccurrence_anchors(pairs: DataFrame, least: int = 3, confidence: float = 0.3) -> DataFrame:
    """A2: from (transliteration, translation) lines, each source word's most frequent companion, the least word on ties.

    Words are sets by line. frequency is the source word's number of lines; the threshold is on the exact share, which is then
    rounded. Sources too rare to pass go before pairs are made, so only they multiply.
    """
    given = pairs.filter((F.coalesce("transliteration", F.lit("")) != "") & (F.coalesce("translation", F.lit("")) != ""))
    words = given.select(source_words(F.col("transliteration")).alias("s"), target_words(F.col("translation")).alias("t"))
    totals = words.select(F.explode("s").alias("source_token")).groupBy("source_token").agg(F.count("*").alias("total")).filter(F.col("total") >= least)
    each = words.select(F.explode("s").alias("source_token"), "t").join(totals, "source_token")
    counted = each.select("source_token", "total", F.explode("t").alias("target_word")).groupBy("source_token", "total", "target_word").agg(F.count("*").alias("n"))
    best = counted.groupBy("source_token", "total").agg(F.min(F.struct((-F.col("n")).alias("m"), "target_word")).alias("b"))
    share = -F.col("b.m") / F.col("total")
    made = best.filter(share >= confidence).select("source_token", F.col("b.target_word").alias("target_word"), F.col("total").alias("frequency"), F.round(share, 4).alias("confidence"))
    return made.withColumn("provenance", F.lit("COOC"))


def merge_anchors(*sources: DataFrame) -> DataFrame:
    """A3: one anchor per source token: the highest confidence, the earlier source on ties, then the least word."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("_o", F.lit(k))
        out = s if out is None else out.unionByName(s)
    rest = ["target_word", "frequency", "confidence", "provenance"]
    best = F.min(F.struct((-F.col("confidence")).alias("_m"), "_o", *rest)).alias("b")
    return out.groupBy("source_token").agg(best).select("source_token", *(F.col(f"b.{c}").alias(c) for c in rest))
