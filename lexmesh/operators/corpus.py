"""Corpus operators: frequency, statistics, keep-longest dedup, composition grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, clean_tokens, resolve_marks, spelled_tokens
from ..storage import spread


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) of each line, line_no from 0."""
    return spread(docs.select(key, text)).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def clean_corpus(texts: DataFrame, key: str, line_array: Column) -> DataFrame:
    """(key, text) of texts that cleaning leaves something of."""
    return texts.select(key, clean_text(line_array).alias("text")).filter("text <> ''")


def token_frequency(lines_: DataFrame, line: str = "line") -> DataFrame:
    """A4: (token, n) over cleaned tokens. The pieces between blanks are counted first, so each distinct one is cleaned once."""
    pieces = lines_.select(F.explode(F.split(resolve_marks(F.col(line)), " ")).alias("piece")).filter("piece <> ''").groupBy("piece").agg(F.count("*").alias("k"))
    return pieces.select(F.explode(spelled_tokens(F.col("piece"))).alias("token"), "k").groupBy("token").agg(F.sum("k").alias("n"))


def corpus_stats(lines_: DataFrame, line: str = "line") -> DataFrame:
    """Lines, non-empty cleaned lines, tokens and distinct tokens, each from partial sums."""
    tokens = clean_tokens(F.col(line))
    rows = lines_.select(F.size(tokens).cast("long").alias("k")).agg(F.count("*").alias("n_lines"), F.count_if(F.col("k") > 0).alias("n_clean_lines"), F.sum("k").alias("n_tokens"))
    distinct = token_frequency(lines_, line).agg(F.count("*").alias("n_distinct"))
    return rows.withColumn("n_distinct", distinct.scalar())


def keep_longest(texts: DataFrame, key: str, size: Column, ordinal: str) -> DataFrame:
    """A5: of the rows of a key, the one with most lines, the first on ties; rows whose key is null or empty all stay.

    The winner comes from a partial maximum by key, so a hot key is not sorted in one task.
    """
    keyed = F.coalesce(F.col(key), F.lit("")) != ""
    marked = texts.withColumn("_size", size.cast("long"))
    best = marked.filter(keyed).groupBy(key).agg(F.max(F.struct("_size", (-F.col(ordinal)).alias("m"))).alias("_best"))
    best = best.select(F.col(key).alias("_k"), (-F.col("_best.m")).alias("_o"))
    kept = marked.filter(keyed).join(best, (F.col(key) == F.col("_k")) & (F.col(ordinal) == F.col("_o"))).drop("_k", "_o")
    return kept.unionByName(marked.filter(~keyed)).drop("_size")


def dedup_stats(texts: DataFrame, key: str) -> DataFrame:
    """A5: rows in, without a key, distinct keys, rows out, removed."""
    key_ = F.nullif(F.col(key), F.lit(""))
    base = texts.agg(F.count("*").alias("n_in"), F.count_if(key_.isNull()).alias("n_no_key"), F.count_distinct(key_).alias("n_unique"))
    return base.withColumn("n_out", F.col("n_no_key") + F.col("n_unique")).withColumn("n_removed", F.col("n_in") - F.col("n_out"))


def composition_of(line_id: Column) -> Column:
    """A line's id up to its last dot."""
    return F.regexp_replace(line_id, r"\.[^.]*$", "")


def compositions(lines_: DataFrame, line_id: str, order: str, line: str, translation: str) -> DataFrame:
    """(composition, n_lines, text, n_translations), lines in order."""
    both = F.array_sort(F.collect_list(F.struct(order, line)))
    grouped = lines_.groupBy(composition_of(F.col(line_id)).alias("composition")).agg(F.count("*").alias("n_lines"), both.alias("x"), F.count(translation).alias("n_translations"))
    return grouped.select("composition", "n_lines", F.array_join(F.transform("x", lambda s: s[line]), "\n").alias("text"), "n_translations")
