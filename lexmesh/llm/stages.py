"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir); all but the last return the columns of docs.

Defined cases: an empty table passes every stage empty. A null or wordless text fails the first stage; where a stage is called
alone, line dedup drops it, near-dedup and decontamination keep it and packing makes it an end token. Rows that share a
doc_id, and rows without one, are judged each by its own text. Columns beside doc_id, text and n_chars pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line and base rules keep, without the lines that failed."""
    from .quality_rules import stage

    return stage(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines, exact or near, that an earlier place has."""
    from .line_dedup import stage

    return stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    from .near_duplicates import stage

    return stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    from .common import table
    from .decontamination import stage

    return stage(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    import public_tokenizers

    from .packing import pack, token_pieces

    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
