"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ranks import numbered
from ..storage import distilled, settle, shared_dir

__all__ = ["distilled", "numbered", "settle", "shared_dir"]

#: ASCII white space, the separators of the contracts' words.
SPACES = " \t\n\x0b\x0c\r"
#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BITS = 1 << 20  # of a bit map of hashes
WORDS_OF_BITS = BITS // 64


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bit_of(h: Column) -> tuple[Column, Column]:
    """(place in the map's array, bit there) of a hash."""
    return h.bitwiseAND(F.lit(WORDS_OF_BITS - 1)).cast("int"), F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(63)).cast("int")


def bit_map(hashes: DataFrame) -> DataFrame:
    """One row: the map of column h, as an array of WORDS_OF_BITS longs, whatever the number of rows."""
    at, bit = bit_of(F.col("h"))
    words = hashes.select(at.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("v")).groupBy("at").agg(F.bit_or("v").alias("v"))
    made = F.map_from_entries(F.collect_list(F.struct("at", "v")))
    full = let(made, lambda m: F.transform(F.sequence(F.lit(0), F.lit(WORDS_OF_BITS - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0).cast("long"))))
    return words.agg(full.alias("bits"))


def has_bit(bits: Column, h: Column) -> Column:
    at, bit = bit_of(h)
    return F.getbit(F.get(bits, at), bit) == 1


def row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of each row's text: doc_id where no other row has it, else a hash of id and text (so rows of one id stay apart by text).

    Ids that repeat are known by a bit map; an id that shares a bit with one of them gets a hash too, which does no harm.
    """
    own = F.col(doc_id).cast("long")
    twice = docs.filter(own.isNotNull()).groupBy(own.alias("h")).agg(F.count("*").alias("n")).filter("n > 1")
    hashed = F.xxhash64(F.lit("row"), F.col(doc_id), F.col(text))
    if twice.isEmpty():
        return F.coalesce(own, hashed)
    bits = bit_map(settle(twice.select(F.xxhash64("h").alias("h"))))
    return F.when(own.isNull() | has_bit(bits.scalar(), F.xxhash64(own)), hashed).otherwise(own)


def split_rows(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among keys, rows that are not): a bit map of fixed size keeps most other rows out of the joins that follow."""
    bits = bit_map(keys.select(F.xxhash64(key).alias("h")))
    bit = spare(rows, "_bit")
    marked = rows.withColumn(bit, has_bit(bits.scalar(), F.xxhash64(key)))
    return marked.filter(F.col(bit)).drop(bit), marked.filter(~F.col(bit)).drop(bit)


def spare(df: DataFrame, name: str) -> str:
    """name, or with as many _ after it as it takes for df not to have such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
