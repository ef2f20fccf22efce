"""Operator 12, Lempel-Ziv phrase fingerprints.

A text is parsed from left to right: the next phrase is the longest one of the dictionary plus one code point, and joins the
dictionary. The phrases are hashed, and the ``SIZE`` least hashes are the text's signature, so two signatures estimate the
Jaccard likeness of two phrase sets, which is high where one text helps to compress the other; sets of up to ``SIZE`` phrases
are compared exactly. An edited text keeps the phrases before the edit, so only its tail is parsed anew.

Neighbours by descending doc_id: the ids alone are sorted, and every so many of them begins a bucket. Whole texts then go
through one shuffle, straight to their buckets, and each bucket's first text also to the bucket before. A task streams its
bucket in order and holds two texts.

Defined cases: a null text counts as empty; an empty text has no phrase and an empty fingerprint. Two empty sets are alike (1),
an empty and another are not (0). Rows of one doc_id stand by their texts, null first; null ids come last. A single row is its
own next. Repeated rows stay rows. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

SIZE = 128  # of a signature
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parse(text: str, known: list[str] | None = None) -> list[str]:
    """The phrases of text, after those known; a rest that is a phrase already adds none."""
    have = set(known or ())
    out: list[str] = []
    add, keep, phrase = have.add, out.append, ""
    for c in text:
        phrase += c
        if phrase not in have:
            add(phrase)
            keep(phrase)
            phrase = ""
    return out


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial's base from 0 on, and of its inverse."""
    one = np.ones(1, np.uint64)
    return np.concatenate([one, np.cumprod(np.full(n - 1, _P))]), np.concatenate([one, np.cumprod(np.full(n - 1, _INVERSE))])


def signature(phrases: list[str], size: int = SIZE) -> np.ndarray:
    """The least hashes, ascending, of distinct phrases."""
    if not phrases:
        return np.empty(0, np.uint32)
    codes = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
    # a phrase's hash is that of its code points as a polynomial, from sums over all phrases so far
    powers, back = _powers(max(1 << 17, 1 << int(len(codes)).bit_length()))
    sums = np.cumsum((codes + np.uint64(1)) * (codes ^ _P) * powers[: len(codes)])
    starts = np.concatenate([ends[:1] * 0, ends[:-1]])
    upto = sums[ends - 1]
    upto[1:] -= upto[:-1].copy()
    h = mix(upto * back[starts] + (ends - starts).astype(np.uint64))
    return np.unique((h >> np.uint64(32)).astype(np.uint32))[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The estimated Jaccard likeness of the sets with signatures a and b."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    twice = both[1:] == both[:-1]
    least = np.concatenate([[True], ~twice]).cumsum() <= size  # places of the least of the union
    return float((twice & least[1:]).sum() / min(size, len(both) - twice.sum()))


def fingerprint(s: np.ndarray) -> str:
    """A signature as text: eight hex digits a hash."""
    return s.astype(">u4").tobytes().hex()


def edited(text: str, after: str) -> str:
    """text with its last half, rounded down, replaced by the first as many code points of after, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare(texts: Iterator[tuple[int | None, str]]) -> Iterator[tuple]:
    """The rows of OUT for every text but the last, which is only the next one's."""
    before = None
    for doc_id, text in texts:
        phrases = parse(text)
        own = signature(phrases)
        if before:
            yield _row(*before, text, own)
        before = (doc_id, text, phrases, own)


def _row(doc_id: int | None, text: str, phrases: list[str], own: np.ndarray, after: str, after_own: np.ndarray) -> tuple:
    new = edited(text, after)
    if new == text:
        other = own
    else:
        # phrases that end before the edit are the edited text's, too
        ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
        same = int(np.searchsorted(ends, len(text) - len(text) // 2, "right"))
        head = phrases[:same]
        other = signature(head + parse(new[int(ends[same - 1]) if same else 0 :], head))
    sha = hashlib.sha256(new.encode(errors="surrogatepass")).hexdigest()
    return doc_id, len(text), sha, fingerprint(own), fingerprint(other), likeness(own, other), likeness(own, after_own)


def _firsts(keys: DataFrame, buckets: int) -> list[int]:
    """Keys that begin buckets of about as many rows each, descending; no more than buckets + 1."""
    placed = numbered(keys.select(F.lit(0).alias("all"), "key"), "all", F.desc("key"))
    step = F.expr(f"greatest(1, (n + {buckets - 1}) div {buckets})")
    return sorted({r[0] for r in placed.filter(F.col("pos") % step == 0).select("key").collect()}, reverse=True)


def _last_at_least(firsts: list[int], key: Column) -> Column:
    """The number of the last of firsts (descending) that is not below key, by halving."""
    steps = [1 << k for k in reversed(range(len(firsts).bit_length()))]
    of = F.array(*map(F.lit, firsts)) if len(firsts) < 2 else F.lit(firsts)
    further = lambda at, s: F.when(F.coalesce(F.get(of, at + s) >= key, F.lit(False)), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of OUT for every row: fingerprints of its text and its edited text, and how near it is to that and to the next text."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    firsts = _firsts(docs.select(key.alias("key")), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not firsts:
        return docs.sparkSession.createDataFrame([], OUT)
    n = len(firsts)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), key.alias("key"), F.col(text).cast("string").alias("text")).withColumn("bucket", _last_at_least(firsts, F.col("key")))
    own = F.struct("bucket", F.lit(False).alias("extra"))
    copy = F.struct(F.pmod(F.col("bucket") - 1, F.lit(n)).alias("bucket"), F.lit(True).alias("extra"))
    first = F.get(F.array(*map(F.lit, firsts)) if n < 2 else F.lit(firsts), F.col("bucket")) == F.col("key")
    dealt = rows.select("id", "key", "text", F.inline(F.when(first, F.array(own, copy)).otherwise(F.array(own))).alias("bucket", "extra"))
    placed = dealt.repartitionById(n, "bucket").sortWithinPartitions("extra", F.desc("key"), F.desc_nulls_last("id"), F.asc_nulls_first("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[tuple[int | None, str]]:
            for b in batches:
                for i, x, extra in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                    yield i, x.as_py() or ""
                    if extra:  # the others like it are of the next bucket
                        return

        out: list[tuple] = []
        for row in compare(texts()):
            out.append(row)
            if len(out) == 500:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return placed.select("id", "text", "extra").mapInArrow(work, OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in OUT.split(", ")])
