"""Operator 2, near-duplicates by ProbMinHash.

A document is its five-word shingles (lower-cased words between ASCII white space), each weighted 1 + ln(its count). Every
shingle is a Poisson process of that rate whose arrivals fall on the signature's registers at random; a register keeps the
shingle that came first, so two signatures agree in a register with the probability Jaccard of the two documents. A shingle's
arrivals stop as soon as they come later than every register's first. Links are by the Jaccard of the shingle sets, so texts
whose counts differ get a second signature with equal weights, in which two texts agree with the probability of just that;
where all counts are equal, both signatures are the same. Bands of registers give candidates, and candidates are verified on
their whole shingle sets. Links are classes' edges; the answer is each document's class.

Exact copies are one node. Pairs are not spelled out within a bucket: its members are compared with its most central one.
Buckets that are one class then are done, as no further link could change a class. In the others, members outside the
largest class meet those of other classes, and a bound from their differences to the pivot drops, within the join, pairs
that cannot reach the threshold; all others are verified. So no link between different classes is lost.

Defined cases: a null or wordless text is in a class of its own, or of its exact copies if it isn't null. A text of one to
four words is one shingle. Rows of one doc_id are one node; rows with a null doc_id have a null class. An empty table gives
an empty result. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distilled, row_key, settle, spare, split_rows
from .components import components

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
GAMMA = np.uint64(0x9E3779B97F4A7C15)
SHINGLE = 5
BANDS, ROWS = 25, 5
SLICE = 250  # documents signed at once, which bounds a worker's memory

_hashes: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > 200_000:
        _hashes.clear()
    get, digest = _hashes.get, xxhash.xxh64_intdigest
    out = []
    for w in words:
        if (h := get(w)) is None:
            h = _hashes[w] = digest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Hash of each run of n words, in text order; of all words if there are fewer."""
    words = (text or "").encode(errors="replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n, out = min(n, len(h)), np.zeros(max(1, len(h) - n + 1), np.uint64)
    for j in range(n):
        out = out * GAMMA + h[j : j + len(out)]
    return mix(out + np.uint64(n))


def prob_minhash(elements: np.ndarray, weights: np.ndarray, docs: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures, n_docs x m, of flat (element, weight, document) triples: the element that arrives first in each register."""
    first, who = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    e, w, d = elements, weights, docs
    x, step, last = np.zeros(len(e)), 0, np.full(n_docs, np.inf)
    while len(e):
        step += 1
        r = mix(e + np.array([step], np.uint64) * GAMMA)
        x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        if step <= 4 or step % 4 == 0:
            last = first.reshape(n_docs, m).max(1)
        go = x < last[d]
        e, w, d, x, r = e[go], w[go], d[go], x[go], r[go]
        slot = d * m + (mix(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, x)
        won = x == first[slot]
        who[slot[won]] = e[won]
    return who.reshape(n_docs, m)


def bands_of(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), np.uint64) + np.arange(bands, dtype=np.uint64) * GAMMA
    for j in range(rows):
        out = mix(out + signatures[:, j : bands * rows : rows])
    return out.view(np.int64)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(id, t1, t2, bands) of docs' (id, t1, t2, text): the bands by equal weights, and by counts where these differ; empty without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                sets = [np.unique(shingles(x, shingle), return_counts=True) for x in b.column(3).to_pylist()]
                own = [k for k, (s, _) in enumerate(sets) if len(s)]
                out: list = [[]] * len(sets)
                if own:
                    d = np.repeat(np.arange(len(own)), [len(sets[k][0]) for k in own])
                    e = np.concatenate([sets[k][0] for k in own])
                    for k, row in zip(own, bands_of(prob_minhash(e, np.ones(len(e)), d, len(own), bands * rows), bands, rows)):
                        out[k] = row
                varied = [k for k in own if (sets[k][1] != sets[k][1][0]).any()]
                if varied:
                    d = np.repeat(np.arange(len(varied)), [len(sets[k][0]) for k in varied])
                    e = np.concatenate([sets[k][0] for k in varied])
                    w = 1 + np.log(np.concatenate([sets[k][1] for k in varied]))
                    for k, row in zip(varied, bands_of(prob_minhash(e, w, d, len(varied), bands * rows), bands, rows)):
                        out[k] = np.union1d(out[k], row)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int64()))], ["id", "t1", "t2", "bands"])

    return docs.mapInArrow(work, "id long, t1 long, t2 long, bands array<long>")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, sh) of docs' (id, text): the distinct shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                sets = [np.unique(shingles(x, shingle)).view(np.int64) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "sh"])

    return docs.mapInArrow(work, "id long, sh array<long>")


MASK = 4  # longs of a mask: a set of hashes, folded


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the shingle sets sa and sb."""
    return pairs.join(sets.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sh").alias("sb")), "b")


def jaccard(shared: Column) -> Column:
    return shared / (F.size("sa") + F.size("sb") - shared)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs whose whole shingle sets are at least threshold alike."""
    both = jaccard(F.size(F.array_intersect("sa", "sb")))
    return with_sets(pairs, sets).select("a", "b", both.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def to_pivot(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, jaccard, na, nd, m0..): of a's difference to its pivot b the size nd and a mask; na is a's size."""
    shared = F.size(F.array_intersect("sa", "sb"))
    base = with_sets(pairs, sets).withColumn("diff", F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")))

    def word(k: int) -> Column:
        one = lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), e.bitwiseAND(F.lit(63)).cast("int"))
        mine = lambda e: F.shiftright(e, 6).bitwiseAND(F.lit(MASK - 1)) == k
        return F.aggregate("diff", F.lit(0).cast("long"), lambda s, e: F.when(mine(e), s.bitwiseOR(one(e))).otherwise(s))

    return base.select("a", "b", jaccard(shared).alias("jaccard"), F.size("sa").alias("na"), F.size("diff").alias("nd"), *(word(k).alias(f"m{k}") for k in range(MASK)))


def may_link(x: str, y: str, threshold: float) -> Column:
    """False only for pairs that cannot reach the threshold, by their differences to one pivot.

    The symmetric difference of two sets is that of their differences D to a third: |Dx| + |Dy| - 2|Dx & Dy|, and a link
    bounds it by (1-t)/(1+t) of both sizes. Every bit of Dx's mask that Dy's lacks is an element of Dx outside Dy.
    """
    only = lambda p, q: sum((F.bit_count(F.col(f"{p}.m{k}").bitwiseAND(F.bitwise_not(F.col(f"{q}.m{k}")))) for k in range(MASK)), F.lit(0))
    most = F.least(F.col(f"{x}.nd") - only(x, y), F.col(f"{y}.nd") - only(y, x))
    bound = F.col(f"{x}.nd") + F.col(f"{y}.nd") - 2 * most
    return bound <= (F.col(f"{x}.na") + F.col(f"{y}.na")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)


def link_buckets(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members (key, id) of one bucket, enough to make the components of all such links."""
    # a bucket's pivot is the member that shares most buckets with most others: the copy nearest to what all were copied from
    size = members.groupBy("key").agg(F.count("*").alias("n"))
    weight = members.join(size, "key").groupBy("id").agg(F.sum("n").alias("w"))
    pivots = members.join(weight, "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("m"))).alias("top")).select("key", (-F.col("top.m")).alias("pivot"))
    own = settle(members.join(pivots, "key"))
    stars = settle(own.filter("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
    near = settle(to_pivot(stars, sets))
    links = near.filter(F.col("jaccard") >= threshold).select("a", "b")
    classes = settle(components(links))
    # then, in buckets of several classes, the members of all but the largest class with the members of other classes
    placed = own.join(classes, "id", "left").select("key", "id", "pivot", F.coalesce("cls", "id").alias("cls"))
    counts = placed.groupBy("key", "cls").agg(F.count("*").alias("n"))
    several = counts.groupBy("key").agg(F.max(F.struct("n", "cls")).alias("top"), F.count("*").alias("classes")).filter("classes > 1").select("key", F.col("top.cls").alias("big"))
    rest = settle(placed.join(several, "key").filter("id != pivot").join(near.withColumnsRenamed({"a": "id", "b": "pivot"}), ["id", "pivot"]))
    x, y = rest.filter("cls != big").alias("x"), rest.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") != F.col("y.cls")) & may_link("x", "y", threshold))
    pairs = settle(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    return links.unionByName(settle(verified(pairs, sets, threshold)).select("a", "b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id) for every row: class_id is the least doc_id among all that links of threshold or more, or equal texts, join."""
    x = F.col(text)
    of = F.when(x.isNull(), F.xxhash64(F.lit("null"), F.col(doc_id)))  # null texts are nobody's copies
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(of, F.xxhash64(x)).alias("t1"), F.coalesce(of, F.xxhash64(F.lit(7), x)).alias("t2"), x.cast("string").alias("text"))
    signed = settle(sign(source, bands, rows, shingle))
    copies = settle(signed.filter("id is not null").groupBy("t1", "t2").agg(F.min("id").alias("rep")))
    entries = signed.join(copies.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", F.explode("bands").alias("key")).distinct()
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = settle(entries.join(shared, "key"))
    wanted = settle(members.select("id").distinct())
    # one row an id: of rows that share an id, the text with the least hash
    texts = source.join(wanted, "id", "left_semi").select("id", "text", "t1")
    sets = shingle_sets(texts.select("id", "text"), shingle)
    sets = settle(sets)
    links = link_buckets(members, sets, threshold)
    copied = signed.filter("id is not null").select("id", "t1", "t2").join(copies, ["t1", "t2"])
    return _classes(signed.select("id"), copied.select(F.col("id").alias("a"), F.col("rep").alias("b")), links)


def _classes(ids: DataFrame, copied: DataFrame, links: DataFrame) -> DataFrame:
    near = settle(components(links))
    rep = copied.groupBy("a").agg(F.min("b").alias("rep"), F.max("b").alias("last"))
    if rep.filter("rep != last").isEmpty():  # each id has one text: its class is its copy's
        cls = rep.join(near, rep["rep"] == near["id"], "left").select(F.col("a").alias("doc_id"), F.coalesce("cls", "rep").alias("class_id"))
    else:
        every = components(copied.unionByName(links.select("a", "b")))
        cls = copied.select("a").distinct().join(every, F.col("a") == F.col("id"), "left").select(F.col("a").alias("doc_id"), F.coalesce("cls", "a").alias("class_id"))
    return ids.join(cls, F.col("id") == F.col("doc_id"), "left").select(F.col("id").alias("doc_id"), "class_id")


def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: of each class one row stays, with the least ``row_key`` (the doc_id, or a hash where an id is null or repeats).

    Different texts that share a doc_id are nodes of their own; of rows alike in id and text one stays. Null and wordless texts
    stay, but for exact copies. Columns other than doc_id and text pass through, whatever their names.
    """
    spark, node = docs.sparkSession, spare(docs, "_node")
    key = row_key(docs)

    def work() -> DataFrame:
        classes = near_duplicates(docs.select(key.alias("doc_id"), "text"))
        per_row = classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
        return per_row.filter("doc_id != class_id or n > 1").select(F.col("doc_id").alias(node), (F.col("doc_id") != F.col("class_id")).alias("drop"))

    touched = distilled(spark, work)
    marked, rest = split_rows(docs.withColumn(node, key), touched.select(node), node)
    left = marked.join(touched.filter("drop").select(node).hint("merge"), node, "left_anti")
    if not touched.filter("not drop").isEmpty():
        left = left.dropDuplicates([node])
    return rest.unionByName(left).select(*(F.col(f"`{c}`") for c in docs.columns))

