"""Operator 4, line dedup by a segment-partition edit join.

Lines that differ by at most tau edits share one of their tau+1 even segments at about the same place; tau goes by the length
of the shorter line, in the bands of ``TAUS``. Every line is indexed by its segments and probes, for each length it could
match, the substrings that the multi-match-aware bounds leave; both sides are rows of one table of (hash of segment, line),
and only keys that two different lines have go on. Candidates are verified on their whole texts by bit-parallel edit distance
over a band of 2*tau+1 diagonals. Equal lines (by 128 bits of hash) are one node; links between different lines make classes;
every occurrence but a class's first is a duplicate.

Lines are split at newlines and compared as they are; lines without a word are left out. Lines below the first band match
exactly only: one edit would turn one word into another.

Defined cases: null and empty texts have no lines. Rows that repeat (also a null doc_id) are occurrences of their own: ties
for the first occurrence go to the least doc_id (null first), then the least line, then one of the rows at that place, and
all others count as duplicates. An empty table gives an empty result. Only the named columns are read, so extra columns can't
clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_map, distilled, has_bit, let, row_key, settle, spare, split_rows
from .components import components

#: (characters, tau): from so many characters of the shorter line on, lines within tau edits are linked.
TAUS = ((12, 1), (24, 2), (512, 3))
BASE = 0x9E3779B97F4A7C15


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, line_no, line) of all lines with a word, line_no from 0; row tells rows of one doc_id apart."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text)
    lines = rows.select("doc_id", "row", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def line_key(line: Column) -> Column:
    return F.xxhash64(line)


def taus_of(n: np.ndarray, taus: tuple = TAUS) -> np.ndarray:
    """tau of lines of n characters; 0 below the first band."""
    return np.array([0, *(t for _, t in taus)])[np.searchsorted([c for c, _ in taus], n, "right")]


def segments(length: np.ndarray, tau: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of the tau+1 even segments of lines of these lengths; the last ones take what is left over."""
    k = tau + 1
    short, rest = length // k, length % k
    out = []
    for i in range(k):
        longer = np.maximum(0, i - (k - rest))
        out.append((i * short + longer, short + (i >= k - rest)))
    return out


def segment_rows(lines: list[str], ids: np.ndarray, taus: tuple = TAUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, probe) of the segments that lines are indexed by (probe 0) and the substrings that they look for (1)."""
    n = np.array([len(x) for x in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    base = np.uint64(BASE)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(n.max(initial=0)) + 1, base)]), dtype=np.uint64)
    begin = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    # a line's prefix sums of code * base^(place from its end), so that equal substrings get equal values after scaling
    place = np.arange(len(codes)) - np.repeat(begin, n)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * power[place], dtype=np.uint64)])
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(n.max(initial=0)) + 1, inverse)]), dtype=np.uint64)

    def value(start: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        a = at + start
        return (prefix[a + length] - prefix[a]) * back[start]

    def key(v: np.ndarray, total: np.ndarray, i: int) -> np.ndarray:
        x = (v ^ (total.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))) + np.array([i + 1], np.uint64) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    keys, who, probe = [], [], []

    def put(k: np.ndarray, own: np.ndarray, is_probe: int) -> None:
        keys.append(k), who.append(own), probe.append(np.full(len(k), is_probe, np.int8))

    for less in range(max(t for _, t in taus) + 1):  # the indexed line is shorter by so much
        for tau in sorted({t for _, t in taus}):
            if less > tau or not len(on := np.flatnonzero(taus_of(n - less, taus) == tau)):
                continue
            at0, own, total = begin[on], ids[on], n[on] - less
            for i, (start, size) in enumerate(segments(total, tau)):
                if not less:
                    put(key(value(start, size, at0), total, i), own, 0)
                low = np.maximum.reduce([start - i, start + less - (tau - i), np.zeros_like(start)])
                high = np.minimum.reduce([start + i, start + less + (tau - i), n[on] - size])
                for step in range(2 * tau + 1):
                    at = low + step
                    ok = at <= high
                    if ok.any():
                        put(key(value(at[ok], size[ok], at0[ok]), total[ok], i), own[ok], 1)
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8)
    return np.concatenate(keys).view(np.int64), np.concatenate(who), np.concatenate(probe)


def segment_table(lines: DataFrame, taus: tuple = TAUS) -> DataFrame:
    """(key, id, probe) of lines' (id, line); a line that repeats within a task is taken once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                own: dict[int, str] = {}
                for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if i not in seen:
                        own[i] = x
                if len(seen) > 200_000:
                    seen.clear()
                seen.update(own)
                if own:
                    made = segment_rows(list(own.values()), np.array(list(own), np.int64), taus)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["key", "id", "probe"])

    return lines.mapInArrow(work, "key long, id long, probe byte")


def within(a: str, b: str, tau: int) -> int | None:
    """Edit distance of a and b if it is at most tau, by a bit-parallel band; None otherwise."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > tau:
        return None
    at, top = 0, len(a)
    while at < top and a[at : at + 64] == b[at : at + 64] and at + 64 <= top:  # equal ends take no edits
        at += 64
    while at < top and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    end = 0
    while end < len(a) and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a:
        return len(b)
    # state e: bit d of reach[e] says that a's prefix ending on diagonal d - tau is reached with e edits
    width = 2 * tau + 1
    full = (1 << width) - 1
    reach = [(1 << (tau + e + 1)) - (1 << (tau - e)) & full for e in range(tau + 1)]
    reach = [r & ~((1 << tau) - 1) for r in reach]  # before b's first character: a's prefixes of 0..e characters
    for j, c in enumerate(b):
        same = 0
        for d in range(width):
            i = j + d - tau
            if 0 <= i < len(a) and a[i] == c:
                same |= 1 << d
        new = []
        for e in range(tau + 1):
            r = reach[e] & same  # equal characters: the same diagonal
            if e:
                r |= reach[e - 1] | (reach[e - 1] >> 1)  # substitution; a character of b inserted
                r |= new[e - 1] << 1  # a character of a left out
            new.append(r & full)
        for d in range(width):  # outside a
            if not 0 <= j + 1 + d - tau <= len(a):
                new = [r & ~(1 << d) for r in new]
        reach = new
        if not reach[tau]:
            return None
    last = 1 << (len(a) - len(b) + tau)
    return next((e for e in range(tau + 1) if reach[e] & last), None)


def verify(pairs: DataFrame, taus: tuple = TAUS) -> DataFrame:
    """(a, b, distance) of pairs' (a, b, x, y) whose texts x and y are within the tau of the shorter one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            most = taus_of(np.array([min(len(x), len(y)) for x, y in zip(left, right)], np.int64), taus).tolist()
            found = [within(x, y, tau) for x, y, tau in zip(left, right, most)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int32())], ["a", "b", "distance"])

    return pairs.select("a", "b", "x", "y").mapInArrow(work, "a long, b long, distance int").filter("distance is not null")


BAG = 32


def with_bags(lines: DataFrame, taus: tuple = TAUS) -> DataFrame:
    """(id, line, n, tau, bag): its characters, its band's tau, and counts of its characters by a hash of BAG values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            bags = [np.bincount((np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(2654435769)) >> np.uint32(27), minlength=BAG) for x in texts]
            n = np.array([len(x) for x in texts], np.int32)
            own = [b.column(0), b.column(1), pa.array(n), pa.array(taus_of(n, taus).astype(np.int32)), pa.array([x.astype(np.int32) for x in bags], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(own, ["id", "line", "n", "tau", "bag"])

    return lines.mapInArrow(work, "id long, line string, n int, tau int, bag array<int>")


def edit_links(lines: DataFrame, taus: tuple = TAUS) -> DataFrame:
    """(a, b, distance), a < b: all links between different lines (id, line), id the line's key."""
    from pyspark.sql import Window

    long = lines.filter(F.length("line") >= taus[0][0])
    rows = segment_table(long.select("id", "line"), taus)
    w = Window.partitionBy("key")
    shared = rows.withColumns({"lo": F.min("id").over(w), "hi": F.max("id").over(w)}).filter("lo < hi").select("key", "id", "probe").distinct()
    shared = settle(shared)
    wanted = settle(shared.select("id").distinct())
    # the bit map only keeps most other lines out of the shuffle
    near = long.withColumn("bits", bit_map(wanted.select(F.col("id").alias("h"))).scalar()).filter(has_bit(F.col("bits"), F.col("id")))
    texts = settle(with_bags(near.select("id", "line").join(wanted, "id", "left_semi").distinct(), taus))
    tagged = shared.join(texts.select("id", "n", "tau", "bag"), "id")
    side = lambda probe, x: tagged.filter(f"probe = {probe}").select(*(F.col(c).alias(f"{x}_{c}") for c in ("key", "id", "n", "tau", "bag")))
    # an edit changes the counts of two characters at most, so counts that differ by more than 2 tau are no link; lines of one
    # length probe each other, and one of the two ways is enough
    apart = F.aggregate(F.zip_with("i_bag", "p_bag", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    one_way = (F.col("i_n") < F.col("p_n")) | ((F.col("i_n") == F.col("p_n")) & (F.col("i_id") < F.col("p_id")))
    pairs = side(0, "i").join(side(1, "p"), (F.col("i_key") == F.col("p_key")) & one_way & (apart <= 2 * F.least("i_tau", "p_tau")))
    pairs = settle(pairs.select(F.least("i_id", "p_id").alias("a"), F.greatest("i_id", "p_id").alias("b")).distinct())
    full = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return verify(full, taus).groupBy("a", "b").agg(F.min("distance").alias("distance"))


def line_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", taus: tuple = TAUS) -> DataFrame:
    """One row per occurrence of a line whose class has two occurrences or more.

    doc_id, line_no, n_words (of the line), class_id (the least key of the class's lines), class_size (occurrences),
    n_links (other lines within tau edits), first_doc_id, first_line_no, removed (every occurrence but the first).
    """
    lines = lines_of(docs, doc_id, text).withColumn("id", line_key(F.col("line")))
    n_words = F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words")
    occurrences = settle(lines.select("doc_id", "row", "line_no", "id", F.xxhash64(F.lit(7), "line").alias("id2"), n_words))
    links = settle(edit_links(lines.select("id", "line"), taus))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    linked = settle(components(links).join(degree, "id"))
    # of exact copies, sums before the classes are joined: one row a line; a line without links is a class by both its hashes
    first = F.min(F.struct("doc_id", "line_no", "row"))
    by_line = occurrences.groupBy("id", "id2").agg(F.count("*").alias("n"), first.alias("first")).join(linked, "id", "left")
    by_line = by_line.withColumns({"class_id": F.coalesce("cls", "id"), "class2": F.when(F.col("cls").isNull(), F.col("id2")).otherwise(0)})
    by_line = settle(by_line.filter("n > 1 or cls is not null").select("id", "id2", "class_id", "class2", "n", "first", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    by_class = by_line.groupBy("class_id", "class2").agg(F.sum("n").alias("class_size"), F.min("first").alias("first"))
    known = by_line.select("id", "id2", "class_id", "class2", "n_links").join(by_class, ["class_id", "class2"])
    out = occurrences.join(known, ["id", "id2"])
    here = F.struct("doc_id", "line_no", "row").eqNullSafe(F.col("first"))
    return out.select("doc_id", "line_no", "n_words", "class_id", "class_size", "n_links", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), (~here).alias("removed"))


def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: texts without the occurrences that line_classes marks removed; documents left without a word go.

    Rows are told apart by ``row_key``, so lines of one row never go for another's of the same doc_id; of rows alike in id and
    text, a line goes only if it is removed in all of them. Null texts have no word. n_chars follows the text; other columns
    pass through, whatever their names.
    """
    spark, node, gone = docs.sparkSession, spare(docs, "_node"), spare(docs, "_gone")
    key = row_key(docs)

    def work() -> DataFrame:
        marked = line_classes(docs.select(key.alias("doc_id"), "text"))
        places = lambda c: F.collect_set(F.when(c, F.col("line_no")))
        by_row = marked.groupBy(F.col("doc_id").alias(node)).agg(places(F.col("removed")).alias("out"), places(~F.col("removed")).alias("stays"))
        return by_row.select(node, F.array_sort(F.array_except("out", "stays")).alias(gone)).filter(F.size(gone) > 0)

    removed = distilled(spark, work)
    touched, rest = split_rows(docs.withColumn(node, key), removed.select(node), node)
    at = touched.join(removed.hint("merge"), node, "left")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), lambda lines: F.array_join(_without(lines, F.col(gone)), "\n")))
    own = lambda df, c: F.col(f"`{c}`") if df is rest or c not in ("text", "n_chars") else text.alias(c) if c == "text" else F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c)
    out = rest.select(*(own(rest, c) for c in docs.columns)).unionByName(at.select(*(own(at, c) for c in docs.columns)))
    return out.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def _without(lines: Column, gone: Column) -> Column:
    """lines without those at the places gone (sorted, from 0): the runs between them."""
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    return let(ends, lambda e: F.flatten(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.slice(lines, F.get(e, k - 1) + 2, F.get(e, k) - F.get(e, k - 1) - 1))))
