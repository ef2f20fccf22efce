"""Operator 8, benchmark decontamination by winnowing, in DataFrame functions only.

Words are lower-cased runs of ASCII letters and digits and of anything beyond ASCII. A window is ``window`` consecutive words
of a benchmark item (all of an item with fewer). Each window keeps its minimum k-gram hash, its fingerprint: a shared window
has the same fingerprint on both sides, so no shared span of ``window`` words or more can be missed. A document's windows go
through a bit map of the benchmark's fingerprints (fixed size, so safe to send to every task; it only saves work), the rest
joins the benchmark on fingerprint and words, and overlapping hits extend to maximal spans.

Defined cases: null and wordless texts have no windows and no hits; null and wordless items are never found. Rows that
repeat (same id and text) give one result row each. A null doc_id is a value like any other; a null item_id counts as the
empty string. An empty benchmark leaves every document clean. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_map, distilled, has_bit, let, lower_ascii, settle, spare, split_rows

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; empty for null."""
    plain = F.length(text) == F.octet_length(text)  # ASCII alone: lower() then agrees, and is quicker
    low = F.coalesce(F.when(plain, F.lower(text)).otherwise(lower_ascii(text)), F.lit(""))
    return F.filter(F.split(low, BREAKS), lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    """Hash of each run of k words; empty if there are fewer."""
    n = F.size(words)
    each = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), each)).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int, k: int) -> DataFrame:
    """Distinct (item, m, fp, win): m words in the window, fp its fingerprint, win its words."""
    words = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    at = words.withColumn("m", F.least(n, F.lit(window))).withColumn("s", F.explode(F.sequence(F.lit(0), n - F.col("m"))))
    win = F.slice("w", F.col("s") + 1, F.col("m"))
    short = F.xxhash64(F.get("w", F.lit(0)))  # too short for k-grams in general: found by its first word
    fp = F.when(F.col("m") < window, short).otherwise(F.array_min(grams(win, k)))
    return at.select("item", "m", fp.alias("fp"), F.array_join(win, " ").alias("win")).distinct()


def scan(docs: DataFrame, windows: DataFrame, doc_id: str, text: str, window: int, k: int) -> DataFrame:
    """One row per document row: doc_id, th (hash of its text), n_words, found (its windows whose fingerprint is in the map)."""
    whole = bit_map(windows.filter(F.col("m") == window).select(F.col("fp").alias("h"))).scalar()
    first = bit_map(windows.filter(F.col("m") < window).select(F.col("fp").alias("h"))).scalar()
    lengths = windows.filter(F.col("m") < window).agg(F.sort_array(F.collect_set("m")).alias("lengths")).scalar()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), words_of(F.col(text)).alias("w"))
    base = base.withColumns({"whole": whole, "first": first, "lengths": lengths})

    def found(w: Column, whole: Column, first: Column, lengths: Column) -> Column:
        n = F.size(w)
        span = window - k + 1
        none = F.array().cast("array<struct<s:int,m:int,fp:bigint,win:string>>")

        def of(h: Column) -> Column:
            fp = lambda s: F.array_min(F.slice(h, s + 1, span))
            # a window's fingerprint is one of its k-grams: only windows around a k-gram in the map need their minimum
            marked = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: has_bit(whole, F.get(h, i)))
            around = lambda i: F.filter(F.sequence(F.greatest(i - (span - 1), F.lit(0)), F.least(i, n - window)), lambda s: fp(s) == F.get(h, i))
            starts = F.array_distinct(F.flatten(F.transform(marked, around)))
            return F.transform(starts, lambda s: F.struct(s.alias("s"), F.lit(window).alias("m"), fp(s).alias("fp"), F.array_join(F.slice(w, s + 1, window), " ").alias("win")))

        long = F.when(n >= window, let(grams(w, k), of)).otherwise(none)
        hit = F.filter(F.sequence(F.lit(0), n - 1), lambda s: has_bit(first, F.xxhash64(F.get(w, s))))
        each = lambda s: F.transform(
            F.filter(lengths, lambda m: s + m <= n),
            lambda m: F.struct(s.alias("s"), m.alias("m"), F.xxhash64(F.get(w, s)).alias("fp"), F.array_join(F.slice(w, s + 1, m), " ").alias("win")),
        )
        brief = F.when((n > 0) & (F.size(lengths) > 0), F.flatten(F.transform(hit, each))).otherwise(none)
        return F.concat(long, brief)

    row = F.struct("w", "whole", "first", "lengths")
    made = let(row, lambda r: F.struct(F.size(r["w"]).cast("long").alias("n_words"), found(r["w"], r["whole"], r["first"], r["lengths"]).alias("found")))
    return base.select("doc_id", "th", made.alias("made")).select("doc_id", "th", "made.n_words", "made.found")


def hits(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, th, s, m, win): windows of scanned that are windows of the benchmark."""
    own = scanned.filter(F.size("found") > 0).select("doc_id", "th", F.explode("found").alias("f")).select("doc_id", "th", "f.*").distinct()
    return own.join(windows.select("fp", "m", "win").distinct(), ["fp", "m", "win"], "left_semi").select("doc_id", "th", "s", "m", "win")


def spans_of(starts: Column) -> Column:
    """Maximal spans [start, end) of an array of (s, m), merged where they overlap or touch."""
    zero = F.array().cast("array<struct<s:int,e:int>>")

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        end = x["s"] + x["m"]
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], end).alias("e"))))
        fresh = F.concat(done, F.array(F.struct(x["s"].alias("s"), end.alias("e"))))
        return F.when((F.size(done) > 0) & (x["s"] <= last["e"]), joined).otherwise(fresh)

    return F.aggregate(F.sort_array(starts), zero, add)


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5
) -> DataFrame:
    """One row per document row: doc_id, th, n_words, n_hit, spans (of words, end excluded), items (sorted ids), contaminated."""
    windows = settle(benchmark_windows(items, item_id, item_text, window, k))
    scanned = settle(scan(docs, windows, doc_id, text, window, k))
    found = settle(hits(scanned, windows))
    # windows of the same items share a set; its key needs no list of items
    in_set = windows.groupBy("win", "m").agg(F.bit_xor(F.xxhash64("item")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("x2"), F.count("*").alias("x3"))
    sets = in_set.groupBy("x1", "x2", "x3").agg(F.min(F.struct("win", "m")).alias("one")).select("x1", "x2", "x3", "one.*")
    members = sets.join(windows, ["win", "m"]).select("x1", "x2", "x3", "item")
    of_docs = found.select("doc_id", "th", "win", "m").join(in_set, ["win", "m"]).select("doc_id", "th", "x1", "x2", "x3").distinct()
    by_doc = of_docs.join(members, ["x1", "x2", "x3"]).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = found.groupBy("doc_id", "th").agg(spans_of(F.collect_list(F.struct("s", "m"))).alias("spans"))
    a, b, c = scanned.select("doc_id", "th", "n_words").alias("a"), spans.alias("b"), by_doc.alias("c")
    same = lambda x: F.col("a.doc_id").eqNullSafe(F.col(f"{x}.doc_id")) & (F.col("a.th") == F.col(f"{x}.th"))
    n_hit = F.aggregate("b.spans", F.lit(0).cast("long"), lambda t, x: t + x["e"] - x["s"])
    return a.join(b, same("b"), "left").join(c, same("c"), "left").select(
        "a.doc_id",
        "a.th",
        "a.n_words",
        F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("b.spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"),
        F.coalesce("c.items", F.array().cast("array<string>")).alias("items"),
        F.col("b.doc_id").isNotNull().__or__(F.col("b.th").isNotNull()).alias("contaminated"),
    )


def stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The pipeline's stage: the documents that share no window with the benchmark, all their columns as they are.

    A row goes by its id and a hash of its text, so rows of one doc_id are judged apart; null texts stay.
    """
    th, bad_id = spare(docs, "_th"), spare(docs, "_bad_id")

    def work() -> DataFrame:
        windows = settle(benchmark_windows(items, "item_id", "text", 10, 5))
        found = hits(scan(docs.select("doc_id", "text"), windows, "doc_id", "text", 10, 5), windows)
        return found.select(F.col("doc_id").alias(bad_id), F.col("th").alias(th)).distinct()

    bad = distilled(docs.sparkSession, work)
    touched, rest = split_rows(docs.withColumn(th, F.xxhash64("text")), bad.select(th), th)
    left = touched.join(bad.hint("merge"), touched["doc_id"].eqNullSafe(bad[bad_id]) & (touched[th] == bad[th]), "left_anti")
    return rest.unionByName(left).drop(th)
