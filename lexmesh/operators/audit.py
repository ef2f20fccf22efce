"""Anchor audit and coverage diagnosis: priority chains over existence joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_junk_token, is_multiword, morphemes, ngrams, normalize_token

BUCKETS = (
    "junk_sumerian", "duplicate_collision", "low_confidence", "sumerian_vocab_miss", "multiword_english", "english_both_miss",
    "english_glove_miss", "english_gemma_miss", "survives",
)
CAUSES = (
    "normalization_recoverable", "in_corpus_below_min_count", "oracc_lemma_surface_recoverable", "morpheme_composition_recoverable",
    "subword_inference_recoverable", "genuinely_missing",
)
#: How each cause can be recovered from.
RECOVERY = {
    "normalization_recoverable": "exact — normalize and rerun extraction",
    "in_corpus_below_min_count": "exact — lower min_count and retrain",
    "oracc_lemma_surface_recoverable": "exact — expand anchors to ORACC surface forms",
    "morpheme_composition_recoverable": "inferred — compose vector from morphemes in vocab",
    "subword_inference_recoverable": "inferred — use FastText OOV subword inference",
    "genuinely_missing": "none — requires new corpus or lemma data",
}
#: The interventions that are ranked, and how far their counts can be trusted.
TRUST = {
    "ascii_normalize": "exact", "lower_min_count (t=1)": "exact", "oracc_lemma_expansion": "exact",
    "morpheme_composition (Tier-2 top-5)": "inferred (compositional)", "subword_inference (Tier-2 top-5)": "inferred (character n-gram)",
}


def flagged(rows: DataFrame, key: Column, members: DataFrame, member: str, name: str) -> DataFrame:
    """rows with a boolean: whether key is among members (an existence join; members may repeat, null is no member)."""
    m = members.filter(F.col(member).isNotNull()).select(F.col(member).alias("_m")).distinct().withColumn("_in", F.lit(True))
    return rows.withColumn("_key", key).join(m, F.col("_key") == F.col("_m"), "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_key", "_m", "_in")


def classify_anchors(anchors: DataFrame, vocabulary: DataFrame, glove: DataFrame, gemma: DataFrame, collisions: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Anchors (source_token, target_word, confidence) with bucket, in_glove and in_gemma. Sets are (word)."""
    s, t = F.coalesce("source_token", F.lit("")), F.lower(F.trim(F.coalesce("target_word", F.lit(""))))
    x = flagged(anchors, s, vocabulary, "word", "in_vocabulary")
    x = flagged(flagged(x, t, glove, "word", "in_glove"), t, gemma, "word", "in_gemma")
    x = flagged(x, s, collisions, "word", "collided")
    chain = (
        (is_junk_token(s), "junk_sumerian"), (F.col("collided"), "duplicate_collision"), (F.coalesce("confidence", F.lit(0.0)) < threshold, "low_confidence"),
        (~F.col("in_vocabulary"), "sumerian_vocab_miss"), (is_multiword(t), "multiword_english"), (~F.col("in_glove") & ~F.col("in_gemma"), "english_both_miss"),
        (~F.col("in_glove"), "english_glove_miss"), (~F.col("in_gemma"), "english_gemma_miss"),
    )
    out = F.lit("survives")
    for test, name in reversed(chain):
        out = F.when(test, name).otherwise(out)
    return x.withColumn("bucket", out).drop("collided")


def counted(rows: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """(column, n, pct) with every name, also those without rows."""
    sums = rows.agg(F.count("*").alias("_all"), *[F.count_if(F.col(column) == n).alias(n) for n in names])
    each = F.array(*[F.struct(F.lit(n).alias(column), F.col(n).alias("n")) for n in names])
    share = F.when(F.col("_all") > 0, 100 * F.col("x.n") / F.col("_all")).otherwise(0.0)
    return sums.select("_all", F.explode(each).alias("x")).select(f"x.{column}", "x.n", F.round(share, 2).alias("pct"))


def partition(anchors: DataFrame, token: str, vocabulary: DataFrame) -> DataFrame:
    """(n_anchors, n_in_vocabulary, n_missing, pct) of anchors whose token a vocabulary (word) has."""
    x = flagged(anchors, F.col(token), vocabulary, "word", "here")
    share = F.when(F.count("*") > 0, 100 * F.count_if("here") / F.count("*")).otherwise(0.0)
    return x.agg(F.count("*").alias("n_anchors"), F.count_if("here").alias("n_in_vocabulary"), F.count_if(~F.col("here")).alias("n_missing"), F.round(share, 2).alias("pct"))


def examples(rows: DataFrame, group: str, key: str, most: int = 10, seed: int = 42) -> DataFrame:
    """Up to most rows of each group, those of the least seeded hash of their key; parts of a group are cut before they meet."""
    hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_s", F.pmod(F.xxhash64(key), F.lit(64)))
    some = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_s").orderBy("_h", key))).filter(F.col("_r") <= most)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h", key))).filter(F.col("_r") <= most).drop("_h", "_s", "_r")


def spelled(misses: DataFrame) -> DataFrame:
    """misses (source_token, ...) with raw, the trimmed token, and norm, its normal form."""
    raw = F.trim(F.coalesce("source_token", F.lit("")))
    return misses.withColumns({"norm": normalize_token(raw), "raw": raw})


def classify_misses(misses: DataFrame, vocabulary: DataFrame, frequency: DataFrame, surfaces: DataFrame, grams: DataFrame, min_count: int = 5, overlap: float = 0.5, low: int = 3, high: int = 6) -> DataFrame:
    """Misses (source_token, ...) with norm, cause, matched_form and n_corpus (of the form below min_count), overlap, and what each test found.

    vocabulary (word), frequency (word, n), surfaces (cf, form), grams (gram): each is joined, none collected.
    """
    base = spelled(misses)
    x = flagged(base, F.col("norm"), vocabulary, "word", "norm_in")
    x = flagged(x, F.col("raw"), vocabulary, "word", "raw_in")
    f = frequency.select(F.col("word").alias("_w"), F.col("n").alias("_n"))
    x = x.join(f, F.col("raw") == F.col("_w"), "left").withColumn("n_raw", F.coalesce("_n", F.lit(0))).drop("_w", "_n")
    x = x.join(f, F.col("norm") == F.col("_w"), "left").withColumn("n_norm", F.coalesce("_n", F.lit(0))).drop("_w", "_n")
    known = surfaces.join(vocabulary.select(F.col("word").alias("form")).distinct(), "form", "left_semi")
    x = flagged(x, F.col("norm"), known, "cf", "surface_in")
    tokens = base.select("raw", "norm").distinct()
    parts = tokens.select("raw", F.explode(morphemes(F.col("raw"))).alias("m"))
    whole = flagged(parts, F.col("m"), vocabulary, "word", "ok").groupBy("raw").agg(F.bool_and("ok").alias("morphemes_in"))
    own = tokens.select("raw", F.explode(ngrams(F.col("norm"), low, high)).alias("g"))
    shared = flagged(own, F.col("g"), grams, "gram", "hit").groupBy("raw").agg(F.avg(F.col("hit").cast("double")).alias("overlap"))
    x = x.join(whole, "raw", "left").join(shared, "raw", "left").withColumns({"overlap": F.coalesce("overlap", F.lit(0.0)), "morphemes_in": F.coalesce("morphemes_in", F.lit(False))})
    rare = lambda n: F.col(n).between(1, min_count - 1)
    chain = (
        ((F.col("norm") != "") & F.col("norm_in"), CAUSES[0]), (rare("n_raw") | rare("n_norm"), CAUSES[1]), (F.col("surface_in"), CAUSES[2]),
        (F.col("morphemes_in"), CAUSES[3]), ((F.col("norm") != "") & (F.col("overlap") >= overlap), CAUSES[4]),
    )
    out = F.lit(CAUSES[5])
    for test, name in reversed(chain):
        out = F.when(test, name).otherwise(out)
    below = lambda a, b: F.when(F.col("cause") == CAUSES[1], F.when(rare("n_raw"), a).otherwise(b))
    named = x.withColumn("cause", out).withColumns({"matched_form": below(F.col("raw"), F.col("norm")), "n_corpus": below(F.col("n_raw"), F.col("n_norm"))})
    return named.withColumn("overlap", F.round("overlap", 6))


def lower_min_count(diagnosed: DataFrame, thresholds: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(threshold, n) misses, in neither spelling in the vocabulary, whose corpus count reaches a lower threshold."""
    reaches = lambda t: ~F.col("raw_in") & ~F.col("norm_in") & (F.greatest("n_raw", "n_norm") >= t)
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(reaches(t)).alias("n")) for t in thresholds])
    return diagnosed.agg(each.alias("a")).select(F.explode("a").alias("x")).select("x.*")


def lemma_expansion(diagnosed: DataFrame, surfaces: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(resolvable, surface_forms) of misses, diagnosed or only ``spelled``: those whose citation form has a surface form in the vocabulary, and how many such forms there are."""
    known = surfaces.join(vocabulary.select(F.col("word").alias("form")).distinct(), "form", "left_semi").distinct()
    hit = diagnosed.select("source_token", F.col("norm").alias("cf")).join(known, "cf")
    return hit.agg(F.count_distinct("source_token").alias("resolvable"), F.count_distinct("form").alias("surface_forms"))


def tier2(candidates: DataFrame, vectors: DataFrame, targets: DataFrame, nearest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(resolvable, tested, top1, top5, top10, skipped) of candidates (id, expected) whose composed vectors (id, vec) are looked up.

    targets (word) is the target vocabulary; nearest maps (id, vec) to (qid, rank, word), the ten nearest targets. A candidate
    whose expected word is no target, or which has no vector, is skipped.
    """
    x = flagged(candidates, F.lower("expected"), targets, "word", "in_target")
    x = x.join(vectors.select("id", F.lit(True).alias("_has")).distinct(), "id", "left").withColumn("tested", F.col("in_target") & F.coalesce("_has", F.lit(False)))
    asked = vectors.join(x.filter("tested").select("id").distinct(), "id", "left_semi")  # the others' answers don't count
    hits = nearest(asked).join(x.filter("tested").select(F.col("id").alias("qid"), F.lower("expected").alias("word")), ["qid", "word"])
    best = hits.groupBy(F.col("qid").alias("id")).agg(F.min("rank").alias("rank"))
    y = x.join(best, "id", "left")
    within = lambda k: F.count_if(F.col("tested") & (F.col("rank") <= k)).alias(f"top{k}")
    return y.agg(F.count("*").alias("resolvable"), F.count_if("tested").alias("tested"), within(1), within(5), within(10), F.count_if(~F.col("tested")).alias("skipped"))


def interventions(diagnosed: DataFrame, composed: DataFrame, inferred: DataFrame) -> DataFrame:
    """(rank, intervention, n, trust): what each measure alone would resolve, most first, in the order of ``TRUST`` on ties.

    composed and inferred are ``tier2`` of the morpheme and the subword candidates: they count by their first five answers.
    """
    names = list(TRUST)
    exact = {names[0]: (F.col("norm") != "") & F.col("norm_in"), names[1]: ~F.col("raw_in") & ~F.col("norm_in") & (F.greatest("n_raw", "n_norm") >= 1), names[2]: F.col("surface_in")}
    row = lambda name, n: F.struct((-n).alias("m"), F.lit(names.index(name)).alias("at"), F.lit(name).alias("intervention"), n.alias("n"), F.lit(TRUST[name]).alias("trust"))
    counts = diagnosed.agg(F.array(*[row(name, F.count_if(test)) for name, test in exact.items()]).alias("a"))
    for name, scored in ((names[3], composed), (names[4], inferred)):
        counts = counts.withColumn("a", F.concat("a", F.array(row(name, scored.select("top5").scalar()))))
    return counts.select(F.posexplode(F.array_sort("a")).alias("p", "x")).select((F.col("p") + 1).alias("rank"), "x.intervention", "x.n", "x.trust")
