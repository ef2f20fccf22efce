"""Queries over a pair of spaces: find, analogy, blend and two-hop reverse lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm, unit
from .knn import nearest


class UnknownSpace(ValueError):
    pass


class SemanticLookup:
    """Q1: source and target are (id, token, vec), vec normalised; of targets that differ in case alone the last (by id) counts.

    check verifies in one pass a side that all vectors have one length and no token is missing, and raises ValueError otherwise.
    """

    def __init__(self, source: DataFrame, target: DataFrame, check: bool = False):
        self.source, self.target = source, target
        if check:
            for name, side in (("source", source), ("target", target)):
                made = side.agg(F.count_distinct(F.size("vec")).alias("sizes"), F.count_if(F.col("token").isNull() | F.col("vec").isNull()).alias("missing"), F.count("*").alias("n")).first()
                if made["sizes"] != 1 or made["missing"]:
                    raise ValueError(f"{name}: {made['n']} rows, {made['sizes']} vector lengths, {made['missing']} without token or vector")

    def words(self) -> DataFrame:
        """(w, id, vec): the target by lower-cased token."""
        last = self.target.groupBy(F.lower("token").alias("w")).agg(F.max("id").alias("id"))
        return last.join(self.target.select("id", "vec"), "id").select("w", "id", "vec")

    def find(self, words: DataFrame, k: int = 10) -> DataFrame:
        """Q2: (word, rank, token, score) for words (word); a word that the target lacks gives no row. Case is ignored."""
        q = words.select(F.lower("word").alias("w"), "word").join(self.words(), "w")
        found = nearest(q.select("id", "vec").distinct(), self.source.select("id", "vec"), k)
        named = found.join(self.source.select("id", "token"), "id")
        return q.select("word", F.col("id").alias("qid")).join(named, "qid").select("word", "rank", "token", "score")

    def find_vectors(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(qid, rank, id, score) for query vectors (id, vec); zero vectors give no rows."""
        q = queries.filter(norm(F.col("vec")) > 1e-12).select("id", unit(F.col("vec")).alias("vec"))
        return nearest(q, self.source.select("id", "vec"), k)

    def analogy(self, triples: DataFrame, k: int = 10) -> DataFrame:
        """Q4: unit(c - a + b) for triples (id, a, b, c) of target ids; triples with an unknown word give no rows."""
        t = self.target.select("id", "vec")
        q = triples
        for x in ("a", "b", "c"):
            q = q.join(t.select(F.col("id").alias(x), F.col("vec").alias(f"v{x}")), x)
        mixed = F.zip_with(F.zip_with("vc", "va", lambda c, a: c - a), "vb", lambda x, b: x + b)
        return self.find_vectors(q.select("id", mixed.alias("vec")), k)

    def blend(self, weights: DataFrame, k: int = 10) -> DataFrame:
        """Q5: the unit weighted sum of known words, for weights (id, word_id, weight)."""
        known = weights.join(self.target.select(F.col("id").alias("word_id"), "vec"), "word_id")
        parts = known.select("id", "weight", F.posexplode("vec").alias("pos", "x")).groupBy("id", "pos").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
        mixed = parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
        return self.find_vectors(mixed, k)

    def reverse(self, seeds: DataFrame, k_source: int = 10, k_target: int = 5) -> DataFrame:
        """Q7: (qid, rank, source_id, targets): each seed's sources, and each source's nearest targets, joined by commas."""
        hop = self.find_vectors(seeds, k_source)
        sources = hop.select("id").distinct().join(self.source.select("id", "vec"), "id")
        back = nearest(sources, self.target.select("id", "vec"), k_target)
        words = back.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"].cast("string")), ",").alias("targets"))
        return hop.join(words.withColumnRenamed("qid", "id"), "id").select("qid", "rank", F.col("id").alias("source_id"), "targets")


def find_in(spaces: dict[str, SemanticLookup], space: str, words: DataFrame, k: int = 10) -> DataFrame:
    """Q2, Q6: find in the named space; ValueError for a space that there isn't."""
    if space not in spaces:
        raise UnknownSpace(f"unknown space {space!r}: one of {sorted(spaces)}")
    return spaces[space].find(words, k)


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two ranked answers (qid, rank, id) side by side; a rank that one lacks stays with a null."""
    x = left.select("qid", "rank", F.col("id").alias("left_id"))
    return x.join(right.select("qid", "rank", F.col("id").alias("right_id")), ["qid", "rank"], "full")


def gloss_of(found: DataFrame) -> DataFrame:
    """(qid, gloss): a query's answers in one line, best first."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"].cast("string"))
    return found.groupBy("qid").agg(F.array_join(ids, " ").alias("gloss"))


def extract_cluster(found: DataFrame, back: DataFrame, least: float = 0.1) -> DataFrame:
    """(qid, n_sources, n_discovered): seeds' sources above a score, and the words these lead back to that are no seed."""
    near = found.filter(F.col("score") > least)
    words = near.select("qid", F.col("id").alias("source_id")).join(back.select(F.col("qid").alias("source_id"), F.col("id").alias("word")), "source_id")
    new = words.join(found.select(F.col("qid").alias("word")).distinct(), "word", "left_anti").groupBy("qid").agg(F.count_distinct("word").alias("n_discovered"))
    return near.groupBy("qid").agg(F.count("*").alias("n_sources")).join(new, "qid", "left").fillna(0, ["n_discovered"])


def displacement(pairs: DataFrame, source: DataFrame, target: DataFrame, strict: bool = False) -> DataFrame:
    """Pairs (source_id, target_id, ...) with cos and distance; unknown ids give no row, or with strict a KeyError."""
    x = pairs.join(source.select(F.col("id").alias("source_id"), F.col("vec").alias("_s")), "source_id")
    x = x.join(target.select(F.col("id").alias("target_id"), F.col("vec").alias("_t")), "target_id")
    if strict:
        _all_known(pairs, "source_id", source), _all_known(pairs, "target_id", target)
    cos = F.round(cosine(F.col("_s"), F.col("_t")), 6)
    return x.withColumns({"cos": cos, "distance": F.round(1 - cos, 6)}).drop("_s", "_t")


def _all_known(rows: DataFrame, column: str, side: DataFrame) -> None:
    missing = rows.select(F.col(column).alias("id")).join(side.select("id"), "id", "left_anti").limit(1).collect()
    if missing:
        raise KeyError(missing[0]["id"])


def pairwise_distances(tokens: DataFrame, vectors: DataFrame, strict: bool = False, most: int = 4096) -> DataFrame:
    """V4: (a, b, distance) for a short list of ids (at most ``most``, else ValueError), in both orders; strict: KeyError for an unknown id."""
    if tokens.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ids")
    if strict:
        _all_known(tokens, "id", vectors)
    own = tokens.select("id").join(vectors.select("id", "vec"), "id")
    listed = own.agg(F.collect_list(F.struct("id", "vec"))).scalar()
    grid = own.select(F.col("id").alias("a"), "vec", F.explode(listed).alias("y"))
    return grid.select("a", F.col("y.id").alias("b"), F.round(1 - cosine(F.col("vec"), F.col("y.vec")), 6).alias("distance"))


def concept_tables(concepts: DataFrame, spaces: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """Q9: (source_id, target_id, rank, <space>_id..., <space>_distance...): a concept's k nearest by its target word in every space, and its own distance there."""
    out, columns = None, []
    words = concepts.select(F.col("target_id").alias("id")).distinct()
    for name, rows in spaces.items():
        found = nearest(words.join(rows.select("id", "vec"), "id"), rows.select("id", "vec"), k).select(F.col("qid").alias("target_id"), "rank", F.col("id").alias(f"{name}_id"))
        out = found if out is None else out.join(found, ["target_id", "rank"])
        columns += [f"{name}_id"]
    for name, rows in spaces.items():
        concepts = displacement(concepts, rows, rows).withColumnRenamed("distance", f"{name}_distance").drop("cos")
        columns += [f"{name}_distance"]
    return concepts.join(out, "target_id").select("source_id", "target_id", "rank", *columns)
