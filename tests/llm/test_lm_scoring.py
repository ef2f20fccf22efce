"""Language-model scoring against the model's formulas, token by token."""

import collections
import math
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmesh.llm import lm_scoring
from lexmesh.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, learn boolean"


def model(rows, weight=(2.0, 1.0)):
    """(score, probability of a token after a history) over counted dicts; rows: (text, learn). weight: of the failure arcs."""
    c, docs = collections.Counter(), []
    for text, learn in rows:
        w = [b"<", *lm_scoring.tokens_of(text)]
        own = collections.Counter(tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1))
        docs.append((w, own if learn else collections.Counter(), own))
        c.update(docs[-1][1])
    tokens = {g[0] for g in c if len(g) == 1 and g != (b"<",)}
    total, v = sum(c[(t,)] for t in tokens), len(tokens)

    def p(history, w, own):
        n = total - sum(x for g, x in own.items() if len(g) == 1 and g != (b"<",))
        out = (c[(w,)] - own[(w,)] + 1) / (n + v + 1)
        for k in range(1, len(history) + 1):
            h = tuple(history[-k:])
            arc = weight[0] * max(c[h] - own[h], 1) ** weight[1]
            out = (c[(*h, w)] - own[(*h, w)] + arc * out) / (c[h] - own[h] + arc)
        return out

    def score(k, others=False):
        w, own, _ = docs[k]
        own = own if others else collections.Counter()
        return sum(math.log10(p(w[max(0, j - 2) : j], w[j], own)) for j in range(1, len(w)))

    return score, p, tokens, total, v, c


def scored(spark, rows, grid=lm_scoring.GRID):
    docs = spark.createDataFrame([(k, x, learn) for k, (x, learn) in enumerate(rows)], SCHEMA)
    return {r.doc_id: r for r in lm_scoring.score_texts(docs, "learn", grid=grid).collect()}


def test_places_by_hand():
    texts = ["Hello  world", "", None, "a\tb\nC d", " x ", "ÜÄ straße ABC abc", "tail\x0b", "hello"]
    keys, of, begin = lm_scoring.places(pa.array(texts, pa.string()).slice(0))
    want = [(k, t) for k, x in enumerate(texts) for t in (b"<", *lm_scoring.tokens_of(x))]
    assert [k for k, _ in want] == of.tolist() and [t == b"<" for _, t in want] == begin.tolist()
    number = {}
    assert all(number.setdefault(t, int(key)) == key for (_, t), key in zip(want, keys)) and len(set(number.values())) == len(number)
    assert lm_scoring.places(pa.array([None, "a b"]).slice(1))[0].tolist() == lm_scoring.places(pa.array(["a b"]))[0].tolist()
    long = "x" * (3 * lm_scoring.SPAN) + " y"
    assert lm_scoring.places(pa.array([long]))[0][2] == lm_scoring.places(pa.array(["y"]))[0][1]


def test_scores_by_brute_force(spark):
    rnd = random.Random(5)
    rows = [(" ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 40))), k % 4 != 0) for k in range(150)] + [(None, True), ("", False), ("q q q q", True), ("q q q q", True), ("zz", None)]
    weights = ((4.0, 0.8), (0.5, 0.5), (2.0, 1.0))
    made = [model([(x, bool(learn)) for x, learn in rows], w) for w in weights]
    best = max(range(3), key=lambda i: sum(made[i][0](k, True) for k, (_, learn) in enumerate(rows) if learn))
    score, _, tokens, total, v, c = made[best]
    got = scored(spark, rows, weights)
    for k, (x, learn) in enumerate(rows):
        w = lm_scoring.tokens_of(x)
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learn, len(w), sum(t in tokens for t in w), total)
        assert math.isclose(r.base_score, sum(math.log10((c[(t,)] + 1) / (total + v + 1)) for t in w), rel_tol=1e-9)
        assert math.isclose(r.score, score(k), rel_tol=1e-9) and math.isclose(r.others_score, score(k, True), rel_tol=1e-9)
        assert (r.backoff_scale, r.backoff_power) == weights[best]


def test_each_state_sums_to_one():
    rows = [("a b a b c", True), ("b a c", True), ("a b c", False)]
    _, p, tokens, *_ = model(rows)
    for h in ([], [b"a"], [b"a", b"b"], [b"<"], [b"<", b"b"], [b"x", b"c"]):
        assert math.isclose(sum(p(h, t, collections.Counter()) for t in (*tokens, b"?")), 1, rel_tol=1e-12)


def test_corpus_scores_by_brute_force_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = QUERIES["op5_lm_scoring"](spark, SF).toPandas().set_index("doc_id")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.doc_id]
    (weight,) = set(zip(got.backoff_scale, got.backoff_power))
    score, _, tokens, total, v, c = model([(x, not h) for x, h in zip(docs.text, held)], weight)
    for k, (i, x) in enumerate(zip(docs.doc_id, docs.text)):
        r, w = got.loc[i], lm_scoring.tokens_of(x)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(t in tokens for t in w), total)
        assert math.isclose(r.base_score, sum(math.log10((c[(t,)] + 1) / (total + v + 1)) for t in w), rel_tol=1e-9)
        if k % 7 == 0 or held[k]:
            assert math.isclose(r.score, score(k), rel_tol=1e-9) and math.isclose(r.others_score, score(k, True), rel_tol=1e-9)
    own = got[got.held_out]
    assert own.score.sum() > own.base_score.sum() and (own.score == own.others_score).all()


def test_most_held_out_texts_gain(spark):
    """Over sf0.01, by text and not by sum, so that copies don't make up for the rest."""
    got = QUERIES["op5_lm_scoring"](spark, "/root/testdata/sf0.01").toPandas()
    own = got[got.held_out & (got.n_tokens > 20)]
    assert (own.score / own.n_tokens).median() > (own.base_score / own.n_tokens).median() + 0.1 and (own.score > own.base_score).mean() > 0.8
    learned = got[~got.held_out]
    assert (learned.score >= learned.others_score - 1e-6).mean() > 0.99


@pytest.mark.parametrize("learn", [True, False])
def test_gibberish_is_below_known_text_and_copies_are_above(spark, learn):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 7 != 2).alias("learn"))
    rnd = random.Random(1)
    junk = " ".join("".join(rnd.choice("bcdfgjklpqvxz") for _ in range(7)) for _ in range(200))
    fresh = " ".join("".join(rnd.choice("bcdfgjklpqvxz") for _ in range(7)) for _ in range(200))
    extra = spark.createDataFrame([(-1, junk, learn), (-2, fresh, learn), (-3, fresh, True)], SCHEMA)
    got = lm_scoring.score_texts(docs.unionByName(extra), "learn").withColumn("each", F.col("others_score") / F.col("n_tokens")).toPandas().set_index("doc_id")
    text = got[(got.index >= 0) & (got.n_tokens >= 20)]
    assert got.loc[-1].each < text.each.min() and got.loc[-2].each > text.each.median()


def test_blocks_do_not_change_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("learn", F.col("doc_id") % 3 != 0)
    a = {r.doc_id: round(r.score, 6) for r in lm_scoring.score_texts(docs, "learn").collect()}
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 5_000)
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 20_000)
    b = {r.doc_id: round(r.score, 6) for r in lm_scoring.score_texts(docs, "learn").collect()}
    c = {r.doc_id: round(r.score, 6) for r in lm_scoring.score_texts(spark.createDataFrame(docs.toPandas()), "learn").collect()}
    assert a == b == c
