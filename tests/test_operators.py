import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmesh.functions.text import clean_tokens
from lexmesh.functions.vectors import cosine, half_precision, unit
from lexmesh.operators import anchors, audit, claims, corpus, knn, lenses, linalg, lookup, passages


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def vectors(spark, *vs):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "id long, vec array<double>").withColumn("vec", unit(F.col("vec")))


def test_keep_longest_first_on_ties_and_null_keys_stay(spark):
    t = spark.createDataFrame([(1, "P1", 2), (2, "P1", 5), (3, "P1", 5), (4, None, 1), (5, "", 1), (6, "P2", 0)], "o long, p string, k long")
    assert [r[0] for r in rows(corpus.keep_longest(t, "p", F.col("k"), "o").select("o"))] == [2, 4, 5, 6]
    s = corpus.dedup_stats(t, "p").first()
    assert (s.n_in, s.n_no_key, s.n_unique, s.n_out, s.n_removed) == (6, 2, 2, 4, 2)


def test_dictionary_anchors_count_both_forms(spark):
    lemmas = spark.createDataFrame([("lu-gal", "lugal", "king")] * 3 + [("e2", "e2", "house"), ("e2", "e2", "x")], "form string, cf string, gw string")
    assert rows(anchors.dictionary_anchors(lemmas, 1).select("source_token", "target_word", "frequency", "confidence")) == [("e2", "house", 1, 0.51), ("lugal", "king", 3, 0.53)]


def test_cooccurrence_takes_the_best_word_and_the_least_on_ties(spark):
    pairs = spark.createDataFrame([("lugal a", "the king came"), ("lugal b", "king came"), ("lugal", "king and came"), ("x1", None)], "transliteration string, translation string")
    assert rows(anchors.cooccurrence_anchors(pairs, 3).select("source_token", "target_word", "frequency", "confidence")) == [("lugal", "came", 3, 1.0)]


def test_merge_keeps_the_most_confident_then_the_earlier_source(spark):
    s = "source_token string, target_word string, frequency long, confidence double, provenance string"
    a = spark.createDataFrame([("a", "x", 1, 0.5, "D"), ("b", "y", 1, 0.5, "D")], s)
    b = spark.createDataFrame([("a", "z", 1, 0.9, "C"), ("b", "a", 1, 0.5, "C"), ("c", "q", 1, 0.3, "C")], s)
    assert rows(anchors.merge_anchors(a, b).select("source_token", "target_word", "provenance")) == [("a", "z", "C"), ("b", "y", "D"), ("c", "q", "C")]


def test_nearest_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (60, 4))
    v[v.sum(1) == 0] = 1
    df = vectors(spark, *v)
    got = rows(knn.nearest(df.filter("id % 7 = 0"), df, 5, other=True), "qid", "rank")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for q in range(0, 60, 7):
        s = np.round(np.clip(n @ n[q], -1, 1), 6)
        top = sorted((-s[i], i) for i in range(60) if i != q)[:5]
        want += [(q, k + 1, i, -m) for k, (m, i) in enumerate(top)]
    assert [r[:3] for r in got] == [w[:3] for w in want]
    assert np.allclose([r[3] for r in got], [w[3] for w in want], atol=1e-6)


def test_search_over_nothing(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    some = vectors(spark, [1, 0])
    assert knn.nearest(none, some, 3).count() == 0 and knn.nearest(some, none, 3).count() == 0
    pairs, bins = knn.pair_report(none, 5, 0.0, 1.0, 4)
    assert pairs.count() == 0 and rows(bins) == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_pair_report_counts_the_closed_last_bin(spark):
    df = vectors(spark, [1, 0], [1, 0], [0, 1], [1, 1])
    pairs, bins = knn.pair_report(df, 2, 0.0, 1.0, 2)
    assert [(a, b) for a, b, _ in rows(pairs, F.desc("score"), "a", "b")] == [(0, 1), (0, 3)]
    assert rows(bins) == [(0, 2), (1, 4)]


def test_lens_geometry(spark):
    df = vectors(spark, [1, 0], [0.9, 0.1], [0.8, 0.2], [-1, 0.1])
    iso = {r.id: r for r in lenses.isolation(df, df, 2).collect()}
    assert max(iso, key=lambda i: iso[i].distance) == 3 and iso[0].nearest5 == "1,2"
    assert {r.id: r.jaccard for r in lenses.divergence(df, df, df, df, 2).collect()} == dict.fromkeys(range(4), 0.0)
    centers = vectors(spark, [1, 0], [0, 1]).withColumnRenamed("id", "label")
    got = {r.id: r.bridge for r in lenses.bridges(vectors(spark, [1, 1], [1, 0]), centers, "label").collect()}
    assert got == {0: 1.0, 1: 0.0}


def test_histogram_drops_outside_and_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.49,), (1.0,), (1.2,), (-0.1,)], "x double")
    assert rows(lenses.histogram(df, "x", 0.0, 1.0, 4)) == [(0, 1), (1, 1), (2, 0), (3, 1)]


def test_analogy_blend_and_displacement(spark):
    df = vectors(spark, [1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 1, 1])
    both = lookup.SemanticLookup(df, df)
    t = spark.createDataFrame([(9, 0, 1, 2), (8, 0, 1, 99)], "id long, a long, b long, c long")
    got = rows(both.analogy(t, 1).select("qid", "id"))
    assert got == [(9, 3)]
    w = spark.createDataFrame([(5, 1, 1.0), (5, 2, 0.1), (6, 77, 1.0), (7, 0, 0.0)], "id long, word_id long, weight double")
    assert rows(both.blend(w, 1).select("qid", "id")) == [(5, 1)]
    d = lookup.displacement(spark.createDataFrame([(0, 1), (0, 0)], "source_id long, target_id long"), df, df)
    assert sorted(r.distance for r in d.collect()) == [0.0, 1.0]


def test_ridge_and_whitening_from_sums(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    y = x @ rng.normal(size=(4, 3)) + 2
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y array<double>")
    g = linalg.gram(df, "x", "y")
    coef, bias = linalg.ridge(g, 1e-9)
    assert np.allclose(x @ coef.T + bias, y, atol=1e-5)
    mean, w = linalg.whitening(g)
    assert np.allclose(np.cov(((x - mean) @ w).T), np.eye(4), atol=1e-8)
    p = linalg.apply_linear(df.select("id", "x"), "x", coef, bias).orderBy("id").first()
    assert np.allclose(p.projected, y[0], atol=1e-5)


def test_half_precision(spark):
    df = spark.createDataFrame([(0.1,), (0.0,), (-3.14159,), (1e-5,)], "x double")
    got = [r[0] for r in df.select(half_precision(F.col("x"))).collect()]
    assert got == [float(np.float16(v)) for v in (0.1, 0.0, -3.14159, 1e-5)]


def test_cosine_is_clipped(spark):
    df = spark.createDataFrame([([1.0, 1e-9], [1.0, 1e-9])], "a array<double>, b array<double>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] <= 1.0


def words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "word string")


def test_audit_priorities(spark):
    a = spark.createDataFrame([("x", "king", 0.9), ("dup", "king", 0.9), ("lugal", "king", 0.2), ("lugal", " King", 0.3), ("nope", "king", 0.9), ("lugal", "a b", 0.9), ("lugal", "zzz", 0.9), ("lugal", "gem", 0.9), ("lugal", "glo", 0.9), (None, None, None)], "source_token string, target_word string, confidence double")
    c = audit.classify_anchors(a, words(spark, "lugal", "dup"), words(spark, "king", "glo"), words(spark, "king", "gem", None), words(spark, "dup"))
    got = sorted((r.source_token or "", r.target_word or "", r.bucket) for r in c.collect())
    assert got == sorted([
        ("x", "king", "junk_sumerian"), ("dup", "king", "duplicate_collision"), ("lugal", "king", "low_confidence"), ("lugal", " King", "survives"), ("nope", "king", "sumerian_vocab_miss"),
        ("lugal", "a b", "multiword_english"), ("lugal", "zzz", "english_both_miss"), ("lugal", "gem", "english_glove_miss"), ("lugal", "glo", "english_gemma_miss"), ("", "", "junk_sumerian"),
    ])
    n = {r.bucket: r.n for r in audit.counted(c, "bucket", audit.BUCKETS).collect()}
    assert n["junk_sumerian"] == 2 and sum(n.values()) == 10 and len(n) == 9


def test_misses_have_one_cause_each(spark):
    m = spark.createDataFrame([("Šu-{x}",), ("rare",), ("cite",), ("ab-cd",), ("abcdez",), ("qqqq",)], "source_token string")
    v = words(spark, "szux", "ab", "cd", "surface")
    f = spark.createDataFrame([("rare", 2)], "word string, n long")
    s = spark.createDataFrame([("cite", "surface"), ("qqqq", "unseen")], "cf string, form string")
    g = spark.createDataFrame([(x,) for x in ("<ab", "abc", "bcd", "cde", "<abc", "abcd", "bcde", "<abcd", "abcde", "<abcde")], "gram string")
    d = {r.source_token: r.cause for r in audit.classify_misses(m, v, f, s, g).collect()}
    assert d == dict(zip(["Šu-{x}", "rare", "cite", "ab-cd", "abcdez", "qqqq"], audit.CAUSES))


def test_passages_first_match_and_clipped_context(spark):
    lines = spark.createDataFrame([(t, n, x) for t in (1, 2, 3) for n, x in enumerate(["a", "lu-gal here", "b", "lugal", "c"])], "text_id long, line_no int, line string")
    q = spark.createDataFrame([("Lugal",), ("none",)], "query string")
    got = rows(passages.find_passages(q, lines, 2, 2))
    assert got == [("Lugal", 1, 1, 1, "lu-gal here", "a\nlu-gal here\nb\nlugal"), ("Lugal", 2, 2, 1, "lu-gal here", "a\nlu-gal here\nb\nlugal")]


def test_accuracy(spark):
    df = vectors(spark, [1, 0], [0, 1], [1, 1])
    p = df.withColumn("gold", F.when(F.col("id") == 0, 1).otherwise(F.col("id")))
    got = {r.k: r.accuracy for r in linalg.accuracy(p, df, (1, 3)).collect()}
    assert math.isclose(got[1], 200 / 3, abs_tol=1e-5) and got[3] == 100.0


def test_blocks_of_queries_and_rows_meet_alike(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = vectors(spark, *rng.integers(-2, 3, (90, 3)) + 0.5)
    named = df.withColumn("word", F.concat(F.lit("w"), "id")).select("word", "vec")
    one = rows(knn.nearest(df, df, 4, other=True), "qid", "rank"), rows(knn.nearest_named(df, named, 4), "qid", "rank")
    pairs, bins = knn.pair_report(df, 7, 0.0, 1.0, 5)
    all_pairs = rows(pairs, F.desc("score"), "a", "b"), rows(bins)
    monkeypatch.setattr(knn, "BLOCK", 17)
    monkeypatch.setattr(knn, "ROWS", 23)
    assert (rows(knn.nearest(df, df, 4, other=True), "qid", "rank"), rows(knn.nearest_named(df, named, 4), "qid", "rank")) == one
    assert all(a[0] != b[0] or (-a[3], a[2]) < (-b[3], b[2]) for a, b in zip(one[1], one[1][1:]))
    pairs, bins = knn.pair_report(df, 7, 0.0, 1.0, 5)
    assert (rows(pairs, F.desc("score"), "a", "b"), rows(bins)) == all_pairs


def test_low_shares_are_tested_before_they_are_rounded(spark):
    pairs = spark.createDataFrame([("lugal", "king if had") if k < 3 else ("lugal", f"other{chr(97 + k)}") for k in range(10)] + [("", "king")], "transliteration string, translation string")
    made = anchors.cooccurrence_anchors(pairs, 3, 0.3).select("target_word", "frequency", "confidence")
    assert [tuple(r) for r in made.collect()] == [("king", 10, 0.3)]
    assert anchors.cooccurrence_anchors(pairs, 3, 0.30001).count() == 0


def test_preflight_reasons_and_warnings(spark):
    concepts = spark.createDataFrame([("lugal", "king"), ("nope", "queen"), ("ki", "earth"), ("an", "Sky")], "source_token string, target_word string")
    spaces = {"gemma": words(spark, "king", "earth"), "glove": words(spark, "King", "sky")}
    near = spark.createDataFrame([("king", "lugal"), ("king", "e2"), ("king", "a"), ("earth", "kur")], "target_word string, token string")
    found = spark.createDataFrame([("lugal",), ("lugal",), ("an",), ("nope",)], "source_token string")
    got = {r.source_token: r for r in passages.preflight(concepts, words(spark, "lugal", "ki", "an"), spaces, near, found).collect()}
    assert (got["lugal"].status, got["lugal"].n_passages, got["lugal"].degenerate, got["lugal"].reasons, got["lugal"].warnings) == ("pass", 2, 0.667, "", "degenerate_top5")
    assert (got["nope"].status, got["nope"].reasons) == ("fail", "sumerian_vocab_miss;english_missing_both_spaces")
    assert got["nope"].warnings == "degenerate_top5;english_missing_gemma;english_missing_glove" and got["nope"].degenerate == 1.0
    assert (got["ki"].reasons, got["ki"].warnings) == ("zero_etcsl_passages", "english_missing_glove")
    assert (got["an"].status, got["an"].warnings) == ("pass", "degenerate_top5;english_missing_gemma")


def test_tier2_counts_by_rank_and_skips(spark):
    targets = spark.createDataFrame([("king", [1.0, 0.0]), ("queen", [0.0, 1.0]), ("gold", [-1.0, 0.0])], "word string, vec array<double>")
    vectors_ = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (4, [0.0, -1.0])], "id long, vec array<double>")
    candidates = spark.createDataFrame([(1, "King"), (2, "king"), (3, "queen"), (4, "none")], "id long, expected string")
    got = audit.tier2(candidates, vectors_, targets.select("word"), lambda q: knn.nearest_named(q, targets, 10)).first()
    assert tuple(got) == (4, 2, 1, 2, 2, 2)


def test_examples_and_partition(spark):
    a = spark.createDataFrame([(f"t{i}", "x" if i % 3 else "y") for i in range(40)], "source_token string, bucket string")
    some = [tuple(r) for r in audit.examples(a, "bucket", "source_token", 4).select("bucket", "source_token").collect()]
    assert len(some) == len(set(some)) == 8 and sorted(some) == sorted(tuple(r) for r in audit.examples(a.repartition(3), "bucket", "source_token", 4).select("bucket", "source_token").collect())
    assert tuple(audit.partition(a, "source_token", words(spark, "t1", "t2", "zz")).first()) == (40, 2, 38, 5.0)


def test_claims(spark):
    lines = spark.createDataFrame([(1, "  cos 0.25, then -0.5 and 3.5 in 1987.123456 "), (2, "none")], "n int, line string")
    found = claims.numeric_claims(lines)
    assert rows(found.select("n", "value", "context")) == [(1, -0.5, "cos 0.25, then -0.5 and 3.5 in 1987.123456"), (1, 0.25, "cos 0.25, then -0.5 and 3.5 in 1987.123456")]
    metrics = spark.createDataFrame([(0.2509,), (-0.502,)], "value double")
    assert rows(claims.supported(found, metrics).select("value", "supported")) == [(-0.5, False), (0.25, True)]
    text = "signs \U00012000 \U00012001 \U00012002\n## Appendix: cuneiform sign PROVENANCE\nU+12001 and \U00012002"
    got = claims.provenance(spark.createDataFrame([(1, text), (2, "\U00012000")], "k int, text string"), "k", "text")
    assert rows(got.select("k", "codepoint", "covered")) == [(1, "\U00012000", False), (1, "\U00012001", True), (1, "\U00012002", True), (2, "\U00012000", False)]


def test_lookup_contract(spark):
    t = spark.createDataFrame([(1, "King", [1.0, 0.0]), (2, "king", [0.0, 1.0])], "id long, token string, vec array<double>")
    s = spark.createDataFrame([(7, "lugal", [0.0, 1.0]), (8, "e2", [1.0, 0.0])], "id long, token string, vec array<double>")
    both = lookup.SemanticLookup(s, t, check=True)
    assert [r.token for r in both.find(words(spark, "KING"), 1).collect()] == ["lugal"]  # the last of the targets that differ in case
    with pytest.raises(ValueError):
        lookup.find_in({"a": both}, "b", words(spark, "king"))
    with pytest.raises(ValueError):
        lookup.SemanticLookup(s.union(spark.createDataFrame([(9, "x", [1.0])], s.schema)), t, check=True)
    with pytest.raises(KeyError):
        lookup.displacement(spark.createDataFrame([(7, 99)], "source_id long, target_id long"), s, t, strict=True)
    with pytest.raises(ValueError):
        lookup.pairwise_distances(s.select("id"), s, most=1)


def test_domains_and_deltas(spark):
    grid = spark.createDataFrame([(1, 2, 0.1, 0.25), (1, 3, 0.4, 0.1), (2, 3, 0.001, 0.9), (2, 4, 0.2, 0.3)], "a long, b long, da double, db double")
    kinds = lenses.merges_splits(grid)
    assert rows(kinds) == [(1, 2, "merge"), (1, 3, "split")]
    d = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "label long")
    similar = spark.createDataFrame([(1, 0.5)], "label long, similarity double")
    assert rows(lenses.rank_domains(d, kinds, similar)) == [(1, 1, 1, 6.5), (2, 1, 0, 7.0), (3, 0, 1, 7.0), (4, 0, 0, 5.0)]
    a, b = spark.createDataFrame([(1, 50.0), (5, 70.0)], "k int, accuracy double"), spark.createDataFrame([(1, 45.5)], "k int, accuracy double")
    assert rows(linalg.deltas(a, b, "k", "accuracy")) == [(1, 50.0, 4.5), (5, 70.0, None)]


def test_permutation_test_finds_what_differs(spark):
    x = spark.createDataFrame([("apart" if i < 20 else "rest", i, 1.0 if i < 20 else i % 10 / 20) for i in range(200)], "grp string, id long, value double")
    got = {r.grp: r.p_value for r in lenses.permutation_test(x, 99).collect()}
    assert got["apart"] == 0.01 and got["rest"] > 0.5


def test_searched_and_flat_passages(spark):
    q = spark.createDataFrame([("q", "lu-gal"), ("q", "e2"), ("q", "")], "query string, token string")
    lines = spark.createDataFrame([(1, 0, "lugal here", "a"), (2, 0, "lugal e2", "b"), (2, 1, "E2 lugal", "a"), (3, 0, "none", "a")], "text_id long, line_no int, line string, kind string")
    assert rows(passages.search_passages(q, lines, F.col("kind") == "a", 2), "rank") == [("q", 1, 2, 1, 2.0), ("q", 2, 1, 0, 1.0)]
    flat = spark.createDataFrame([(k, x) for k, x in enumerate(["a", "lugal", "b", "c"])], "line_no int, line string")
    got = passages.flat_passages(spark.createDataFrame([("LUGAL",)], "query string"), flat, 1)
    assert rows(got) == [("LUGAL", 1, "lugal", "a\nlugal\nb")]


def test_tier2_looks_up_tested_candidates_alone(spark):
    candidates = spark.createDataFrame([(1, "A"), (2, "nowhere"), (3, "b")], "id long, expected string")
    vectors_ = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>")
    targets, asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vec array<double>"), []

    def near(queries):
        asked.append([r.id for r in queries.select("id").collect()])
        return knn.nearest_named(queries, targets, 10)

    got = audit.tier2(candidates, vectors_, targets.select("word"), near).first()
    assert tuple(got) == (3, 1, 1, 1, 1, 2) and asked == [[1]]


def test_lemma_expansion_needs_no_diagnosis(spark, monkeypatch):
    """The misses' spelling is enough: no count or n-gram is looked up for it, and the answer is that of diagnosed misses."""
    from lexmesh.operators import audit
    from lexmesh.plans import audit_queries

    sf = "/root/testdata/sf0.001"
    frequency = audit_queries._frequency(spark, sf)
    want = audit.lemma_expansion(audit_queries._diagnosed(spark, sf, frequency), audit_queries._surfaces(spark, sf), audit_queries._vocabulary(frequency)).collect()
    monkeypatch.setattr(audit, "classify_misses", None)
    assert audit_queries.sim_lemma_expansion(spark, sf).collect() == want and want[0].resolvable > 0


def test_token_frequency_cleans_distinct_pieces(spark):
    """Pieces between blanks are counted before they are cleaned; the counts are those of whole lines, also about marks, odd blanks and final sigmas."""
    raw = ["[lugal]-e lu2-{d}nanna lu2-{d}nanna", "1.5 a.1 KA.KAK... 2. end.\tend", "$ broken", " $a b ", "(bar)(re) |KA.KAK| x y.\u00a0z.1", "ΟΔΟΣ ΟΔΟΣ ΣΑ\u3000İx", "", " ", None, "a- -b - & + ' %x 7"]
    lines = spark.createDataFrame([(x,) for x in raw * 3], "line string")
    got = corpus.token_frequency(lines)
    want = lines.select(F.explode(clean_tokens(F.col("line"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    assert rows(got) == rows(want) and len(rows(want)) > 20
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
