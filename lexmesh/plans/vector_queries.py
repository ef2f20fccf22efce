"""Vector queries. Tokens t<id> and words w<id> are all vectors; space a is their first half, space b their second.

Searches take as queries every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import norm, pad, unit
from ..operators import alignment, atlas, cells, layout, lenses, linalg, lookup, validation
from ..operators.audit import flagged
from ..storage import settle
from .registry import query, table

QUERY = "id % 50 = 0"
RAW_SQL = """raw AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""


def _unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"


SPACE_SQL = f"{RAW_SQL}, e AS (SELECT id, label, {_unit_sql('v')} AS f, {_unit_sql('v[1:32]')} AS a, {_unit_sql('v[33:64]')} AS b FROM raw)"
ANCHOR_SQL = "anch AS (SELECT id AS source_id, 't' || id AS source_token, m AS target_id, 'w' || m AS target_word, (5 + (id % 20) * 5) / 100.0 AS confidence FROM e JOIN (SELECT label, min(id) AS m FROM e GROUP BY label) USING (label))"


def space(spark: SparkSession, sf_dir: str, part: str = "f") -> DataFrame:
    """(id, label, vec): unit vectors of the whole (f), first (a) or second half (b) of the dimensions."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    v = v if part == "f" else F.slice(v, 1 if part == "a" else 33, 32)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), unit(v).alias("vec"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    first = e.groupBy("label").agg(F.min("id").alias("target_id"))
    return e.join(first, "label").select(
        F.col("id").alias("source_id"), F.concat(F.lit("t"), "id").alias("source_token"), "target_id", F.concat(F.lit("w"), "target_id").alias("target_word"),
        ((5 + (F.col("id") % 20) * 5) / 100).alias("confidence"),
    )


def frequency(id_: Column) -> Column:
    return 1 + (id_ * 37) % 101


def tokens(spark: SparkSession, sf_dir: str, part: str, lead: str) -> DataFrame:
    return space(spark, sf_dir, part).withColumn("token", F.concat(F.lit(lead), "id"))


@query(f"WITH {RAW_SQL} SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_sum(list_transform(range(1, 65), lambda i: i * v[i])) / sqrt(list_dot_product(v, v)), 6) AS weighted FROM raw")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(norm(v), 6).alias("norm"), F.round(F.aggregate(F.transform(unit(v), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("weighted"))


@query(f"WITH {RAW_SQL} SELECT id, CAST(2 * len(v) AS INT) AS size, round(list_sum(v), 6) AS total FROM raw")
def fuse_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), pad(F.col("embedding"), 64).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return fused.select("id", F.size("v").alias("size"), F.round(total, 6).alias("total"))


@query(f"WITH {SPACE_SQL}, s AS (SELECT label, min(id) AS id FROM e GROUP BY label), p AS (SELECT e.id, f FROM e JOIN s USING (id)) SELECT x.id AS a, y.id AS b, round(1 - greatest(-1, least(1, list_dot_product(x.f, y.f))), 6) AS distance FROM p x, p y")
def pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the first tokens of all labels."""
    e = space(spark, sf_dir)
    return lookup.pairwise_distances(e.groupBy("label").agg(F.min("id").alias("id")), e)


@query(f"WITH {SPACE_SQL}, {ANCHOR_SQL} SELECT source_token, target_word, round(list_dot_product(s.f, t.f), 6) AS cos, round(1 - round(list_dot_product(s.f, t.f), 6), 6) AS distance FROM anch JOIN e s ON s.id = source_id JOIN e t ON t.id = target_id")
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = space(spark, sf_dir)
    return lookup.displacement(anchors(spark, sf_dir), e, e).select("source_token", "target_word", "cos", "distance")


def _top_sql(q: str, side: str, k: int, other: bool = False, name: str = "top") -> str:
    """name AS (qid, rank, id, score): the k best of e.side for the rows (id, v) of q."""
    skip = "WHERE q.id <> r.id" if other else ""
    return f"""{name} AS (SELECT * FROM (SELECT q.id AS qid, r.id, round(greatest(-1, least(1, list_dot_product(q.v, r.{side}))), 6) AS score,
        CAST(row_number() OVER (PARTITION BY q.id ORDER BY round(greatest(-1, least(1, list_dot_product(q.v, r.{side}))), 6) DESC, r.id) AS INT) AS rank FROM {q} q, e r {skip}) WHERE rank <= {k})"""


FIND_SQL = f"WITH {SPACE_SQL}, q AS (SELECT id, b AS v FROM e WHERE {QUERY}), {_top_sql('q', 'a', 10)}"


@query(f"{FIND_SQL} SELECT 'w' || qid AS word, rank, 't' || id AS token, score FROM top")
def lookup_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: words of space b against the tokens of space a."""
    both = lookup.SemanticLookup(tokens(spark, sf_dir, "a", "t"), tokens(spark, sf_dir, "b", "w"))
    return both.find(space(spark, sf_dir, "b").filter(QUERY).select(F.concat(F.lit("W"), "id").alias("word"))).withColumn("word", F.lower("word"))


@query(f"""WITH {SPACE_SQL}, qa AS (SELECT id, a AS v FROM e WHERE {QUERY}), qb AS (SELECT id, b AS v FROM e WHERE {QUERY}), {_top_sql('qa', 'a', 5, name='ta')}, {_top_sql('qb', 'b', 5, name='tb')}
    SELECT 'a' AS space, qid, rank, id, score FROM ta UNION ALL SELECT 'b', qid, rank, id, score FROM tb""")
def lookup_find_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for part in ("a", "b"):
        s = space(spark, sf_dir, part)
        found = lookup.SemanticLookup(s, s).find_vectors(s.filter(QUERY), 5)
        out.append(found.select(F.lit(part).alias("space"), "qid", "rank", "id", "score"))
    return out[0].unionByName(out[1])


@query(f"""WITH {SPACE_SQL}, m AS (SELECT x.id, list_transform(range(1, 65), lambda i: z.f[i] - x.f[i] + y.f[i]) AS v FROM e x JOIN e y ON y.id = x.id + 1 JOIN e z ON z.id = x.id + 2 WHERE x.id % 50 = 0),
    q AS (SELECT id, {_unit_sql('v')} AS v FROM m), {_top_sql('q', 'f', 10)} SELECT qid, rank, id, score FROM top""")
def lookup_analogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = space(spark, sf_dir)
    triples = e.filter(QUERY).select("id", F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    return lookup.SemanticLookup(e, e).analogy(triples)


@query(f"""WITH {SPACE_SQL}, m AS (SELECT x.id, list_transform(range(1, 65), lambda i: 0.5 * x.f[i] + 0.3 * y.f[i] + 0.2 * z.f[i]) AS v FROM e x JOIN e y ON y.id = x.id + 1 JOIN e z ON z.id = x.id + 2 WHERE x.id % 50 = 0),
    q AS (SELECT id, {_unit_sql('v')} AS v FROM m), {_top_sql('q', 'f', 10)} SELECT qid, rank, id, score FROM top""")
def lookup_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = space(spark, sf_dir)
    w = F.array(*[F.struct((F.col("id") + k).alias("word_id"), F.lit(x).alias("weight")) for k, x in enumerate((0.5, 0.3, 0.2))])
    return lookup.SemanticLookup(e, e).blend(e.filter(QUERY).select("id", F.explode(w).alias("w")).select("id", "w.*"))


@query(f"""WITH {SPACE_SQL}, q AS (SELECT id, b AS v FROM e WHERE {QUERY}), {_top_sql('q', 'a', 3)}, s AS (SELECT DISTINCT e.id, a AS v FROM e JOIN top ON top.id = e.id), {_top_sql('s', 'b', 3, name='back')},
    w AS (SELECT qid AS id, string_agg(id, ',' ORDER BY rank) AS targets FROM back GROUP BY qid) SELECT top.qid, top.rank, top.id AS source_id, targets FROM top JOIN w ON w.id = top.id""")
def reverse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = space(spark, sf_dir, "b")
    return lookup.SemanticLookup(space(spark, sf_dir, "a"), b).reverse(b.filter(QUERY), 3, 3)


@query(f"""WITH {SPACE_SQL}, qa AS (SELECT id, a AS v FROM e WHERE {QUERY}), qb AS (SELECT id, b AS v FROM e WHERE {QUERY}), {_top_sql('qa', 'a', 10, name='ta')}, {_top_sql('qb', 'b', 5, name='tb')}
    SELECT coalesce(ta.qid, tb.qid) AS qid, coalesce(ta.rank, tb.rank) AS rank, ta.id AS left_id, tb.id AS right_id FROM ta FULL JOIN tb ON tb.qid = ta.qid AND tb.rank = ta.rank""")
def cluster_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: the ten nearest in one space beside the five nearest in the other."""
    a, b = space(spark, sf_dir, "a"), space(spark, sf_dir, "b")
    return lookup.compare(lookup.SemanticLookup(a, a).find_vectors(a.filter(QUERY), 10), lookup.SemanticLookup(b, b).find_vectors(b.filter(QUERY), 5))


@query(f"{FIND_SQL} SELECT qid, string_agg(id, ' ' ORDER BY rank) AS gloss FROM top GROUP BY qid")
def geometric_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N8."""
    a, b = space(spark, sf_dir, "a"), space(spark, sf_dir, "b")
    return lookup.gloss_of(lookup.SemanticLookup(a, b).find_vectors(b.filter(QUERY), 10))


@query(f"""WITH {SPACE_SQL}, q AS (SELECT id, b AS v FROM e WHERE {QUERY}), {_top_sql('q', 'a', 5)}, s AS (SELECT DISTINCT e.id, a AS v FROM e JOIN top ON top.id = e.id), {_top_sql('s', 'b', 5, name='back')},
    n AS (SELECT qid, count(*) AS n_sources FROM top WHERE score > 0.1 GROUP BY qid),
    d AS (SELECT top.qid, count(DISTINCT back.id) AS n_discovered FROM top JOIN back ON back.qid = top.id WHERE top.score > 0.1 AND back.id NOT IN (SELECT qid FROM top) GROUP BY top.qid)
    SELECT n.qid, n_sources, coalesce(n_discovered, 0) AS n_discovered FROM n LEFT JOIN d USING (qid)""")
def extract_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1."""
    a, b = space(spark, sf_dir, "a"), space(spark, sf_dir, "b")
    found = lookup.SemanticLookup(a, b).find_vectors(b.filter(QUERY), 5)
    sources = found.select("id").distinct().join(a.select("id", "vec"), "id")
    return lookup.extract_cluster(found, lookup.SemanticLookup(b, b).find_vectors(sources, 5))


LENS1_SQL = f"WITH {SPACE_SQL}, {ANCHOR_SQL}, d AS (SELECT source_token, target_word, CAST(confidence AS DOUBLE) AS confidence, round(list_dot_product(s.f, t.f), 6) AS cos FROM anch JOIN e s ON s.id = source_id JOIN e t ON t.id = target_id)"


@query(f"{LENS1_SQL} SELECT * FROM d ORDER BY cos, source_token LIMIT 50")
def lens1_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = space(spark, sf_dir)
    return lenses.lens1(anchors(spark, sf_dir), e, e)


@query(f"{LENS1_SQL} SELECT * FROM d WHERE length(target_word) > 2 AND length(source_token) >= 2 AND confidence >= 0.5 ORDER BY cos, source_token LIMIT 50")
def lens1_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = space(spark, sf_dir)
    return lenses.lens1(anchors(spark, sf_dir), e, e, filtered=True)


LENS2_SQL = f"""WITH {SPACE_SQL}, q AS (SELECT id, a AS v FROM e WHERE {QUERY} AND id % 3 <> 0), {_top_sql('q', 'b', 1)}
    SELECT qid AS id, id AS best_id, score AS cos, round((SELECT count(*) FROM events WHERE user_id = qid) * (1 - score), 6) AS score FROM top ORDER BY 4 DESC, 1 LIMIT 50"""


@query(LENS2_SQL)
def lens2_no_counterpart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token's frequency is the number of events of the user of its number."""
    a = space(spark, sf_dir, "a")
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    return lenses.lens2(a.filter(QUERY), a.filter("id % 3 = 0"), space(spark, sf_dir, "b"), n)


ISO_SQL = f"""WITH {SPACE_SQL}, q AS (SELECT id, f AS v FROM e WHERE {QUERY}), {_top_sql('q', 'f', 10, True)},
    iso AS (SELECT qid AS id, round(1 - min(score), 6) AS distance, string_agg(id, ',' ORDER BY rank) FILTER (rank <= 5) AS nearest5 FROM top GROUP BY qid)"""


@query(f"{ISO_SQL} SELECT * FROM iso ORDER BY distance DESC, id LIMIT 50")
def lens3_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = space(spark, sf_dir)
    return lenses.isolation(e.filter(QUERY), e).orderBy(F.desc("distance"), "id").limit(50)


@query(f"{ISO_SQL} SELECT CAST(g AS INT) AS bin, count(id) AS n FROM range(20) t(g) LEFT JOIN iso ON least(floor(distance / 0.1 + 1e-9), 19) = g AND distance BETWEEN 0 AND 2 GROUP BY g")
def lens3_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = space(spark, sf_dir)
    return lenses.histogram(lenses.isolation(e.filter(QUERY), e), "distance", 0.0, 2.0, 20)


def _cells(rows: DataFrame) -> cells.CellIndex:
    """As many cells as the square root of the rows, also where one would do."""
    return cells.CellIndex(rows, max(1, round(rows.count() ** 0.5)))


@query(f"WITH {SPACE_SQL}, q AS (SELECT id, f AS v FROM e WHERE {QUERY}), {_top_sql('q', 'f', 10, True)} SELECT qid, rank, id, score FROM top")
def cell_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 through cells: only the cells that may hold one of a query's ten nearest are searched."""
    e = space(spark, sf_dir)
    return _cells(e).exact(e.filter(QUERY), 10, other=True)


@query()
def cell_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the ten nearest an approximate search of the nearest cells finds, and in how many of all cells."""
    e = space(spark, sf_dir)
    index, q = _cells(e), e.filter(QUERY)
    probes = index.probes_for(q, 10, other=True)
    found = cells.recall(index.search(q, 10, probes, other=True), index.exact(q, 10, other=True))
    return found.select("*", F.lit(probes).alias("probes"), F.lit(len(index.centers)).alias("cells"))


@query(f"WITH {SPACE_SQL}, p AS (SELECT x.id AS a, y.id AS b, round(list_dot_product(x.a, y.a), 6) AS score FROM e x JOIN e y ON x.id < y.id) SELECT a, b, score FROM p ORDER BY score DESC, a, b LIMIT 100")
def pivot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 through cells: the hundred nearest pairs of space a; rows visit only the cells that may hold such a partner."""
    a = space(spark, sf_dir, "a")
    return cells.top_pairs(a, 100, max(1, round(a.count() ** 0.5)))


DIV_SQL = f"""WITH {SPACE_SQL}, qa AS (SELECT id, a AS v FROM e WHERE {QUERY}), qb AS (SELECT id, b AS v FROM e WHERE {QUERY}), {_top_sql('qa', 'a', 10, True, 'ta')}, {_top_sql('qb', 'b', 10, True, 'tb')},
    div AS (SELECT ta.qid AS id, round(1 - count(tb.id) / (20 - count(tb.id)), 6) AS jaccard FROM ta LEFT JOIN tb ON tb.qid = ta.qid AND tb.id = ta.id GROUP BY ta.qid)"""


def _divergence(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    a, b = space(spark, sf_dir, "a"), space(spark, sf_dir, "b")
    return lenses.divergence(a.filter(QUERY), a, b.filter(QUERY), b, k)


@query(f"{DIV_SQL} SELECT * FROM div ORDER BY jaccard DESC, id LIMIT 50")
def lens4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divergence(spark, sf_dir).orderBy(F.desc("jaccard"), "id").limit(50)


@query(f"{DIV_SQL} SELECT * FROM div WHERE id % 3 = 0 ORDER BY jaccard DESC, id LIMIT 50")
def lens4_anchor_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchored = space(spark, sf_dir).filter("id % 3 = 0").select("id")
    return _divergence(spark, sf_dir).join(anchored, "id", "left_semi").orderBy(F.desc("jaccard"), "id").limit(50)


PAIRS_SQL = f"WITH {SPACE_SQL}, p AS (SELECT x.id AS a, y.id AS b, round(list_dot_product(x.f, y.f), 6) AS score FROM e x JOIN e y ON x.id < y.id)"


@query(f"{PAIRS_SQL} SELECT a, b, score, a % 3 = 0 AS a_anchored, b % 3 = 0 AS b_anchored FROM p WHERE score >= 0.35 ORDER BY score DESC, a, b LIMIT 50")
def lens5_doppelgangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether a side is anchored is an existence join; tokens whose number is divisible by three are."""
    e = space(spark, sf_dir)
    pairs, anchored = cells.top_pairs(e, 50).filter("score >= 0.35"), e.filter("id % 3 = 0").select("id")
    for side in ("a", "b"):
        pairs = flagged(pairs, F.col(side), anchored, "id", f"{side}_anchored")
    return pairs


@query(f"{PAIRS_SQL} SELECT CAST(g AS INT) AS bin, count(a) AS n FROM range(15) t(g) LEFT JOIN p ON least(floor((score - 0.2) / (0.5 - 0.2) * 15 + 1e-9), 14) = g AND score BETWEEN 0.2 AND 0.5 GROUP BY g")
def lens5_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.pair_counts(space(spark, sf_dir), 0.2, 0.5, 15)


CENTER_SQL = f"""m AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(f) AS x, generate_subscripts(f, 1) AS pos FROM e) GROUP BY 1, 2) GROUP BY label),
    c AS (SELECT label, {_unit_sql('v')} AS v FROM m)"""
BRIDGE_SQL = f"""WITH {SPACE_SQL}, {CENTER_SQL}, d AS (SELECT e.id, c.label, round(1 - greatest(-1, least(1, list_dot_product(e.f, c.v))), 6) AS d FROM e, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, label) AS rn FROM d),
    br AS (SELECT x.id, CAST(x.label AS BIGINT) AS nearest, CAST(y.label AS BIGINT) AS second, round(CASE WHEN y.d > 0 THEN x.d / y.d ELSE 1 END, 6) AS bridge FROM r x JOIN r y ON y.id = x.id AND x.rn = 1 AND y.rn = 2)"""


@query(f"{BRIDGE_SQL} SELECT * FROM br ORDER BY bridge DESC, id LIMIT 50")
def lens6_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = space(spark, sf_dir)
    return lenses.bridges(e, lenses.centroids(e, "label"), "label").orderBy(F.desc("bridge"), "id").limit(50)


@query("""SELECT CAST(label AS BIGINT) AS label, string_agg(vec_id, ',' ORDER BY vec_id) AS members FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 5 GROUP BY label""")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.members(space(spark, sf_dir), "label")


def atlas_config(spark: SparkSession, sf_dir: str) -> atlas.AtlasConfig:
    """Lens 1 over whole vectors would need a space of its own here, so this atlas is of space a against space b."""
    a = space(spark, sf_dir, "a")
    return atlas.AtlasConfig(
        a, space(spark, sf_dir, "b"), anchors(spark, sf_dir), lenses.centroids(a, "label"), space(spark, sf_dir, "b"),
        queries=F.expr(QUERY), frequency=frequency(F.col("id")), pair_threshold=0.5, pair_range=(0.2, 0.8, 15),
    )


def atlas_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lens with its first entry, n/a where a lens is empty."""
    lenses_of = {
        "lens1": lens1_displacement, "lens2": lens2_no_counterpart, "lens3": lens3_isolation, "lens4": lens4_divergence, "lens5": lens5_doppelgangers, "lens6": lens6_bridges,
    }
    return atlas.summary({name: f(spark, sf_dir) for name, f in lenses_of.items()})


def _first_sql(lens: str, sql: str, item: str, value: str, least: str) -> str:
    return f"SELECT '{lens}' AS lens, coalesce((SELECT {item} FROM ({sql}) x ORDER BY {least}, length({item}), {item} LIMIT 1), 'n/a') AS item, (SELECT {value} FROM ({sql}) x ORDER BY {least}, length({item}), {item} LIMIT 1) AS value"


query(" UNION ALL ".join([
    _first_sql("lens1", f"{LENS1_SQL} SELECT * FROM d", "source_token", "cos", "cos"),
    _first_sql("lens2", LENS2_SQL, "CAST(id AS VARCHAR)", "score", "-score"),
    _first_sql("lens3", f"{ISO_SQL} SELECT * FROM iso", "CAST(id AS VARCHAR)", "distance", "-distance"),
    _first_sql("lens4", f"{DIV_SQL} SELECT * FROM div", "CAST(id AS VARCHAR)", "jaccard", "-jaccard"),
    _first_sql("lens5", f"{PAIRS_SQL} SELECT * FROM p WHERE score >= 0.35", "a || '-' || b", "score", "-score"),
    _first_sql("lens6", f"{BRIDGE_SQL} SELECT * FROM br", "CAST(id AS VARCHAR)", "bridge", "-bridge"),
]))(atlas_summary)


# --- linear algebra -------------------------------------------------------------------------------------------------


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, y, gold): a token's vector in space a, and its anchor's in space b."""
    x = space(spark, sf_dir, "a").select("id", "vec")
    y = space(spark, sf_dir, "b").select(F.col("id").alias("gold"), F.col("vec").alias("y"))
    pairs = anchors(spark, sf_dir).select(F.col("source_id").alias("id"), F.col("target_id").alias("gold"))
    return x.join(pairs, "id").join(y, "gold").select("id", "vec", "y", "gold")


ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10_000.0, 100_000.0)


def _aligned(spark: SparkSession, sf_dir: str, alphas: tuple[float, ...]) -> DataFrame:
    rows = settle(_training(spark, sf_dir))
    g = linalg.gram(rows.filter(~linalg.is_test(F.col("id"))), "vec", "y")
    test, target, out = rows.filter(linalg.is_test(F.col("id"))), settle(space(spark, sf_dir, "b").select("id", "vec")), None
    for alpha in alphas:
        coef, bias = linalg.ridge(g, alpha)
        p = settle(linalg.apply_linear(test.select("id", "vec", "gold"), "vec", coef, bias).select("id", unit(F.col("projected")).alias("vec"), "gold"))
        own = linalg.accuracy(p, target).withColumn("alpha", F.lit(alpha))
        out = own if out is None else out.unionByName(own)
    return out.select("alpha", "k", "n", "accuracy")


@query()
def ridge_align_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on four fifths of the anchors, percent of the rest whose anchor is among the nearest."""
    return _aligned(spark, sf_dir, (100.0,))


@query()
def alignment_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space a against space b (gloss), its first half (bare) and both whitened; delta is to the gloss run's accuracy."""
    b = space(spark, sf_dir, "b").select("id", "vec")
    spaces = {"gloss": b, "bare": b.select("id", unit(F.slice("vec", 1, 16)).alias("vec"))}
    made = settle(alignment.modes(space(spark, sf_dir, "a"), spaces, anchors(spark, sf_dir), linalg.is_test(F.col("source_id"))))
    base = made.filter("mode = 'gloss'").select("k", "accuracy")
    out = None
    for mode in alignment.MODES:
        own = alignment.merged(made.filter(F.col("mode") == mode), base, "k", "accuracy").withColumn("mode", F.lit(mode))
        out = own if out is None else out.unionByName(own)
    return out.join(made.select("mode", "k", "n", "train", "test", "valid", "total"), ["mode", "k"])


@query()
def random_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean cosine of a thousand random pairs of whole vectors, before and after whitening."""
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    out = [alignment.random_cosine(rows).select(F.lit(name).alias("space"), "pairs", F.round("mean", 6).alias("mean")) for name, rows in (("raw", raw), ("white", alignment.whitened(raw)))]
    return out[0].unionByName(out[1])


@query()
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of sums, eight penalties; delta is to the first one's accuracy."""
    swept = settle(_aligned(spark, sf_dir, ALPHAS))
    return linalg.deltas(swept, swept.filter(F.col("alpha") == ALPHAS[0]).select("k", "accuracy"), "k", "accuracy")


@query()
def ridge_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6, V7: every token projected, in half precision."""
    from ..functions.vectors import half_precision

    g = linalg.gram(_training(spark, sf_dir), "vec", "y")
    coef, bias = linalg.ridge(g, 100.0)
    p = linalg.apply_linear(space(spark, sf_dir, "a").select("id", "vec"), "vec", coef, bias)
    return p.select("id", F.array_join(F.transform("projected", lambda x: F.format_number(half_precision(x), 5)), ",").alias("projected"))


@query(f"""WITH {RAW_SQL}, x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM raw), s AS (SELECT pos, avg(x) AS m, var_samp(x) AS var FROM x GROUP BY pos)
    SELECT (SELECT count(*) FROM raw) AS n, round(sqrt(sum(m * m)), 6) AS mean_norm, round(sum(var), 6) AS trace, true AS white FROM s""")
def whiten_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm of the mean and trace of the covariance before, and whether the covariance is one after."""
    import numpy as np

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    g = linalg.gram(rows, "vec")
    mean, w = linalg.whitening(g)
    after = linalg.gram(linalg.apply_linear(rows, "vec", w.T, -mean @ w), "projected")
    cov = (after["xx"] - np.outer(after["x"], after["x"]) / after["n"]) / (after["n"] - 1)
    trace = float(np.trace((g["xx"] - g["n"] * np.outer(mean, mean)) / (g["n"] - 1)))
    white = bool(np.abs(cov - np.eye(len(cov))).max() < 1e-6)
    return spark.createDataFrame([(int(g["n"]), round(float(np.linalg.norm(mean)), 6), round(trace, 6), white)], "n long, mean_norm double, trace double, white boolean")


@query()
def kmeans_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V16 with L6: clusters fitted rather than given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = space(spark, sf_dir)
    model = KMeans(k=10, seed=42, maxIter=20, featuresCol="v").fit(e.select(array_to_vector("vec").alias("v")))
    centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "label long, vec array<double>")
    return lenses.bridges(e, centers.select("label", unit(F.col("vec")).alias("vec")), "label").orderBy(F.desc("bridge"), "id").limit(50)


@query()
def pca_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two principal coordinates of every token."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = space(spark, sf_dir).select("id", array_to_vector("vec").alias("v"))
    xy = vector_to_array("xy")
    return PCA(k=2, inputCol="v", outputCol="xy").fit(v).transform(v).select("id", F.round(xy[0], 6).alias("x"), F.round(xy[1], 6).alias("y"))


@query()
def neighbour_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coordinates of every token by which its neighbours stay near."""
    return layout.neighbour_plane(space(spark, sf_dir)).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {SPACE_SQL}, {CENTER_SQL}, ax AS (SELECT {_unit_sql('v')} AS v FROM (SELECT list_transform(range(1, 65), lambda i: q.v[i] - p.v[i]) AS v FROM c p, c q WHERE p.label = (SELECT min(label) FROM c) AND q.label = (SELECT max(label) FROM c)))
    SELECT e.id, round(list_dot_product(e.f, ax.v), 6) AS projection FROM e, ax""")
def axis_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token on the axis from the first to the last label's centroid."""
    import numpy as np

    e = space(spark, sf_dir)
    c = lenses.centroids(e, "label")
    ends = c.agg(F.min_by("vec", "label").alias("a"), F.max_by("vec", "label").alias("b")).first()
    axis = np.array(ends["b"]) - np.array(ends["a"])
    axis = axis / (np.linalg.norm(axis) or 1.0)
    p = linalg.apply_linear(e.select("id", "vec"), "vec", axis[None, :], np.zeros(1))
    return p.select("id", F.round(F.get("projected", 0), 6).alias("projection"))


@query()
def word2vec_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip-gram vectors of the cleaned corpus, of words that occur five times or more; every core trains a share of the lines."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    from ..functions.text import clean_tokens
    from ..operators.corpus import lines

    # the vocabulary and the training each read them
    words = settle(lines(table(spark, sf_dir, "documents")).select(clean_tokens(F.col("line")).alias("w")).filter(F.size("w") > 0))
    shares = max(8, spark.sparkContext.defaultParallelism)
    model = Word2Vec(vectorSize=32, windowSize=10, minCount=5, maxIter=2, numPartitions=shares, seed=42, inputCol="w", outputCol="v").fit(words)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


# --- extensions ------------------------------------------------------------------------------------------------------

CENTERS2_SQL = """ca AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(a) AS x, generate_subscripts(a, 1) AS pos FROM e) GROUP BY 1, 2) GROUP BY label),
    cb AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(b) AS x, generate_subscripts(b, 1) AS pos FROM e) GROUP BY 1, 2) GROUP BY label)"""


def _means(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return space(spark, sf_dir, part).groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("vec"))


@query(f"WITH {SPACE_SQL}, {CENTERS2_SQL} SELECT CAST(label AS BIGINT) AS label, round(sqrt(list_sum(list_transform(range(1, 33), lambda i: (ca.v[i] - cb.v[i]) * (ca.v[i] - cb.v[i])))), 6) AS shift FROM ca JOIN cb USING (label)")
def centroid_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4."""
    a, b = _means(spark, sf_dir, "a"), _means(spark, sf_dir, "b").withColumnRenamed("vec", "other")
    return a.join(b, "label").select("label", F.round(norm(F.zip_with("vec", "other", lambda x, y: x - y)), 6).alias("shift"))


GRID_SQL = f"""WITH {SPACE_SQL}, {CENTERS2_SQL}, ua AS (SELECT label, {_unit_sql('v')} AS v FROM ca), ub AS (SELECT label, {_unit_sql('v')} AS v FROM cb),
    g AS (SELECT CAST(x.label AS BIGINT) AS a, CAST(y.label AS BIGINT) AS b, round(1 - list_dot_product(x.v, y.v), 6) AS da, round(1 - list_dot_product(p.v, q.v), 6) AS db
        FROM ua x JOIN ua y ON x.label < y.label JOIN ub p ON p.label = x.label JOIN ub q ON q.label = y.label)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for part in ("a", "b"):
        c = _means(spark, sf_dir, part).select(F.col("label").alias("id"), unit(F.col("vec")).alias("vec"))
        out.append(lookup.pairwise_distances(c, c).filter("a < b").withColumnRenamed("distance", f"d{part}"))
    return out[0].join(out[1], ["a", "b"])


@query(f"{GRID_SQL} SELECT a, b, da, db, round(da - db, 6) AS diff FROM g")
def distance_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2, over label centroids."""
    return _grid(spark, sf_dir).withColumn("diff", F.round(F.col("da") - F.col("db"), 6))


@query(f"{GRID_SQL} SELECT a, b, CASE WHEN db / da >= 1.2 THEN 'merge' ELSE 'split' END AS kind FROM g WHERE da >= 0.01 AND db >= 0.01 AND (db / da >= 1.2 OR da / db >= 1.2)")
def merge_split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose distances in the two spaces differ by a fifth."""
    return lenses.merges_splits(_grid(spark, sf_dir), 1.2)


NEAR20_SQL = DIV_SQL.replace("rank <= 10", "rank <= 20").replace("(20 - count(tb.id))", "(40 - count(tb.id))")


@query(f"{NEAR20_SQL} SELECT id, round(1 - jaccard, 6) AS similarity FROM div")
def neighborhood_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the twenty nearest that two spaces have in common."""
    return _divergence(spark, sf_dir, 20).select("id", F.round(1 - F.col("jaccard"), 6).alias("similarity"))


@query(f"""WITH {SPACE_SQL}, {CENTER_SQL} SELECT CAST(e.label AS BIGINT) AS label, count(*) AS n, round(avg(1 - greatest(-1, least(1, list_dot_product(e.f, c.v)))), 6) AS spread FROM e JOIN c USING (label) GROUP BY e.label""")
def cluster_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine distance of a label's tokens to their centroid."""
    return lenses.spread(space(spark, sf_dir), "label")


RANK_SQL = f"""{GRID_SQL}, ms AS (SELECT x.label AS d, count(*) FILTER (db / da >= 1.2) AS merges, count(*) FILTER (da / db >= 1.2) AS splits FROM (SELECT DISTINCT CAST(label AS BIGINT) AS label FROM e) x LEFT JOIN g ON (g.a = x.label OR g.b = x.label) AND da >= 0.01 AND db >= 0.01 GROUP BY x.label),
    {DIV_SQL.removeprefix(f"WITH {SPACE_SQL}, ")}, sj AS (SELECT CAST(e.label AS BIGINT) AS d, avg(1 - jaccard) AS similarity FROM div JOIN e ON e.id = div.id GROUP BY e.label)"""


@query(f"{RANK_SQL} SELECT d AS domain, merges, splits, round(2 * merges + 2 * splits + 5 * (1 - coalesce(similarity, 0)), 6) AS score FROM ms LEFT JOIN sj USING (d)")
def rank_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by how differently two spaces place them: pairs that come together or part by a fifth, and neighbours that change."""
    e = space(spark, sf_dir).select("id", "label")
    similar = _divergence(spark, sf_dir).join(e, "id").groupBy("label").agg(F.avg(1 - F.col("jaccard")).alias("similarity"))
    return lenses.rank_domains(e.select("label").distinct(), lenses.merges_splits(_grid(spark, sf_dir), 1.2), similar)


@query(f"""{DIV_SQL}, v AS (SELECT CAST(e.label AS BIGINT) AS grp, div.id, CAST(round(jaccard * 1e6) AS BIGINT) AS v FROM div JOIN e ON e.id = div.id),
    own AS (SELECT grp, count(*) AS n, sum(v) AS own FROM v GROUP BY grp), slots AS (SELECT grp, row_number() OVER (ORDER BY grp, id) AS pos FROM v),
    dealt AS (SELECT t.r, v, row_number() OVER (PARTITION BY t.r ORDER BY md5('42:' || t.r || ':' || id), id) AS pos FROM v, range(1, 1000) t(r)),
    sums AS (SELECT grp, r, sum(dealt.v) AS drawn FROM dealt JOIN slots USING (pos) GROUP BY grp, r), beat AS (SELECT grp, count(*) FILTER (drawn >= own) AS k FROM sums JOIN own USING (grp) GROUP BY grp)
    SELECT grp, n, round(own / n / 1e6, 6) AS mean, round((k + 1) / 1000, 6) AS p_value FROM own JOIN beat USING (grp)""")
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By label, the chance that tokens dealt at random diverge as much between two spaces as the label's own."""
    e = space(spark, sf_dir).select("id", F.col("label").alias("grp"))
    return lenses.permutation_test(_divergence(spark, sf_dir).join(e, "id").select("grp", "id", F.col("jaccard").alias("value")), 999)


@query(f"""WITH {SPACE_SQL}, {ANCHOR_SQL}, cp AS (SELECT source_id, target_id FROM anch WHERE source_id % 50 = 0), qa AS (SELECT DISTINCT e.id, a AS v FROM e JOIN cp ON cp.target_id = e.id), qb AS (SELECT DISTINCT e.id, b AS v FROM e JOIN cp ON cp.target_id = e.id),
    {_top_sql('qa', 'a', 10, name='ta')}, {_top_sql('qb', 'b', 10, name='tb')}
    SELECT cp.source_id, cp.target_id, ta.rank, ta.id AS a_id, tb.id AS b_id, round(1 - round(greatest(-1, least(1, list_dot_product(x.a, y.a))), 6), 6) AS a_distance, round(1 - round(greatest(-1, least(1, list_dot_product(x.b, y.b))), 6), 6) AS b_distance
    FROM cp JOIN ta ON ta.qid = cp.target_id JOIN tb ON tb.qid = cp.target_id AND tb.rank = ta.rank JOIN e x ON x.id = source_id JOIN e y ON y.id = target_id""")
def concept_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: for each concept the ten nearest in both spaces side by side, and how far its translation lies in each."""
    concepts = anchors(spark, sf_dir).filter("source_id % 50 = 0").select("source_id", "target_id")
    spaces = {part: space(spark, sf_dir, part) for part in ("a", "b")}
    return lookup.concept_tables(concepts, spaces)


@query(f"""WITH {SPACE_SQL}, x AS (SELECT id, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM e), m AS (SELECT i, avg(x) AS m FROM x GROUP BY i), c AS (SELECT id, x.i, x - m AS x FROM x JOIN m USING (i)),
    cov AS (SELECT p.i, q.i AS j, avg(p.x * q.x) AS v FROM c p JOIN c q USING (id) GROUP BY 1, 2) SELECT (SELECT count(*) FROM e) AS n, round(power(sum(v) FILTER (i = j), 2) / sum(v * v), 6) AS participation FROM cov""")
def cluster_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participation ratio of the whole space's covariance."""
    import numpy as np

    g = linalg.gram(space(spark, sf_dir).select("vec"), "vec")
    mean = g["x"] / g["n"]
    w = np.maximum(np.linalg.eigvalsh(g["xx"] / g["n"] - np.outer(mean, mean)), 0)
    p = w / max(w.sum(), 1e-300)
    return spark.createDataFrame([(int(g["n"]), round(float(1 / max((p**2).sum(), 1e-300)), 6))], "n long, participation double")


SEED_SQL = "(SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0 ORDER BY vec_id LIMIT 5)"


@query(f"""SELECT 'length' AS test, count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS failed, count(*) FILTER (len(embedding) <> 64) = 0 AS passed FROM embeddings
    UNION ALL SELECT 'finite', count(*), count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0), count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) = 0 FROM embeddings
    UNION ALL SELECT 'nonzero', count(*), count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0), count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) = 0 FROM embeddings
    UNION ALL SELECT c, count(*), count(*) FILTER ((SELECT count(*) FROM embeddings) = 0), count(*) FILTER ((SELECT count(*) FROM embeddings) = 0) = 0 FROM {SEED_SQL}, (VALUES ('seeds_a'), ('seeds_b')) t(c) GROUP BY c
    UNION ALL SELECT 'analogy', count(*), count(*) FILTER (NOT known), count(*) FILTER (NOT known) = 0 FROM (SELECT vec_id + 2 IN (SELECT vec_id FROM embeddings) AND vec_id + 1 IN (SELECT vec_id FROM embeddings) AS known FROM {SEED_SQL})""")
def smoke_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: the vectors' own checks, five seeds that must find something in both spaces, and their analogies; counted as the rows pass."""
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    out = validation.passed_over(validation.watch(raw, validation.vector_checks(64))).report(spark)
    e = space(spark, sf_dir)
    seeds = settle(e.filter(QUERY).select("id").orderBy("id").limit(5))
    found = {f"seeds_{part}": lookup.SemanticLookup(s, s).find_vectors(s.join(seeds, "id"), 5) for part in ("a", "b") for s in (space(spark, sf_dir, part),)}
    found["analogy"] = lookup.SemanticLookup(e, e).analogy(seeds.select("id", F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c")), 5)
    for name, answered in found.items():
        out = out.unionByName(validation.passed_over(validation.answers(seeds, answered, name=name)).report(spark))
    return out
