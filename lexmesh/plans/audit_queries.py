"""Audit, coverage, passage, format and streaming queries.

The corpus is cleaned and counted once, as are the anchors mined: these tables are found again while their inputs' files stay as they are
(G3). Vocabulary and n-grams come from the counts. Anchors under audit: each whitespace token of the conversations with the token that follows it most often. Vocabulary: the
cleaned tokens of the documents that occur five times or more. English vocabularies: the benchmark's and the answers' words.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, morphemes, ngrams, normalize_token, runs
from ..functions.vectors import unit
from ..operators import audit, corpus, passages
from ..operators.knn import nearest_named
from ..sources import corpora
from ..storage import kept, new_path, settle, spread
from ..streaming import counts, longest
from .corpus_queries import CLEAN_SQL, TEXTS_SQL, norm_sql
from .registry import query, table

# --- inputs ----------------------------------------------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str, name: str, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, name).filter(where).select(F.explode(F.split(F.lower("text"), SPACE)).alias("word")).filter("word <> ''").distinct()


def _frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kept(spark, "frequency", [docs], lambda: corpus.token_frequency(corpus.lines(docs)).withColumnRenamed("token", "word"))


def _vocabulary(frequency: DataFrame) -> DataFrame:
    return frequency.filter("n >= 5").select("word")


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return kept(spark, "anchors", [turns], lambda: _mined(turns))


def _mined(turns: DataFrame) -> DataFrame:
    w = spread(turns.select("text")).select(F.split("text", SPACE).alias("w"))
    each = w.select(F.explode(runs(F.col("w"), 2)).alias("p")).groupBy(F.get("p", 0).alias("s"), F.get("p", 1).alias("t")).agg(F.count("*").alias("n"))
    best = each.groupBy("s").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "t")).alias("b"))
    return best.select(F.col("s").alias("source_token"), F.col("b.t").alias("target_word"), F.round(-F.col("b.m") / F.col("total"), 4).alias("confidence"))


def _collisions(anchors: DataFrame) -> DataFrame:
    """Tokens that share their normal form with one that sorts before them."""
    n = anchors.select("source_token", normalize_token(F.col("source_token")).alias("k"))
    low = n.groupBy("k").agg(F.min("source_token").alias("low"))
    return n.join(low, "k").filter("source_token <> low").select(F.col("source_token").alias("word"))


def _classified(spark: SparkSession, sf_dir: str, frequency: DataFrame | None = None) -> DataFrame:
    a = _anchors(spark, sf_dir)
    v = _vocabulary(frequency or _frequency(spark, sf_dir))
    return audit.classify_anchors(a, v, _words(spark, sf_dir, "benchmark"), _words(spark, sf_dir, "conversations", "role = 'assistant'"), _collisions(a))


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")

    def work() -> DataFrame:
        raw = turns.select(F.explode(F.split("text", SPACE)).alias("w")).filter("w <> ''").distinct()
        return raw.select(normalize_token(F.col("w")).alias("cf"), F.regexp_replace(F.lower("w"), r"[.,:;!?]+$", "").alias("form")).distinct()

    return kept(spark, "surfaces", [turns], work)


def _missed(spark: SparkSession, sf_dir: str, frequency: DataFrame) -> DataFrame:
    return _classified(spark, sf_dir, frequency).filter("bucket = 'sumerian_vocab_miss'").select("source_token", "target_word")


def _diagnosed(spark: SparkSession, sf_dir: str, frequency: DataFrame | None = None) -> DataFrame:
    frequency = frequency or _frequency(spark, sf_dir)
    v = _vocabulary(frequency)
    grams = v.select(F.explode(ngrams(F.col("word"), 3, 6)).alias("gram")).distinct()
    return audit.classify_misses(_missed(spark, sf_dir, frequency), v, frequency, _surfaces(spark, sf_dir), grams)


AUDIT_SQL = f"""WITH {CLEAN_SQL}, freq AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM clean) GROUP BY word), voc AS (SELECT word FROM freq WHERE n >= 5),
    cw AS (SELECT role, regexp_split_to_array(text, '\\s+') AS w FROM conversations),
    pr AS (SELECT w[i] AS s, w[i + 1] AS t, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM cw) GROUP BY 1, 2),
    an AS MATERIALIZED (SELECT s AS source_token, t AS target_word, round(n / total, 4) AS confidence FROM (SELECT *, sum(n) OVER (PARTITION BY s) AS total, row_number() OVER (PARTITION BY s ORDER BY n DESC, t) AS rn FROM pr) WHERE rn = 1),
    glove AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM benchmark),
    gemma AS (SELECT DISTINCT lower(unnest(w)) AS word FROM cw WHERE role = 'assistant'),
    nk AS (SELECT source_token, {norm_sql('source_token')} AS k FROM an), col AS (SELECT source_token AS word FROM (SELECT *, min(source_token) OVER (PARTITION BY k) AS low FROM nk) WHERE source_token <> low),
    fl AS (SELECT an.*, source_token IN (SELECT word FROM voc) AS iv, lower(trim(target_word)) IN (SELECT word FROM glove WHERE word <> '') AS ig, lower(trim(target_word)) IN (SELECT word FROM gemma WHERE word <> '') AS im, source_token IN (SELECT word FROM col) AS ic FROM an),
    cl AS MATERIALIZED (SELECT *, CASE WHEN length(trim(source_token)) <= 1 THEN 'junk_sumerian' WHEN ic THEN 'duplicate_collision' WHEN confidence < 0.3 THEN 'low_confidence' WHEN NOT iv THEN 'sumerian_vocab_miss'
        WHEN regexp_matches(lower(trim(target_word)), '[\\s_\\-]') THEN 'multiword_english' WHEN NOT ig AND NOT im THEN 'english_both_miss' WHEN NOT ig THEN 'english_glove_miss' WHEN NOT im THEN 'english_gemma_miss' ELSE 'survives' END AS bucket FROM fl)"""


def _names_sql(names: tuple[str, ...], column: str) -> str:
    return f"(SELECT unnest([{', '.join(repr(n) for n in names)}]) AS {column})"


@query(f"{AUDIT_SQL} SELECT b.bucket, count(cl.bucket) AS n, round(100 * count(cl.bucket) / (SELECT count(*) FROM cl), 2) AS pct FROM {_names_sql(audit.BUCKETS, 'bucket')} b LEFT JOIN cl ON cl.bucket = b.bucket GROUP BY b.bucket")
def anchor_audit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.counted(_classified(spark, sf_dir), "bucket", audit.BUCKETS)


@query(f"""{AUDIT_SQL} SELECT g.b AS in_glove, m.b AS in_gemma, (SELECT count(*) FROM cl WHERE bucket IN ('english_both_miss', 'english_glove_miss', 'english_gemma_miss', 'survives') AND ig = g.b AND im = m.b) AS n
    FROM (VALUES (true), (false)) g(b), (VALUES (true), (false)) m(b)""")
def anchor_audit_venn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four cells, also those without anchors."""
    four = _classified(spark, sf_dir).filter(F.col("bucket").isin(*audit.BUCKETS[-4:]))
    cells = [(g, m) for g in (True, False) for m in (True, False)]
    test = lambda g, m: (F.col("in_glove") == g) & (F.col("in_gemma") == m)
    each = F.array(*[F.struct(F.lit(g).alias("in_glove"), F.lit(m).alias("in_gemma"), F.count_if(test(g, m)).alias("n")) for g, m in cells])
    return four.agg(each.alias("a")).select(F.explode("a").alias("x")).select("x.*")


@query(f"""{AUDIT_SQL}, r AS (SELECT bucket, source_token, row_number() OVER (PARTITION BY bucket ORDER BY md5('42' || source_token), source_token) AS rn FROM cl) SELECT bucket, source_token FROM r WHERE rn <= 10""")
def anchor_audit_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten examples a bucket, by a seeded hash."""
    return audit.examples(_classified(spark, sf_dir), "bucket", "source_token", 10, 42).select("bucket", "source_token")


GRAMS = "list_distinct(flatten(list_transform(list_filter([3, 4, 5, 6], lambda n: n <= length({w}) + 2), lambda n: list_transform(range(1, length({w}) + 4 - n), lambda i: substring('<' || {w} || '>', i, n)))))"
DIAG_SQL = f"""{AUDIT_SQL}, ms AS MATERIALIZED (SELECT source_token, lower(target_word) AS expected, trim(source_token) AS raw, {norm_sql('trim(source_token)')} AS norm FROM cl WHERE bucket = 'sumerian_vocab_miss'),
    raww AS (SELECT DISTINCT unnest(w) AS w FROM cw), sf AS (SELECT DISTINCT {norm_sql('w')} AS cf, regexp_replace(lower(w), '[.,:;!?]+$', '') AS form FROM raww WHERE w <> ''),
    sfv AS MATERIALIZED (SELECT DISTINCT cf, form FROM sf JOIN voc ON voc.word = form), gr AS MATERIALIZED (SELECT DISTINCT unnest({GRAMS.format(w='word')}) AS gram FROM voc),
    mo AS MATERIALIZED (SELECT source_token, m, m IN (SELECT word FROM voc) AS ok FROM (SELECT source_token, unnest(list_transform(string_split(raw, '-'), lambda p: {norm_sql('p')})) AS m FROM ms WHERE contains(raw, '-')) WHERE m <> ''),
    mp AS (SELECT source_token, bool_and(ok) AS ok FROM mo GROUP BY source_token),
    og AS MATERIALIZED (SELECT source_token, unnest({GRAMS.format(w='norm')}) AS g FROM ms),
    ov AS (SELECT source_token, count(gr.gram) / count(*) AS overlap FROM og LEFT JOIN gr ON gr.gram = og.g GROUP BY source_token),
    dg0 AS (SELECT ms.*, coalesce(f1.n, 0) AS nr, coalesce(f2.n, 0) AS nn, norm IN (SELECT word FROM voc) AS norm_in, raw IN (SELECT word FROM voc) AS raw_in, norm IN (SELECT cf FROM sfv) AS surface_in, coalesce(mp.ok, false) AS morphemes_in, coalesce(ov.overlap, 0) AS overlap
        FROM ms LEFT JOIN freq f1 ON f1.word = ms.raw LEFT JOIN freq f2 ON f2.word = norm LEFT JOIN mp ON mp.source_token = ms.source_token LEFT JOIN ov ON ov.source_token = ms.source_token),
    dg AS MATERIALIZED (SELECT *, CASE WHEN norm <> '' AND norm_in THEN 'normalization_recoverable' WHEN nr BETWEEN 1 AND 4 OR nn BETWEEN 1 AND 4 THEN 'in_corpus_below_min_count' WHEN surface_in THEN 'oracc_lemma_surface_recoverable'
        WHEN morphemes_in THEN 'morpheme_composition_recoverable' WHEN norm <> '' AND overlap >= 0.5 THEN 'subword_inference_recoverable' ELSE 'genuinely_missing' END AS cause FROM dg0)"""
# tier 2: a word's vector is the row of embeddings that a hash of the word picks; the target of a row is the least target word that picks it
PICK = "('0x' || substr(md5({w}), 1, 7))::BIGINT % (SELECT count(*) FROM embeddings)"
TIER2_SQL = f"""{DIAG_SQL}, emb AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    pick AS (SELECT min(word) AS word, k FROM (SELECT word, {PICK.format(w='word')} AS k FROM gemma WHERE word <> '') GROUP BY k),
    tg AS MATERIALIZED (SELECT word, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM pick JOIN emb ON emb.vec_id = k),
    cm AS (SELECT source_token, expected FROM dg WHERE morphemes_in), cs AS (SELECT source_token, expected FROM dg WHERE norm <> '' AND NOT norm_in AND overlap >= 0.5),
    part AS (SELECT 'm' AS kind, mo.source_token, mo.m AS part FROM mo JOIN cm USING (source_token) UNION ALL SELECT 's', og.source_token, og.g FROM og JOIN cs USING (source_token) JOIN gr ON gr.gram = og.g),
    pv AS (SELECT kind, source_token, v FROM (SELECT kind, source_token, {PICK.format(w='part')} AS k FROM part) JOIN emb ON emb.vec_id = k),
    qm AS (SELECT kind, source_token, list(x ORDER BY pos) AS v FROM (SELECT kind, source_token, pos, avg(x) AS x FROM (SELECT kind, source_token, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM pv) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    qv AS MATERIALIZED (SELECT qm.kind, qm.source_token, c.expected, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM qm JOIN (SELECT 'm' AS kind, * FROM cm UNION ALL SELECT 's', * FROM cs) c USING (kind, source_token)),
    gold AS (SELECT qv.*, round(list_dot_product(qv.v, tg.v), 6) AS score FROM qv JOIN tg ON tg.word = qv.expected),
    rk AS (SELECT g.kind, g.source_token, count(*) FILTER (round(list_dot_product(g.v, tg.v), 6) > g.score OR (round(list_dot_product(g.v, tg.v), 6) = g.score AND tg.word < g.expected)) + 1 AS rank FROM gold g, tg GROUP BY 1, 2),
    t2 AS (SELECT kind, count(*) AS tested, count(*) FILTER (rank <= 1) AS top1, count(*) FILTER (rank <= 5) AS top5, count(*) FILTER (rank <= 10) AS top10 FROM rk GROUP BY kind),
    res AS (SELECT 'm' AS kind, count(*) AS resolvable FROM cm UNION ALL SELECT 's', count(*) FROM cs),
    sm AS (SELECT res.kind, resolvable, coalesce(tested, 0) AS tested, coalesce(top1, 0) AS top1, coalesce(top5, 0) AS top5, coalesce(top10, 0) AS top10, resolvable - coalesce(tested, 0) AS skipped FROM res LEFT JOIN t2 USING (kind))"""


@query(f"{DIAG_SQL} SELECT b.cause, count(dg.cause) AS n, round(100 * count(dg.cause) / (SELECT count(*) FROM dg), 2) AS pct FROM {_names_sql(audit.CAUSES, 'cause')} b LEFT JOIN dg ON dg.cause = b.cause GROUP BY b.cause")
def coverage_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.counted(_diagnosed(spark, sf_dir), "cause", audit.CAUSES)


@query(f"""{DIAG_SQL} SELECT source_token, norm, cause, CASE WHEN cause = 'in_corpus_below_min_count' THEN CASE WHEN nr BETWEEN 1 AND 4 THEN raw ELSE norm END END AS matched_form,
    CASE WHEN cause = 'in_corpus_below_min_count' THEN CASE WHEN nr BETWEEN 1 AND 4 THEN nr ELSE nn END END AS n_corpus, round(CAST(overlap AS DOUBLE), 6) AS overlap FROM dg""")
def coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each missing anchor with its cause, the form that is too rare, and its subword overlap."""
    return _diagnosed(spark, sf_dir).select("source_token", "norm", "cause", "matched_form", "n_corpus", "overlap")


@query(f"{DIAG_SQL} SELECT CAST(t AS INT) AS threshold, count(*) FILTER (NOT raw_in AND NOT norm_in AND (nr >= t OR nn >= t)) AS n FROM dg, (SELECT unnest([1, 2, 3, 4]) AS t) GROUP BY t")
def sim_lower_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.lower_min_count(_diagnosed(spark, sf_dir))


@query(f"{DIAG_SQL} SELECT count(*) FILTER (norm <> '' AND norm_in) AS resolvable FROM dg")
def sim_ascii_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosed(spark, sf_dir).agg(F.count_if((F.col("norm") != "") & F.col("norm_in")).alias("resolvable"))


@query(f"{DIAG_SQL} SELECT (SELECT count(*) FROM dg WHERE surface_in) AS resolvable, (SELECT count(DISTINCT form) FROM sfv JOIN dg ON dg.norm = sfv.cf) AS surface_forms")
def sim_lemma_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequency = _frequency(spark, sf_dir)
    # the tokens' spelling is all that this needs of the misses: no n-gram or count is looked up
    return audit.lemma_expansion(audit.spelled(_missed(spark, sf_dir, frequency)), _surfaces(spark, sf_dir), _vocabulary(frequency))


def _unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _pick(word: Column, rows: Column) -> Column:
    """The row of embeddings that stands for a word."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("long") % rows


def _tier2(spark: SparkSession, sf_dir: str, diagnosed: DataFrame, grams: DataFrame, kind: str) -> DataFrame:
    """The mean of a candidate's parts' vectors against the target words."""
    rows = _unit_rows(spark, sf_dir)
    size = rows.agg(F.count("*")).scalar()
    words = _words(spark, sf_dir, "conversations", "role = 'assistant'")
    targets = settle(words.groupBy(_pick(F.col("word"), size).alias("k")).agg(F.min("word").alias("word")).join(rows, "k").select("word", unit(F.col("v")).alias("vec")))
    if kind == "morphemes":
        found = diagnosed.filter("morphemes_in").select(F.col("source_token").alias("name"), F.col("target_word").alias("expected"), morphemes(F.trim("source_token")).alias("parts"))
    else:
        found = diagnosed.filter("norm <> '' AND NOT norm_in AND overlap >= 0.5").select(F.col("source_token").alias("name"), F.col("target_word").alias("expected"), ngrams(F.col("norm"), 3, 6).alias("parts"))
    found = settle(found.withColumn("id", F.xxhash64("name")))
    parts = found.select("id", F.explode("parts").alias("part"))
    if kind == "subwords":
        parts = parts.join(grams.select(F.col("gram").alias("part")), "part", "left_semi")
    vectors = parts.select("id", _pick(F.col("part"), size).alias("k")).join(rows, "k").groupBy("id").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("v"))
    known = targets.select(F.xxhash64("word").alias("id"), "word", "vec")

    def near(queries: DataFrame) -> DataFrame:
        """Ten best by rounded score, then word: whoever ties with the tenth comes along first."""
        return nearest_named(queries, known, 10)

    return audit.tier2(found.select("id", "expected"), vectors.select("id", unit(F.col("v")).alias("vec")), targets.select("word"), near)


def _grams(frequency: DataFrame) -> DataFrame:
    return _vocabulary(frequency).select(F.explode(ngrams(F.col("word"), 3, 6)).alias("gram")).distinct()


@query(f"{TIER2_SQL} SELECT resolvable, tested, top1, top5, top10, skipped FROM sm WHERE kind = 'm'")
def sim_morpheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose morphemes are all known, by the mean of their vectors."""
    frequency = _frequency(spark, sf_dir)
    return _tier2(spark, sf_dir, settle(_diagnosed(spark, sf_dir, frequency)), _grams(frequency), "morphemes")


@query(f"{TIER2_SQL} SELECT resolvable, tested, top1, top5, top10, skipped FROM sm WHERE kind = 's'")
def sim_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that share half of their n-grams with the vocabulary, by the mean of the shared ones' vectors."""
    frequency = _frequency(spark, sf_dir)
    return _tier2(spark, sf_dir, settle(_diagnosed(spark, sf_dir, frequency)), _grams(frequency), "subwords")


@query(f"""{TIER2_SQL}, s AS (SELECT 1 AS o, 'ascii_normalize' AS intervention, count(*) FILTER (norm <> '' AND norm_in) AS n, 'exact' AS trust FROM dg UNION ALL SELECT 2, 'lower_min_count (t=1)', count(*) FILTER (NOT raw_in AND NOT norm_in AND (nr >= 1 OR nn >= 1)), 'exact' FROM dg UNION ALL
    SELECT 3, 'oracc_lemma_expansion', count(*) FILTER (surface_in), 'exact' FROM dg UNION ALL SELECT 4, 'morpheme_composition (Tier-2 top-5)', (SELECT top5 FROM sm WHERE kind = 'm'), 'inferred (compositional)' UNION ALL SELECT 5, 'subword_inference (Tier-2 top-5)', (SELECT top5 FROM sm WHERE kind = 's'), 'inferred (character n-gram)')
    SELECT CAST(row_number() OVER (ORDER BY n DESC, o) AS INT) AS rank, intervention, n, trust FROM s""")
def ranked_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequency = _frequency(spark, sf_dir)
    diagnosed, grams = settle(_diagnosed(spark, sf_dir, frequency)), _grams(frequency)
    scored = [_tier2(spark, sf_dir, diagnosed, grams, kind) for kind in ("morphemes", "subwords")]
    return audit.interventions(diagnosed, *scored)


@query(f"{AUDIT_SQL} SELECT count(*) AS n_anchors, count(*) FILTER (iv) AS n_in_vocabulary, count(*) FILTER (NOT iv) AS n_missing, round(100 * count(*) FILTER (iv) / count(*), 2) AS pct FROM fl")
def vocabulary_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchors that the vocabulary has and lacks."""
    return audit.partition(_anchors(spark, sf_dir), "source_token", _vocabulary(_frequency(spark, sf_dir)))


# --- passages --------------------------------------------------------------------------------------------------------

PASSAGE_SQL = f"""WITH q AS (SELECT DISTINCT string_split(text, ' ')[1] AS query FROM benchmark), qn AS (SELECT query, {norm_sql('query')} AS token FROM q),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
    tk AS (SELECT doc_id, no, {norm_sql('t')} AS token FROM (SELECT doc_id, no, unnest(regexp_split_to_array(line, '\\s+')) AS t FROM l)),
    hit AS (SELECT query, doc_id, min(no) AS no FROM tk JOIN qn USING (token) WHERE token <> '' GROUP BY 1, 2)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.get(F.split("text", " "), 0).alias("query")).distinct()


@query(f"""{PASSAGE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc_id) AS rank FROM hit)
    SELECT r.query, CAST(rank AS INT) AS rank, r.doc_id AS text_id, CAST(r.no AS INT) AS line_no, max(l.line) FILTER (l.no = r.no) AS line, string_agg(l.line, chr(10) ORDER BY l.no) AS context
    FROM r JOIN l ON l.doc_id = r.doc_id AND l.no BETWEEN r.no - 2 AND r.no + 2 WHERE rank <= 3 GROUP BY 1, 2, 3, 4""")
def passages_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.lines(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "text_id")
    return passages.find_passages(_queries(spark, sf_dir), lines)


@query(f"""WITH q AS (SELECT item_id, unnest(string_split(text, ' ')[1:3]) AS t FROM benchmark), qn AS (SELECT DISTINCT item_id, {norm_sql('t')} AS token FROM q),
    l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
    tk AS (SELECT DISTINCT doc_id, lang, no, {norm_sql('t')} AS token FROM (SELECT doc_id, lang, no, unnest(regexp_split_to_array(line, '\\s+')) AS t FROM l)),
    h AS (SELECT item_id, doc_id, no, count(*) * CASE WHEN lang = 'en' THEN 1.0 ELSE 0.5 END AS score FROM tk JOIN qn USING (token) WHERE token <> '' GROUP BY item_id, doc_id, no, lang)
    SELECT item_id AS query, CAST(rank AS INT) AS rank, doc_id AS text_id, CAST(no AS INT) AS line_no, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, no) AS rank FROM h) WHERE rank <= 3""")
def search_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with most of the benchmark items' first three words; lines of other than English documents count half."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.slice(F.split("text", " "), 1, 3)).alias("token"))
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return passages.search_passages(q, lines, F.col("lang") == "en")


@query(f"""{PASSAGE_SQL}, {CLEAN_SQL}, voc AS (SELECT word FROM (SELECT unnest(tokens) AS word FROM clean) GROUP BY word HAVING count(*) >= 5),
    cw AS (SELECT role, regexp_split_to_array(text, '\\s+') AS w FROM conversations), cc AS (SELECT DISTINCT string_split(text, ' ')[1] AS s, string_split(text, ' ')[2] AS t FROM benchmark),
    ga AS (SELECT DISTINCT lower(unnest(w)) AS word FROM cw WHERE role = 'assistant'), gu AS (SELECT DISTINCT lower(unnest(w)) AS word FROM cw WHERE role = 'user'),
    pr AS (SELECT role, lower(w[i]) AS t, w[i + 1] AS token, count(*) AS n FROM (SELECT role, w, unnest(range(1, len(w))) AS i FROM cw WHERE role IN ('assistant', 'user')) GROUP BY 1, 2, 3),
    nb AS (SELECT t, token FROM (SELECT *, row_number() OVER (PARTITION BY role, t ORDER BY n DESC, token) AS rn FROM pr) WHERE rn <= 5),
    dn AS (SELECT t, avg(CASE WHEN length(token) <= 2 THEN 1.0 ELSE 0.0 END) AS degenerate FROM nb GROUP BY t),
    ps AS (SELECT query AS s, count(*) AS n FROM (SELECT DISTINCT query, doc_id, no FROM tk JOIN qn USING (token) WHERE token <> '') GROUP BY query),
    x AS (SELECT cc.s, cc.t, cc.s IN (SELECT word FROM voc) AS known, lower(cc.t) IN (SELECT word FROM ga) AS ia, lower(cc.t) IN (SELECT word FROM gu) AS iu, coalesce(degenerate, 1) AS degenerate, coalesce(ps.n, 0) AS n FROM cc LEFT JOIN dn ON dn.t = lower(cc.t) LEFT JOIN ps ON ps.s = cc.s)
    SELECT s AS source_token, t AS target_word, known AS in_vocabulary, ia AS in_gemma, iu AS in_glove, n AS n_passages, round(CAST(degenerate AS DOUBLE), 3) AS degenerate,
        CASE WHEN known AND (ia OR iu) AND n > 0 THEN 'pass' ELSE 'fail' END AS status,
        concat_ws(';', CASE WHEN NOT known THEN 'sumerian_vocab_miss' END, CASE WHEN NOT ia AND NOT iu THEN 'english_missing_both_spaces' END, CASE WHEN n = 0 THEN 'zero_etcsl_passages' END) AS reasons,
        concat_ws(';', CASE WHEN degenerate > 0.5 THEN 'degenerate_top5' END, CASE WHEN NOT ia THEN 'english_missing_gemma' END, CASE WHEN NOT iu THEN 'english_missing_glove' END) AS warnings FROM x""")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20 over the benchmark's first two words: answers' and users' words as the two spaces, the five commonest followers as neighbours."""
    first = F.split("text", " ")
    concepts = table(spark, sf_dir, "benchmark").select(F.get(first, 0).alias("source_token"), F.get(first, 1).alias("target_word")).distinct()
    said = spread(table(spark, sf_dir, "conversations").filter("role IN ('assistant', 'user')").select("role", "text")).select("role", F.split("text", SPACE).alias("w"))
    turns = said.select("role", F.explode(runs(F.col("w"), 2)).alias("p")).select("role", F.lower(F.get("p", 0)).alias("t"), F.get("p", 1).alias("token"))
    wanted = turns.join(concepts.select(F.lower("target_word").alias("t")).distinct(), "t", "left_semi").groupBy("role", "t", "token").agg(F.count("*").alias("n"))
    five = wanted.groupBy("role", "t").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "token"))), 1, 5).alias("x"))
    near = concepts.select("target_word").distinct().join(five, F.lower("target_word") == F.col("t")).select("target_word", F.explode("x.token").alias("token"))
    lines = corpus.lines(table(spark, sf_dir, "documents"))
    tokens = lines.select("doc_id", "line_no", F.explode(F.array_distinct(F.transform(F.split("line", SPACE), normalize_token))).alias("token"))
    asked = concepts.select("source_token", normalize_token(F.col("source_token")).alias("token")).filter("token <> ''").distinct()
    found = tokens.join(asked, "token").select("source_token", "doc_id", "line_no").distinct()
    spaces = {"gemma": _words(spark, sf_dir, "conversations", "role = 'assistant'"), "glove": _words(spark, sf_dir, "conversations", "role = 'user'")}
    return passages.preflight(concepts, _vocabulary(_frequency(spark, sf_dir)), spaces, near, found)


# --- formats, over texts that Spark writes from the tables -----------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE lang = 'en')
    SELECT 'P' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS p_number, source AS designation, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) AS INT) AS line_no, trim(line) AS line FROM l WHERE trim(line) <> ''""")
def parse_atf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents are blocks in Sumerian; French ones end in another language, German ones only end in it."""
    docs = table(spark, sf_dir, "documents")
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    lang = lambda x: F.concat(F.lit("#atf: lang "), x)
    starts = lang(F.when(F.col("lang").isin("en", "fr"), "sux").otherwise("akk"))
    ends = lang(F.when(F.col("lang").isin("en", "de"), "sux").otherwise("akk"))
    head = F.concat(F.lit("&P"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(" = "), F.col("source"))
    text = F.concat_ws("\n", head, starts, F.lit("@tablet"), F.lit("$ broken"), numbered, F.lit("7'. this prime is dropped"), ends)
    return corpora.parse_atf(docs.select(F.col("doc_id").cast("string").alias("path"), text.alias("text"))).drop("path")


XML_SQL = """SELECT 'c.' || conv_id || '.' || turn AS line_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM conversations WHERE trim(text) <> ''"""


@query(XML_SQL)
def xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as lines of a TEI text."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = F.format_string('<l id="c.%d.%d" corresp="t.%d.%d">%s</l>', "conv_id", "turn", "conv_id", "turn", escaped)
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(one)), "\n").alias("body"))
    tei = F.concat(F.lit('<TEI.2 xmlns="x"><text><body>'), F.col("body"), F.lit("</body></text></TEI.2>"))
    return corpora.parse_tei_lines(files.select(F.col("conv_id").cast("string").alias("path"), tei.alias("text"))).select("line_id", "line")


@query("""SELECT 'c.' || u.conv_id || '.' || u.turn AS line_id, coalesce(a.text, s.text) AS translation FROM conversations u
    LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn - 1 AND s.role = 'system' WHERE u.role = 'user'""")
def match_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's line by the answer that corresponds to it, else by the system's line before it."""
    c = table(spark, sf_dir, "conversations")
    at = lambda prefix, turn: F.concat_ws(".", F.lit(prefix), "conv_id", turn)
    lines = c.filter("role = 'user'").select(at("c", F.col("turn")).alias("line_id"), at("t", F.col("turn") + 1).alias("corresp"))
    answers = c.filter("role = 'assistant'").select(at("t", F.col("turn")).alias("key"), F.col("text").alias("translation"))
    before = c.filter("role = 'system'").select(at("c", F.col("turn") + 1).alias("key"), F.col("text").alias("translation"))
    return corpora.match_translations(lines, answers.unionByName(before)).select("line_id", "translation")


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS line_no, array_to_string(regexp_split_to_array(trim(text), '\\s+'), ' ') AS line FROM conversations WHERE trim(text) <> ''""")
def oracc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a tree of lemmas, one line a turn."""
    return corpora.lemma_lines(corpora.parse_lemmas(_trees(spark, sf_dir), "conv_id", "raw"), "conv_id")


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, raw): each conversation as a lemma tree in JSON."""
    words = F.filter(F.split(F.trim("text"), SPACE), lambda w: w != "")
    lemma = lambda w: F.struct(F.struct(F.lit("sux-x-emesal").alias("lang"), w.alias("form"), F.lower(w).alias("cf"), F.lit("N").alias("pos")).alias("f"))
    node = F.struct(F.lit("line-start").alias("type"), F.array(F.struct(F.transform(words, lemma).alias("cdl"))).alias("cdl"))
    trees = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(node).alias("x")))).alias("t"))
    raw = F.concat(F.lit('{"cdl":['), F.array_join(F.transform("t", lambda s: s["x"]), ","), F.lit("]}"))
    return trees.select("conv_id", raw.alias("raw"))


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS INT) AS place, w AS form, lower(w) AS cf FROM (
    SELECT conv_id, turn, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT conv_id, turn, regexp_split_to_array(trim(text), '\\s+') AS w FROM conversations WHERE trim(text) <> ''))""")
def json_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lemmas of those trees, numbered in their order."""
    found = corpora.parse_lemmas(_trees(spark, sf_dir), "conv_id", "raw")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "pos", "form", "cf"))).alias("x")
    return found.groupBy("conv_id").agg(ordered).select("conv_id", F.posexplode("x").alias("p", "l")).select("conv_id", (F.col("p") + 1).alias("place"), "l.form", "l.cf")


@query("SELECT 'w' || vec_id AS token, CAST(len(embedding) AS INT) AS size, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def vectors_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as text lines and read back."""
    line = F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "))
    read = corpora.parse_vectors(table(spark, sf_dir, "embeddings").select(line.alias("value")), strict=64)
    return read.select("token", F.size("vec").alias("size"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


# --- streaming -------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a pattern, as a stream's plain path must be a folder, and a table may be one file
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query(f"WITH {CLEAN_SQL} SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM clean) GROUP BY token")
def streaming_token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "tokens")
    counts.run_available(counts.streaming_token_counts(corpus.lines(_stream(spark, sf_dir, "documents"))), out, f"{out}-state")
    return spark.read.parquet(out)


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def streaming_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that the watermark has passed by the end of what is there."""
    out = new_path(spark, "events")
    counts.append_available(counts.windowed_counts(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"), out, f"{out}-state")
    return spark.read.parquet(out)


@query(f"""WITH {TEXTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY p_number ORDER BY k DESC, doc_id) AS rn FROM texts)
    SELECT doc_id, p_number, CAST(k AS INT) AS n_lines FROM r WHERE p_number IS NULL OR rn = 1""")
def streaming_dedup_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 over a stream: state is two numbers a catalogue number, and the log of improvements is read as what it says last."""
    out = new_path(spark, "longest")
    number = F.when(F.col("source") != "src1", F.concat_ws("-", "source", "n_chars"))
    texts = _stream(spark, sf_dir, "documents").select("doc_id", number.alias("p_number"), F.size(F.split("text", "\n")).alias("n_lines"))
    longest.append_improvements(texts, out, f"{out}-state", "p_number", F.col("n_lines"), "doc_id")
    return longest.latest(spark.read.parquet(out), "p_number", F.col("n_lines"), "doc_id")
