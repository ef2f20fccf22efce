"""Text, corpus and anchor queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import anchors, claims, corpus
from .registry import query, table

NORM_SQL = r"coalesce(trim(replace(translate(replace(lower(regexp_replace(translate({x},'₀₁₂₃₄₅₆₇₈₉','0123456789'),'\{{([^}}]*)\}}','\1','g')),'š','sz'),'ŋḫṣṭʾ','jhst'),'-','')),'')"


def norm_sql(x: str) -> str:
    return NORM_SQL.format(x=x)


def _replace_chain(x: str) -> str:
    x = f"CASE WHEN starts_with({x}, '$') THEN '' ELSE {x} END"
    paren = (r"(^|[^0-9])\(([^)]*)\)", r"\1\2")
    for what, by in (
        (r"!\([^)]*\)", ""), (r"[\[\]]", ""), (r"<([^>]*)>", r"\1"), (r"\|[^|]*\|", ""), (r"\|[A-Z0-9.x+]+", ""), (r"[A-Z0-9.x+]+\|", ""),
        (r"_[^_\s]*_", ""), paren, paren, (r"[#?!]", ""), (r"\{([^}]*)\}", r" \1 "),
    ):
        x = f"regexp_replace({x}, '{what}', '{by}', 'g')"
    return x


LINES_SQL = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
# a dot between its neighbours a and b stays if a ends or b begins with a digit
CLEAN_SQL = (
    f"{LINES_SQL}, marked AS (SELECT doc_id, line_no, {_replace_chain('line')} AS x FROM lines), "
    r"spread AS (SELECT doc_id, line_no, array_to_string(flatten(list_transform(regexp_split_to_array(x, '\s+'), lambda t: CASE WHEN contains(t, '-') THEN list_concat([replace(t, '-', '')], string_split(t, '-')) ELSE [t] END)), ' ') AS x FROM marked), "
    "dotless AS (SELECT doc_id, line_no, list_reduce(string_split(x, '.'), lambda a, b: a || CASE WHEN regexp_matches(right(a, 1), '[0-9]') OR regexp_matches(left(b, 1), '[0-9]') THEN '.' ELSE ' ' END || b) AS x FROM spread), "
    r"clean AS MATERIALIZED (SELECT doc_id, line_no, list_filter(regexp_split_to_array(lower(translate(x, '₀₁₂₃₄₅₆₇₈₉', '0123456789')), '\s+'), "
    r"lambda t: NOT (t = '' OR regexp_matches(t, '^[$%&+'']') OR (length(t) = 1 AND NOT regexp_matches(t, '^\p{L}$')))) AS tokens FROM dotless)"
)


@query(f"""WITH t AS (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS raw FROM documents)
    SELECT {norm_sql('raw')} AS token, count(*) AS n FROM t WHERE {norm_sql('raw')} <> '' GROUP BY 1""")
def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select(F.explode(F.split("text", X.SPACE)).alias("raw"))
    return raw.select(X.normalize_token(F.col("raw")).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {CLEAN_SQL} SELECT doc_id, CAST(line_no AS INT) AS line_no, array_to_string(tokens, ' ') AS cleaned FROM clean WHERE len(tokens) > 0")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "line_no", X.clean_line(F.col("line")).alias("cleaned")).filter("cleaned <> ''")


@query(f"WITH {CLEAN_SQL} SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM clean) GROUP BY token")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.token_frequency(corpus.lines(table(spark, sf_dir, "documents")))


@query(f"""WITH {CLEAN_SQL} SELECT count(*) AS n_lines, count(*) FILTER (len(tokens) > 0) AS n_clean_lines, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens,
    (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM clean)) AS n_distinct FROM clean""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_stats(corpus.lines(table(spark, sf_dir, "documents")))


@query(f"""WITH {CLEAN_SQL}, t AS (SELECT doc_id, string_agg(array_to_string(tokens, ' '), ' ' ORDER BY line_no) FILTER (len(tokens) > 0) AS text FROM clean GROUP BY doc_id)
    SELECT doc_id, text FROM t WHERE text IS NOT NULL""")
def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.clean_corpus(table(spark, sf_dir, "documents"), "doc_id", F.split("text", "\n"))


TEXTS_SQL = "texts AS (SELECT doc_id, CASE WHEN source = 'src1' THEN NULL ELSE source || '-' || n_chars END AS p_number, len(string_split(text, chr(10))) AS k FROM documents)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a catalogue number, which some lack and others share."""
    number = F.when(F.col("source") != "src1", F.concat_ws("-", "source", "n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", number.alias("p_number"), F.split("text", "\n").alias("lines"))


@query(f"""WITH {TEXTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY p_number ORDER BY k DESC, doc_id) AS rn FROM texts)
    SELECT doc_id, p_number, CAST(k AS INT) AS n_lines FROM r WHERE p_number IS NULL OR rn = 1""")
def dedup_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = corpus.keep_longest(_texts(spark, sf_dir), "p_number", F.size("lines"), "doc_id")
    return kept.select("doc_id", "p_number", F.size("lines").alias("n_lines"))


@query(f"""WITH {TEXTS_SQL}, s AS (SELECT count(*) AS n_in, count(*) FILTER (p_number IS NULL) AS n_no_key, count(DISTINCT p_number) AS n_unique FROM texts)
    SELECT n_in, n_no_key, n_unique, n_no_key + n_unique AS n_out, n_in - n_no_key - n_unique AS n_removed FROM s""")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dedup_stats(_texts(spark, sf_dir), "p_number")


@query("""SELECT 'c.' || conv_id AS composition, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) FILTER (role = 'assistant') AS n_translations
    FROM conversations GROUP BY conv_id""")
def composition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    lines = c.select(F.format_string("c.%d.%d", "conv_id", "turn").alias("line_id"), "turn", "text", F.when(F.col("role") == "assistant", F.col("text")).alias("translation"))
    return corpus.compositions(lines, "line_id", "turn", "text", "translation")


@query("""SELECT source, count(*) AS n_texts, CAST(sum(k) AS BIGINT) AS n_lines FROM (
    SELECT 'DOCUMENTS' AS source, len(string_split(text, chr(10))) AS k FROM documents UNION ALL
    SELECT 'BENCHMARK', len(string_split(text, chr(10))) FROM benchmark UNION ALL
    SELECT 'CONVERSATIONS', len(string_split(text, chr(10))) FROM conversations) GROUP BY source""")
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t.upper()).alias("source"), F.split("text", "\n").alias("lines")) for t in ("documents", "benchmark", "conversations")]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.size("lines")).alias("n_lines"))


DICT_SQL = """lemma AS (SELECT 'u' || user_id AS cf, 'k' || CAST(json_extract(props, '$.k') AS VARCHAR) AS form, event_type AS gw FROM events),
    dict AS (SELECT source_token, target_word, count(*) AS frequency FROM (
        SELECT unnest(CASE WHEN cf = form THEN [cf] ELSE [cf, form] END) AS source_token, gw AS target_word FROM lemma) GROUP BY 1, 2 HAVING count(*) >= 10),
    dict_a AS (SELECT *, round(least(0.95, 0.5 + frequency / 100), 4) AS confidence, 'DICT' AS provenance FROM dict)"""
STOP_SQL = (
    "'the','of','and','in','to','a','is','was','for','on','with','his','her','its','their','he','she','it','they','that','this','by','from','at','an','be','has','had','not','but','who','which','as','or','if','my','your'"
)
COOC_SQL = f"""par AS (SELECT row_number() OVER () AS r, u.text AS s, a.text AS t FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant' WHERE a.text <> ''),
    sw AS (SELECT DISTINCT r, unnest(regexp_extract_all(lower(s), '([a-zA-ZšŠḫḪṭṬṣṢĝĜ]+\\d*)', 1)) AS w FROM par),
    tw AS (SELECT DISTINCT r, w FROM (SELECT r, unnest(regexp_extract_all(lower(t), '([a-z]+)', 1)) AS w FROM par) WHERE w NOT IN ({STOP_SQL})),
    tot AS (SELECT w, count(*) AS total FROM sw GROUP BY w HAVING count(*) >= 3),
    cnt AS (SELECT sw.w AS s, tw.w AS t, any_value(total) AS total, count(*) AS n FROM sw JOIN tot ON tot.w = sw.w JOIN tw ON tw.r = sw.r GROUP BY 1, 2),
    cooc_a AS (SELECT s AS source_token, t AS target_word, total AS frequency, round(n / total, 4) AS confidence, 'COOC' AS provenance FROM (
        SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, t) AS rn FROM cnt) WHERE rn = 1 AND n / total >= 0.3)"""


def _lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("cf"), F.concat(F.lit("k"), k).alias("form"), F.col("event_type").alias("gw"))


def parallel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the answer that follows it."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("transliteration"))
    return u.join(c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("translation")), ["conv_id", "turn"])


@query(f"WITH {DICT_SQL} SELECT * FROM dict_a")
def dict_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.dictionary_anchors(_lemmas(spark, sf_dir), 10)


@query(f"WITH {COOC_SQL} SELECT * FROM cooc_a")
def cooc_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.cooccurrence_anchors(parallel_lines(spark, sf_dir))


@query(f"""WITH {DICT_SQL}, {COOC_SQL}, a AS (SELECT *, 0 AS o FROM dict_a UNION ALL SELECT *, 1 FROM cooc_a)
    SELECT source_token, target_word, frequency, confidence, provenance FROM (
        SELECT *, row_number() OVER (PARTITION BY source_token ORDER BY confidence DESC, o, target_word) AS rn FROM a) WHERE rn = 1""")
def merged_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.merge_anchors(anchors.dictionary_anchors(_lemmas(spark, sf_dir), 10), anchors.cooccurrence_anchors(parallel_lines(spark, sf_dir)))


JUNK_SQL = "'x','xx','0','00','1','n','c','e','i','u','s','unmng','cf'"


@query(f"""WITH w AS (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS gloss FROM conversations)
    SELECT lower(trim(gloss)) IN ({JUNK_SQL}) OR length(lower(trim(gloss))) <= 2 OR regexp_matches(lower(trim(gloss)), '^\\p{{Nd}}+$') OR starts_with(lower(trim(gloss)), '~') AS junk,
        count(*) AS n, count(DISTINCT gloss) AS n_distinct FROM w GROUP BY 1""")
def junk_gloss_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", X.SPACE)).alias("gloss"))
    return words.groupBy(X.is_junk_gloss(F.col("gloss")).alias("junk")).agg(F.count("*").alias("n"), F.count_distinct("gloss").alias("n_distinct"))


@query("""WITH w AS (SELECT DISTINCT lower(unnest(regexp_split_to_array(text, '\\s+'))) AS word FROM benchmark),
    g AS (SELECT DISTINCT word, unnest(flatten(list_transform(list_filter([3, 4, 5, 6], lambda n: n <= length(word) + 2), lambda n: list_transform(range(1, length(word) + 4 - n), lambda i: substring('<' || word || '>', i, n))))) AS gram FROM w)
    SELECT gram, count(*) AS n_words FROM g GROUP BY gram""")
def ngram_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), X.SPACE)).alias("word")).distinct()
    return words.select(F.explode(X.ngrams(F.col("word"), 3, 6)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n_words"))


def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line): each event as a sentence that claims two numbers."""
    claim = lambda by: F.format_string("%.4f", ((F.col("event_id") * by) % 30001 - 15000) / 10000)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", F.concat(F.lit("  Event "), "event_id", F.lit(" of "), "event_type", F.lit(" scored "), claim(37), F.lit(" against "), claim(91), F.lit(".")).alias("line"))


SCORES_SQL = """score_lines AS (SELECT user_id AS doc_id, event_id, '  Event ' || event_id || ' of ' || event_type || ' scored ' || printf('%.4f', ((event_id * 37) % 30001 - 15000) / 10000.0) || ' against ' || printf('%.4f', ((event_id * 91) % 30001 - 15000) / 10000.0) || '.' AS line FROM events)"""
CLAIMS_SQL = f"""{SCORES_SQL}, claims AS (SELECT doc_id, event_id, CAST(claim AS DOUBLE) AS value, context FROM (
    SELECT doc_id, event_id, unnest(regexp_extract_all(line, '-?\\d+\\.\\d{{1,4}}')) AS claim, substring(trim(line), 1, 120) AS context FROM score_lines) WHERE CAST(claim AS DOUBLE) BETWEEN -1 AND 1)"""


@query(f"WITH {CLAIMS_SQL} SELECT doc_id, event_id, value, context, count(*) AS n FROM claims GROUP BY ALL")
def numeric_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18."""
    return claims.numeric_claims(score_lines(spark, sf_dir)).groupBy("doc_id", "event_id", "value", "context").agg(F.count("*").alias("n"))


@query(f"""WITH {CLAIMS_SQL}, metrics AS (SELECT DISTINCT round(CAST(x AS DOUBLE), 6) AS value FROM (SELECT unnest(embedding) AS x FROM embeddings))
    SELECT supported, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT value, EXISTS (SELECT 1 FROM metrics m WHERE abs(m.value - c.value) <= 0.001) AS supported FROM claims c) GROUP BY supported""")
def claims_in_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: claims that some metric supports, and those that none does."""
    metrics = table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("x")).select(F.round(F.col("x").cast("double"), 6).alias("value")).distinct()
    found = claims.supported(claims.numeric_claims(score_lines(spark, sf_dir)), metrics)
    return found.groupBy("supported").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query("""WITH d AS (SELECT doc_id, text, strpos(text, chr(10)) AS cut FROM documents), a AS (SELECT doc_id, CASE WHEN cut > 0 THEN substring(text, 1, cut - 1) ELSE text END AS body, CASE WHEN cut > 0 THEN substring(text, cut + 1) ELSE '' END AS appendix FROM d),
    c AS (SELECT DISTINCT doc_id, appendix, unnest(regexp_extract_all(body, '[\\x{C0}-\\x{17F}]')) AS ch FROM a)
    SELECT ch AS codepoint, count(*) FILTER (contains(appendix, ch)) AS n_covered, count(*) FILTER (NOT contains(appendix, ch)) AS n_missing FROM c GROUP BY ch""")
def provenance_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of a document's first line that the rest, as its appendix, has or lacks."""
    text = F.col("text")
    marked = F.concat(F.substring_index(text, "\n", 1), F.lit("\n## Appendix: sign provenance\n"), F.when(text.contains("\n"), F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(""))
    found = claims.provenance(table(spark, sf_dir, "documents").select("doc_id", marked.alias("text")), "doc_id", "text", r"[\x{C0}-\x{17F}]")
    return found.groupBy("codepoint").agg(F.count_if("covered").alias("n_covered"), F.count_if(~F.col("covered")).alias("n_missing"))


@query("""SELECT lang, ch AS codepoint, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(text, '[\\x{C0}-\\x{17F}]')) AS ch FROM documents) GROUP BY 1, 2""")
def codepoint_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19, over the range that these corpora use."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\x{C0}-\x{17F}])"), 1))).alias("codepoint"))
    return found.groupBy("lang", "codepoint").agg(F.count("*").alias("n_docs"))
