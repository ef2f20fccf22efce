"""The registered queries of the training-data operators, with the columns of their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality_rules import PHRASES

WORD_BPE = "word_bpe_49k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge_documents

    return judge_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words", "removed_by"
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls, parse_rule

    given = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # a page's url ends in the number of its document, which may have been labelled
    number = F.regexp_extract("url", r"://[^/?#]*/[^/?#]*/(\d{1,18})", 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    of_page = pages.withColumn("doc_id", F.when(number != "", number.cast("long"))).filter("doc_id is not null")
    return judge_urls(pages, of_page.join(labels, "doc_id").select("url", "bad"), [parse_rule(*r) for r in given])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_classes

    return line_classes(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out
    from .lm_scoring import score_texts

    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.withColumn("learn", ~held_out(F.col("doc_id"), 7, 2)), "learn")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 3, 1)
    model = train(docs.filter(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", F.to_json("spans").alias("spans"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack, token_pieces

    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return pack(pieces)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    docs = table(spark, sf_dir, "documents").withColumns({"host": F.col("source"), "path": F.concat_ws("/", "source", "lang")})
    judged = classify(docs, table(spark, sf_dir, "labels"), ("quality", "toxic"))
    return judged.withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import fold, manifest, proof

    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(table(spark, sf_dir, "documents"), text).withColumn("folded_root", fold(F.col("claimed"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lz_fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, repaired

    return repaired(damaged(table(spark, sf_dir, "conversations")))


_ALL = (
    op1_quality_rules, op2_near_duplicates, op3_url_filters, op4_line_dedup, op5_lm_scoring, op6_language_id,
    op7_best_fit_packing, op8_benchmark_decontamination, op9_quality_classifier, op10_html_extraction,
    op11_merkle_manifest, op12_lz_fingerprint, op13_conversation_repair,
)
QUERIES = {f.__name__: f for f in _ALL}
SPLIT = r"'[^\x20\x09-\x0D]+'"
FURNITURE = "(?i)" + "|".join(p.replace("'", "''") for p in PHRASES)
MARKS = r"#*$%&|<>{}\\^~="


def _crc(s: str) -> str:
    """SQL for crc32 of an ASCII string, bit by bit."""
    eight = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({s}) + 1), lambda i: CAST(ascii(({s})[i]) AS BIGINT))), lambda c, b: {eight}), 4294967295)"


def _leaf(text: str) -> str:
    """SQL for a leaf of the manifest."""
    one = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(one)})"


ORACLES: dict[str, str] = {
    "op1_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, doc_id, text, regexp_extract_all(text, {SPLIT}) AS w FROM d),
        g AS (SELECT r, i, list_slice(w, i, i + 4) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5)),
        rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
        rw AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
        l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
        l1 AS (SELECT r, line, regexp_extract_all(line, {SPLIT}) AS w FROM l0),
        l2 AS (SELECT *, len(w) AS n FROM l1 WHERE len(w) > 0),
        l3 AS (SELECT r, line, n, CASE
            WHEN len(list_filter(w, lambda x: x IN ('|', '||', '»', '>', '>>', '/', '•', '·', '<', '›', '-', '::'))) > 0.2 * n THEN 'navigation'
            WHEN n <= 25 * len(regexp_extract_all(line, '{FURNITURE}')) THEN 'boilerplate'
            WHEN n > 3 AND len(list_filter(range(1, n), lambda i: w[i] = w[i + 1])) > 0.3 * n THEN 'boilerplate'
            WHEN len(list_filter(w, lambda x: regexp_matches(x, '[{MARKS}]{{2,}}|^[{MARKS}]+$|[A-Za-zÀ-ɏ][#$%*|<>{{}}]+$'))) > 0.3 * n THEN 'punctuation'
            WHEN n >= 6 AND length(line) - length(replace(line, '!', '')) + length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) > 20
                AND len(list_filter(w, lambda x: length(x) > 1 AND regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) > 0.6 * n THEN 'punctuation'
            WHEN n >= 60 AND NOT regexp_matches(line, '[.!?…。！？؟।;:]') THEN 'punctuation' END AS fault FROM l2),
        f AS (SELECT r, fault, count(*) AS k FROM l3 WHERE fault IS NOT NULL GROUP BY r, fault),
        fs AS (SELECT r, string_agg(fault || ':' || k, ',' ORDER BY fault) AS removed_by FROM f GROUP BY r),
        ls AS (SELECT r, count(*) - count(DISTINCT line) AS dup, count(fault) AS lost_lines, coalesce(sum(n) FILTER (fault IS NOT NULL), 0) AS lost FROM l3 GROUP BY r),
        t AS (SELECT w.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(dup, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, coalesce(lost_lines, 0) AS n_removed_lines, coalesce(lost, 0) AS n_removed_words, removed_by
            FROM w LEFT JOIN rw ON rw.r = w.r LEFT JOIN ls ON ls.r = w.r LEFT JOIN fs ON fs.r = w.r)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words,
            n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_removed_words <= 0.5 * n_words AS kept, n_removed_lines, CAST(n_removed_words AS BIGINT) AS n_removed_words, removed_by FROM t""",
    "op2_near_duplicates": rf"""
        WITH RECURSIVE t AS (SELECT min(doc_id) AS rep, text FROM documents WHERE text IS NOT NULL GROUP BY text),
        w AS (SELECT rep, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {SPLIT}) AS w FROM t),
        g AS (SELECT DISTINCT rep, w[i : i + least(len(w), 5) - 1] AS sh FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        s AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
        p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS k FROM g x JOIN g y ON x.sh = y.sh AND x.rep < y.rep GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN s x ON x.rep = a JOIN s y ON y.rep = b WHERE k / (x.n + y.n - k) >= 0.8),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT rep AS id, rep AS node FROM t UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.node),
        c AS (SELECT id, min(node) AS cls FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(c.cls, d.doc_id) AS class_id FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN c ON c.id = t.rep""",
    "op8_benchmark_decontamination": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r,
                   coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
            FROM documents),
        b AS (
            SELECT CAST(item_id AS VARCHAR) AS item,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE text IS NOT NULL),
        bw AS (
            SELECT DISTINCT item, m, array_to_string(w[s : s + m - 1], ' ') AS win
            FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT m FROM bw),
        starts AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, lengths WHERE len(w) >= m),
        dw AS (SELECT r, m, s, array_to_string(w[s : s + m - 1], ' ') AS win FROM starts),
        hit AS (SELECT DISTINCT r, m, s, item FROM dw JOIN bw USING (m, win)),
        cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM hit) GROUP BY r),
        of AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN cover USING (r) LEFT JOIN of USING (r)""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT *, coalesce('1' || source, '0') AS g,
                   CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
        l0 AS (SELECT doc_id, g, {_leaf('text')} AS leaf, {_leaf('changed')} AS claimed FROM d),
        l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l0),
        t AS (SELECT g, pos, n, 0 AS level, leaf AS h FROM l
              UNION ALL SELECT g, pos // 3, any_value((n + 2) // 3), any_value(level + 1), sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, pos // 3),
        s0 AS (SELECT g, h AS subroot, level AS height FROM t WHERE n = 1),
        s AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM s0),
        u AS (SELECT pos, n, 0 AS level, subroot AS h FROM s
              UNION ALL SELECT pos // 3, any_value((n + 2) // 3), any_value(level + 1), sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY pos // 3),
        a AS (SELECT l.g, l.pos, k AS level, l.pos // CAST(pow(3, k) AS BIGINT) AS spot FROM l JOIN s USING (g), range(height) h(k)),
        b AS (SELECT s.g, height + k AS level, k, s.pos // CAST(pow(3, k) AS BIGINT) AS spot FROM s, range((SELECT max(level) FROM u)) h(k)),
        p AS (SELECT a.g, a.pos, a.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos < spot), '') AS before, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos > spot), '') AS after
              FROM a JOIN t ON t.g = a.g AND t.level = a.level AND t.pos // 3 = a.spot // 3 GROUP BY 1, 2, 3),
        q AS (SELECT b.g, b.level, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos < spot), '') AS before, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos > spot), '') AS after
              FROM b JOIN u ON u.level = b.k AND u.pos // 3 = b.spot // 3 GROUP BY 1, 2),
        w AS (SELECT g, pos, level, before, after FROM p UNION ALL SELECT l.g, l.pos, q.level, before, after FROM l JOIN q USING (g)),
        f AS (SELECT g, pos, 0 AS level, claimed AS h FROM l
              UNION ALL SELECT f.g, f.pos, f.level + 1, sha256(before || h || after) FROM f JOIN w ON w.g = f.g AND w.pos = f.pos AND w.level = f.level),
        e AS (SELECT g, pos, arg_max(h, level) AS folded_root FROM f GROUP BY 1, 2),
        pr AS (SELECT g, pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM w GROUP BY 1, 2),
        r AS (SELECT h AS root FROM u WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM l JOIN s USING (g) JOIN e ON e.g = l.g AND e.pos = l.pos LEFT JOIN pr ON pr.g = l.g AND pr.pos = l.pos, r""",
    "op13_conversation_repair": rf"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
        k AS (SELECT *, {_crc('s')} % 20 AS kind FROM c),
        d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM k),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
        m AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
                     NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, left(role, 1) AS x, left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS pair FROM o),
        f AS (SELECT *, CASE WHEN blank OR again THEN 2 WHEN cut THEN 1 ELSE 0 END AS fault FROM m),
        st AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
                      count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        nx(q, y, z) AS (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        ins(q, z, c, i) AS (SELECT q, q, 0, '' FROM nx UNION ALL SELECT q, z, 3, 'I' FROM nx UNION ALL SELECT a.q, b.z, 6, 'II' FROM nx a JOIN nx b ON b.q = a.z),
        b AS (
            SELECT conv_id, CAST(1 AS BIGINT) AS pos, 0 AS q, 0 AS cost, '' AS audit FROM st
            UNION ALL
            SELECT conv_id, pos + 1, to_q, min(ROW(c2, a2))[1], min(ROW(c2, a2))[2] FROM (
                SELECT b.conv_id, b.pos, e.t AS to_q, b.cost + ins.c + e.c AS c2, b.audit || ins.i || e.l AS a2
                FROM b JOIN ins ON ins.q = b.q JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos JOIN nx ON nx.q = ins.z,
                LATERAL (SELECT 'D' AS l, 4 AS c, nx.q AS t
                    UNION ALL SELECT 'K', 3 * fault, CASE WHEN x = nx.y THEN nx.z ELSE 1 END WHERE fault < 2 AND (x = nx.y OR x = 's' AND nx.q = 0)
                    UNION ALL SELECT 'R', 3 + 3 * fault, nx.z WHERE fault < 2) e)
            GROUP BY conv_id, pos, to_q),
        best AS (SELECT b.conv_id, min(ROW(b.cost + ins.c, b.audit || ins.i)) AS w FROM b JOIN ins ON ins.q = b.q JOIN st ON st.conv_id IS NOT DISTINCT FROM b.conv_id AND b.pos = st.n + 1 WHERE ins.z IN (0, 3) GROUP BY b.conv_id),
        a AS (SELECT conv_id, w[1] AS cost, w[2] AS audit FROM best),
        e AS (SELECT conv_id, audit, i, audit[i] AS l, length(replace(audit[1:i], 'I', '')) AS row FROM a, range(1, 1000000) r(i) WHERE i <= length(audit)),
        y AS (SELECT e.conv_id, i, l, role, text, count(*) FILTER (l <> 'D' AND NOT (l = 'K' AND f.x = 's')) OVER (PARTITION BY e.conv_id ORDER BY i) % 2 AS odd
              FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.row AND l <> 'I'),
        z AS (SELECT conv_id, string_agg(CASE l WHEN 'K' THEN role ELSE CASE odd WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE l WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS whole FROM y WHERE l <> 'D' GROUP BY conv_id)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM i.conv_id""",
}
