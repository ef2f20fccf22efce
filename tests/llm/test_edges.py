"""Every operator over empty tables, nulls in every column, empty and very long texts, repeats, ties and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexmesh.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} and{i % 31}," for i in range(40_000)) + "."
PROSE = "The cat sat on the mat and looked at the moon. It was a clear night, and all was well in the old town."
PAGE = "<html><body><nav>Menu</nav><article><h1>Title</h1><p>Body &amp; soul</p></article><footer>Foot</footer></body></html>"
#: Columns that operators use inside.
CLASH = ("id", "key", "th", "bits", "w", "cls", "grp", "block", "train", "host", "path", "kept", "score", "spans", "features", "label", "line", "bad", "a", "b")


def write(spark, folder, docs, bench, labels, pages, conversations):
    extra = [F.lit("z").alias(c) for c in CLASH]
    for name, rows, schema in (
        ("documents", docs, DOCS), ("benchmark", bench, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int"), ("pages", pages, "page_id long, url string, html string"), ("conversations", conversations, "conv_id long, turn long, role string, text string"),
    ):
        spark.createDataFrame(rows, schema).select("*", *extra).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [], [])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    docs = [(i, f"{PROSE} Number {i}.\n{PROSE}", "en", "s", 9) for i in range(4)] + [
        (10, None, "en", "s", None), (11, "", "fr", None, 0), (12, "  \n\t ", None, "s", 3), (None, PROSE, "en", "s", 1), (None, None, None, None, None),
        (13, LONG, "en", "s", len(LONG)), (14, PROSE, "en", "s", 5), (14, PROSE, "en", "s", 5), (15, "...", "en", "s", 3), (16, "Ünïcödé ßtraße 漢字 😀 \x00 <|endoftext|>", "de", "s", 9),
    ]
    bench = [(1, "looked at the moon. It was a clear night, and all"), (2, "old town"), (3, None), (4, ""), (None, "clear night"), (2, "old town")]
    labels = [(0, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, None), (None, 1, 0), (14, 1, 0), (999, 0, 1)]
    pages = [(1, "http://a.com/en/1", PAGE), (2, None, PAGE), (3, "nonsense", None), (None, "HTTP://Shop.COM/en/", ""), (5, "http://a.com/en/2", "<p>broken <b>mark"), (5, "http://a.com/en/2", "<p>broken <b>mark"), (6, "http://b.net/de/3", "x" * 300_000)]
    talks = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, None, None), (None, 2, "assistant", ""), (2, 1, "system", LONG), (3, 1, "tool", "x")]
    return write(spark, tmp_path_factory.mktemp("odd"), docs, bench, labels, pages, talks)


ROWS = {"op3_url_filters": 7, "op10_html_extraction": 7, "op4_line_dedup": None, "op7_best_fit_packing": None, "op13_conversation_repair": 4}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows_give_one_result_each(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    want = ROWS.get(name, 14)
    assert want is None or len(rows) == want


def test_defined_results(spark, odd):
    by = lambda name, *cols: [tuple(r) for r in QUERIES[name](spark, odd).filter("doc_id IS NOT NULL").select("doc_id", *cols).orderBy("doc_id").collect()]
    op1 = dict((r[0], r[1:]) for r in by("op1_quality_rules", "n_words", "base_failed", "kept"))
    assert op1[10] == op1[11] == op1[12] == (0, True, False) and op1[14] == (len(PROSE.split()), False, True) and op1[13][0] == 80_000
    op2 = dict(by("op2_near_duplicates", "class_id"))
    assert op2[10] == 10 and op2[14] == 14 and op2[11] == 11
    op6 = dict(by("op6_language_id", "lang_pred"))
    assert {op6[i] for i in (10, 11, 12, 15)} == {"und"}
    op8 = dict((r[0], r[1:]) for r in by("op8_benchmark_decontamination", "n_words", "n_hit", "n_items", "items_sha256"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert op8[10] == (0, 0, 0, sha("")) and op8[14][0] == len(PROSE.split()) and op8[14][2:] == (3, sha(",1,2")) and op8[14][1] == 13
    pages = {(r.page_id, r.url): r.text for r in QUERIES["op10_html_extraction"](spark, odd).collect()}
    assert pages[(1, "http://a.com/en/1")] == pages[(2, None)] == "Title Body & soul" and pages[(3, "nonsense")] == "" and pages[(5, "http://a.com/en/2")] == "broken mark"
    op3 = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op3_url_filters"](spark, odd).collect()}
    assert op3[1][:3] == ("a.com", "/en/1", "com/en/") and op3[None][:3] == ("shop.com", "/en/", "com/en/") and op3[2][:3] == op3[3][:3] == ("", "", None)


def test_line_classes_count_occurrences(spark, odd):
    rows = QUERIES["op4_line_dedup"](spark, odd).collect()
    same = [r for r in rows if r.class_size == 7]  # the second line of four documents, and the three that are nothing else
    assert len(same) == 7 and sum(not r.removed for r in same) == 1
    near = [r for r in rows if r.n_links == 3]
    assert len(near) == 4 and {r.first_doc_id for r in near} == {0}


def test_url_rules_have_the_verdicts_of_their_contract(spark, tmp_path):
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://m.example.com/en/7": ("example.com/en/7", "allow"), "http://b.net/de/3": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://x.example.net/de/81": ("example.net/de/8", "block"), "http://c.org/es/": ("org/es/", "block"),
    }
    sf = write(spark, tmp_path, [], [], [], [(i, u, "") for i, u in enumerate(want)], [])
    assert [(r.rule, r.verdict) for r in QUERIES["op3_url_filters"](spark, sf).orderBy("page_id").collect()] == list(want.values())
