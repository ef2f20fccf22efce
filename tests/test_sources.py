import json

import pytest

from lexmesh.sources import corpora, sinks


def texts(spark, *t):
    return spark.createDataFrame([(str(i), x) for i, x in enumerate(t)], "path string, text string")


ATF = """stray
&P000001 = First
#atf: lang sux
@tablet
1. lugal kur
2'. dropped
3' kept
&P000002 = Second
#atf: lang akk
1. not here
#atf: lang sux
2. late line
&P000003 = Third
#atf: lang sux
1. lost at the end
#atf: lang akk
& malformed
1. nobody's
&P000004 = Fourth
#atf: lang sux
$ blank
"""


def test_atf_blocks(spark):
    got = [tuple(r) for r in corpora.parse_atf(texts(spark, ATF)).select("p_number", "line_no", "line").orderBy("p_number", "line_no").collect()]
    assert got == [("P000001", 1, "lugal kur"), ("P000001", 2, "kept"), ("P000002", 1, "late line")]


def test_tei_and_translations(spark):
    tei = '<TEI.2 xmlns="x"><l id="c.1.1" corresp="t.1.1"><w form="lugal" lemma="l"/><w form="X"/><w form="&aleph;e2"/></l><l id="c.1.2">plain  &amp; text</l><l>no id</l><l id="c.1.3"></l>'
    got = [tuple(r) for r in corpora.parse_tei_lines(texts(spark, tei)).select("line_id", "corresp", "line").orderBy("line_id").collect()]
    assert got == [("c.1.1", "t.1.1", "lugal _aleph_e2"), ("c.1.2", None, "plain & text")]
    tr = corpora.parse_translations(texts(spark, '<p id="t.1.1" corresp="c.9">The king</p><p id="t.1.1">A king</p>'))
    assert {r.key: r.translation for r in tr.collect()} == {"c.9": "The king", "t.1.1": "A king"}
    lines = corpora.parse_tei_lines(texts(spark, tei))
    assert {r.line_id: r.translation for r in corpora.match_translations(lines, tr).collect()} == {"c.1.1": "A king", "c.1.2": None}


def test_lemma_tree(spark):
    f = lambda form, lang="sux": {"f": {"form": form, "lang": lang, "cf": form}}
    tree = {"cdl": [{"type": "line-start"}, {"cdl": [{"cdl": [f("a"), f("skip", "akk")]}, f("b")]}, {"ftype": "line-start"}, {"ftype": "line-start"}, f("c"), f("")]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, "no json"), (3, None)], "id long, raw string")
    lemmas = corpora.parse_lemmas(df, "id", "raw")
    assert [(r.line_no, r.pos, r.form) for r in lemmas.orderBy("pos").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 2, "c")]
    assert [(r.line_no, r.line) for r in corpora.lemma_lines(lemmas, "id").orderBy("line_no").collect()] == [(0, "a b"), (1, "c")]


def test_vectors_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("king 1 2.5",), ("x 0 1",)], "value string")
    assert {r.token: r.vec for r in corpora.parse_vectors(df, strict=2).collect()} == {"king": [1.0, 2.5], "x": [0.0, 1.0]}
    sinks.write_corpus(spark.createDataFrame([("a b",)], "text string"), str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["a b"]
    h = spark.createDataFrame([(0, 2), (1, 4), (2, 0)], "bin int, n long")
    assert [len(r.bar) for r in sinks.bars(h).orderBy("bin").collect()] == [20, 40, 0]
    assert sinks.markdown(spark.createDataFrame([("a|b", 0.5)], "k string, v double")).endswith("| a\\|b | 0.5000 |")
    (tmp_path / "a.json").write_text(json.dumps([{"sumerian": "a", "english": "b", "confidence": 0.5}, {"sumerian": "a"}]))
    assert corpora.read_anchors(spark, str(tmp_path / "a.json")).count() == 1


def test_zip_members_and_reports(spark, tmp_path):
    import zipfile

    from lexmesh.plans.jobs import run_audit

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/corpusjson/P1.json", '{"cdl":[]}')
        z.writestr("x/readme.txt", "no")
    (tmp_path / "b.zip").write_text("no archive")
    got = corpora.read_zip_members(spark, str(tmp_path / "*.zip"), r"corpusjson/.*\.json$").collect()
    assert [(r.member, r.text) for r in got] == [("x/corpusjson/P1.json", '{"cdl":[]}')]
    texts, lemmas = corpora.read_projects(spark, str(tmp_path / "*.zip"))
    assert texts.count() == lemmas.count() == 0
    made = run_audit(spark, "/root/testdata/sf0.001", str(tmp_path / "out"))
    assert made["anchor_audit_buckets"].count() == 9 and spark.read.json(str(tmp_path / "out/metadata")).count() == 1


def test_projects_words_and_contracts(spark, tmp_path):
    import zipfile

    leaf = lambda form: {"f": {"lang": "sux", "form": form, "cf": form, "gw": "x", "pos": "N"}}
    tree = {"cdl": [{"type": "line-start"}, leaf("a"), leaf("b"), {"ftype": "line-start", "cdl": [leaf("c")]}]}
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("p/corpusjson/P0001.json", json.dumps(tree))
        z.writestr("p/corpusjson/P0002.json", "{broken")
    texts, lemmas = corpora.read_projects(spark, str(tmp_path / "*.zip"))
    assert [(r.p_number, r.lines) for r in texts.collect()] == [("P0001", ["a b", "c"])] and lemmas.count() == 3
    lines = spark.createDataFrame([(1, "king 1 2"), (2, "Lugal 0 1"), (3, "x 1")], "line_no int, value string")
    assert [r.token for r in corpora.vector_words(lines).collect()] == ["king", "Lugal", "x"]
    for n, what in ((2, "line 3: 1 values"), (1, "line 1: 2 values")):
        with pytest.raises(ValueError, match=what):
            corpora.check_vectors(lines, n)
    with pytest.raises(ValueError, match="line 2: 'Lugal'"):
        corpora.check_vectors(lines.filter("line_no < 3"), 2)
    corpora.check_vectors(lines.filter("line_no = 1"), 2)
    made = sinks.metadata({"vocab_size": 3}, {"gemma": {"dim": 768}, "glove": {"ridge_alpha": 1}}, {"gemma": spark.createDataFrame([(1, 52.1)], "k int, accuracy double")})
    assert made["spaces"]["gemma"] == {"ridge_alpha": 100, "dtype": "float16", "accuracy": {"top1": 52.1}, "dim": 768} and made["spaces"]["glove"]["accuracy"] is None
    sinks.write_metadata(spark, made, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value)["schema_version"] == 2


def test_atlas_of_a_configuration(spark, tmp_path):
    from lexmesh.operators import atlas
    from lexmesh.plans import jobs, vector_queries

    config = vector_queries.atlas_config(spark, "/root/testdata/sf0.001")
    made = jobs.write_atlas(spark, config, str(tmp_path / "a"))
    assert {r.lens for r in made["summary"].collect()} == {"lens1", "lens2", "lens3", "lens4", "lens5", "lens6"}
    stamps = spark.read.json(str(tmp_path / "a/metadata")).first()
    assert {r.input for r in stamps.inputs} == {"source", "target", "anchors", "second"}
    again = {r.input: r.sha256 for r in atlas.stamp({"source": config.source.repartition(5)}).collect()}
    assert again["source"] == {r.input: r.sha256 for r in stamps.inputs}["source"]
    assert spark.read.text(str(tmp_path / "a/pages/lens3_histogram")).count() > 20
    import dataclasses

    assert "lens4" not in atlas.run(dataclasses.replace(config, second=None))
