import pytest
from pyspark.sql import functions as F

from lexmesh.functions import text as X


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("r")).collect()]


def test_normalize_token_spellings_and_idempotence(spark):
    raw = ["{Tug₂}-Sze₃-la₂", "{D}Šeš₂-Ŋar", "ḫi-ṣa-ṭu", "ʾa", "  LUGAL ", None, ""]
    got = one(spark, X.normalize_token, *raw)
    assert got == ["tug2sze3la2", "dszesz2jar", "hisatu", "a", "lugal", "", ""]
    assert one(spark, X.normalize_token, *got) == got


def test_clean_tokens_resolves_marks_in_order(spark):
    raw = ["[lugal]-e", "mu!(BU)", "dingir#", "$ broken", "lu2-{d}nanna ki", "a?-ba <x> (bar)(re) 1(disz)", "|KA.KAK| ...", None, "", "& + ' %x 7 b"]
    got = one(spark, X.clean_tokens, *raw)
    assert got[0] == ["lugale", "lugal", "e"]
    assert got[1:4] == [["mu"], ["dingir"], []]
    assert got[4] == ["lu2", "lu2", "d", "nanna", "ki"]
    assert got[5] == ["aba", "a", "ba", "x", "barre", "1(disz)"]
    assert got[6:] == [[], [], [], ["b"]]


def test_hyphens_expand_to_joined_form_and_parts(spark):
    got = one(spark, lambda c: X.expand_hyphens(F.split(c, " ")), "ki-masz lu a-")
    assert got == [["kimasz", "ki", "masz", "lu", "a", "a", ""]]


def test_ngrams_skip_lengths_beyond_the_word(spark):
    assert [sorted(x) for x in one(spark, lambda c: X.ngrams(c, 3, 6), "ab", "")] == [["<ab", "<ab>", "ab>"], []]


@pytest.mark.parametrize("gloss,junk", [("x", True), ("12", True), ("345", True), ("~abc", True), ("unknown", False), ("unmng", True), ("xx", True), ("king", False), (" King ", False)])
def test_junk_gloss(spark, gloss, junk):
    assert one(spark, X.is_junk_gloss, gloss) == [junk]


def test_morphemes_and_words(spark):
    assert one(spark, X.morphemes, "a-Ša₂-", "lugal") == [["a", "sza2"], []]
    assert one(spark, X.source_words, "Lu2 lu2 šeš kur") == [["lu2", "šeš", "kur"]]
    assert one(spark, X.target_words, "The king OF the land") == [["king", "land"]]
    assert one(spark, X.neutralize_entities, '<a xmlns="q">&amp;&C;&#5;') == ["<a>&amp;_C_&#5;"]


def test_dots_and_underscores(spark):
    got = one(spark, X.clean_tokens, "_a_ b_c moon. x.y _one two_ z", "1.5 a.1 KA.KAK... 2. end.")
    assert got == [["b_c", "moon", "x", "y", "_one", "two_", "z"], ["1.5", "a.1", "ka", "kak", "2.", "end"]]
