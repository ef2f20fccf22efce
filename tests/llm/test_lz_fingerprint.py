"""Lempel-Ziv fingerprints against plain parses and whole phrase sets."""

import hashlib
import random

from pyspark.sql import functions as F

from lexmesh.llm import lz_fingerprint as lz
from lexmesh.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def phrases(text):
    """The parse by definition: the shortest run that is no phrase yet."""
    out, at = [], 0
    for end in range(1, len(text) + 1):
        if text[at:end] not in out:
            out.append(text[at:end])
            at = end
    return out


def jaccard(a, b):
    a, b = set(phrases(a)), set(phrases(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_parse_and_signature():
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 40, 400):
        text = "".join(rng.choice("ab c漢😀") for _ in range(n))
        got = lz.parse(text)
        assert got == phrases(text) and len(lz.signature(got)) == min(lz.SIZE, len(got))
        assert (lz.signature(got) == lz.signature(got[::-1])).all()  # a set has no order


def test_signatures_estimate_likeness():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    text = lambda: " ".join(rng.choice(words) for _ in range(600))
    errors = []
    for _ in range(40):
        a, b = text(), text()
        b = a[: rng.randint(0, len(a))] + b
        got = lz.likeness(lz.signature(lz.parse(a)), lz.signature(lz.parse(b)))
        errors.append(got - jaccard(a, b))
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.2


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        yield i, len(text), hashlib.sha256(new.encode()).hexdigest(), jaccard(text, new), jaccard(text, after)


def check(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("z") for c in ("key", "bucket", "extra", "id", "pos", "n")}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op12_lz_fingerprint"](spark, str(folder)).collect()
    short = lambda r: (str(r[0]), r[1], r[2], round(r[3], 9), round(r[4], 9))
    assert sorted(short((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next)) for r in got) == sorted(map(short, brute(rows)))
    for text in {r[1] for r in rows}:
        assert len({r.fingerprint for r in got if any(r.doc_id == i and text == x for i, x in rows if sum(i == j for j, _ in rows) == 1)}) <= 1
    return got


def test_query_by_brute_force(spark, tmp_path):
    """Over many buckets; these sets are small, so likeness is exact."""
    rng = random.Random(5)
    rows = [(i * 13 - 40, "".join(rng.choice("abcde ") for _ in range(rng.choice([0, 1, 2, 3, 50, 90])))) for i in range(83)]
    got = check(spark, tmp_path, rows)
    by = {r.doc_id: r for r in got}
    assert all(r.fingerprint == "" for r in got if r.n_chars == 0) and by[-40].edited_fingerprint is not None


def test_odd_rows(spark, tmp_path):
    rows = [(1, "abc"), (1, "abc"), (1, None), (1, "zz top"), (None, "last"), (None, None), (7, ""), (9, "漢字😀 漢字😀"), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    check(spark, tmp_path, rows)


def test_a_single_row_is_its_own_next(spark, tmp_path):
    (row,) = check(spark, tmp_path, [(4, "abcabcab")])
    assert row.near_next == 1.0 and row.fingerprint == lz.fingerprint(lz.signature(phrases("abcabcab")))
