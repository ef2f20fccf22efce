"""Alignment modes, whitening and merged reports against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmesh.operators import alignment


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 6))
    y = np.tanh(x @ rng.normal(size=(6, 5))) + 0.4 * rng.normal(size=(120, 5)) + 1.5
    pairs = [(i, (i * 7) % 120) for i in range(120)] + [(500, 3), (4, 900)]
    return x, y[[(i * 103) % 120 for i in range(120)]], pairs


def white(y):
    c = y - y.mean(0)
    w, e = np.linalg.eigh(c.T @ c / (len(y) - 1))
    return c @ (e @ np.diag(np.maximum(w, 1e-6) ** -0.5) @ e.T)


def by_numpy(x, y, pairs, alpha):
    pairs = [(a, b) for a, b in pairs if a < 120 and b < 120]
    train, test = [p for p in pairs if p[0] % 5], [p for p in pairs if p[0] % 5 == 0]
    a, b = x[[p[0] for p in train]], y[[p[1] for p in train]]
    ma, mb = a.mean(0), b.mean(0)
    coef = np.linalg.solve((a - ma).T @ (a - ma) + alpha * np.eye(a.shape[1]), (a - ma).T @ (b - mb))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.rint(unit((x[[p[0] for p in test]] - ma) @ coef + mb) @ unit(y).T * 1e6)
    order = [np.lexsort((np.arange(len(y)), -row)) for row in s]
    return {k: 100 * np.mean([g in o[:k] for (_, g), o in zip(test, order)]) for k in (1, 5, 10)}, len(train), len(test)


def test_four_modes_by_numpy(spark, data):
    x, y, pairs = data
    anchors = spark.createDataFrame(pairs, "source_id long, target_id long")
    spaces = {"gloss": frame(spark, y), "bare": frame(spark, y[:, :3])}
    got = {}
    for r in alignment.modes(frame(spark, x), spaces, anchors, F.col("source_id") % 5 == 0, alpha=2.0).collect():
        got.setdefault(r["mode"], {})[r.k] = r
    for mode, t in (("gloss", y), ("bare", y[:, :3]), ("whitened", white(y)), ("bare_whitened", white(y[:, :3]))):
        want, train, test = by_numpy(x, t, pairs, 2.0)
        assert {k: round(r.accuracy, 4) for k, r in got[mode].items()} == {k: round(v, 4) for k, v in want.items()}, mode
        assert all((r.train, r.test, r.valid, r.total, r.n) == (train, test, train + test, len(pairs), test) for r in got[mode].values())
    assert list(alignment.modes(frame(spark, x), {"bare": spaces["bare"]}, anchors, F.col("source_id") % 5 == 0).select("mode").distinct().toPandas()["mode"].sort_values()) == ["bare", "bare_whitened"]
    with pytest.raises(ValueError):
        alignment.modes(frame(spark, x), {}, anchors, F.lit(False))


def test_whitening_leaves_nothing_in_common(spark, data):
    y = data[1]
    got = np.array([r.vec for r in alignment.whitened(frame(spark, y)).orderBy("id").collect()])
    assert np.allclose(got, white(y), atol=1e-6) and np.allclose(np.cov(got.T), np.eye(5), atol=1e-6)
    before = alignment.random_cosine(frame(spark, y), 800).first()
    after = alignment.random_cosine(frame(spark, got), 800).first()
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    exact = ((u.sum(0) ** 2).sum() - len(u)) / len(u) / (len(u) - 1)
    assert before.pairs == 800 and abs(before["mean"] - exact) < 0.05 and abs(after["mean"]) < 0.06


def test_random_cosine_of_few_rows(spark):
    assert tuple(alignment.random_cosine(frame(spark, np.ones((1, 2)))).first()) == (0, None)
    assert alignment.random_cosine(frame(spark, np.array([[1.0, 0], [0, 1]])), 50).first()["mean"] == 0


def test_reports_merge_with_what_one_lacks(spark):
    a = spark.createDataFrame([("top1", 50.0), ("top5", 70.0)], "k string, accuracy double")
    b = spark.createDataFrame([("top1", 40.5), ("top10", 90.0)], "k string, accuracy double")
    got = {tuple(r) for r in alignment.merged(a, b, "k", "accuracy").collect()}
    assert got == {("top1", 50.0, 40.5, 9.5), ("top5", 70.0, None, None), ("top10", None, 90.0, None)}
