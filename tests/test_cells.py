"""Cells of vectors: searches and pair joins against brute force, recall, and what is shuffled."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmesh.operators import cells, knn
from lexmesh.ranks import numbered


def made(spark, v, ids=None):
    v = np.asarray(v, float)
    v = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v, axis=1, keepdims=True))
    return spark.createDataFrame([(int(i), [float(c) for c in x]) for i, x in zip(ids if ids is not None else range(len(v)), v)], "id long, vec array<double>"), v


def nearest_by_brute_force(v, q, k, other=False):
    s = np.rint(np.clip(v[q] @ v.T, -1, 1) * 1e6)
    out = set()
    for row, i in zip(s, q):
        order = [j for j in np.lexsort((np.arange(len(v)), -row)) if not (other and j == i)][:k]
        out |= {(int(i), r + 1, int(j), row[j] / 1e6) for r, j in enumerate(order)}
    return out


def pairs_by_brute_force(v):
    s = np.round(np.clip(v @ v.T, -1, 1), 6)
    a, b = np.triu_indices(len(v), 1)
    at = np.lexsort((b, a, -s[a, b]))
    return [(int(a[k]), int(b[k]), float(s[a[k], b[k]])) for k in at]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 16))
    v = centers[rng.integers(0, 30, 3000)] + 0.12 * rng.normal(size=(3000, 16))
    return made(spark, v)


@pytest.fixture(scope="module")
def index(clustered):
    return cells.CellIndex(clustered[0], 40, block=100)


def test_blocks_are_bounded_and_whole(clustered, index):
    assert index.rows.sum() == 3000 and index.rows.max() < 200 and len(index.names) > len(set(index.cells)) > 10
    assert index.table.select("id").distinct().count() == 3000


def test_exact_search_equals_brute_force(spark, clustered, index):
    df, v = clustered
    q = np.arange(0, 3000, 50)
    for other in (False, True):
        got = {tuple(r) for r in index.exact(df.filter("id % 50 = 0"), 10, probes=1, other=other).collect()}
        assert got == nearest_by_brute_force(v, q, 10, other)


def test_recall_of_the_approximate_search(spark, clustered, index):
    df, _ = clustered
    q = df.filter("id % 50 = 0")
    truth = index.exact(q, 10, other=True)
    n, found, share = cells.recall(index.search(q, 10, other=True), truth).first()
    assert n == 600 and share >= 0.9
    assert cells.recall(index.search(q, 10, len(index.centers), other=True), truth).first()["recall"] == 1.0
    assert index.probes_for(q, 10, other=True) < len(index.centers) / 2


def test_recall_on_vectors_without_clusters(spark):
    df, _ = made(spark, np.random.default_rng(3).normal(size=(900, 24)))
    index = cells.CellIndex(df, 30)
    q = df.filter("id % 10 = 0")
    assert cells.recall(index.search(q, 10), index.exact(q, 10)).first()["recall"] >= 0.9


def test_exact_search_skips_cells(spark, clustered, index):
    """On clustered rows most queries meet few blocks."""
    q = clustered[0].filter("id % 50 = 0")
    first = index._found(index._routes(q, 2, 0, False), 10, False)
    kth = cells.best(first, 10).groupBy(F.col("qid").alias("id")).agg(F.min("score").alias("worst"))
    more = index._routes(q.join(kth, "id"), 40, 2, True).count()
    assert more < 0.3 * 60 * len(index.names)


def test_top_pairs_equal_brute_force(spark, clustered):
    df, v = clustered
    for top in (1, 60):
        assert [tuple(r) for r in cells.top_pairs(df, top, 40, block=100).collect()] == pairs_by_brute_force(v)[:top]


def test_pair_joins_shuffle_less_than_all_pairs_of_blocks(clustered, index):
    least = pairs_by_brute_force(clustered[1])[59][2]
    assert index._visits(least).count() < 0.1 * 3000 * len(index.names) / 2


def test_pair_counts_equal_brute_force(spark, clustered, index):
    scores = np.array([s for _, _, s in pairs_by_brute_force(clustered[1])])
    for low, high in ((0.2, 0.5), (0.9, 1.0), (-1.0, -0.6)):
        inside = scores[(scores >= low) & (scores <= high)]
        want = np.bincount(np.minimum(((inside - low) / (high - low) * 6 + 1e-9).astype(int), 5), minlength=6)
        assert [tuple(r) for r in index.pair_counts(low, high, 6).orderBy("bin").collect()] == list(enumerate(want))


def test_a_third_of_the_rows_alike(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 8))
    v[::3] = v[0]
    v[5] = 0
    df, v = made(spark, v)
    assert [tuple(r) for r in cells.top_pairs(df, 30, 10, block=50).collect()] == pairs_by_brute_force(v)[:30]
    assert cells.distinct_vectors(df, 30).count() == 600 - 200 + 31
    got = {tuple(r) for r in cells.CellIndex(df, 10, block=50).exact(df.filter("id % 50 = 0"), 5).collect()}
    assert got == nearest_by_brute_force(v, np.arange(0, 600, 50), 5)


def test_many_queries_go_through_cells(spark, clustered, monkeypatch):
    df, v = clustered
    monkeypatch.setattr(knn, "BLOCK", 50)
    monkeypatch.setattr(knn, "ROWS", 500)
    q = np.arange(0, 3000, 25)
    assert {tuple(r) for r in knn.nearest(df.filter("id % 25 = 0"), df, 3, True).collect()} == nearest_by_brute_force(v, q, 3, True)


def test_few_and_no_rows(spark):
    df, v = made(spark, [[1, 0], [0, 1], [1, 1]])
    assert {tuple(r) for r in cells.CellIndex(df, 7).exact(df, 5).collect()} == nearest_by_brute_force(v, np.arange(3), 5)
    assert [tuple(r)[:2] for r in cells.top_pairs(df, 9, 2).collect()] == [(0, 2), (1, 2), (0, 1)]
    none = df.filter("id < 0")
    assert cells.top_pairs(none, 3).count() == 0 and cells.CellIndex(none).exact(df, 2).count() == 0 and cells.CellIndex(df).search(none, 2).count() == 0


def test_numbers_within_groups(spark):
    rows = [(g, i) for g, n in (("a", 500), ("b", 1), ("c", 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, pos_ long").repartition(7)
    got = numbered(df, "g", F.desc("pos_")).collect()
    size = {"a": 500, "b": 1, "c": 60}
    assert len(got) == 561 and all(r.pos == size[r.g] - 1 - r.pos_ and r.n == size[r.g] for r in got)


@pytest.mark.parametrize("n_queries", [40, 300])
def test_searches_hold_one_tile_of_scores(monkeypatch, n_queries):
    monkeypatch.setattr(knn, "TILE", 5_000)
    monkeypatch.setattr(knn, "STRIP", 200)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1000, 8))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    v[500:510] = v[3]  # ties go by id
    held = []
    tile = knn.Top._tile
    monkeypatch.setattr(knn.Top, "_tile", lambda self, at, ids, v, single: (held.append(len(self.qids[at]) * len(ids)), tile(self, at, ids, v, single))[1])
    top = knn.Top(np.arange(n_queries), v[:n_queries], 6, True)
    for lo in range(0, 1000, 350):
        top.add(np.arange(lo, min(1000, lo + 350))[::-1], v[lo : lo + 350][::-1])
    got = top.table(pa.int64()).to_pylist()
    want = {(q, i, s) for q, _, i, s in nearest_by_brute_force(v, np.arange(n_queries), 6, True)}
    assert {(r["qid"], r["id"], r["score"]) for r in got} == want and max(held) <= 5_000


def test_many_queries_meet_blocks_of_rows_not_cells(spark, monkeypatch):
    """Vectors without structure: no bound helps, and a query must not travel once for each of many cells."""
    monkeypatch.setattr(knn, "BLOCK", 50)
    monkeypatch.setattr(knn, "ROWS", 100)
    v = np.random.default_rng(5).normal(size=(1000, 8))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    monkeypatch.setattr(cells, "CellIndex", None)
    assert {tuple(r) for r in knn.nearest(df, df, 3).collect()} == nearest_by_brute_force(v, np.arange(1000), 3)


def test_pair_counts_of_blocks_equal_brute_force(spark):
    v = np.random.default_rng(6).normal(size=(700, 6))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    v[600:610] = v[5]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    s = np.round(np.clip(v @ v.T, -1, 1), 6)[np.triu_indices(700, 1)]
    s = s[(s >= 0.2) & (s <= 1)]
    want = np.bincount(np.minimum(((s - 0.2) / 0.8 * 9 + 1e-9).astype(int), 8), minlength=9)
    for block in (None, 30, 1000):
        assert [r.n for r in cells.pair_counts(df, 0.2, 1.0, 9, block=block).orderBy("bin").collect()] == list(want)


@pytest.mark.parametrize("g, shares", [(1, 1), (2, 1), (7, 3), (60, 4)])
def test_blocks_cross_once_and_travel_to_half(spark, g, shares):
    """Each pair of rows meets in one place, also where blocks are empty; a row goes to the earlier blocks, and to its own once a share."""
    v = np.random.default_rng(7).normal(size=(40, 6))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    placed = cells.crossed(df, g, shares)
    s = np.round(np.clip(v @ v.T, -1, 1), 6)[np.triu_indices(40, 1)]
    got = knn.meet(placed, cells.counts_task(-1.0, 1.0, 1, True), "bin int, n long").agg(F.sum("n")).first()[0]
    assert got == len(s) == 780
    sent = placed.groupBy("id").agg(F.count("*").alias("n"), F.count_if("own").alias("alone"))
    most = sent.agg(F.max("n"), F.min("alone"), F.max("alone")).first()
    assert most[0] <= g - 1 + shares + 1 and most[1] == most[2] == 1 and sent.agg(F.avg("n")).first()[0] <= (g - 1) * 0.7 + shares + 1


def test_top_pairs_without_structure_meet_by_large_blocks(spark, clustered, monkeypatch):
    """where bounds rule out little, rows travel to half of few blocks, not of all cells; clustered rows still go through cells."""
    df, v = made(spark, np.random.default_rng(9).normal(size=(1500, 24)), range(1500))
    crossed, dealt = cells.crossed, []
    monkeypatch.setattr(cells, "crossed", lambda rows, g, shares: dealt.append((g, shares)) or crossed(rows, g, shares))
    for rows in (16_384, 64):
        monkeypatch.setattr(knn, "ROWS", rows)
        got = [tuple(r) for r in cells.top_pairs(df, 40, 38, block=60).orderBy(F.desc("score"), "a", "b").collect()]
        assert got == pairs_by_brute_force(v)[:40]
    assert len(dealt) == 2 and dealt[1][0] == 6
    monkeypatch.setattr(cells, "VISIT", 0)
    df, v = clustered
    assert [tuple(r) for r in cells.CellIndex(df, 40, block=100).top_pairs(40).collect()] == pairs_by_brute_force(v)[:40]
    assert len(dealt) == 2


@pytest.mark.parametrize("low, high, dims", [(0.2, 0.5, 64), (0.2, 0.8, 64), (0.35, 0.5, 32)])
def test_scores_just_below_the_lowest_bin_do_not_count(low, high, dims):
    """the bound in single precision is itself rounded; scores around it and around the range's ends count as in double precision."""
    scores = [float(np.nextafter(np.float32(low - knn.slack(dims)), np.float32(side))) for side in (-1, 2)] + [float(np.float32(low - knn.slack(dims)))]
    scores += [x + d for x in (low, high) for d in (-2e-5, -6e-7, -4e-7, 0, 4e-7, 6e-7, 2e-5)]
    b = np.zeros((len(scores), dims))
    b[:, 0], b[:, 1] = scores, np.sqrt(1 - np.square(scores))
    a, counts = np.eye(1, dims), np.zeros(15, np.int64)
    cells.tally(counts, low, high, np.array([0]), a, np.arange(1, len(b) + 1), b, False)
    s = np.round(np.array(scores), 6)
    s = s[(s >= low) & (s <= high)]
    assert counts.tolist() == np.bincount(np.minimum(((s - low) / (high - low) * 15 + 1e-9).astype(int), 14), minlength=15).tolist()
