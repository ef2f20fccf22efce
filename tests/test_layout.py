"""The neighbour plane: its weights and edges by definition, and whose neighbours it keeps against the principal plane."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmesh.operators import layout


def made(spark, v):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>"), v


def kept(v, plane, k=10):
    """The share of each row's k nearest that are among its k nearest in the plane."""
    near = lambda d: np.argsort(d + np.eye(len(d)) * 1e9, axis=1)[:, :k]
    high, low = near(-(v @ v.T)), near(((plane[:, None] - plane[None]) ** 2).sum(2))
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(high, low)])


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 24))
    return np.repeat(centers, 25, axis=0) + 0.25 * rng.normal(size=(300, 24))


def test_weights_by_definition():
    d = np.sort(np.random.default_rng(2).random((50, 15)), axis=1)
    w = layout.fuzzy(d)
    assert np.allclose(w[:, 0], 1) and np.allclose(w.sum(1), np.log2(15), atol=1e-4) and (np.diff(w, axis=1) <= 1e-12).all()
    assert np.allclose(layout.fuzzy(np.zeros((1, 4))), 1)


def test_edges_are_a_fuzzy_union():
    i, j, w = layout.union(np.array([0, 1, 2]), np.array([1, 0, 0]), np.array([0.5, 0.4, 1.0]), 3)
    assert list(zip(i, j)) == [(0, 1), (0, 2)] and np.allclose(w, [0.5 + 0.4 - 0.2, 1])


def test_neighbours_stay_where_principal_axes_lose_them(spark, clusters):
    df, v = made(spark, clusters)
    got = layout.neighbour_plane(df).orderBy("id").toPandas()
    plane = got[["x", "y"]].to_numpy()
    assert list(got.id) == list(range(300)) and kept(v, plane) > kept(v, layout.principal_plane(v)) + 0.1


def test_rows_beyond_the_landmarks_land_in_their_cluster(spark, clusters):
    df, v = made(spark, clusters)
    plane = layout.neighbour_plane(df, landmarks=150).orderBy("id").toPandas()[["x", "y"]].to_numpy()
    centers = plane.reshape(12, 25, 2).mean(1)
    own = ((plane[:, None] - centers[None]) ** 2).sum(2).argmin(1)
    assert (own == np.repeat(np.arange(12), 25)).mean() > 0.85 and kept(v, plane) > kept(v, layout.principal_plane(v))


def test_the_same_plane_again(spark, clusters):
    df, _ = made(spark, clusters[:60])
    a, b = (layout.neighbour_plane(x).orderBy("id").toPandas() for x in (df, df.repartition(5)))
    assert np.allclose(a, b)


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_few_rows(spark, n):
    df, _ = made(spark, np.random.default_rng(3).normal(size=(12, 4)))
    got = layout.neighbour_plane(df.filter(F.col("id") < n)).collect()
    assert len(got) == n and all(np.isfinite([r.x, r.y]).all() for r in got)


def test_landmarks_are_bounded(spark):
    with pytest.raises(ValueError, match="at most"):
        layout.neighbour_plane(spark.createDataFrame([], "id long, vec array<double>"), landmarks=layout.LANDMARKS + 1)


def test_sessions_without_arrow_for_pandas(spark, clusters):
    df, _ = made(spark, clusters[:60])
    was = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        assert layout.neighbour_plane(df).count() == 60
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", was)
