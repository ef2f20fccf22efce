"""NumPy archives: round trips, ranges of rows, filters, and what NumPy itself reads and writes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmesh.sources import npz


@pytest.fixture
def arrays():
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" if i % 5 else f"šu₂ {i}" for i in range(1000)])
    return words, rng.normal(size=(1000, 7)).astype(np.float32)


def rows(df):
    return {r.idx: (r.token, r.vec) for r in df.collect()}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_reads_what_numpy_writes(spark, tmp_path, arrays, save):
    words, v = arrays
    path = f"{tmp_path}/a.npz"
    save(path, vectors=v, vocab=words, hit_rate=np.float32(0.5), mode=np.array("gloss"))
    df = npz.read_npz(spark, path, rows=300)
    assert df.rdd.getNumPartitions() == (4 if save is np.savez else 1)
    got = rows(df)
    assert len(got) == 1000 and all(got[i][0] == words[i] and np.array_equal(np.float32(got[i][1]), v[i]) for i in range(1000))
    assert npz.scalars(path) == {"hit_rate": 0.5, "mode": "gloss"} and np.array_equal(npz.matrix(path, "vectors"), v)
    with pytest.raises(ValueError, match="more than 10 values"):
        npz.matrix(path, "vectors", most=10)


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_ranges_of_rows(spark, tmp_path, arrays, save):
    words, v = arrays
    save(f"{tmp_path}/a.npz", vectors=v, vocab=words)
    for first, last, tasks in ((250, 420, 2), (777, 778, 1), (998, 5000, 1), (5000, 6000, 1), (0, 1000, 10)):
        df = npz.read_npz(spark, f"{tmp_path}/a.npz", rows=100, first=first, last=last)
        got = rows(df)
        assert sorted(got) == list(range(first, min(last, 1000))) and all(got[i][0] == words[i] and np.array_equal(np.float32(got[i][1]), v[i]) for i in got)
        assert df.rdd.getNumPartitions() == (tasks if save is np.savez else 1)
    df = npz.read_npz(spark, f"{tmp_path}/a.npz")
    assert df.filter("idx > 5000").count() == 0 and df.filter("idx = 3 OR idx = 5").count() == 2


@pytest.mark.parametrize("dtype", ["float16", "float32", "float64"])
def test_round_trip(spark, tmp_path, arrays, dtype):
    words, v = arrays
    df = spark.createDataFrame([(str(w), x.tolist()) for w, x in zip(words, v)], "token string, vec array<double>").repartition(3)
    npz.write_npz(df, f"{tmp_path}/out", dtype=dtype, rows=150)
    back = npz.read_npz(spark, f"{tmp_path}/out")
    got = {r.token: r.vec for r in back.collect()}
    assert back.schema["vec"].dataType.simpleString() == f"array<{'double' if dtype == 'float64' else 'float'}>"
    assert len(got) == 1000 and all(np.array_equal(np.array(got[w], v.dtype), x.astype(dtype).astype(v.dtype)) for w, x in zip(words, v))
    files = sorted(os.listdir(f"{tmp_path}/out"))
    loaded = [np.load(f"{tmp_path}/out/{f}") for f in files]
    assert all(f.startswith("part-") for f in files) and len(files) >= 6 and sum(len(z["vocab"]) for z in loaded) == 1000
    assert {str(z["vectors"].dtype) for z in loaded} == {dtype} and max(len(z["vocab"]) for z in loaded) <= 4096


def test_order_modes_and_bare_vectors(spark, tmp_path):
    df = spark.range(500).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec")).orderBy("vec")
    for mode, n in (("overwrite", 500), ("overwrite", 500), ("append", 1000)):
        npz.write_npz(df, f"{tmp_path}/out", mode, rows=64)
        back = npz.read_npz(spark, f"{tmp_path}/out")
        assert back.columns == ["file", "idx", "vec"] and back.count() == n
    npz.write_npz(df, f"{tmp_path}/one")
    first = [r.vec[0] for r in npz.read_npz(spark, f"{tmp_path}/one").orderBy("file", "idx").collect()]
    assert first == sorted(first)


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    ragged = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "token string, vec array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        npz.write_npz(ragged, f"{tmp_path}/out")
    with pytest.raises(Exception, match="null"):
        npz.write_npz(spark.createDataFrame([(None, [1.0])], "token string, vec array<double>"), f"{tmp_path}/out")
    assert not [f for f in os.listdir(f"{tmp_path}/out") if f.startswith("part")]


def test_refuses_what_it_cannot_read(spark, tmp_path):
    np.savez(f"{tmp_path}/pickled.npz", vectors=np.array([[1, "x"]], object))
    np.savez(f"{tmp_path}/flat.npz", vectors=np.arange(3))
    np.savez(f"{tmp_path}/uneven.npz", vectors=np.ones((3, 2)), vocab=np.array(["a", "b"]))
    for name, what in (("pickled", "no matrix"), ("flat", "no matrix"), ("uneven", "3 vectors, but 2 words"), ("absent", "absent")):
        with pytest.raises(Exception, match=what):
            npz.read_npz(spark, f"{tmp_path}/{name}.npz").count()


def test_empty_and_long_words(spark, tmp_path):
    np.savez(f"{tmp_path}/none.npz", vectors=np.zeros((0, 4)), vocab=np.array([], "<U1"))
    assert npz.read_npz(spark, f"{tmp_path}/none.npz").count() == 0
    df = spark.createDataFrame([("x" * (100_000 if i == 7 else 1), [float(i)]) for i in range(9000)], "token string, vec array<double>").coalesce(1)
    npz.write_npz(df, f"{tmp_path}/out")
    got = npz.read_npz(spark, f"{tmp_path}/out").agg(F.count("*"), F.max(F.length("token")), F.sum(F.get("vec", 0))).first()
    assert tuple(got) == (9000, 100_000, 9000 * 8999 / 2)
