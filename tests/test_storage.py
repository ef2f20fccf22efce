"""Tables in the shared folder: what distilled deletes, and what it leaves to others."""

import os
import subprocess
import sys
import threading

import pytest

from lexmesh.storage import distilled, files_stamp, kept, settle, shared_dir, spread

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def here(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_distilled_keeps_its_result_alone(spark):
    before = here(spark)
    out = distilled(spark, lambda: settle(settle(spark.range(5)).filter("id > 1")))
    assert len(here(spark) - before) == 1 and out.count() == 3


def test_nested_results_go_with_the_outer_one(spark):
    before = here(spark)
    out = distilled(spark, lambda: distilled(spark, lambda: settle(spark.range(4))).filter("id > 0"))
    assert len(here(spark) - before) == 1 and out.count() == 3


def test_another_threads_tables_stay(spark):
    made, ready, go = [], threading.Event(), threading.Event()

    def other():
        ready.wait(60)
        made.append(settle(spark.range(7)))
        go.set()

    thread = threading.Thread(target=other)
    thread.start()

    def work():
        ready.set()
        assert go.wait(60)
        return settle(spark.range(3))

    distilled(spark, work)
    thread.join()
    assert made[0].count() == 7


def test_a_failure_leaves_its_tables_to_the_outer_one(spark):
    before = here(spark)

    def fails():
        settle(spark.range(2))
        raise KeyError("x")

    def work():
        with pytest.raises(KeyError):
            distilled(spark, fails)
        return spark.range(1)

    distilled(spark, work)
    assert len(here(spark) - before) == 1


def test_spread_fills_the_cores_and_leaves_wide_tables(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == cores and sorted(r.id for r in spread(one).collect()) == list(range(100))
    wide = spark.range(100).repartition(cores + 3)
    assert spread(wide) is wide


def test_kept_tables_are_made_once_for_their_inputs(spark, tmp_path):
    made = []

    def sums(name="sums", folder="a"):
        df = spark.read.parquet(f"{tmp_path}/{folder}")

        def work():
            made.append(name)
            return df.agg({"id": "sum"}).withColumnRenamed("sum(id)", "s")

        return kept(spark, name, [df], work).first()["s"]

    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/a")
    assert sums() == sums() == 45 and made == ["sums"]
    assert sums("others") == 45 and made == ["sums", "others"]
    spark.range(10, 12).write.mode("append").parquet(f"{tmp_path}/a")
    assert sums() == 66 and made == ["sums", "others", "sums"]
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/b")
    stamps = [files_stamp(spark.read.parquet(f"{tmp_path}/{x}")) for x in "aab"]
    assert stamps[0] == stamps[1] != stamps[2]


def test_a_kept_table_that_fails_is_made_the_next_time(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    df = spark.read.parquet(f"{tmp_path}/a")
    with pytest.raises(ZeroDivisionError):
        kept(spark, "failing", [df], lambda: 1 / 0)
    assert kept(spark, "failing", [df], lambda: df).count() == 3


def test_the_entry_stands_without_what_the_training_part_needs():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 80 and said[2] == "True"
