"""Keep-longest over shuffled micro-batches, and checks that are counted as rows pass."""

import random

import pytest
from pyspark.sql import functions as F

from lexmesh.operators import corpus, validation
from lexmesh.streaming import longest

TEXTS = "doc_id long, p_number string, n_lines int, note string"


def batches(spark, folder, rows, n, seed):
    """rows in n files, in a random order."""
    rng = random.Random(seed)
    mixed = rng.sample(rows, len(rows))
    for k in range(n):
        spark.createDataFrame(mixed[k::n], TEXTS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_keeps_what_the_batch_keeps(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", "hot", "hot", *(f"P{k}" for k in range(25))]), rng.randint(0, 6), f"n{i}") for i in range(300)]
    stream = batches(spark, f"{tmp_path}/in", rows, 6, seed)
    longest.append_improvements(stream, f"{tmp_path}/out", f"{tmp_path}/state", "p_number", F.col("n_lines"), "doc_id")
    log = spark.read.parquet(f"{tmp_path}/out")
    got = longest.latest(log, "p_number", F.col("n_lines"), "doc_id")
    want = corpus.keep_longest(spark.createDataFrame(rows, TEXTS), "p_number", F.col("n_lines"), "doc_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    keyed = log.filter("p_number <> ''")
    assert keyed.count() < sum(bool(r[1]) for r in rows) / 1.5  # most rows are no improvement and leave no trace


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    first = [(1, "P1", 3, "a"), (2, "P1", 5, "b"), (3, None, 1, "c")]
    later = [(4, "P1", 5, "d"), (5, "P1", 9, "e"), (6, "P2", 0, "f")]
    for rows in (first, later):
        stream = batches(spark, f"{tmp_path}/in", rows, 1, 0)
        longest.append_improvements(stream, f"{tmp_path}/out", f"{tmp_path}/state", "p_number", F.col("n_lines"), "doc_id")
    log = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.doc_id for r in log.collect()) == [2, 3, 5, 6]
    assert sorted(r.doc_id for r in longest.latest(log, "p_number", F.col("n_lines"), "doc_id").collect()) == [3, 5, 6]


def test_checks_are_counted_in_the_pass_that_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None)], "id long, vec array<double>")
    report = validation.write_checked(df, f"{tmp_path}/out", validation.vector_checks(2))
    assert {tuple(r) for r in report.collect()} == {("length", 5, 2, False), ("finite", 5, 2, False), ("nonzero", 5, 2, False)}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    w = validation.passed_over(validation.watch(df.filter("id = 1"), validation.vector_checks(2)))
    w.require()
    with pytest.raises(ValueError, match="length: 2 of 5 rows"):
        validation.passed_over(validation.watch(df, validation.vector_checks(2))).require()


def test_line_checks(spark):
    lines = spark.createDataFrame([(1, "the 1 2"), (2, "Of 1 2"), (3, "and 1"), (150, "LATE 1 2")], "line_no long, value string")
    assert validation.passed_over(validation.watch(lines, validation.line_checks(2))).failures() == {"fields": 1, "lower_case": 1}


def test_questions_without_an_answer(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    found = spark.createDataFrame([(1, 7), (1, 8), (3, 9)], "qid long, id long")
    assert [tuple(r) for r in validation.passed_over(validation.answers(asked, found)).report(spark).collect()] == [("answers", 3, 1, False)]


def test_nothing_to_check(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert {tuple(r) for r in validation.passed_over(validation.watch(none, validation.vector_checks(2))).report(spark).collect()} == {(n, 0, 0, True) for n in ("length", "finite", "nonzero")}
