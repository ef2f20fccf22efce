"""Validation by metrics that are observed while rows pass, so a check costs no scan of its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class Watch:
    """Rows that count their own faults as an action passes over them. rows must be read in full once before ``report``."""

    rows: DataFrame
    observation: Observation
    names: list[str]

    def failures(self) -> dict[str, int]:
        got = self.observation.get
        return {n: int(got[f"failed_{n}"]) for n in self.names}

    def report(self, spark: SparkSession) -> DataFrame:
        """(test, n, failed, passed): a row for each check, n the rows that passed by."""
        n = int(self.observation.get["rows"])
        return spark.createDataFrame([(name, n, k, k == 0) for name, k in self.failures().items()], REPORT)

    def require(self) -> None:
        """ValueError with all that failed."""
        wrong = {n: k for n, k in self.failures().items() if k}
        if wrong:
            raise ValueError("; ".join(f"{n}: {k} of {self.observation.get['rows']} rows" for n, k in wrong.items()))


REPORT = "test string, n long, failed long, passed boolean"


def watch(rows: DataFrame, checks: dict[str, Column], name: str = "checks") -> Watch:
    """rows with checks (name: condition that each row must meet; null doesn't meet it)."""
    seen = Observation(name)
    failed = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"failed_{n}") for n, c in checks.items()]
    return Watch(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *failed), seen, list(checks))


def passed_over(w: Watch) -> Watch:
    """w after a pass over its rows that keeps nothing, for where no write follows."""
    w.rows.write.format("noop").mode("overwrite").save()
    return w


def write_checked(rows: DataFrame, path: str, checks: dict[str, Column], kind: str = "parquet") -> DataFrame:
    """Write rows and report on them, in one pass."""
    w = watch(rows, checks)
    w.rows.write.mode("overwrite").format(kind).save(path)
    return w.report(rows.sparkSession)


def vector_checks(size: int) -> dict[str, Column]:
    """Of rows with vec: its length, and that its values are numbers and not all zero."""
    return {"length": F.size("vec") == size, "finite": F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), "nonzero": F.exists("vec", lambda x: x != 0)}


def line_checks(size: int, sample: int = 100) -> dict[str, Column]:
    """S15 over (line_no, value): size numbers after the word, and the words of the first sample lines in lower case."""
    word = F.substring_index("value", " ", 1)
    return {"fields": F.size(F.split("value", " ")) == size + 1, "lower_case": (F.col("line_no") > sample) | (word == F.lower(word))}


def answers(asked: DataFrame, answered: DataFrame, key: str = "qid", name: str = "answers") -> Watch:
    """Q10's smoke test: every asked (id) must have a row in answered (qid)."""
    have = answered.select(F.col(key).alias("id")).distinct().withColumn("_found", F.lit(True))
    return watch(asked.join(have, "id", "left"), {name: F.col("_found")})
