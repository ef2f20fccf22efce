"""Row numbers without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settle


def numbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows, settled, with long columns pos (from 0, by order within its group) and n (the group's rows).

    One global sort, then each task's part of a group gets the rows of the parts before it; the only window runs over a row for
    each task and group. A null group's rows are left out.
    """
    at = "_at"
    while at in rows.columns:
        at += "_"
    ordered = settle(rows.orderBy(group, *order).withColumn(at, F.monotonically_increasing_id()))
    task = F.shiftright(at, 33)
    parts = ordered.groupBy(F.col(group), task.alias(f"{at}task")).agg(F.count("*").alias("rows"), F.min(at).alias("first"))
    whole = Window.partitionBy(group)
    before = F.sum("rows").over(whole.orderBy(f"{at}task").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(group, f"{at}task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias(f"{at}shift"), F.sum("rows").over(whole).alias("n"))
    placed = ordered.withColumn(f"{at}task", task).join(starts, [group, f"{at}task"])
    return placed.select(*rows.columns, (F.col(at) + F.col(f"{at}shift")).alias("pos"), "n")
