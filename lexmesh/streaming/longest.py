"""A5 over a stream: of each key's rows the longest, the first on ties, by arbitrary keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.corpus import keep_longest


def improvements(texts: DataFrame, key: str, size: Column, ordinal: str, idle_minutes: int = 60) -> DataFrame:
    """Rows of a stream that are longer than all of their key's rows so far, or as long and of a lesser ordinal; rows without a key all pass.

    A key's state is two numbers, and goes when nothing has come for it for idle_minutes. Should the key come back after that,
    its rows start over; the log may then have shorter rows after longer ones, which ``latest`` leaves out. Rows of one key and
    micro-batch stream through one task, which keeps the best of them alone.
    """
    keyed = F.coalesce(F.col(key), F.lit("")) != ""
    marked = texts.withColumns({"_size": size.cast("long"), "_ordinal": F.col(ordinal).cast("long")})
    schema = texts.schema

    def update(_: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = (-state.get[0], state.get[1]) if state.exists else None
        found = None
        for pdf in frames:
            first = pdf.sort_values(["_size", "_ordinal"], ascending=[False, True], kind="stable").iloc[:1]
            mine = (-int(first["_size"].iloc[0]), int(first["_ordinal"].iloc[0]))
            if best is None or mine < best:
                best, found = mine, first
        state.update((-best[0], best[1]))
        state.setTimeoutDuration(idle_minutes * 60_000)
        if found is not None:
            yield found[[f.name for f in schema]]

    kept = marked.filter(keyed).groupBy(key).applyInPandasWithState(update, schema, "size long, ordinal long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return kept.unionByName(texts.filter(~keyed))


def latest(log: DataFrame, key: str, size: Column, ordinal: str) -> DataFrame:
    """The result of all that a log of ``improvements`` has: what ``keep_longest`` makes of the whole stream."""
    return keep_longest(log, key, size, ordinal)


def append_improvements(texts: DataFrame, path: str, checkpoint: str, key: str, size: Column, ordinal: str, idle_minutes: int = 60) -> None:
    """Process what is there and stop; improvements are appended to the files at path, and the next call goes on from there."""
    log = improvements(texts, key, size, ordinal, idle_minutes)
    # with timers of processing time a query asks for one more batch without rows for ever
    conf, name = texts.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        query = log.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()
