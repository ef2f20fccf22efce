"""Counting operators over streams: token counts, and counts by event-time window with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_tokens


def streaming_token_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """A4 over a stream of lines: state is one count a token."""
    return lines.select(F.explode(clean_tokens(F.col(line))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by tumbling window and key. In append mode a window comes out once, when the watermark (the latest time less late)
    has passed it; its state goes then, and rows for it that come later are left out."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; each micro-batch writes the whole result so far in place of the last one's."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def append_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; finished windows are appended to the files at path."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
