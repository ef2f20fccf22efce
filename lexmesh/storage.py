"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that settle writes for the innermost open ``distilled`` of this thread; none is open by default.
_open: ContextVar[list[str] | None] = ContextVar("open", default=None)
#: The folder of an application whose driver and executors are one process.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names; a local master, where it is unset, gets one of its own."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share; intermediate tables go there")
        if context.applicationId not in _local:
            _local[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        named = _local[context.applicationId]
    return named


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _note(path: str) -> None:
    if (paths := _open.get()) is not None:
        paths.append(path)


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, "settled")
    _note(path)  # before it is written, so that a write that fails is cleared away, too
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distilled(spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame:
    """work's result, settled; the tables that were settled for it are deleted from the shared folder. Other threads' tables stay."""
    paths: list[str] = []
    opened = _open.set(paths)
    try:
        out = settle(work())
    except BaseException:
        _open.reset(opened)
        for path in paths:
            _note(path)
        raise
    _open.reset(opened)
    _note(paths.pop())  # the result's own, which settle noted last
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return out


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that is dear by row: a small file is one partition, however many cores wait.

    A table of many files stays as it is and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def files_stamp(df: DataFrame) -> str:
    """A hash of the files that df scans: their paths, sizes and times of change. Reads no column; df must be a plain scan of files."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    sums = [F.sum(F.xxhash64(F.lit(k), "file_path", "file_size", "file_modification_time").cast("decimal(38,0)")) for k in (1, 2)]
    return files.agg(F.sha2(F.concat_ws(",", F.count("*"), *sums), 256).alias("stamp")).first()["stamp"]


def kept(spark: SparkSession, name: str, inputs: list[DataFrame], work: Callable[[], DataFrame]) -> DataFrame:
    """work's table, found again in the shared folder for as long as its inputs' files stay as they are.

    name must say all that work depends on beside its inputs. A table gets its path when it is whole; of two that are made at
    once the first stays.
    """
    stamp = hashlib.sha256(",".join([name, *map(files_stamp, inputs)]).encode()).hexdigest()[:32]
    path = f"{shared_dir(spark).rstrip('/')}/kept-{name}-{stamp}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        made = new_path(spark, "making")
        work().write.parquet(made)
        if fs.exists(at) or not fs.rename(hadoop.Path(made), at):
            fs.delete(hadoop.Path(made), True)
    return spark.read.parquet(path)
