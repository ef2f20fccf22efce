"""Exact vector search: queries meet all rows in their tasks, tile by tile, and partial tops meet by query.

A tile's scores are first taken in single precision; only those that may count, within the error of that, are taken again in double.
So a task holds one block of rows, a few runs of queries and one tile of scores, however many rows and queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle

BLOCK = 4096  # queries that are sent to all tasks, at most
ROWS = 16_384  # rows in a block of a cell
STRIP = 4096  # rows scored at once
TILE = 1 << 20  # scores held at once
STEP = 2048  # queries or visitors met at once
NONE = -2_000_000  # below every score in millionths


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An array column of equal lengths as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def slack(dims: int) -> float:
    """What a score of unit vectors in single precision may be off by, and half a millionth for rounding."""
    return 1e-6 + 1.3e-7 * dims


def dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """a[i] . b[j] in double precision, a run of pairs at a time."""
    out = np.empty(len(i))
    for lo in range(0, len(i), 1 << 14):
        at = slice(lo, lo + (1 << 14))
        out[at] = np.einsum("ij,ij->i", a[i[at]], b[j[at]])
    return out


class Top:
    """The k best rows of each query so far: score in millionths descending, then id ascending."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, other: bool):
        self.qids, self.q, self.k, self.other, self.single = qids, q, k, other, q.astype(np.float32)
        self.scores, self.ids = np.full((len(qids), k), NONE), None

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        by = np.argsort(ids, kind="stable")
        ids, v = ids[by], v[by]
        if self.ids is None:
            self.ids = np.empty((len(self.qids), self.k), ids.dtype)
        single = v.astype(np.float32)
        for lo in range(0, len(ids), STRIP):
            high = min(lo + STRIP, len(ids))
            step = max(1, TILE // (high - lo))
            for first in range(0, len(self.qids), step):
                self._tile(slice(first, first + step), ids[lo:high], v[lo:high], single[lo:high])

    def _tile(self, at: slice, ids: np.ndarray, v: np.ndarray, single: np.ndarray) -> None:
        bar = self.scores[at, -1]
        if bar.min() > NONE:
            least = (bar / 1e6 - slack(v.shape[1])).astype(np.float32)
            may = self.single[at] @ single.T >= least[:, None]
            if np.count_nonzero(may) * 32 <= may.size:
                i, j = np.nonzero(may)
                return self._merge(at, i, np.rint(np.clip(dots(self.q[at], i, v, j), -1, 1) * 1e6).astype(np.int64), ids[j])
        s = np.rint(np.nan_to_num(np.clip(self.q[at] @ v.T, -1, 1) * 1e6, copy=False, nan=NONE)).astype(np.int64)
        if self.other:
            s[self.qids[at][:, None] == ids[None, :]] = NONE
        m = len(ids)
        if m > self.k:  # a place's number breaks ties, so a partition finds just the k best
            best = np.argpartition(-(s * m + (m - 1 - np.arange(m))), self.k - 1, axis=1)[:, : self.k]
        else:
            best = np.broadcast_to(np.arange(m), s.shape)
        i = np.repeat(np.arange(len(s)), best.shape[1])
        self._merge(at, i, np.take_along_axis(s, best, 1).ravel(), ids[best].ravel())

    def _merge(self, at: slice, i: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (i, score, id) of the queries at, i counted from its start, against what these queries have."""
        own, found = self.scores[at], self.ids[at]
        good = (scores > NONE) & (scores >= own[i, -1])
        if self.other:
            good &= self.qids[at][i] != ids
        if not good.any():
            return
        some, i = np.unique(i[good], return_inverse=True)
        held_i, held = np.nonzero(own[some] > NONE)
        q, x, y = np.concatenate([held_i, i]), np.concatenate([own[some[held_i], held], scores[good]]), np.concatenate([found[some[held_i], held], ids[good]])
        order = np.lexsort((np.unique(y, return_inverse=True)[1] if y.dtype == object else y, -x, q))
        q, x, y = q[order], x[order], y[order]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(some)))[q]
        keep = place < self.k
        own[some[q[keep]], place[keep]], found[some[q[keep]], place[keep]] = x[keep], y[keep]

    def table(self, kind: pa.DataType) -> pa.Table:
        i, j = np.nonzero(self.scores > NONE)
        ids = self.ids[i, j] if self.ids is not None else []
        return pa.table({"qid": pa.array(self.qids[i], pa.int64()), "id": pa.array(ids, kind), "score": pa.array(self.scores[i, j] / 1e6)})


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def meet(placed: DataFrame, task: Callable, schema: str) -> DataFrame:
    """task(a block's rows, its visitors run by run) over placed (block, side, ...), where a partition has each block's rows (side 0) first, then its visitors.

    task makes an object of a block's rows; its meet(run) and, at the end, result() give record batches.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, state = None, [], None
        for b in batches:
            names, sides = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (sides[1:] != sides[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                if lo == hi:
                    continue
                if names[lo] != now:
                    if state is None and held and getattr(task, "ALONE", False):
                        state = task(pa.Table.from_batches(held))
                    if state is not None:
                        yield from state.result()
                    now, held, state = names[lo], [], None
                part = b.slice(lo, hi - lo)
                if sides[lo] == 0:
                    held.append(part)
                    continue
                if state is None:
                    state, held = task(pa.Table.from_batches(held)) if held else Nothing(), []
                for at in range(0, part.num_rows, STEP):
                    yield from state.meet(part.slice(at, STEP))
        if state is None and held and getattr(task, "ALONE", False):
            state = task(pa.Table.from_batches(held))
        if state is not None:
            yield from state.result()

    return placed.mapInArrow(work, schema)


class Nothing:
    """A block that has visitors, but no rows."""

    def meet(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return iter(())

    def result(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def search_task(k: int, other: bool, kind: pa.DataType) -> type:
    """A task for ``meet``: each visitor's (qid, vec) k best of the block's rows (id, vec)."""

    class Search:
        def __init__(self, rows: pa.Table):
            self.ids, self.v = numbers(rows.column("id")), matrix(rows.column("vec"))

        def meet(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            top = Top(part.column("qid").to_numpy(), matrix(part.column("vec")), k, other)
            top.add(self.ids, self.v)
            return iter(top.table(kind).to_batches())

        def result(self) -> Iterator[pa.RecordBatch]:
            return iter(())

    return Search


def gridded(queries: DataFrame, rows: DataFrame, k: int, other: bool, kind: str, arrow: pa.DataType) -> DataFrame:
    """(qid, id, score): each query's k best of each block of rows.

    Rows are dealt to blocks of about 4 * ``ROWS`` by their ids, queries to as many groups as keep all cores busy; a task holds one
    block and streams one group past it. A query travels once for each block, a row once for each group.
    """
    queries = settle(queries.select(F.col("id").cast("long").alias("qid"), "vec"))
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // (4 * ROWS)))
    groups = max(1, min(-(-2 * cores // blocks), -(-queries.count() // STEP)))
    every = lambda m, at: F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), at))
    dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    home = rows.withColumn("_own", dealt("id", blocks)).select(every(groups, lambda g: g * blocks + F.col("_own")).alias("block"), F.lit(0).alias("side"), "id", F.lit(None).cast("long").alias("qid"), "vec")
    asking = queries.withColumn("_own", dealt("qid", groups)).select(every(blocks, lambda b: F.col("_own") * blocks + b).alias("block"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("id"), "qid", "vec")
    placed = home.unionByName(asking).repartitionById(blocks * groups, F.col("block")).sortWithinPartitions("block", "side")
    return meet(placed, search_task(k, other, arrow), f"qid long, id {kind}, score double")


def nearest(queries: DataFrame, rows: DataFrame, k: int, other: bool = False) -> DataFrame:
    """(qid, rank, id, score), the k rows of highest cosine for each query, ranked by the rounded score, then id.

    queries (id long) and rows (id long or string) have unit vectors vec; other leaves out the row that has the query's id.
    One block of queries is sent to all tasks; of more queries than that, groups meet blocks of rows (``gridded``), so no side is
    held whole anywhere. Where bounds rule out most rows, ``cells.CellIndex.exact`` has less to do.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    schema = f"qid long, id {kind}, score double"
    block = queries.select("id", "vec").limit(BLOCK + 1).toArrow()
    if block.num_rows > BLOCK:
        found = gridded(queries, rows.select("id", "vec"), k, other, kind, arrow)
    else:
        sent = spark.sparkContext.broadcast((numbers(block.column("id")), matrix(block.column("vec"))))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = Top(*sent.value, k, other)
            for b in batches:
                if len(top.qids) and b.num_rows:
                    top.add(numbers(b.column(0)), matrix(b.column(1)))
            yield from top.table(arrow).to_batches()

        found = rows.select("id", "vec").mapInArrow(work, schema)
    # a query's candidates are k from each task or block at most
    top = found.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "id"))), 1, k).alias("t"))
    return top.select("qid", F.posexplode("t").alias("pos", "x")).select("qid", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.m")).alias("score"))


def nearest_named(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(qid, rank, word, score): nearest over rows (word, vec), ties by word."""
    return nearest(queries, rows.select(F.col("word").alias("id"), "vec"), k).select("qid", "rank", F.col("id").alias("word"), "score")


def pair_report(rows: DataFrame, top: int, low: float, high: float, bins: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, score) of the top pairs of all rows, and (bin, n) of pairs from low to high. ``cells`` has both on their own."""
    from . import cells

    return cells.top_pairs(rows, top), cells.pair_counts(rows, low, high, bins)
