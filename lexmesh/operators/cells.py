"""Vector search and pair joins through cells of k-means centers: inverted files (J6, J7) and pivot joins.

Angles between unit vectors obey the triangle inequality, so a row x of a cell with center c lies no nearer to a vector q than
angle(q, c) - angle(x, c) or angle(x, c) - angle(q, c). A cell whose bound is beyond what a query has found already, or beyond
the angle that a pair may have, is never met. A cell of many rows is several blocks of at most about ``knn.ROWS`` rows; a task
holds one block and streams what visits it, so neither side is ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ranks import numbered
from ..storage import settle
from . import knn
from .knn import STEP, STRIP, TILE, dots, matrix, numbers, slack

MOST_CELLS = 4096
SAMPLE = 65_536  # rows that centers are fitted on, at most about
SLACK = 2e-6  # of scores rounded to millionths
VISITS = 8192  # rows in a batch of visits
VISIT = 3000  # dot products that take as long as a row's way to another block, about
PAIRS = "a long, b long, score double"


def runs(b: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Runs of b's rows, so few that a matrix of width columns over them is one tile."""
    step = max(1, min(STEP, TILE // max(1, width)))
    return (b.slice(lo, step) for lo in range(0, b.num_rows, step))


def visiting(names: np.ndarray, b: pa.RecordBatch, i: np.ndarray, j: np.ndarray, own: bool = False) -> Iterator[pa.RecordBatch]:
    """(block, id, vec) of b's rows i at the blocks j, and with own that they are no block's own, a bounded batch at a time."""
    for lo in range(0, len(i), VISITS):
        x, y = pa.array(i[lo : lo + VISITS]), j[lo : lo + VISITS]
        more = ([pa.array(np.zeros(len(y), bool))], ["own"]) if own else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(names[y], pa.string()), b.column(0).take(x), b.column(1).take(x), *more[0]], ["block", "id", "vec", *more[1]])


def angles(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centers.T, -1, 1))


def bounded(b: pa.RecordBatch, least: float, most: float, centers: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray, place: dict[str, int]) -> np.ndarray:
    """For each of b's rows (id, vec, block), whether each later block may hold a row of a cosine from least to most with it."""
    to = angles(matrix(b.column(1)), centers)[:, cells]
    bound = np.maximum(np.maximum(to - high, low - to), 0)
    home = np.array([place[x] for x in b.column(2).to_pylist()], np.int64)
    farthest = np.cos(np.minimum(to + high, np.pi))
    return (np.cos(bound) >= least - SLACK) & (farthest <= most + SLACK) & (np.arange(len(cells)) > home[:, None])


class CellIndex:
    """Rows (id, vec) of unit vectors, dealt to the cells of centers fitted on a bounded sample.

    cells defaults to the square root of the rows, up to ``MOST_CELLS``; rows of one block need no more than one. The sample is
    the rows whose hashed id falls below a bound that about ``SAMPLE`` rows do. table, settled, is (id, vec, cell, angle, block); blocks has a line for each block:
    its cell, rows, and its rows' least and largest angle to the center.
    """

    def __init__(self, rows: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 42, block: int | None = None):
        self.spark, self.kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
        rows, block = rows.select("id", "vec"), block or knn.ROWS
        n = rows.count()
        cells = min(cells or (1 if n <= block else round(n**0.5)), MOST_CELLS)
        centers = self._fit(rows, n, cells, sample, seed)
        self.centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        placed = settle(self._place(rows))
        sizes = placed.groupBy("cell").agg(F.count("*").alias("rows"))
        # a cell's rows are dealt by their ids to as many blocks as they need
        parts = F.broadcast(sizes.select("cell", F.ceil(F.col("rows") / block).alias("parts")))
        numbered_blocks = F.concat_ws(":", "cell", F.pmod(F.xxhash64("id"), F.col("parts")))
        self.table = settle(placed.join(parts, "cell").select("id", "vec", "cell", "angle", numbered_blocks.alias("block")))
        of_blocks = self.table.groupBy("block", "cell").agg(F.count("*").alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("cell", "block").toPandas()
        self.names, self.cells = of_blocks["block"].to_numpy(object), of_blocks["cell"].to_numpy(np.int64)
        self.low, self.high, self.rows = (of_blocks[c].to_numpy() for c in ("low", "high", "rows"))

    def _fit(self, rows: DataFrame, n: int, cells: int, sample: int, seed: int) -> np.ndarray:
        if cells == 1:  # any center will do
            width = rows.select(F.size("vec").alias("n")).limit(1).collect()
            return np.eye(1, width[0]["n"] if width else 1)
        part = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30)))
        some = settle(part.filter(F.exists("vec", lambda x: x != 0)).select(array_to_vector("vec").alias("v")))
        if some.isEmpty():
            width = rows.select(F.size("vec").alias("n")).limit(1).collect()
            return np.eye(1, width[0]["n"] if width else 1)
        model = KMeans(k=cells, seed=seed, maxIter=8, initMode="random", distanceMeasure="cosine", featuresCol="v").fit(some)
        return np.array(model.clusterCenters(), np.float64)

    def _place(self, rows: DataFrame) -> DataFrame:
        sent = self.spark.sparkContext.broadcast(self.centers)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in runs(b, len(sent.value)):
                    a = angles(matrix(part.column(1)), sent.value)
                    at = a.argmin(1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at.astype(np.int32)), pa.array(a[np.arange(len(at)), at])], ["id", "vec", "cell", "angle"])

        return rows.mapInArrow(work, f"id {self.kind}, vec array<double>, cell int, angle double")

    def _meet(self, visitors: DataFrame, task: Callable, schema: str) -> DataFrame:
        """task(rows of a block, its visitors so far) for visitors (block, id, vec, ...), each block's rows first, then its visitors in runs.

        One shuffle brings both together; a task holds the rows of one block.
        """
        extra = [c for c in visitors.columns if c not in ("block", "id", "vec")]
        home = self.table.select("block", F.lit(0).alias("side"), "id", "vec", *[F.lit(None).cast(visitors.schema[c].dataType).alias(c) for c in extra])
        both = home.unionByName(visitors.select("block", F.lit(1).alias("side"), F.col("id").cast(self.kind).alias("id"), "vec", *extra))
        placed = both.repartition("block").sortWithinPartitions("block", "side")

        return knn.meet(placed, task, schema)

    # --- search -------------------------------------------------------------------------------------------------------

    def _routes(self, queries: DataFrame, probes: int, skip: int, bounded: bool) -> DataFrame:
        """(block, id, vec): queries at the blocks of their probes nearest cells after the first skip ones; bounded: where column worst (a cosine) leaves room."""
        sent = self.spark.sparkContext.broadcast((self.centers, self.cells, self.low, self.high, self.names))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers, cells, low, high, names = sent.value
            if not len(names):
                return
            full = np.zeros(len(centers), bool)
            full[cells] = True
            for whole in batches:
                for b in runs(whole, max(len(centers), len(cells))):
                    a = angles(matrix(b.column(1)), centers)
                    order = np.argsort(np.where(full, a, np.inf), axis=1, kind="stable")
                    place = np.empty_like(order)
                    np.put_along_axis(place, order, np.broadcast_to(np.arange(a.shape[1]), a.shape), 1)
                    of = place[:, cells]
                    go = (of >= skip) & (of < skip + probes)
                    if bounded:
                        to = a[:, cells]
                        least = np.maximum(np.maximum(to - high, low - to), 0)
                        go &= np.cos(least) >= b.column(2).to_numpy()[:, None] - SLACK
                    yield from visiting(names, b, *np.nonzero(go))

        cols = ["id", "vec", "worst"] if bounded else ["id", "vec"]
        return queries.select(*cols).mapInArrow(work, f"block string, id {queries.schema['id'].dataType.simpleString()}, vec array<double>")

    def _found(self, visits: DataFrame, k: int, other: bool) -> DataFrame:
        """(qid, id, score): each visit's k best of its block."""
        arrow = pa.string() if self.kind == "string" else pa.int64()

        visits = visits.select("block", F.lit(None).cast(self.kind).alias("id"), "vec", F.col("id").cast("long").alias("qid"))
        return self._meet(visits, knn.search_task(k, other, arrow), f"qid long, id {self.kind}, score double")

    def probes_for(self, queries: DataFrame, k: int, target: float = 0.95, sample: int = 256, other: bool = False) -> int:
        """The fewest cells to search for a sample of queries to keep the share target of their true k nearest."""
        some = settle(queries.select("id", "vec").orderBy(F.xxhash64("id")).limit(sample))
        true = self.exact(some, k, other=other).select("qid", "id").join(self.table.select("id", "cell"), "id").join(some.select(F.col("id").alias("qid"), "vec"), "qid").select("cell", "vec").toArrow()
        if not true.num_rows:
            return 1
        full = np.zeros(len(self.centers), bool)
        full[self.cells] = True
        a = np.where(full, angles(matrix(true.column("vec")), self.centers), np.inf)
        own = a[np.arange(len(a)), true.column("cell").to_numpy()]
        return int(np.quantile((a < own[:, None]).sum(1) + 1, target, method="higher"))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, other: bool = False) -> DataFrame:
        """(qid, rank, id, score), the best k of the rows in each query's nearest cells; probes is ``probes_for`` a recall of 0.95 by default."""
        probes = probes or self.probes_for(queries, k, other=other)
        return best(self._found(self._routes(queries, probes, 0, False), k, other), k)

    def exact(self, queries: DataFrame, k: int, probes: int = 4, other: bool = False) -> DataFrame:
        """(qid, rank, id, score), the k best of all rows: after the first probes, the cells that may hold a better one."""
        queries = queries.select("id", "vec")
        first = settle(self._found(self._routes(queries, probes, 0, False), k, other))
        kth = best(first, k).groupBy(F.col("qid").alias("id")).agg(F.when(F.count("*") == k, F.min("score")).alias("worst"))
        left = queries.join(kth, "id", "left").select("id", "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
        more = self._found(self._routes(left, len(self.centers), probes, True), k, other)
        return best(first.unionByName(more), k)

    # --- pairs --------------------------------------------------------------------------------------------------------

    def _pairs(self, visits: DataFrame, top: int, least: float = -1.5) -> DataFrame:
        """(a, b, score): each block's best pairs of a row and a visitor, a < b, of those that reach least; visits come once for each pair of blocks."""
        return self._meet(visits, pairs_task(top, least), PAIRS)

    def _visits(self, least: float | None, most: float = 1.0) -> DataFrame:
        """Rows at their own block (least None), or at each later block that may hold a row of a cosine from least to most with them."""
        sent = self.spark.sparkContext.broadcast((self.centers, self.cells, self.low, self.high, {b: i for i, b in enumerate(self.names)}, self.names))
        if least is None:
            return self.table.select("block", "id", "vec", F.lit(True).alias("own"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = sent.value[-1]
            for whole in batches:
                for b in runs(whole, max(len(sent.value[0]), len(names))):
                    i, j = np.nonzero(bounded(b, least, most, *sent.value[:-1]))
                    yield from visiting(names, b, i, j, own=True)

        return self.table.select("id", "vec", "block").mapInArrow(work, f"block string, id {self.kind}, vec array<double>, own boolean")

    def _dots(self, least: float, sample: int = 4096) -> tuple[float, float]:
        """About how many visits a cosine of least needs, and how many dot products they take: what a hashed sample of rows has, carried on."""
        part = self.table.filter(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) < int(min(1.0, sample / self.rows.sum()) * (1 << 30)))
        sent = self.spark.sparkContext.broadcast((self.centers, self.cells, self.low, self.high, {b: i for i, b in enumerate(self.names)}, self.rows))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sent.value[-1]
            for whole in batches:
                for b in runs(whole, max(len(sent.value[0]), len(rows))):
                    go = bounded(b, least, 1.0, *sent.value[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array([len(go)]), pa.array([int(go.sum())]), pa.array([int((go @ rows).sum())])], ["n", "visits", "dots"])

        n, visits, products = part.select("id", "vec", "block").mapInArrow(work, "n long, visits long, dots long").agg(F.sum("n"), F.sum("visits"), F.sum("dots")).first()
        return (visits * self.rows.sum() / n, products * self.rows.sum() / n) if n else (0.0, 0.0)

    def top_pairs(self, top: int) -> DataFrame:
        """(a, b, score) of the top pairs of all rows, by rounded score, then ids.

        The best pairs within blocks say how near a pair must be to count; only rows that may have such a partner elsewhere
        visit other blocks. Where that would be so many visits that they cost more than all pairs do by blocks of ``crossed``, those
        meet instead, each row only at half of few large blocks. Ids must be integers.
        """
        order = (F.desc("score"), "a", "b")
        first = settle(self._pairs(self._visits(None), top).orderBy(*order).limit(top))
        if len(self.names) < 2:
            return first.orderBy(*order)
        n, least = first.agg(F.count("*"), F.min("score")).first()
        least = least if n == top else -2.0
        visits, products = self._dots(least)
        rows = int(self.rows.sum())
        g, shares = dealing(self.spark, rows, 4 * knn.ROWS)
        if visits * VISIT + products > rows * rows / 2 + rows * (g / 2 + shares) * VISIT:
            return knn.meet(crossed(self.table.select("id", "vec"), g, shares), pairs_task(top, least, True), PAIRS).orderBy(*order).limit(top)
        more = self._pairs(self._visits(least), top, least)
        return first.unionByName(more).orderBy(*order).limit(top)

    def pair_counts(self, low: float, high: float, bins: int) -> DataFrame:
        """A16 over pairs: (bin, n) of pairs by rounded score from low to high, the last bin closed, every bin present."""

        visits = self._visits(None).unionByName(self._visits(low, high))
        return every_bin(self._meet(visits, counts_task(low, high, bins), "bin int, n long"), bins)


def tally(counts: np.ndarray, low: float, high: float, a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray, own: bool) -> None:
    """Adds to counts, by bin from low to high, the pairs of a row of a and one of b by rounded score; own: only where a's id is the lesser.

    A score in single precision says the bin, unless it is so near an edge that its error matters.
    """
    near, scale = slack(a.shape[1]), len(counts) / (high - low)
    x32, y32 = a.astype(np.float32), b.astype(np.float32)
    step = max(1, TILE // STRIP)
    for x in range(0, len(a), step):
        for y in range(0, len(b), STRIP):
            p, q = a_ids[x : x + step], b_ids[y : y + STRIP]
            if own and p.min() >= q.max():
                continue
            s = x32[x : x + step] @ y32[y : y + STRIP].T
            inside = s >= np.float32(low - near)
            if own:
                inside &= p[:, None] < q[None, :]
            at = np.flatnonzero(inside)
            t = (s.ravel()[at].astype(float) - low) * scale
            edge = np.abs(t - np.rint(t)) <= near * scale
            clear = t[~edge & (t >= 0)]  # the bound on s is itself rounded, so that a score may lie just below it
            counts += np.bincount(clear[clear < len(counts)].astype(np.int64), minlength=len(counts))
            i, j = np.divmod(at[edge], len(q))
            scores = np.round(np.clip(dots(a[x : x + step], i, b[y : y + STRIP], j), -1, 1), 6)
            scores = scores[(scores >= low) & (scores <= high)]
            counts += np.bincount(np.minimum(((scores - low) / (high - low) * len(counts) + 1e-9).astype(np.int64), len(counts) - 1), minlength=len(counts))


def counts_task(low: float, high: float, bins: int, alone: bool = False) -> type:
    """A task for ``knn.meet``: (bin, n) of a block's rows with its visitors; alone: of rows that are marked own with each other."""

    class Counts:
        ALONE = alone

        def __init__(self, rows: pa.Table):
            self.ids, self.v, self.n = numbers(rows.column("id")), matrix(rows.column("vec")), np.zeros(bins, np.int64)
            self.alone = bool(rows.column("own")[0].as_py())

        def meet(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, v, own = numbers(part.column("id")), matrix(part.column("vec")), part.column("own").to_numpy(zero_copy_only=False)
            for mine in (True, False):
                tally(self.n, low, high, ids[own == mine], v[own == mine], self.ids, self.v, mine)
            return iter(())

        def result(self) -> Iterator[pa.RecordBatch]:
            if self.alone:
                by = np.argsort(self.ids, kind="stable")
                tally(self.n, low, high, self.ids[by], self.v[by], self.ids[by], self.v[by], True)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins, dtype=np.int32)), pa.array(self.n)], ["bin", "n"])

    return Counts


def pairs_task(top: int, least: float, alone: bool = False) -> type:
    """A task for ``knn.meet``: the top (a, b, score), a < b, from least on, of a block's rows with its visitors; alone: of rows that are marked own with each other."""

    class Pairs:
        ALONE = alone

        def __init__(self, rows: pa.Table):
            self.rows, self.ids, self.v = rows, numbers(rows.column("id")), matrix(rows.column("vec"))
            self.single = self.v.astype(np.float32)
            self.a = self.b = np.empty(0, np.int64)
            self.score = np.empty(0)

        def meet(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for run in runs(part, min(STRIP, len(self.ids))):
                ids, v, own = numbers(run.column("id")), matrix(run.column("vec")), run.column("own").to_numpy(zero_copy_only=False)
                for lo in range(0, len(self.ids), STRIP):
                    self._tile(ids, v, lo, lambda i, j: ~own[i] | (ids[i] < self.ids[j]))  # a block's own rows meet each other once
            return iter(())

        def _tile(self, ids: np.ndarray, v: np.ndarray, lo: int, once: Callable) -> None:
            bar = max(least, self.score[-1] if len(self.score) >= top else -1.5)
            i, j = np.nonzero(v.astype(np.float32) @ self.single[lo : lo + STRIP].T >= np.float32(bar - slack(v.shape[1])))
            j += lo
            good = once(i, j)
            i, j = i[good], j[good]
            if not len(i):
                return
            scores = np.round(np.clip(dots(v, i, self.v, j), -1, 1), 6)
            if len(i) > 4 * top:
                bar = max(bar, np.partition(scores, len(scores) - top)[len(scores) - top])
            good = scores >= bar
            i, j, scores = i[good], j[good], scores[good]
            x, y = ids[i], self.ids[j]
            a, b, score = (np.concatenate(p) for p in ((self.a, np.minimum(x, y)), (self.b, np.maximum(x, y)), (self.score, scores)))
            at = np.lexsort((b, a, -score))[:top]
            self.a, self.b, self.score = a[at], b[at], score[at]

        def result(self) -> Iterator[pa.RecordBatch]:
            if alone and self.rows.column("own")[0].as_py():
                step = TILE // STRIP
                for first in range(0, len(self.ids), step):
                    for lo in range(first // STRIP * STRIP, len(self.ids), STRIP):
                        self._tile(self.ids[first : first + step], self.v[first : first + step], lo, lambda i, j: (i + first < j) & (self.ids[i + first] != self.ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(self.a), pa.array(self.b), pa.array(self.score)], ["a", "b", "score"])

    return Pairs


def every_bin(found: DataFrame, bins: int) -> DataFrame:
    summed = found.groupBy("bin").agg(F.sum("n").alias("n"))
    return found.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(summed, "bin", "left").fillna(0, ["n"])


def best(found: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, score): of a query's candidates, at most k from each block that it met, the k best by score, then id."""
    top = found.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "id"))), 1, k).alias("t"))
    return top.select("qid", F.posexplode("t").alias("pos", "x")).select("qid", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.m")).alias("score"))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """rows (id, vec) without those that more than most rows of lesser ids are equal to: no pair of theirs can be among the most best."""
    same = rows.select("id", F.concat_ws(":", F.xxhash64("vec"), F.xxhash64(F.lit(5), "vec")).alias("same"))
    crowded = settle(same.groupBy("same").agg(F.count("*").alias("n")).filter(F.col("n") > most + 1).select("same"))
    if crowded.isEmpty():
        return rows
    beyond = numbered(same.join(crowded, "same"), "same", F.col("id")).filter(F.col("pos") > most)
    return rows.join(beyond.select("id"), "id", "left_anti")


def top_pairs(rows: DataFrame, top: int, cells: int | None = None, sample: int = SAMPLE, block: int | None = None) -> DataFrame:
    """(a, b, score) of the top pairs of rows (id, vec), by rounded score, then ids."""
    one = cells is None and rows.limit((block or knn.ROWS) + 1).count() <= (block or knn.ROWS)  # rows of one block need no thinning
    return CellIndex(rows if one else distinct_vectors(rows, top), cells, sample, block=block).top_pairs(top)


def pair_counts(rows: DataFrame, low: float, high: float, bins: int, cells: int | None = None, block: int | None = None) -> DataFrame:
    """(bin, n) of pairs of rows (id, vec) by rounded score from low to high.

    All blocks of rows meet: a task holds one block and streams a share of the later ones past it, so a row travels to half of the
    blocks and once for each share; with cells, only those blocks of a ``CellIndex`` meet that may have such pairs.
    """
    if cells is not None:
        return CellIndex(rows, cells, block=block).pair_counts(low, high, bins)
    rows = settle(rows.select("id", "vec"))
    g, shares = dealing(rows.sparkSession, rows.count(), 4 * (block or knn.ROWS))
    return every_bin(knn.meet(crossed(rows, g, shares), counts_task(low, high, bins, True), "bin int, n long"), bins)


def dealing(spark: SparkSession, n: int, most: int) -> tuple[int, int]:
    """Into how many blocks of about most of n rows ``crossed`` deals, and how many shares keep all cores busy."""
    g = max(1, -(-n // most), min(6, -(-8 * n // most)))
    return g, max(1, min(g - 1, -(-2 * spark.sparkContext.defaultParallelism // g)))


def crossed(rows: DataFrame, g: int, shares: int) -> DataFrame:
    """(block, side, id, vec, own) for ``knn.meet``: rows dealt to g blocks by their ids, each pair of them in one place.

    Task i * (shares + 1) + s holds block i (side 0) and is visited by the blocks j > i with j % shares = s; in the last s it is alone.
    """
    own = rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.lit(g)).cast("int"))
    later = lambda s: (F.col("_own") + 1 < g) & F.exists(F.sequence(F.least(F.col("_own") + 1, F.lit(g - 1)), F.lit(g - 1)), lambda j: j % shares == s)
    shares_of = F.filter(F.sequence(F.lit(0), F.lit(shares)), lambda s: (s == shares) | later(s))
    held = own.select(F.explode(shares_of).alias("_s"), "_own", "id", "vec").select((F.col("_own") * (shares + 1) + F.col("_s")).alias("block"), F.lit(0).alias("side"), "id", "vec", (F.col("_s") == shares).alias("own"))
    earlier = F.explode(F.sequence(F.lit(0), F.col("_own") - 1)).alias("_i")
    visits = own.filter("_own > 0").select(earlier, "_own", "id", "vec").select((F.col("_i") * (shares + 1) + F.col("_own") % shares).alias("block"), F.lit(1).alias("side"), "id", "vec", F.lit(False).alias("own"))
    return held.unionByName(visits).repartitionById(g * (shares + 1), F.col("block")).sortWithinPartitions("block", "side")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(n, found, recall): how many of truth's (qid, id) found has."""
    hit = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.agg(F.count("*").alias("n"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
