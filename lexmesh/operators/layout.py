"""A plane in which neighbours stay neighbours, by a fuzzy neighbour graph and negative sampling (the UMAP objective).

The graph and the layout are of landmarks, a bounded sample of the rows by a hash of their ids; every row then gets its place
from its nearest landmarks, in one pass and without a shuffle. Up to ``LANDMARKS`` rows all are landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import matrix, nearest, numbers

LANDMARKS = 4096
#: The curve 1 / (1 + a d^(2b)) that stands for a least distance of 0.1 in the plane.
A, B = 1.577, 0.8951


def fuzzy(distance: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights of each row's neighbours (n, k), nearest first: 1 for the nearest, and log2(k) in all, by halving on the width of the fall."""
    n, k = distance.shape
    over = np.maximum(distance - distance[:, :1], 0)
    low, high = np.full(n, 1e-9), np.full(n, 1e3)
    for _ in range(rounds):
        mid = np.sqrt(low * high)
        much = np.exp(-over / mid[:, None]).sum(1) > np.log2(k)
        low, high = np.where(much, low, mid), np.where(much, mid, high)
    return np.exp(-over / high[:, None])


def union(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i < j) of the fuzzy union of directed ones: a + b - ab."""
    lo, hi = np.minimum(i, j), np.maximum(i, j)
    keys, at = np.unique(lo * n + hi, return_inverse=True)
    rest = np.ones(len(keys))
    np.multiply.at(rest, at, 1 - w)
    return keys // n, keys % n, 1 - rest


def descend(start: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, epochs: int = 500, negatives: int = 5, seed: int = 42) -> np.ndarray:
    """Places that edges (i, j, w) pull together while random others push away; an edge is drawn each epoch with a chance of w."""
    rng, x, n = np.random.default_rng(seed), start.astype(float).copy(), len(start)
    if n < 2 or not len(i):
        return x
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        go = rng.random(len(i)) < w / w.max()
        a, b = np.concatenate([i[go], j[go]]), np.concatenate([j[go], i[go]])
        d = x[a] - x[b]
        square = (d**2).sum(1)
        pull = -2 * A * B * np.where(square > 0, square, 1) ** (B - 1) / (1 + A * square**B) * (square > 0)
        step = np.zeros_like(x)
        np.add.at(step, a, np.clip(pull[:, None] * d, -4, 4))
        other = rng.integers(0, n, (len(a), negatives))
        d = x[a][:, None, :] - x[other]
        square = (d**2).sum(2)
        push = 2 * B / ((0.001 + square) * (1 + A * square**B)) * (other != a[:, None])
        np.add.at(step, a, np.clip(push[:, :, None] * d, -4, 4).sum(1))
        drawn = np.bincount(a, minlength=n)  # a point moves by the mean of its pulls, times at most the neighbours of a usual one
        x += rate * step / np.maximum(1, drawn / 4)[:, None]
    return x


def principal_plane(v: np.ndarray) -> np.ndarray:
    c = v - v.mean(0)
    _, _, axes = np.linalg.svd(c, full_matrices=False)
    p = c @ axes[:2].T if len(axes) > 1 else np.column_stack([c @ axes[0], np.zeros(len(c))])
    return p / max(np.abs(p).max(), 1e-12) * 10


def neighbour_plane(rows: DataFrame, k: int = 15, landmarks: int = LANDMARKS, epochs: int = 500, seed: int = 42) -> DataFrame:
    """(id, x, y) of rows (id long, vec of unit length). Fewer than k + 1 rows are laid out by their principal axes."""
    if landmarks > LANDMARKS:
        raise ValueError(f"at most {LANDMARKS} landmarks, as they are sent to every task")
    chosen = rows.select("id", "vec").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(landmarks)
    t = chosen.toArrow()
    ids, v = numbers(t.column("id")), matrix(t.column("vec"))
    n = len(ids)
    if not n:
        return rows.sparkSession.createDataFrame([], "id long, x double, y double")
    place = principal_plane(v)
    if n > k:
        own = rows.sparkSession.createDataFrame(t)
        near = nearest(own, own, k, other=True).select("qid", "rank", "id", "score").toPandas().sort_values(["qid", "rank"])
        order = np.argsort(ids)
        at = lambda x: order[np.searchsorted(ids[order], x)]
        i, j = at(near["qid"].to_numpy()), at(near["id"].to_numpy())
        w = fuzzy((1 - near["score"].to_numpy()).reshape(-1, k)).ravel()
        place = descend(place, *union(i, j, w, n), epochs=epochs, seed=seed)
    few = min(k, n)
    sent = rows.sparkSession.sparkContext.broadcast((ids, v, place))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, v, place = sent.value
        by_id = {int(x): p for x, p in zip(own, place)}
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                d = 1 - np.clip(matrix(b.column(1)) @ v.T, -1, 1)
                best = np.argpartition(d, few - 1, axis=1)[:, :few]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1)
                w = fuzzy(np.take_along_axis(d, best, 1)) if few > 2 else np.ones(best.shape)
                xy = (w[:, :, None] * place[best]).sum(1) / w.sum(1)[:, None]
                for row, x in enumerate(b.column(0).to_pylist()):  # landmarks stay where they are
                    if x in by_id:
                        xy[row] = by_id[x]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["id", "x", "y"])

    return rows.select("id", "vec").mapInArrow(work, "id long, x double, y double")
