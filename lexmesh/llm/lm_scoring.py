"""Operator 5, language-model scoring by a weighted backoff automaton.

The model is smoothed counts of one, two and three tokens. A state is the last two tokens (the place before a text counts as
one). A token that followed the state in training has an arc; every other token takes the failure arcs to the shorter
histories, down to the root. With c the counts, and N the tokens and V the distinct tokens of training::

    root    p(w)    = (c(w) + 1) / (N + V + 1)                    one more class stands for all tokens never seen
    state   p(w|h)  = (c(hw) + K(h) p(w|h')) / (c(h) + K(h))      h' is h without its first token
    failure weight  = K(h) / (c(h) + K(h)),  K(h) = a max(c(h), 1) ** b

so every state's probabilities add up to one. K grows with the state's count, as the tokens not seen yet after a frequent
history are many. Of ``GRID`` that (a, b) is taken by which the training texts, each scored by the *others* (its own counts taken
off), are the likeliest. Every n-gram of the training texts is an arc, whatever the size of the corpus. ``score`` is by this one
model for all texts; ``others_score`` is a training text's by the others, so that it and held-out texts compare.

How it runs: the model is held whole nowhere. Documents are dealt to blocks of neighbouring rows of like size. A block sends
the keys of its distinct n-grams, with their training counts, to the buckets of the keys' ranges; a bucket adds up and
answers each block, in the order of its keys, how often its n-grams occur in the other blocks. Then
every place of the block's texts has its state's arcs beside it, and each text adds up its log-probabilities. Keys are hashes of
``KEY_BITS`` more bits than the corpus has bytes (63 at most), so two n-grams share one by a chance of 2^-KEY_BITS or so.

Defined cases: a null text is empty, so it is the end token alone. Without training documents every token has probability
one. Repeated rows are scored each on its own; a null in the training column counts as held out. Very long texts are walked
whole, each in a block of its own. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .near_duplicates import GAMMA, mix

END = b"\n"  # no word holds a newline
#: (a, b) of the failure arcs' weights to choose from.
GRID = ((1.0, 1.0), (2.0, 1.0), (4.0, 1.0), (8.0, 1.0), (2.0, 0.8), (4.0, 0.8))
BLOCK_BYTES = 10_000_000  # text of a block is less than twice this, unless it is one text
BUCKET_BYTES = 8_000_000  # text of the corpus for each bucket of keys
KEY_BITS = 20
SPAN = 1 << 20  # bytes hashed at once
END_KEY, BEGIN_KEY = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
with np.errstate(over="ignore"):
    _VALUE = mix(np.arange(1, 257, dtype=np.uint64) * GAMMA)  # of each byte, that of a-z for A-Z
_VALUE[65:91] = _VALUE[97:123]


def tokens_of(text: str | None) -> list[bytes]:
    """A text's tokens one by one, as ``places`` finds them."""
    return (text or "").encode(errors="replace").lower().split() + [END]


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each token, bytes starts to ends of data: a polynomial in the bytes' values, from prefix sums over spans of data."""
    out = np.empty(len(starts), np.uint64)
    power, back = _powers(_BASE, SPAN), _powers(pow(_BASE, -1, 1 << 64), SPAN)
    a = 0
    while a < len(starts):
        low = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, low + SPAN, "right")))
        size = int(ends[b - 1]) - low
        if size > SPAN:  # one token longer than a span
            power, back = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[data[low : low + size]] * power[:size], dtype=np.uint64)])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        a = b
    return out


def places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the text, whether it is the place before a text) of the places of all texts: each has one more than tokens."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = texts.buffers()[2] if n else None
    data = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole and bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(word & (cut[:-1] | ~np.append(False, word[:-1])))
    ends = np.flatnonzero(word & (cut[1:] | ~np.append(word[1:], False))) + 1
    of = np.searchsorted(bounds, starts, "right") - 1
    sizes = np.bincount(of, minlength=n) + 2
    text = np.repeat(np.arange(n, dtype=np.int32), sizes)
    last = np.cumsum(sizes) - 1
    keys = np.empty(len(text), np.uint64)
    keys[np.arange(len(starts)) + 2 * of + 1] = token_hashes(data, starts, ends)
    keys[last] = END_KEY
    begin = np.zeros(len(text), bool)
    begin[last - sizes + 1] = True
    keys[begin] = BEGIN_KEY
    return keys, text, begin


def grams(texts: pa.Array, order: int, bits: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """(keys, which places have one) of the n-grams of one to order tokens that end in each place; number of the text, place before a text.

    The two lowest bits of a key are the tokens less one, or 3 for the place before a text.
    """
    t, text, begin = places(texts)
    short = lambda x, kind: (x >> np.uint64(66 - bits) << np.uint64(2)) | np.asarray(kind, np.uint64)
    keys, there = [short(t, np.where(begin, 3, 0))], [np.ones(len(t), bool)]
    before = t
    for k in range(1, order):
        now = np.zeros(len(t), np.uint64)
        now[1:] = mix(before[:-1] * GAMMA + t[1:] + np.uint64(k))
        keys.append(short(now, k))
        there.append(~begin & np.append(False, there[-1][:-1]) if k > 1 else ~begin)
        before = now
    return keys, there, text, begin


def packed(x: np.ndarray) -> bytes:
    """Whole numbers of at least 0: how many bytes the largest needs, then their planes, least byte first, compressed."""
    n = (int(x.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T)
    return bytes([n]) + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if n and len(x) else b"")


def unpacked(x: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and x[0]:
        out[:, : x[0]] = np.frombuffer(pa.decompress(x[1:], x[0] * n, "zstd", asbytes=True), np.uint8).reshape(-1, n).T
    return out.view("<u8")[:, 0]


BLOCKS = "block long, heads binary, texts binary"


def in_blocks(docs: DataFrame, doc_id: str, text: str, train: str) -> DataFrame:
    """BLOCKS: rows packed by block; neighbouring rows of a file of one size class (by powers of two) make a block."""
    cols = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train")]
    kind = F.greatest(F.lit(9), F.floor(F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1))).cast("int")
    rows = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / F.pow(F.lit(2.0), kind))).cast("long")
    try:
        placed = docs.select(*cols, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        placed.schema
    except AnalysisException:  # rows of no file are written first
        placed = settle(docs.select(*cols, F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")))
    placed = placed.select(F.xxhash64("file", kind, F.floor(F.col("at") / rows)).alias("block"), "doc_id", "text", "train")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(block[order]) != 0, True)) + 1 if len(block) else []
            for lo, hi in zip([0, *ends], ends):
                part = b.take(pa.array(order[lo:hi]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(block[order[lo]])]), pa.array([framed(part.select([1, 3]))], pa.binary()), pa.array([framed(part.select([2]))], pa.binary())],
                    ["block", "heads", "texts"],
                )

    return placed.mapInArrow(work, BLOCKS)


def framed(batch: pa.RecordBatch) -> bytes:
    """An Arrow stream of one batch, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def block_rows(packed_rows: pa.Table) -> pa.Table:
    """(doc_id, train, text) of a block's packed rows."""
    read = lambda name: pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packed_rows.column(name).to_pylist()])
    return read("heads").append_column("text", read("texts").column(0)).combine_chunks()


def one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def flat(keys: list[np.ndarray], there: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([k[t] for k, t in zip(keys, there)])


def requests(blocks: DataFrame, order: int, bits: int, buckets: int) -> DataFrame:
    """(bucket, block, size, keys, n): the distinct n-grams of each block as differences of sorted keys, and their counts in its training texts."""

    def work(rows: pa.Table) -> pa.Table:
        docs = block_rows(rows)
        keys, there, text, _ = grams(one(docs.column("text")), order, bits)
        learn = docs.column("train").to_numpy()[text]
        marked = np.sort(flat(keys, there) << np.uint64(1) | flat([learn] * len(keys), there).astype(np.uint64))  # whether it teaches: the lowest bit
        first = np.flatnonzero(np.append(True, np.diff(marked >> np.uint64(1)) != 0))
        u, n = marked[first] >> np.uint64(1), np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)
        bucket = ((u >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        ends = np.flatnonzero(np.append(np.diff(bucket) != 0, True)) + 1
        starts = np.append(0, ends[:-1])
        delta = lambda a, b: packed(np.diff(u[a:b], prepend=np.uint64(0)))
        block = rows.column("block")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array(bucket[starts]), pa.array(np.full(len(starts), block)), pa.array(ends - starts)]
            + [pa.array([f(a, b) for a, b in zip(starts, ends)], pa.binary()) for f in (delta, lambda a, b: packed(n[a:b]))],
            ["bucket", "block", "size", "keys", "n"],
        )

    return blocks.groupBy("block").applyInArrow(work, "bucket long, block long, size long, keys binary, n binary")


def answers(asked: DataFrame) -> DataFrame:
    """(block, bucket, size, others, n, v): in the order of the keys asked, their counts in other blocks; tokens and distinct tokens, once a bucket."""

    def work(t: pa.Table) -> pa.Table:
        sizes = t.column("size").to_numpy()
        read = lambda name: [unpacked(x, n) for x, n in zip(t.column(name).to_pylist(), sizes)]
        keys, own = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in read("keys")]), np.concatenate(read("n")).astype(np.int64)
        u, at = np.unique(keys, return_inverse=True)
        c = np.bincount(at, own, len(u)).astype(np.int64)
        others = c[at] - own
        ends = np.cumsum(sizes)
        token = (u & np.uint64(3) == 0) & (c > 0)
        once = lambda x: pa.array([int(x)] + [0] * (len(sizes) - 1), pa.int64())
        made = pa.array([packed(others[b - n : b]) for b, n in zip(ends, sizes)], pa.binary())
        return pa.Table.from_arrays([t.column("block"), t.column("bucket"), t.column("size"), made, once(c[token].sum()), once(token.sum())], ["block", "bucket", "size", "others", "n", "v"])

    return asked.groupBy("bucket").applyInArrow(work, "block long, bucket long, size long, others binary, n long, v long")


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, others_score double, backoff_scale double, backoff_power double"
SCORED_BY_GRID = SCORED[: SCORED.index(", score double")] + ", scores array<double>, others array<double>"


def score_blocks(blocks: DataFrame, answered: DataFrame, order: int, bits: int, n: int, v: int, grid: tuple[tuple[float, float], ...]) -> DataFrame:
    """SCORED_BY_GRID of every row: each block's texts beside the answers to its n-grams, scored with every weight of grid."""

    def work(rows: pa.Table, answered: pa.Table) -> pa.Table:
        docs = block_rows(rows)
        keys, there, text, begin = grams(one(docs.column("text")), order, bits)
        train = docs.column("train").to_numpy()
        learn = train[text]
        every, whose = flat(keys, there), flat([text] * len(keys), there)
        u, at = np.unique(every, return_inverse=True)
        teaches = train[whose]
        got = sorted(zip(answered.column("bucket").to_pylist(), answered.column("size").to_pylist(), answered.column("others").to_pylist()))
        c = np.bincount(at, teaches, len(u)) + np.concatenate([unpacked(x, size) for _, size, x in got]).astype(np.float64)
        _, at_own, own = np.unique(mix(every + mix(whose.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
        whole, other = c[at], c[at] - np.where(teaches, own[at_own], 0)  # with and without the text's own
        size = len(docs)
        place = ~begin
        add = lambda x: np.bincount(text[place], x[place], size)
        lengths = add(np.ones(len(text)))
        known = whole[: len(text)]

        def by_grid(seen: np.ndarray, n: np.ndarray | int) -> np.ndarray:
            """log10 of each text's probability by the counts seen, a column for each weight."""
            counts, first = [], 0
            for t in there:  # back to places
                k = np.zeros(len(text))
                k[t] = seen[first : first + t.sum()]
                counts.append(k)
                first += int(t.sum())
            root = (counts[0] + 1) / (n + v + 1)
            histories = [np.append(0.0, counts[k - 1][:-1]) for k in range(1, order)]
            out = []
            for scale, power in grid:
                p = root
                for k, history in enumerate(histories, 1):
                    weight = np.maximum(history, 1)
                    weight = scale * (weight if power == 1 else weight**power)
                    p = np.where(there[k], (counts[k] + weight * p) / (history + weight), p)
                out.append(add(np.log10(p)))
            return np.array(out).T

        scores = by_grid(whole, n)
        others = by_grid(other, (n - lengths * train)[text]) if train.any() else scores
        nested = lambda x: pa.array(list(x), pa.list_(pa.float64()))
        return pa.Table.from_arrays(
            [
                docs.column("doc_id"), pa.array(~train), pa.array(lengths.astype(np.int64)), pa.array(add((known > 0).astype(float)).astype(np.int64)), pa.array(np.full(size, n)),
                pa.array(add(np.log10((known + 1) / (n + v + 1)))), nested(scores), nested(others),
            ],
            [x.split()[0] for x in SCORED_BY_GRID.split(", ")],
        )

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(work, SCORED_BY_GRID)


def score_texts(docs: DataFrame, train: str, doc_id: str = "doc_id", text: str = "text", order: int = 3, grid: tuple[tuple[float, float], ...] = GRID) -> DataFrame:
    """SCORED of every row; train names a boolean column: the rows to learn from. order: the longest n-grams, in tokens, up to 3."""
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])
    bits = min(63, max(40, size.bit_length() + KEY_BITS))
    blocks = in_blocks(docs, doc_id, text, train)
    answered = settle(answers(requests(blocks, order, bits, 1 + size // BUCKET_BYTES)))
    n, v = answered.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    scored = settle(score_blocks(blocks, answered.select("block", "bucket", "size", "others"), order, bits, int(n), int(v), grid))
    # the weight by which the training texts are the likeliest, the first on ties
    sums = scored.filter(~F.col("held_out")).agg(*[F.round(F.sum(F.get("others", k)), 3).alias(str(k)) for k in range(len(grid))]).first()
    best = max(range(len(grid)), key=lambda k: (sums[k] or 0.0, -k))
    chosen = {"score": F.get("scores", best), "others_score": F.get("others", best), "backoff_scale": F.lit(grid[best][0]), "backoff_power": F.lit(grid[best][1])}
    return scored.withColumns(chosen).select(*(x.split()[0] for x in SCORED.split(", ")))
