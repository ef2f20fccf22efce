"""Operator 7, best-fit packing with certified bounds.

Documents become token pieces of at most ``capacity``; pieces are dealt to groups of bounded size, each group is packed by
best-fit decreasing, and dual-feasible functions give a lower bound of the group's bins. A group whose bins equal its bound
is proven and final. A group with a gap keeps its full bins and hands the documents of its other bins to the exchange,
where the open groups are dealt anew, fewer each round, and best-fit decreasing runs again. No step sees more than a group.
Every piece names the bins and the bound of the group that it was packed in last.

Defined cases: a null text counts as empty, so its document is the end token alone. Repeated rows are packed each on its
own (pieces carry their row's key in the exchange, doc_id may repeat or be null). An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "grp long, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, group_bins long, group_bound long, open boolean"

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids of whole texts, as little-endian bytes, by a tokenizer file of the word-end kind.

    Its pre-tokens never span white space, so a text's ids are its chunks' ids in turn, and chunks repeat: a cache holds
    them, in two generations of at most LIMIT chunks. When the young one is full it becomes the old one, and chunks that
    still occur move back from there, so rare chunks leave and frequent ones stay. Chunks of plain Latin letters go to the
    model directly, all others through the tokenizer's whole chain.
    """

    LIMIT = 250_000
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [str(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # the byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.bytes = {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}

    def slow(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, token: str) -> bytes:
        spelled = token if token.isascii() else token.encode().decode("latin-1").translate(self.bytes)
        return np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()

    def part(self, token: str) -> bytes:
        """word of a part of a chunk: marks and stems repeat over chunks."""
        if (got := self.parts.get(token)) is None:
            if len(self.parts) >= self.LIMIT // 10:
                self.parts.clear()
            got = self.parts[token] = self.word(token)
        return got

    def chunk(self, chunk: bytes) -> bytes:
        if (got := self.old.get(chunk)) is None:
            text = chunk.decode()
            if max(text) >= "ɐ" or not text.isprintable():
                got = self.slow(text)
            elif (low := text.lower()).isalpha():
                got = self.word(low)
            else:
                got = b"".join(map(self.part, self.SPLIT.findall(low)))
        if len(self.young) >= self.LIMIT:
            self.old, self.young = self.young, {}
        self.young[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.slow(text)
        make, chunks = self.chunk, text.encode(errors="replace").split()
        return b"".join([got or make(c) for c, got in zip(chunks, map(self.young.get, chunks))])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of at most capacity tokens: PIECES."""
    end = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):  # one text at a time as a Python string
                ids = enc.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(work, PIECES)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, bins from 0: largest first, each to the fullest bin that still takes it."""
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: dict[int, list[int]] = {}  # bins by room left
    rooms: list[int] = []  # the rooms that some bin has, sorted
    bins = 0
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = free[room].pop()
            if not free[room]:
                del rooms[at], free[room]
        else:
            room, b, bins = capacity, bins, bins + 1
        where[i], offset[i] = b, capacity - room
        if left := room - size:
            if left not in free:
                insort(rooms, left)
                free[left] = []
            free[left].append(b)
    return where, offset


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the dual-feasible functions u_k (rounding) and f_k (large items whole)."""
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    length = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * length).sum()) // capacity)
    above = counts[::-1].cumsum()[::-1]  # items of this length or more
    mass = (counts * length).cumsum()
    for k in range(1, capacity // 2 + 1):  # f_k: below k nothing, over capacity-k a whole bin, between them its length
        over = int(above[capacity - k + 1])
        best = max(best, over + -(-int(mass[capacity - k] - mass[k - 1]) // capacity))
    for k in range(1, 21):  # u_k: (k+1)x/C if whole, else floor, all over k
        scaled = (k + 1) * length
        value = np.where(scaled % capacity == 0, length * k, (scaled // capacity) * capacity)  # in units of 1/(k*C)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def pack_groups(pieces: DataFrame, capacity: int, last: bool) -> DataFrame:
    """PACKED for pieces with a column grp: each group packed on its own; bins that stay open are those below capacity of a group whose bins exceed its bound."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = pdf["length"].to_numpy(np.int64)
        where, offset = best_fit_decreasing(sizes, capacity)
        bins, bound = int(where.max()) + 1, lower_bound(sizes, capacity)
        full = np.bincount(where, weights=sizes) >= capacity
        made = pdf.assign(bin=where, offset=offset, group_bins=bins, group_bound=bound, open=(~full[where]) & (bins > bound) & (not last))
        return made[[x.split()[0] for x in PACKED.split(", ")]]

    return pieces.groupBy("grp").applyInPandas(work, PACKED)


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 5_000, rounds: int = 8) -> DataFrame:
    """pieces with sequence_id and offset, and of the group that a piece was packed in last, its bins and their lower bound.

    group_rows bounds a group: pieces are dealt by a hash, so a hot document or source can't fill one group. Each exchange
    deals the open documents of all gapped groups over groups of the same bound; group_bins = group_bound certifies a group.
    Rounds end when no group has a gap, when one group alone saw every open document (nobody is left to exchange with), or
    after ``rounds``; then all bins are final.
    """
    pieces, done = settle(pieces), []
    for k in range(rounds):
        n = pieces.count()
        if k and not n:
            break
        groups = max(1, -(-n // group_rows))
        dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(k), F.monotonically_increasing_id()), F.lit(groups)))
        last = groups == 1 or k == rounds - 1
        packed = settle(pack_groups(dealt, capacity, last))
        done.append(packed.filter("not open").withColumn("sequence_id", (F.col("grp") * F.lit(rounds) + F.lit(k)) * F.lit(1 << 24) + F.col("bin")))
        if last:
            break
        pieces = packed.filter("open").select(*(x.split()[0] for x in PIECES.split(", ")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "group_bins", "group_bound")
