"""Operator 6, language identification of mixed-language text.

Training counts hashed character n-grams and whole words by language in one pass over the labelled documents, into a table
of fixed width, and letters by script and language. To predict, a word's script narrows the candidate languages, the table
scores the word for each of them, and Viterbi with a switching penalty labels the words, so that a span changes language
only where its words make up for the penalty. A document gets the language with most letters; its score is their share.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Ties go to the language that sorts first.
Without any labelled document every text with letters is ``und`` too. Repeated rows are predicted each on its own. Very long
texts count as any other; work is cut into runs of bounded size by whole documents. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: First code points of scripts, in order; each range ends where the next begins.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"),
    (0x3100, "Han"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_AT = np.array([NAMES.index(n) for _, n in SCRIPTS])


def word_of(chunk: str) -> str:
    """The letters of a chunk between white space, in lower case."""
    return chunk.lower() if chunk.isalpha() else "".join(c for c in chunk.lower() if c.isalpha())


ORDERS = (2, 3, 4, 5)


class Flat:
    """Words laid out one after the other with marked ends, for work on all of them at once."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.array([len(w) + 2 for w in words], np.int64)
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.of = np.repeat(np.arange(self.n), self.size)

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, whether it lies within its word) of the gram that starts at each place."""
        m, h = len(self.codes), np.zeros(len(self.codes), np.uint64)
        padded = np.concatenate([self.codes.astype(np.uint64), np.zeros(order, np.uint64)])
        for j in range(order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + m]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64), np.arange(m) + order <= self.end[self.of]

    def scripts(self) -> np.ndarray:
        """Letters of each word (rows) in each script (columns)."""
        inner = (np.arange(len(self.codes)) > self.begin[self.of]) & (np.arange(len(self.codes)) < self.end[self.of] - 1)
        at = SCRIPT_AT[np.searchsorted(STARTS, self.codes[inner], "right") - 1]
        return np.bincount(self.of[inner] * len(NAMES) + at, minlength=self.n * len(NAMES)).reshape(self.n, len(NAMES))


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict:
    """The model: langs, log-probabilities (BUCKETS + 1 x langs), scripts (scripts x langs, letters). Its size is fixed by the number of languages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, own in counts.items():
                total, letters = np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)
                pairs = [(w, n) for c, n in own.items() if (w := word_of(c.decode(errors="replace")))]
                for lo in range(0, len(pairs), 40_000):
                    flat = Flat([w for w, _ in pairs[lo : lo + 40_000]])
                    n = np.array([n for _, n in pairs[lo : lo + 40_000]], np.int64)
                    for order in ORDERS:
                        bucket, ok = flat.grams(order)
                        total += np.bincount(bucket[ok], weights=n[flat.of[ok]], minlength=BUCKETS).astype(np.int64)
                    letters += (flat.scripts() * n[:, None]).sum(0)
                at, sc = np.flatnonzero(total), np.flatnonzero(letters)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (len(at) + len(sc)), pa.string()), pa.array(np.concatenate([at, -1 - sc]).astype(np.int32)), pa.array(np.concatenate([total[at], letters[sc]]))], ["lang", "at", "n"]
                )
            counts.clear()

        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts.setdefault(name, Counter()).update(x.encode(errors="replace").split())
                if sum(map(len, counts.values())) > 400_000:
                    yield from flush()
        yield from flush()

    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    rows = known.mapInArrow(work, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    names, at, n = rows.column("lang").to_pylist(), rows.column("at").to_numpy(), rows.column("n").to_numpy().astype(np.float64)
    langs = sorted(set(names))
    own = np.array([langs.index(x) for x in names], np.int64)
    counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs)))
    up = at >= 0
    counts[at[up], own[up]] = n[up]
    scripts[-1 - at[~up], own[~up]] = n[~up]
    logp = np.log((counts + 0.05) / (counts.sum(0) + 0.05 * BUCKETS))
    none = np.zeros((1, len(langs)))  # the bucket of grams that would leave their word
    return {"langs": langs, "logp": np.concatenate([logp, none]).astype(np.float32), "scripts": scripts}


def candidates(scripts: np.ndarray, least: float = 0.005) -> np.ndarray:
    """Of each script, the languages that have at least so much of their letters in it; all if none has."""
    share = scripts / np.maximum(scripts.sum(0), 1)
    ok = share >= least
    ok[~ok.any(1)] = True
    return ok


def viterbi(scores: np.ndarray, words: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word of documents that lie one after the other in words (rows of scores); switching costs penalty."""
    n, labels = len(lengths), scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    begin = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")  # documents that have a t-th word
    best = np.zeros((n, labels), np.float32)
    stays = np.empty((len(words), labels), bool)
    tops = np.zeros(len(words), np.int16)
    for t, k in enumerate(active):
        at = begin[:k] + t
        v = best[:k]
        if t:
            top = v.argmax(1)
            jump = v[np.arange(k), top] - penalty
            stays[at] = v >= jump[:, None]
            tops[at] = top
            v = np.maximum(v, jump[:, None])
        best[:k] = v + scores[words[at]]
    out = np.zeros(len(words), np.int16)
    state = np.zeros(n, np.int64)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        ends = size[:k] == t + 1
        state[:k] = np.where(ends, best[:k].argmax(1), state[:k])
        at = begin[:k] + t
        out[at] = state[:k]
        if t:
            state[:k] = np.where(stays[at, state[:k]], state[:k], tops[at])
    return out


def identify(docs: DataFrame, model: dict, text: str = "text", penalty: float = 8.0, run_words: int = 2_000_000) -> DataFrame:
    """docs' other columns (those of its columns but text) with lang_pred, score and spans (start, end, lang; of chunks between white space, end excluded)."""
    rest = [c for c in docs.columns if c != text and c not in ("lang_pred", "score", "spans")]
    ordered = docs.select(*rest, F.col(text).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema[:-1]) + ", lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        langs, logp, ok = m["langs"], m["logp"], candidates(m["scripts"]) if len(m["langs"]) else None
        index: dict[bytes, int] = {}
        table, letters = np.zeros((0, max(1, len(langs))), np.float32), np.zeros(0, np.int64)

        def judge(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            words = [word_of(c.decode(errors="replace")) for c in chunks]
            size = np.array([len(w) for w in words], np.int64)
            out = np.zeros((len(words), max(1, len(langs))), np.float32)
            if not langs:
                return out, size
            for lo in range(0, len(words), 50_000):
                flat = Flat(words[lo : lo + 50_000])
                sums = np.zeros((len(flat.codes), len(langs)), np.float32)
                for order in ORDERS:
                    bucket, within = flat.grams(order)
                    sums += logp[np.where(within, bucket, BUCKETS)]
                own = np.where(ok[flat.scripts().argmax(1)], np.add.reduceat(sums, flat.begin, axis=0) / len(ORDERS), np.float32(-1e4))
                own -= own.max(1, keepdims=True)
                out[lo : lo + 50_000] = np.where(size[lo : lo + 50_000, None] > 0, own, 0)
            return out, size

        def label(texts: list[str | None]) -> tuple[list, list, list]:
            nonlocal table, letters
            if len(index) > 300_000:
                index.clear()
                table, letters = table[:0], letters[:0]
            put = index.setdefault
            rows = [np.array([put(c, len(index)) for c in (x or "").encode(errors="replace").split()], np.int32) for x in texts]
            if len(index) > len(letters):
                more, size = judge(list(islice(index, len(letters), None)))
                table, letters = np.concatenate([table, more]), np.concatenate([letters, size])
            lengths = np.array([len(r) for r in rows], np.int64)
            words = np.concatenate(rows) if rows else np.empty(0, np.int32)
            size = letters[words]
            path = viterbi(table, words, lengths, penalty)
            pred, share, spans, at = [], [], [], 0
            for k in lengths.tolist():
                own, n = path[at : at + k], size[at : at + k]
                at += k
                total = int(n.sum())
                if not total or not langs:
                    pred.append("und"), share.append(0.0), spans.append([])
                    continue
                of = np.bincount(own, weights=n, minlength=len(langs))
                top = int(of.argmax())
                pred.append(langs[top]), share.append(float(of[top] / total))
                cut = np.flatnonzero(np.diff(own)) + 1
                spans.append([{"start": int(a), "end": int(b), "lang": langs[own[a]]} for a, b in zip([0, *cut], [*cut, k])])
            return pred, share, spans

        for b in batches:
            at, run, size = 0, [], 0
            texts = b.column(b.num_columns - 1)
            bounds, held = [0], 0
            for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
                held += n or 0
                if held > 5 * run_words:
                    bounds.append(i + 1)
                    held = 0
            for lo, hi in zip(bounds, [*bounds[1:], b.num_rows]):
                if hi > lo:
                    part = b.slice(lo, hi - lo)
                    p, s, sp = label(part.column(b.num_columns - 1).to_pylist())
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(b.num_columns - 1)), pa.array(p, pa.string()), pa.array(s, pa.float64()), pa.array(sp, span)], [*rest, "lang_pred", "score", "spans"])

    return ordered.mapInArrow(work, schema)


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(False))
