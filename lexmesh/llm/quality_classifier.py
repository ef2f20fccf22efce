"""Operator 9, quality by hierarchical empirical Bayes.

A document's own evidence is a logistic model of its text, fitted on at most ``sample`` labelled documents. Its site adds a
prior: the rate of good documents of its host, shrunk towards the global rate, and that of its path, shrunk towards its
host's. How far they shrink is estimated from how much the rates differ between sites beyond chance, by grouped sums alone.
A labelled document's own labels are taken off its sites' sums, so they don't judge it.
Posterior log-odds are the document's, plus the path's, minus the global ones that the text model already holds.

Defined cases: a null text is empty; a null host or path is one of its own; a site without labels has its parent's rate.
Labels without a document, or null, don't count; with labels of one kind or none there is no evidence and sites shrink to
the global rate (0.5 without labels). Repeated rows are judged each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle

DENSE = ("log_length", "symbol_share", "bar_share", "caps_share", "digit_share", "word_length", "fresh_share", "stop_share")
SYMBOLS, CAPITALS, DIGITS, STOPS, BAR = b"#*$%&<>{}=~^\\!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?", b"|"

_buckets: dict[bytes, int] = {}


def bucket_of(chunk: bytes, hashed: int) -> int:
    """Bucket of the chunk's letters and digits in lower case; -1 without any."""
    word = "".join(c for c in chunk.decode(errors="replace").lower() if c.isalnum())
    return zlib.crc32(word.encode()) % hashed if word else -1


def measure(text: str | None, hashed: int) -> tuple[list[float], list[int]]:
    """(the DENSE measures, sorted buckets of the words that occur)."""
    raw = (text or "").encode(errors="replace")
    chunks = raw.split()
    distinct = set(chunks)
    if len(_buckets) > 200_000:
        _buckets.clear()
    get, found = _buckets.get, set()
    for c in distinct:
        if (k := get(c)) is None:
            k = _buckets[c] = bucket_of(c, hashed)
        found.add(k)
    found.discard(-1)
    n, size = max(1, len(raw)), max(1, len(chunks))
    share = lambda marks: (len(raw) - len(raw.translate(None, marks))) / n
    dense = [math.log1p(len(raw)) / 10, share(SYMBOLS) * 10, share(BAR) * 10, share(CAPITALS) * 5, share(DIGITS) * 5, n / size / 10, len(distinct) / size, share(STOPS) * 10]
    return dense, sorted(found)


def training_vectors(docs: DataFrame, text: str, hashed: int) -> DataFrame:
    """docs' other columns with the sparse vector _features."""
    rest = [c for c in docs.columns if c != text]
    ordered = docs.select(*rest, text)
    schema = T.StructType([*ordered.schema.fields[:-1], T.StructField("_features", VectorUDT())])
    size = len(DENSE) + hashed

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [measure(x, hashed) for x in b.column(len(rest)).to_pylist()]
            places = [[*range(len(DENSE)), *(len(DENSE) + k for k in found)] for _, found in made]
            values = [[*dense, *[1.0] * len(found)] for dense, found in made]
            fields = [pa.array([0] * len(made), pa.int8()), pa.array([size] * len(made), pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.StructArray.from_arrays(fields, ["type", "size", "indices", "values"])], schema.names)

    return ordered.mapInArrow(work, schema)


def text_scores(docs: DataFrame, models: dict[str, tuple[np.ndarray, float] | None], text: str, hashed: int) -> DataFrame:
    """docs' columns but text, and NAME_text for each model (null for none): weights and intercepts, of fixed size, go to every task."""
    rest = [c for c in docs.columns if c != text]
    ordered = docs.select(*rest, text)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema[:-1]] + [f"{t}_text double" for t in models])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = list(sent.value.items())
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                scores: list[list[float | None]] = [[] for _ in fitted]
                for x in b.column(len(rest)).to_pylist():
                    dense, found = measure(x, hashed)
                    at = np.array(found, np.int64) + len(DENSE)
                    for out, (_, m) in zip(scores, fitted):
                        out.append(None if m is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, m[1] + float(np.dot(m[0][: len(DENSE)], dense)) + float(m[0][at].sum()))))))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), *(pa.array(o, pa.float64()) for o in scores)], [*rest, *(f"{t}_text" for t, _ in fitted)])

    return ordered.mapInArrow(work, schema)


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def strength(groups: DataFrame, mean: Column) -> float:
    """How many labelled documents the parent's rate is worth, by moments of the children's: (n, good, mean) by group."""
    n, good, m = F.col("n"), F.col("good"), mean
    between = F.sum(n * (good / n - m) ** 2) - F.sum(m * (1 - m))
    room, within = F.sum(n - 1), F.sum(n * m * (1 - m))
    b, r, w = groups.agg(between, room, within).first()
    if not r or not w:
        return 50.0
    rho = max(1e-4, min(0.99, (b or 0.0) / max(1e-9, w * r / max(1.0, r + 1)))) if b and b > 0 else 1e-3
    return min(5000.0, max(1.0, (1 - rho) / rho))


def site_counts(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float, float, float]:
    """((host, hn, hgood), (host, path, pn, pgood), the global rate, strengths of host and path priors) of labelled (host, path, y)."""
    by_path = settle(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").cast("double").alias("good")))
    paths = by_path.select("host", "path", F.col("n").alias("pn"), F.col("good").alias("pgood"))
    n, good = by_path.agg(F.sum("n"), F.sum("good")).first()
    hosts = settle(by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    if not n:
        return hosts.select("host", F.col("n").alias("hn"), F.col("good").alias("hgood")), paths, 0.5, 50.0, 50.0
    rate = min(1 - 1e-3, max(1e-3, good / n))
    at_host = strength(hosts, F.lit(rate))
    rated = hosts.select("host", ((F.col("good") + at_host * rate) / (F.col("n") + at_host)).alias("host_rate"))
    at_path = strength(by_path.join(rated, "host"), F.col("host_rate"))
    return hosts.select("host", F.col("n").alias("hn"), F.col("good").alias("hgood")), paths, rate, at_host, at_path


def shrunk(n: str, good: str, parent: Column | float, strength: float) -> Column:
    """A site's rate drawn towards its parent's, without the document's own labels (own_n, own_good)."""
    taken = lambda c, own: F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.coalesce(F.col(own).cast("double"), F.lit(0.0)))
    return (taken(good, "own_good") + F.lit(strength) * parent) / (taken(n, "own_n") + F.lit(strength))


def classify(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality",), doc_id: str = "doc_id", text: str = "text", host: str = "host", path: str = "path", sample: int = 20_000, hashed: int = 1 << 16) -> DataFrame:
    """(doc_id, and for each target: target_text, target_host, target_path, target, all probabilities of label 1) of every row."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.coalesce(F.col(path), F.lit("")).alias("path"))
    kinds = [F.col(t).cast("double").alias(f"y_{t}") for t in targets]
    known = labels.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), *kinds)
    n = known.count()
    part = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, sample / max(n, 1))))
    train = settle(training_vectors(base.filter(part).join(known.filter(part), "doc_id"), "text", hashed).select("_features", *(f"y_{t}" for t in targets)))
    models: dict[str, tuple[np.ndarray, float] | None] = {}
    for t in targets:
        own = train.filter(F.col(f"y_{t}").isNotNull())
        if own.select(f"y_{t}").distinct().count() < 2:
            models[t] = None
        else:
            fit = LogisticRegression(featuresCol="_features", labelCol=f"y_{t}", maxIter=25, regParam=2e-3, standardization=False).fit(own)
            models[t] = (fit.coefficients.toArray(), float(fit.intercept))
    scored = settle(text_scores(base, models, "text", hashed))
    sited = settle(scored.select("doc_id", "host", "path").filter("doc_id is not null").join(known, "doc_id"))
    for t in targets:
        y = F.col(f"y_{t}")
        hosts, paths, rate, k_host, k_path = site_counts(sited.filter(y.isNotNull()).select("host", "path", y.alias("y")))
        own = known.filter(y.isNotNull()).groupBy("doc_id").agg(F.count("*").alias("own_n"), F.sum(y).alias("own_good"))
        x = scored.join(hosts, "host", "left").join(paths, ["host", "path"], "left").join(own, "doc_id", "left")
        x = x.withColumn(f"{t}_host", shrunk("hn", "hgood", F.lit(rate), k_host)).withColumn(f"{t}_path", shrunk("pn", "pgood", F.col(f"{t}_host"), k_path))
        odds = F.coalesce(logit(F.col(f"{t}_text")), F.lit(math.log(rate / (1 - rate)))) + logit(F.col(f"{t}_path")) - F.lit(math.log(rate / (1 - rate)))
        scored = x.withColumn(t, 1 / (1 + F.exp(-odds))).drop("hn", "hgood", "pn", "pgood", "own_n", "own_good")
    return scored.select("doc_id", *(f"{t}{x}" for t in targets for x in ("_text", "_host", "_path", "")))
