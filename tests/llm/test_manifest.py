"""The Merkle manifest against a tree built node by node."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexmesh.llm import manifest
from lexmesh.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout=3):
    """(root, for each node its runs from the bottom: digests left of it, digests right of it)."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fanout, len(nodes))) for i in range(0, len(nodes), fanout)]
        for run in runs:
            for j in run:
                for k in below[j]:
                    paths[k].append(("".join(nodes[x] for x in run if x < j), "".join(nodes[x] for x in run if x > j)))
        nodes, below = [H(*(nodes[j] for j in run)) for run in runs], [[k for j in run for k in below[j]] for run in runs]
    return nodes[0], paths


def brute(rows, fanout=3):
    """Rows of op11 by definition, for rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done[s] = (mine, *tree([leaf(r) for r in mine], fanout))
    root, above = tree([done[s][1] for s in order], fanout)
    for s, path in zip(order, above):
        mine, subroot, paths = done[s]
        for r, own in zip(mine, paths):
            whole, acc = own + path, leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                acc = leaf((*r[:4], r[4].replace("\n", "")))
            for a, b in whole:
                acc = H(a, acc, b)
            yield (r[0], leaf(r), subroot, root, H(*(a + b for a, b in whole)), acc, acc == root)


def key(t):
    return tuple(str(x) for x in t)


@pytest.mark.parametrize("sizes", [[1], [3], [1, 1], [2, 4, 83, 1], [250, 7]])
def test_query_by_brute_force(spark, tmp_path, sizes):
    rows = [(i * 7 % 997 + 1000 * g, f"g{g}", "en" if i % 3 else None, i, f"text {i}\nof {g}") for g, n in enumerate(sizes) for i in range(n)]
    spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert len({r[6] for r in got}) == (2 if len(rows) > 8 else len({r[6] for r in got}))


def test_nulls_repeats_and_bytewise_order(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, None, "en", 2, "a\nb"), (1, None, "en", 2, "a\nb"), (1, "é", "x", 1, ""), (2, "z", None, None, "\n"), (2, "", "y", 0, None), (-5, "Z", "y", 3, "ü\n\n"), (None, "Z", "y", 3, "q")]
    spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("fanout", [2, 5])
def test_other_fanouts_and_whole_paths(spark, fanout):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(70)]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], DOCS)
    found = manifest.manifest(df, fanout=fanout).withColumn("again", manifest.fold(F.col("leaf"), F.col("path"))).collect()
    root, paths = tree([leaf(r) for r in rows], fanout)
    assert {r.root for r in found} == {r.again for r in found} == {root}
    assert {r.doc_id: [tuple(p) for p in r.path] for r in found} == dict(enumerate(paths))
