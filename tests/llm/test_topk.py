"""Norm-bucketed top-k against all products."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelweave.llm import queries, topk


def brute(rows, k, every=50):
    good = [(i, np.floor(256 * np.array(e, float)).astype(int)) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q, x in good:
        if q % every == 0:
            found = []
            for i, y in good:
                if i != q:
                    m = min(len(x), len(y))
                    found.append((-int(x[:m] @ y[:m]), i))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return Counter(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, "x", 0) for i, e in rows], "vec_id long, embedding array<float>, norm string, cell int")
    return Counter(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 50 == 0, **kw).collect()))


@pytest.mark.parametrize("kind", ["unit", "long", "copies", "signs"])
def test_against_all_products(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 12))
    if kind == "unit":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "long":
        v *= rng.pareto(1.0, size=(900, 1))
    if kind == "copies":
        v[100:700] = v[50]
    if kind == "signs":
        v = -np.abs(v)
        v[:, 6:] *= -1
    v = v.astype(np.float32)
    rows = [(int(i), [float(x) for x in e]) for i, e in enumerate(v)]
    assert run(spark, rows, cell_rows=40, block_rows=7) == brute(rows, 5)
    assert run(spark, rows) == brute(rows, 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [1.0]), (50, [-1.0, 0.5, 3.0]), (None, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, []) == Counter()
    assert run(spark, [(0, [1.0])]) == Counter()


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])]
    got = run(spark, rows)
    assert got == Counter({(0, 1, 1, 256 * 128): 2, (0, 2, 1, 256 * 128): 2})


def test_pruning_saves_products():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4000, 16)) * rng.pareto(1.0, size=(4000, 1)) * 256
    v = np.floor(v)
    ids = np.arange(4000)
    _, made = topk.search(ids[:40], v[:40], np.full(40, -np.inf), ids, v, 5)
    assert made < 0.6 * 40 * 4000


def test_twin(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = Counter(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.oracle()})").fetchall())
    got = queries.QUERIES["op4_norm_bucket_top_k"](spark, sf).select("query_id", "rank", "vec_id", "score")
    assert Counter(map(tuple, got.collect())) == want
