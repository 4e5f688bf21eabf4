"""Hard negatives by shared lists against all products."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelweave.llm import negatives, queries
from reelweave.llm.topk import Best


def brute(rows, k=5, low=80, high=100, every=100):
    good = [(i, y, [int(np.floor(256 * float(x))) for x in e]) for i, y, e in rows if i is not None and y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, e in good:
        if i % every:
            continue
        others = sorted((-dot(e, f), j, z) for j, z, f in good if j != i)
        for s, p, _ in [o for o in others if o[2] == y][:k]:
            fit = [(-t, j) for t, j, z in others if z != y and low * -s <= 100 * -t <= high * -s][:k]
            out += [(i, p, r + 1, j, -s, t) for r, (t, j) in enumerate(fit)]
    return Counter(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, y, e, "x", 0) for i, y, e in rows], "vec_id long, label int, embedding array<float>, turn string, anchor_no int")
    return Counter(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).collect()))


@pytest.mark.parametrize("kind", ["plain", "clustered", "copies", "grid"])
def test_against_all_products(spark, kind):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 8))
    if kind == "clustered":
        v = rng.normal(size=(12, 8))[rng.integers(0, 12, 1500)] + 0.1 * v
    if kind == "copies":
        v[:900] = v[0]
    if kind == "grid":
        v = rng.integers(-1, 2, size=(1500, 8)) / 2
    labels = rng.integers(0, 4, 1500)
    rows = [(int(i), int(y), [float(np.float32(x)) for x in e]) for i, (y, e) in enumerate(zip(labels, v))]
    want = brute(rows)
    assert len(want) > 50
    assert run(spark, rows) == want
    if kind == "grid":
        assert run(spark, rows, round_bytes=8 * 8 * 6) == want  # several rounds


def test_odd_tables(spark):
    nan = float("nan")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.5]), (2, 2, [0.9, 0.5]), (3, None, [1.0, 0.5]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [None, 1.0]), (None, 2, [1.0, 0.5]), (7, 3, [0.95]), (8, 3, []), (9, 1, [-1.0, 0.0]), (100, 5, [0.0, 0.0]), (200, 1, [3.0, 4.0, 5.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == Counter()
    assert run(spark, [(1, 1, [1.0])]) == Counter()
    assert run(spark, [(100, 1, [1.0]), (200, 1, None)]) == Counter()


def test_large_numbers(spark):
    rows = [(i, i % 2, [float(np.float32((i + 1) * 3e4)), -1.0]) for i in range(0, 40)] + [(100, 0, [1e7, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_lists_end_early():
    rng = np.random.default_rng(2)
    centre = np.floor(256 * rng.normal(size=(10, 16)))
    v = centre[rng.integers(0, 10, 6000)] + np.floor(20 * rng.normal(size=(6000, 16)))
    ids, labels = np.arange(6000), rng.integers(0, 3, 6000)
    at = np.arange(0, 6000, 100)
    centres = negatives.directions(v[at], 10)
    cluster = negatives.angles(v[at], centres).argmin(axis=1)
    one = (len(at), 1)
    m = negatives.Members(at, ids[at], labels[at], v[at], centres, cluster, np.full(one, negatives.LEAST), np.full(one, negatives.MOST), np.full(one, -np.inf), True)
    best = [Best(len(at), 5)]
    made = m.walk(best, ids, labels, v)
    assert made < 0.5 * len(at) * 6000
    for n, i in enumerate(at[:10]):
        s = v @ v[i]
        want = sorted((-s[j], j) for j in ids if labels[j] == labels[i] and j != i)[:5]
        assert [(-a, b) for a, b in zip(best[0].score[n], best[0].ids[n])] == want


def test_twin(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    want = Counter(con.execute(f"SELECT {names} FROM ({queries.ORACLE['op11_shared_list_negatives']})").fetchall())
    got = queries.QUERIES["op11_shared_list_negatives"](spark, sf).select(*names.split(", "))
    assert want and Counter(map(tuple, got.collect())) == want
