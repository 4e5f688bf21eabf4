"""Incremental clustering against rounds from scratch."""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from reelweave.llm import centroids, queries
from reelweave.session import shared_folder


def brute(rows, clusters, rounds, dims):
    good = [(i, [int(np.clip(np.floor(256 * float(x)), -(2**27), 2**27)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(e) for _, e in order[:clusters]]
    apart = lambda e, c: sum((a - b) ** 2 for a, b in zip(e, c))

    def assign():
        return [min(range(len(centres)), key=lambda j: (apart(e, centres[j]), j)) for _, e in good]

    for _ in range(rounds):
        of = assign()
        for j in range(len(centres)):
            mine = [e for (_, e), k in zip(good, of) if k == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    of = assign()
    d = [apart(e, centres[j]) for (_, e), j in zip(good, of)]
    per = Counter()
    for j, x in zip(of, d):
        per[j] += x
    return Counter((i, j, x, per[j], sum(d), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), j, x in zip(good, of, d))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, 1, "x", 2) for i, e in rows], "vec_id long, embedding array<float>, cluster int, vector string, s0 int")
    return Counter(map(tuple, centroids.clustered(df, **kw).collect()))


@pytest.mark.parametrize("kind", ["plain", "copies", "grid", "large"])
def test_rounds(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6))
    if kind == "copies":
        v[:200] = v[0]
    if kind == "grid":  # many equal distances
        v = rng.integers(0, 2, size=(300, 6))
    if kind == "large":
        v *= 4e5
    rows = [(int(i), [float(np.float32(x)) for x in e]) for i, e in enumerate(v)]
    assert run(spark, rows, clusters=7, rounds=4, dims=6) == brute(rows, 7, 4, 6)


def test_odd_tables(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [-1.0, 2.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, [1.0]), (None, [0.5, 0.5]), (8, [1e30, -1e30]), (9, [0.0, 0.0])]
    assert run(spark, rows, clusters=3, rounds=5, dims=2) == brute(rows, 3, 5, 2)
    assert run(spark, rows, clusters=40, rounds=5, dims=2) == brute(rows, 40, 5, 2)
    assert run(spark, [], clusters=3, rounds=5, dims=2) == Counter()


def test_only_changed_components_are_multiplied():
    rng = np.random.default_rng(0)
    v, c = rng.integers(-300, 300, size=(50, 8)), rng.integers(-300, 300, size=(4, 8))
    moves = np.zeros((4, 8), np.int64)
    moves[1, [2, 5]] = 7, -3
    v2 = v.copy()
    v2[:, [0, 1, 3, 4, 6, 7]] = 10**9  # must not be read
    assert (centroids.changed(v @ c.T, v2, moves) == v @ (c + moves).T).all()
    assert (centroids._exact(np.full((1, 2), 2**40), np.array([2**20, 1])) == [2**60 + 2**40]).all()


def test_stage_tables_are_deleted(spark):
    left = lambda: {x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith("job-")}
    before = left()
    run(spark, [(i, [float(i), 1.0]) for i in range(20)], clusters=3, rounds=3, dims=2)
    assert left() == before


def test_twin(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    names = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    want = Counter(con.execute(f"SELECT {names} FROM ({queries.ORACLE['op12_incremental_centroids']})").fetchall())
    got = queries.QUERIES["op12_incremental_centroids"](spark, sf).select(*names.split(", "))
    assert Counter(map(tuple, got.collect())) == want
