"""Centroid clustering with an incremental distance matrix.

Each vector keeps its exact inner products with all centroids. After a round every
centroid has moved by a whole-number difference; the products change by the vector's
product with that difference, taken over its nonzero components only, and a centroid that
has not moved costs nothing. Squared distance is ``|v|^2 - 2 v.c + |c|^2``; the least one,
ties to the smaller number, is the assignment.

A round reads the table of the round before (``vec_id, vector, square, dots, cluster,
distance``), updates it in Arrow batches and writes it to the shared folder; the table before is
deleted then. Sums of members are aggregated on the map side by (cluster) and come to the
driver as one row a cluster: ``clusters x dims`` numbers, whatever the table's size. A
round in which no centroid moves ends the work, since all later ones would repeat it.

Components x become ``floor(256 x)`` and are held within 2 ** 27 on either side, so that
every distance of 64 components fits a long. Vectors that are null, of another number of
components, or with a null or not finite component take no part. Numbers below 2 ** 52 are multiplied in
doubles, which is exact; larger ones in 64-bit whole numbers.

Starting centroids are the vectors with the least hashes of their ids; null ids come last,
equal ids in the order of their components. With fewer vectors than clusters there are as many
clusters as vectors; an empty table gives no rows. Repeated rows are rows. A cluster that loses all
vectors keeps its centroid. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave.session import Stages, cut_lineage

SCALE = 256
LIMIT = 2**27
STATE = "vec_id long, vector array<int>, square long, dots array<long>, cluster int, distance long"


def usable(embedding: Column, dims: int) -> Column:
    """Vectors of ``dims`` components, all of them finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == dims) & ~bad, F.lit(False))


def whole(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(x.cast("double") * SCALE).cast("double"))).cast("int"))


def start_hash(vec_id: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")).cast("binary"), 256)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` in whole numbers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * max(1, a.shape[1]) < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def changed(dots: np.ndarray, vectors: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """``dots`` after the centroids have moved by ``moves``; only nonzero components are multiplied."""
    dots = dots.copy()
    for j in np.flatnonzero((moves != 0).any(axis=1)):
        at = np.flatnonzero(moves[j])
        dots[:, j] += _exact(vectors[:, at], moves[j, at])
    return dots


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.ravel(), kind))


def updater(moves: np.ndarray, centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches of the state after ``moves``, which led to ``centres``."""
    lengths = (centres * centres).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _numbers(batch.column("vector"), centres.shape[1])
            square = batch.column("square").to_numpy()
            dots = batch.column("dots")
            dots = _numbers(dots, len(centres)) if dots.null_count == 0 else np.zeros((len(vectors), len(centres)), np.int64)
            dots = changed(dots, vectors, moves)
            apart = square[:, None] - 2 * dots + lengths[None, :]
            nearest = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    _lists(vectors, pa.int32()),
                    batch.column("square"),
                    _lists(dots, pa.int64()),
                    pa.array(nearest, pa.int32()),
                    pa.array(apart[np.arange(len(apart)), nearest], pa.int64()),
                ],
                names=["vec_id", "vector", "square", "dots", "cluster", "distance"],
            )

    return run


def moved(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centroids as the floored means of their vectors; empty clusters stay."""
    dims = centres.shape[1]
    sums = [F.sum(F.col("vector")[i].cast("long")).alias(f"s{i}") for i in range(dims)]
    out = centres.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # one row a cluster
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return out


def clustered(vectors: DataFrame, *, clusters: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of ``vectors (vec_id, embedding)``."""
    rows = vectors.where(usable(F.col("embedding"), dims)).select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("vector"))
    first = rows.orderBy(start_hash(F.col("vec_id"), seed).asc_nulls_last(), "vector").limit(clusters).collect()  # at most ``clusters`` rows
    centres = np.array([r["vector"] for r in first], np.int64).reshape(len(first), dims)
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    with Stages(vectors.sparkSession) as stages:
        fresh = rows.select("vec_id", "vector", square.alias("square"), F.lit(None).cast("array<long>").alias("dots"))
        state = stages.cut(fresh.mapInArrow(updater(centres, centres), STATE))
        for _ in range(rounds if len(first) else 0):
            after = moved(state, centres)
            moves = after - centres
            if not moves.any():
                break
            before, centres = state, after
            state = stages.cut(before.select("vec_id", "vector", "square", "dots").mapInArrow(updater(moves, centres), STATE))
            stages.drop(before)
        totals = state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # one row a cluster
        digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
        inertia = {r["cluster"]: r["d"] for r in totals}
        facts = vectors.sparkSession.createDataFrame(
            [(j, inertia.get(j, 0), sum(inertia.values()), d) for j, d in enumerate(digests)],
            "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
        )
        # as many rows as there are clusters
        result = state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster")
        return cut_lineage(result.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def oracle(clusters: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2") -> str:
    """The rounds one after the other, every distance from scratch."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1)::INTEGER AS j, e AS c FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) <= {clusters})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, e, j, d FROM (SELECT vec_id, e, j,
  list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS MATERIALIZED (SELECT j, i, floor(sum(x) / count(*)::DOUBLE)::BIGINT AS x FROM (
  SELECT j, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY j, i),
c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(any_value(n.c), any_value(c.c)) AS c FROM c{r} c LEFT JOIN
  (SELECT j, list(x ORDER BY i) AS c FROM m{r} GROUP BY j) n ON c.j = n.j GROUP BY c.j)"""
            )
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.j AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.j)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j"""
