"""Exact vector retrieval.

Scores are matrix products of Arrow batches. Search over the whole corpus sends bounded
blocks of queries to its splits; search inside videos lets both meet in a grid of bounded
cells. A task returns only the rows that can still be among the first k of a query (ties at
the cut included), so what is shuffled is about k rows per query and task, never query x
corpus, and never the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave.operators.ranking import ranked
from reelweave.session import cut_lineage

QUERY_BLOCK = 512
GRID_ROWS = 32768
#: Bytes of queries sent to all tasks at once, and scores a task holds at once.
ROUND_BYTES = 32 << 20
SCORES_AT_ONCE = 1 << 22
#: From so many queries on, the corpus is dealt out to all cores before it is scored.
MANY_QUERIES = 4096
SCORE_DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector, or null when the norm is zero or a component is not finite."""
    n = norm(v)
    ok = (n > 0) & ~F.isnan(n) & (n < F.lit(float("inf")))
    return F.when(ok, F.transform(v, lambda x: x.cast("double") / n))


def vector_violation(v: Column, dim: int) -> Column:
    """Name of the first broken rule of a vector, null when it is valid."""
    return (
        F.when(v.isNull(), "missing")
        .when(F.size(v) != dim, "dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(norm(v) == 0, "zero_norm")
    )


def mean_vector(df: DataFrame, by: list[str], v: str, dim: int) -> DataFrame:
    """Component-wise mean per group: one partial aggregate, no explode."""
    cells = [F.avg(F.col(v)[i].cast("double")).alias(f"_m{i}") for i in range(dim)]
    means = df.groupBy(*by).agg(*cells)
    return means.select(*by, F.array(*[F.col(f"_m{i}") for i in range(dim)]).alias(v))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(arr)
    flat = np.asarray(arr.flatten(), dtype=np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _candidates(scores: np.ndarray, k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Row/query positions that may belong to the first k of each query column."""
    keep = np.ones_like(scores, dtype=bool)
    if scores.shape[0] > k:
        cut = np.partition(scores, scores.shape[0] - k, axis=0)[scores.shape[0] - k]
        keep = scores >= cut
    if threshold is not None:
        keep &= scores >= threshold
    return np.nonzero(keep)


_HIT = pa.schema(
    [
        ("query_id", pa.int64()),
        ("lane", pa.string()),
        ("video_id", pa.string()),
        ("frame_id", pa.int64()),
        ("score", pa.float64()),
    ]
)
_HIT_DDL = "query_id BIGINT, lane STRING, video_id STRING, frame_id BIGINT, score DOUBLE"


def _score_block(table: pa.Table, qids: np.ndarray, qmat: np.ndarray, lane: str, k: int, threshold: float | None, unit: bool) -> pa.RecordBatch | None:
    x = _matrix(table.column("embedding"))
    if not len(x):
        return None
    if unit:
        x = _unit(x)
    scores = np.round(x @ qmat.T, SCORE_DIGITS) + 0.0
    rows, cols = _candidates(scores, k, threshold)
    if not len(rows):
        return None
    picked = table.select(["video_id", "frame_id"]).take(pa.array(rows))
    return pa.record_batch(
        [
            pa.array(qids[cols]),
            pa.array([lane] * len(rows), pa.string()),
            picked.column("video_id").combine_chunks(),
            picked.column("frame_id").combine_chunks().cast(pa.int64()),
            pa.array(scores[rows, cols]),
        ],
        schema=_HIT,
    )


class _Lane:
    """Queries of one lane, and the k-th best score each has reached in this task."""

    def __init__(self, qids: np.ndarray, qmat: np.ndarray, k: int):
        self.qids, self.qmat, self.k = qids, qmat, k
        self.best = np.full((k, len(qids)), -np.inf)

    def keep(self, scores: np.ndarray, threshold: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Row/query positions that may belong to the first k, ties at the cut included."""
        top = scores if scores.shape[0] <= self.k else np.partition(scores, scores.shape[0] - self.k, axis=0)[-self.k :]
        merged = np.concatenate([self.best, top])
        self.best = np.partition(merged, merged.shape[0] - self.k, axis=0)[-self.k :]
        keep = scores >= self.best.min(axis=0)
        if threshold is not None:
            keep &= scores >= threshold
        return np.nonzero(keep)


def _scan(held: object, k: int, threshold: float | None, cosine: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores a corpus split against the broadcast queries, some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = {lane: _Lane(qids, qmat, k) for lane, (qids, qmat) in held.value.items()}
        for batch in batches:
            names = batch.column("lane")
            for name in names.unique().to_pylist():
                if name not in lanes:
                    continue
                lane = lanes[name]
                part = batch.filter(pc.equal(names, name))
                step = max(1, SCORES_AT_ONCE // max(1, len(lane.qids)))
                for a in range(0, part.num_rows, step):
                    piece = part.slice(a, step)
                    x = _matrix(piece.column("embedding"))
                    scores = np.round((_unit(x) if cosine else x) @ lane.qmat.T, SCORE_DIGITS) + 0.0
                    rows, cols = lane.keep(scores, threshold)
                    if len(rows):
                        at = pa.array(rows)
                        columns = [pa.array(lane.qids[cols]), pa.array([name] * len(rows), pa.string()), piece.column("video_id").take(at), piece.column("frame_id").take(at), pa.array(scores[rows, cols])]
                        yield pa.record_batch(columns, schema=_HIT)

    return run


def vector_hits(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, cosine: bool = True, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Candidate hits that contain the exact top k of every (query, lane).

    ``vectors(lane, video_id, frame_id, embedding)`` x ``queries(query_id, lane,
    qv)``. With ``cosine`` both sides are normalised, else plain inner product.

    The corpus stays where it is: queries are sent to its splits in rounds of at most
    ``round_bytes``, and a split returns only rows that reach the k-th score a query has there.
    Only where there are ``MANY_QUERIES``, which make every row costly, it is first dealt out
    evenly: a file of few row groups would keep a few cores busy.
    With several rounds each one's hits are stored before the next begins.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("lane", "video_id", F.col("frame_id").cast("bigint").alias("frame_id"), "embedding").filter("embedding is not null")
    queries = cut_lineage(queries.select(F.col("query_id").cast("bigint").alias("query_id"), "lane", "qv").filter("qv is not null"))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("qv")).alias("dims")).head()
    rounds = max(1, math.ceil(size["n"] * 8 * (size["dims"] or 1) / round_bytes))
    if size["n"] >= MANY_QUERIES:
        vectors = cut_lineage(vectors.repartition(spark.sparkContext.defaultParallelism, "video_id", "frame_id"))
    found = None
    for turn in range(rounds):
        asked = queries.filter(F.pmod(F.xxhash64("query_id", "lane"), F.lit(rounds)) == turn).toArrow()  # one round's queries
        lanes = {}
        for name in asked.column("lane").unique().to_pylist():
            part = asked.filter(pc.equal(asked.column("lane"), name))
            qmat = _matrix(part.column("qv"))
            lanes[name] = (part.column("query_id").to_numpy(), _unit(qmat) if cosine else qmat)
        held = spark.sparkContext.broadcast(lanes)
        hits = vectors.filter(F.col("lane").isin(list(lanes))).mapInArrow(_scan(held, k, threshold, cosine), _HIT_DDL)
        if rounds > 1:
            hits = cut_lineage(ranked(hits, ["query_id", "lane"], [F.desc("score"), F.asc("video_id"), F.asc("frame_id")], k).drop("rank"))
            held.unpersist()
        found = hits if found is None else found.unionByName(hits)
    return found


def cell_hits(left: DataFrame, right: DataFrame, cell: list[str], k: int, threshold: float | None, cosine: bool) -> DataFrame:
    def score(corpus: pa.Table, wanted: pa.Table) -> pa.Table:
        if not corpus.num_rows or not wanted.num_rows:
            return pa.Table.from_batches([], schema=_HIT)
        qmat = _matrix(wanted.column("qv"))
        hits = _score_block(
            corpus,
            np.asarray(wanted.column("query_id")),
            _unit(qmat) if cosine else qmat,
            corpus.column("lane")[0].as_py(),
            k,
            threshold,
            cosine,
        )
        return pa.Table.from_batches([hits] if hits is not None else [], schema=_HIT)

    # fresh column identities: both sides may stem from the same frame table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(score, _HIT_DDL)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, cosine: bool = True) -> DataFrame:
    """Exact top k per (query, lane): score desc, then video and frame."""
    hits = vector_hits(vectors, queries, k, threshold, cosine)
    return ranked(hits, ["query_id", "lane"], [F.desc("score"), F.asc("video_id"), F.asc("frame_id")], k)


def in_video_top_n(vectors: DataFrame, queries: DataFrame, shortlist: DataFrame, n: int, cosine: bool = True, cell_frames: int = GRID_ROWS) -> DataFrame:
    """Top n frames of every (query, lane, shortlisted video).

    Corpus and queries meet in cells of one video and one frame range, so a
    video with a large share of the corpus is spread over many cells; queries
    of a popular video are spread over slots of bounded size.
    """
    load = shortlist.select("query_id", "video_id").distinct()
    slots = load.groupBy("video_id").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("_slots")
    )
    left = (
        vectors.join(slots, "video_id")
        .withColumn("_v", F.floor(F.col("frame_id") / cell_frames))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)))
        .drop("_slots")
    )
    cells = left.select("lane", "video_id", "_v").distinct()
    right = (
        queries.join(load, "query_id")
        .join(slots, "video_id")
        .withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_slots")).cast("int"))
        .join(cells, ["lane", "video_id"])
        .select(F.col("query_id").cast("bigint").alias("query_id"), "lane", "video_id", "_v", "_q", "qv")
    )
    hits = cell_hits(left, right, ["lane", "video_id", "_v", "_q"], n, None, cosine)
    return ranked(hits, ["query_id", "lane", "video_id"], [F.desc("score"), F.asc("frame_id")], n)


def lane_slices(frames: DataFrame, lanes: dict[str, tuple[int, int]], v: str = "embedding", alias: str = "embedding") -> DataFrame:
    """Explode one wide vector into one row per lane (one-based inclusive ranges)."""
    parts = F.array(
        *[
            F.struct(F.lit(lane).alias("lane"), F.slice(F.col(v), lo, hi - lo + 1).alias(alias))
            for lane, (lo, hi) in lanes.items()
        ]
    )
    keep = [c for c in frames.columns if c != v]
    return frames.select(*keep, F.explode(parts).alias("_p")).select(*keep, "_p.lane", f"_p.{alias}")
