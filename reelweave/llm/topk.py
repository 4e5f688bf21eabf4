"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length (norm): approximate quantiles cut the lengths into
``NORM_BUCKETS`` ranges, and a range is split by a hash of the id into cells of about
``CELL_ROWS`` rows, so equal lengths and copies of one vector spread. Queries form blocks
of about ``BLOCK_ROWS``. Each (cell, block) pair is one bounded task.

Inside a task the cell is sorted by length and cut into pages. A query with a best list
whose k-th score is ``s`` needs, from a page of greatest length ``l``, a cosine above
``s / (|q| l)``: its local threshold. Above 1 the page is skipped. A high threshold is
answered by coordinate pruning: on the query's ``FOCUS`` strongest coordinates a candidate
of that cosine can only have values within bounds that follow from the threshold, and only
candidates within all of them are multiplied out. A low one is answered by length pruning:
the page's rows with ``|v| >= s / |q|``. Products of what is left are computed in whole
numbers and decide. Bounds are widened by a rounding margin, so nothing is lost.

The longest cells run first: the k-th scores they reach (one row per query) are the
starting thresholds for all others. Each task returns at most k rows per query; the last
step ranks those.

Components x become ``floor(256 x)``. Vectors that are null or hold a null or a component
that is not finite take no part; vectors of other dimension count missing components as 0.
Ties go to the smaller id. Repeated ids are rows: a row is never its own candidate, its
equal-id copies are not candidates either. An empty table gives no rows. Other columns do
not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.llm.common import cut_lineage

SCALE = 256
NORM_BUCKETS = 8
CELL_ROWS = 8192
BLOCK_ROWS = 2048
PAGE_ROWS = 1024
FOCUS = 3
#: Cosine thresholds from here on are answered by coordinate pruning.
STEEP = 0.6
MARGIN = 1e-6


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole_numbers(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dims).all():
        return flat.reshape(len(lists), dims)
    out = np.zeros((len(lists), dims))
    row = np.repeat(np.arange(len(lists)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, col] = flat
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole-number inner products; doubles hold them exactly while they are small enough."""
    if not q.size or not v.size or np.abs(q).max() * np.abs(v).max() * max(1, q.shape[1]) < 2**52:
        return (q @ v.T).astype(np.int64)
    return (q.astype(object) @ v.T.astype(object)).astype(np.int64)


class Best:
    """The k best (score, id) per query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, 0), 0, np.int64)
        self.ids = np.full((queries, 0), 0, np.int64)
        self.live = np.zeros((queries, 0), bool)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, live: np.ndarray) -> None:
        """Merge candidates of the queries ``rows``: matrices of one column per candidate."""
        if score.shape[1] > 4 * self.k:  # keep what reaches the k-th score of this batch, ties included
            low = np.where(live, score, -np.iinfo(np.int64).max)
            kth = -np.partition(-low, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            keep = live & (low >= kth)
            width = max(1, int(keep.sum(axis=1).max()))
            if width < score.shape[1]:
                order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
                score, live = np.take_along_axis(score, order, 1), np.take_along_axis(keep, order, 1)
                ids = np.take_along_axis(np.broadcast_to(ids, keep.shape), order, 1)
        n = len(rows)
        score = np.concatenate([self.score[rows], score], axis=1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, (n, ids.shape[-1]))], axis=1)
        live = np.concatenate([self.live[rows], live], axis=1)
        order = np.lexsort((ids, -score, ~live), axis=1)[:, : self.k]
        score, ids, live = (np.take_along_axis(x, order, 1) for x in (score, ids, live))
        if self.score.shape[1] < score.shape[1]:
            grow = score.shape[1] - self.score.shape[1]
            self.score, self.ids, self.live = (np.pad(x, ((0, 0), (0, grow))) for x in (self.score, self.ids, self.live))
        self.score[rows, : score.shape[1]] = score
        self.ids[rows, : ids.shape[1]] = ids
        self.live[rows, : live.shape[1]] = live

    def floor(self, start: np.ndarray) -> np.ndarray:
        """The score a candidate must reach, per query."""
        if self.score.shape[1] < self.k:
            return start
        return np.maximum(start, np.where(self.live[:, self.k - 1], self.score[:, self.k - 1].astype(np.float64), -np.inf))


def search(q_ids: np.ndarray, q: np.ndarray, start: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> tuple[Best, int]:
    """The k best candidates of each query that reach ``start``; also the number of products made."""
    length = np.sqrt((v * v).sum(axis=1))
    order = np.lexsort((v_ids, -length))
    v_ids, v, length = v_ids[order], v[order], length[order]
    q_len = np.sqrt((q * q).sum(axis=1))
    unit_q = q / np.maximum(q_len, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
    best, made = Best(len(q), k), 0
    for a in range(0, len(v), PAGE_ROWS):
        page, page_ids, page_len = v[a : a + PAGE_ROWS], v_ids[a : a + PAGE_ROWS], length[a : a + PAGE_ROWS]
        floor = best.floor(start)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(q_len * page_len[0] > 0, floor / (q_len * page_len[0]), np.where(floor > 0, np.inf, -np.inf))
        alive = need <= 1 + MARGIN
        steep = alive & (need >= STEEP)
        flat = np.flatnonzero(alive & ~steep)
        if len(flat):  # length pruning: rows are sorted, so what is long enough is a prefix
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where(floor[flat] > 0, floor[flat] / q_len[flat], 0.0).min() * (1 - MARGIN)
            n = int(np.searchsorted(-page_len, -shortest, side="right"))
            if n:
                made += len(flat) * n
                best.add(flat, _products(q[flat], page[:n]), page_ids[:n], page_ids[:n][None, :] != q_ids[flat][:, None])
        if steep.any():
            unit = page / np.maximum(page_len, 1e-300)[:, None]
            for i in np.flatnonzero(steep):
                t = min(1.0, need[i])
                # with cos >= t, a coordinate y of the candidate and x of the query obey
                # x y + sqrt(1 - x^2) sqrt(1 - y^2) >= t, so y is within an angle of x
                reach = np.arccos(t) + MARGIN
                ok = np.ones(len(page), bool)
                for d in focus[i]:
                    x = unit_q[i, d]
                    low = np.cos(min(np.pi, np.arccos(np.clip(x, -1, 1)) + reach)) - MARGIN
                    high = np.cos(max(0.0, np.arccos(np.clip(x, -1, 1)) - reach)) + MARGIN
                    ok &= (unit[:, d] >= low) & (unit[:, d] <= high)
                at = np.flatnonzero(ok)
                if len(at):
                    made += len(at)
                    best.add(np.array([i]), _products(q[i : i + 1], page[at]), page_ids[at], page_ids[at][None, :] != q_ids[i])
    return best, made


def _task(k: int):
    def run(key, left: Iterator[pa.RecordBatch] | pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("query_no", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dims = max(max(np.diff(t.column("vector").combine_chunks().offsets.to_numpy()).max() for t in (left, right)), 1)
        q_ids = left.column("vec_id").to_numpy()
        start = left.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
        start = np.where(np.isnan(start), -np.inf, start)
        best, _ = search(q_ids, _matrix(left.column("vector"), dims), start, right.column("vec_id").to_numpy(), _matrix(right.column("vector"), dims), k)
        q, j = np.nonzero(best.live)
        return pa.table([pa.array(q_ids[q]), left.column("query_no").take(pa.array(q)), pa.array(best.ids[q, j]), pa.array(best.score[q, j])], schema=schema)

    return run


def _meet(queries: DataFrame, cells: DataFrame, cell_names: Column, blocks: int, k: int) -> DataFrame:
    """Scores of query blocks against cells: both sides dealt to (cell, block) tasks."""
    left = queries.withColumn("cell", F.explode(cell_names))
    right = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # keyed by one number: Python sees the pair of tables of one (cell, block) at a time
    left = left.select((F.col("cell") * blocks + F.col("block")).alias("task"), "vec_id", "query_no", "vector", "floor")
    right = right.select((F.col("cell") * blocks + F.col("block")).alias("task"), "vec_id", "vector")
    run = _task(k)
    return left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(lambda a, b: run(None, a, b), "query_id long, query_no long, vec_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_no").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of every query row over ``vectors (vec_id, embedding)``."""
    rows = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = cut_lineage(rows.where("vec_id IS NOT NULL").withColumn("norm", norm))
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.percentile_approx("norm", [i / NORM_BUCKETS for i in range(1, NORM_BUCKETS)], 1000).alias("marks")).head()
    n, asked = size["n"], size["q"]
    marks = sorted(set(size["marks"] or []), reverse=True)
    salts = max(1, -(-n // (cell_rows * (len(marks) + 1))))
    blocks = max(1, -(-asked // block_rows))
    # bucket 0 has the longest vectors
    bucket = F.size(F.filter(F.array(*map(F.lit, marks)).cast("array<double>"), lambda m: F.col("norm") < m)) if marks else F.lit(0)
    cells = rows.select("vec_id", "vector", (bucket.cast("long") * salts + F.pmod(F.xxhash64("vec_id"), F.lit(salts))).alias("cell"))
    queries = rows.where("asks").select("vec_id", "vector", "norm")
    # a number of its own tells repeated query rows apart
    queries = cut_lineage(queries.withColumn("query_no", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("query_no"), F.lit(blocks))))
    seeds = cells.where("cell = 0")
    first = cut_lineage(_best(_meet(queries.withColumn("floor", F.lit(None).cast("double")), seeds, F.array(F.lit(0).cast("long")), blocks, k), k))
    if (len(marks) + 1) * salts == 1:
        found = first
    else:
        kth = first.where(F.col("rank") == k).select("query_no", F.col("score").cast("double").alias("floor"))
        ask = queries.join(kth, "query_no", "left")
        # the greatest length in each range of lengths: a range that cannot reach the floor is not asked
        tops = [None, *marks]
        reach = [
            F.when(F.col("floor").isNull() | F.lit(top is None) | (F.col("floor") <= F.col("norm") * F.lit(float(top or 0)) * (1 + MARGIN)), F.sequence(F.lit(b * salts + (1 if b == 0 else 0)).cast("long"), F.lit((b + 1) * salts - 1).cast("long")))
            for b, top in enumerate(tops)
            if not (b == 0 and salts == 1)
        ]
        names = F.flatten(F.filter(F.array(*reach), lambda x: x.isNotNull()))
        found = _meet(ask, cells.where("cell <> 0"), names, blocks, k).unionByName(first.drop("rank"))
    return _best(found.drop("rank"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle(every: int = 50, k: int = 5) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
