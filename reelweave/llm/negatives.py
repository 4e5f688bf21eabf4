"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction around centres fitted on a bounded sample of anchors. For a
cluster with centre ``c`` and radius ``r`` (the widest angle of a member), no member ``u`` can
score a candidate ``v`` above ``|u| |v| cos(angle(v, c) - r)``. So one list serves the whole
cluster: candidates sorted once by ``|v| cos(angle - r)``. Every member walks that list from
the top, page by page, and is certified done at the first page whose bound times ``|u|`` is
below all that could still change its result.

What can change it is given by *windows*: the best k rows of a score range among rows of the
same label, or of other labels. First one open window of the same label finds the positives;
then one window per positive, from ``low`` to ``high`` per cent of its score, finds the
negatives. A window's need is the greater of its lower end and its k-th score so far; a
member is done when its least need is out of reach.

Anchors are taken in rounds of at most ``ROUND_BYTES`` of vectors, the size of what is
broadcast (and passes the driver) at once. The corpus is never shuffled: a round's tasks read
their splits in Arrow batches, sort each batch once per cluster and keep the best k of
each window over the whole split. Each round first sweeps one row in ``SEEDS``; the k-th
scores found there are where all other rows start, so a split returns only what can still be
among the first k. Those few rows are ranked by anchor and window at the end.

Components x become ``floor(256 x)``; products are exact whole numbers, beyond the range of
a long they are held at its ends. Rows with a null id, label or vector, or a null or not
finite component, take no part. Shorter vectors count missing components as 0, zero vectors score 0.
Ties of a score go to the smaller id. Repeated ids are rows of their own, but a row whose
id is the anchor's is never its positive or negative. An anchor without positives, or
without a row in a window, gives no rows; so do an empty table and a table without anchors.
Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.llm.topk import Best, _matrix, usable, whole_numbers
from reelweave.session import Stages, cut_lineage

SAMPLE = 2000
MEMBERS = 64
MAX_CLUSTERS = 256
ROUND_BYTES = 32 << 20
SEEDS = 16
PAGE_ROWS = 512
LEAST, MOST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
FOUND = "anchor_no long, window_no int, vec_id long, score long"


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole-number inner products; doubles hold them exactly while they are small enough."""
    if not q.size or not v.size or np.abs(q).max() * np.abs(v).max() * q.shape[1] < 2**52:
        return (q @ v.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(q) @ whole(v).T, int(LEAST), int(MOST)).astype(np.int64)


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def angles(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of every vector to every centre of length 1; zero vectors have angle 0."""
    size = lengths(v)
    cosine = (v @ centres.T) / np.where(size > 0, size, 1)[:, None]
    return np.where(size[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)


def directions(v: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Centres of length 1 by spherical k-means, started from vectors spread over ``v``."""
    v = v[lengths(v) > 0]
    if not len(v):
        return np.zeros((1, max(1, v.shape[1])))
    v = v / lengths(v)[:, None]
    centres = v[np.linspace(0, len(v) - 1, min(clusters, len(v))).astype(int)].copy()
    for _ in range(rounds):
        of = (v @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            total = v[of == j].sum(axis=0)
            if np.linalg.norm(total) > 1e-9:
                centres[j] = total / np.linalg.norm(total)
    return centres


class Members:
    """Anchors of a round, with their windows and the best rows found so far.

    ``low`` and ``high`` (anchors x windows) bound a window's scores, ``start`` is the score a
    row must reach because k others are known to; a window that does not exist has a lower
    end above its upper one.
    """

    def __init__(self, no: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, centres: np.ndarray, cluster: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, same: bool):
        self.no, self.ids, self.labels, self.vectors = no, ids, labels, vectors
        self.length = lengths(vectors)
        self.centres, self.same = centres, same
        self.low, self.high, self.start = low, high, start.astype(np.float64)
        angle = angles(vectors, centres)[np.arange(len(cluster)), cluster] if len(cluster) else np.zeros(0)
        self.groups = []
        for c in np.unique(cluster):
            at = np.flatnonzero(cluster == c)
            self.groups.append((int(c), at, float(angle[at].max())))

    def walk(self, best: list[Best], ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> int:
        """Walk the lists of one batch of candidates; the number of products made."""
        size, made = lengths(v), 0
        to_centre = angles(v, self.centres)
        for c, at, radius in self.groups:
            # angles near 0 and 180 degrees are exact to 1e-8 only
            bound = size * (np.cos(np.maximum(0.0, to_centre[:, c] - radius - 1e-6)) + 1e-9)
            order = np.argsort(-bound, kind="stable")
            for a in range(0, len(order), PAGE_ROWS):
                page = order[a : a + PAGE_ROWS]
                need = np.min([self.need(best[w], w, at) for w in range(len(best))], axis=0)
                at = at[self.length[at] * bound[page[0]] * (1 + 1e-9) >= need]
                if not len(at):
                    break
                made += len(at) * len(page)
                self.take(best, at, scores(self.vectors[at], v[page]), ids[page], labels[page])
        return made

    def need(self, best: Best, w: int, at: np.ndarray) -> np.ndarray:
        """The least score that can still enter window ``w``; infinite without such a window."""
        reach = np.maximum(best.floor(self.start[:, w])[at], self.low[at, w].astype(np.float64))
        return np.where(self.low[at, w] > self.high[at, w], np.inf, reach)

    def take(self, best: list[Best], at: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        fits = ((labels[None, :] == self.labels[at][:, None]) == self.same) & (ids[None, :] != self.ids[at][:, None])
        for w, mine in enumerate(best):
            floor = self.need(mine, w, at)
            live = fits & (score >= floor[:, None]) & (score >= self.low[at, w][:, None]) & (score <= self.high[at, w][:, None])
            rows = np.flatnonzero(live.any(axis=1))
            if len(rows):
                cols = np.flatnonzero(live[rows].any(axis=0))
                mine.add(at[rows], score[np.ix_(rows, cols)], ids[cols], live[np.ix_(rows, cols)])


def sweep(held: object, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best rows of a split for every window of the broadcast members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: Members = held.value
        best = [Best(len(members.no), k) for _ in range(members.low.shape[1])]
        dims = members.vectors.shape[1]
        for batch in batches:
            if batch.num_rows:
                members.walk(best, batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("vector"), dims))
        for w, mine in enumerate(best):
            q, j = np.nonzero(mine.live)
            yield pa.RecordBatch.from_arrays(
                [pa.array(members.no[q], pa.int64()), pa.array(np.full(len(q), w), pa.int32()), pa.array(mine.ids[q, j], pa.int64()), pa.array(mine.score[q, j], pa.int64())],
                names=["anchor_no", "window_no", "vec_id", "score"],
            )

    return run


def best_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_no", "window_no").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def per_cent(score: np.ndarray, share: int, up: bool) -> np.ndarray:
    """``share`` per cent of a score, rounded up or down, without leaving the range of a long."""
    whole, rest = score // 100, score % 100
    return whole * share + (-((-rest * share) // 100) if up else (rest * share) // 100)


class Miner:
    """Rounds of anchors over one stored table of candidates."""

    def __init__(self, stages: Stages, rows: DataFrame, dims: int, centres: np.ndarray, k: int):
        self.stages, self.rows, self.dims, self.centres, self.k = stages, rows, dims, centres, k

    def members(self, anchors: pa.Table, windows: int, bounds: dict[tuple[int, int], tuple[int, int]] | None, start: dict[tuple[int, int], int]) -> Members:
        no = anchors.column("anchor_no").to_numpy()
        vectors = _matrix(anchors.column("vector"), self.dims)
        shape = (len(no), windows)
        low, high, begin = np.full(shape, LEAST), np.full(shape, MOST), np.full(shape, -np.inf)
        if bounds is not None:
            low, high = np.full(shape, MOST), np.full(shape, LEAST)
        place = {int(n): i for i, n in enumerate(no)}
        for (n, w), (a, b) in (bounds or {}).items():
            low[place[n], w], high[place[n], w] = a, b
        for (n, w), s in start.items():
            begin[place[n], w] = s
        cluster = angles(vectors, self.centres).argmin(axis=1)
        return Members(no, anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), vectors, self.centres, cluster, low, high, begin, bounds is None)

    def pass_over(self, rows: DataFrame, members: Members) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast(members)
        found = self.stages.cut(best_rows(self.stages.cut(rows.mapInArrow(sweep(held, self.k), FOUND)), self.k))
        held.unpersist()
        return found

    def best(self, anchors: pa.Table, windows: int, bounds: dict[tuple[int, int], tuple[int, int]] | None) -> DataFrame:
        """``anchor_no, window_no, vec_id, score, rank`` of a round's anchors: seeds, then all other rows."""
        seed = F.pmod(F.xxhash64("vec_id"), F.lit(SEEDS)) == 0
        first = self.pass_over(self.rows.where(seed), self.members(anchors, windows, bounds, {}))
        # at most one row per anchor of the round and window
        full = first.where(F.col("rank") == self.k).select("anchor_no", "window_no", "score").collect()
        start = {(r["anchor_no"], r["window_no"]): r["score"] for r in full}
        rest = self.pass_over(self.rows.where(~seed), self.members(anchors, windows, bounds, start))
        return self.stages.cut(best_rows(first.unionByName(rest).drop("rank"), self.k))


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, k: int = 5, low: int = 80, high: int = 100, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` over ``vectors (vec_id, label, embedding)``.

    The first ``k`` positives of each anchor and for each of them the first ``k`` rows of other
    labels that score ``low`` to ``high`` per cent of it.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole_numbers(F.col("embedding")).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks")]
    with Stages(spark) as stages:
        rows = stages.cut(kept.select(*columns))
        size = rows.agg(F.count_if("asks").alias("anchors"), F.max(F.size("vector")).alias("dims")).head()
        dims = max(1, size["dims"] or 0)
        per_round = max(1, round_bytes // (8 * dims))
        turns = max(1, -(-size["anchors"] // per_round))
        anchors = rows.where("asks").select(F.monotonically_increasing_id().alias("anchor_no"), "vec_id", "label", "vector")
        # about ``per_round`` anchors each: the hash decides, so a tenth more is left for chance
        anchors = stages.cut(anchors.withColumn("turn", F.pmod(F.xxhash64("anchor_no"), F.lit(turns if turns == 1 else -(-turns * 11 // 10)))))
        sample = anchors.orderBy(F.xxhash64("anchor_no")).limit(SAMPLE).select("vector").toArrow()
        centres = directions(_matrix(sample.column("vector"), dims), min(MAX_CLUSTERS, -(-size["anchors"] // MEMBERS) or 1))
        miner = Miner(stages, rows.select("vec_id", "label", "vector"), dims, centres, k)
        parts = []
        for turn in range(turns if turns == 1 else -(-turns * 11 // 10)):
            asked = anchors.where(F.col("turn") == turn).drop("turn")
            members = asked.toArrow()  # one round's anchors
            if not members.num_rows:
                continue
            positives = miner.best(members, 1, None)
            known = positives.select("anchor_no", "rank", "score").toArrow()
            score = known.column("score").to_numpy()
            ends = zip(per_cent(score, low, True).tolist(), per_cent(score, high, False).tolist())
            bounds = {(n, r - 1): e for n, r, e in zip(known.column("anchor_no").to_pylist(), known.column("rank").to_pylist(), ends)}
            negatives = miner.best(members, k, bounds)
            pairs = positives.select("anchor_no", (F.col("rank") - 1).alias("window_no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            mined = negatives.select("anchor_no", "window_no", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            named = asked.select("anchor_no", F.col("vec_id").alias("anchor_id"))
            parts.append(stages.cut(mined.join(pairs, ["anchor_no", "window_no"]).join(named, "anchor_no")))
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        if not parts:
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        result = parts[0].select(names)
        for part in parts[1:]:
            result = result.unionByName(part.select(names))
        return cut_lineage(result)


def oracle(every: int = 100, k: int = 5, low: int = 80, high: int = 100) -> str:
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS vec_id, list_inner_product(a.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % {every} = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {k}),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {low} * positive_score <= 100 * s.score AND 100 * s.score <= {high} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {k}"""
