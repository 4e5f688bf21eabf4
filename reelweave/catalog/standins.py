"""Retrieval tables derived from the given test tables, in Spark and in SQL.

* frames: ``embeddings`` with one video per label; frame = ``vec_id``.
* lanes: slices of the embedding, compared by cosine.
* queries: the mean vector of each label.
* timeline: ``events`` on a minute grid, one video per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelweave.catalog.registry import cte
from reelweave.operators.vectors import lane_slices, mean_vector, vector_top_k
from reelweave.schema import lane_config
from reelweave.session import cut_lineage, table

DIM = 64
LANE_RANGES = {
    "visual_pe_core": (1, 32),
    "visual_beit3": (33, 64),
    "visual_siglip2": (1, 64),
    "audio": (17, 32),
    "ocr": (49, 64),
    "ocr_semantic": (1, 16),
    "caption": (33, 48),
}
VISUAL_LANES = ["visual_pe_core", "visual_beit3", "visual_siglip2"]
SIGNAL_DEPTH = 50


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(
        F.concat(F.lit("L"), F.col("label"), F.lit("_V001")).alias("video_id"),
        F.col("vec_id").alias("frame_id"),
        F.col("label").cast("bigint").alias("label"),
        "embedding",
    )


def lane_vectors(spark: SparkSession, d: str, lanes: list[str] | None = None) -> DataFrame:
    ranges = {k: v for k, v in LANE_RANGES.items() if lanes is None or k in lanes}
    return lane_slices(frames(spark, d), ranges)


def query_vectors(spark: SparkSession, d: str, lanes: list[str] | None = None) -> DataFrame:
    ranges = {k: v for k, v in LANE_RANGES.items() if lanes is None or k in lanes}
    means = mean_vector(frames(spark, d), ["label"], "embedding", DIM)
    return lane_slices(means, ranges, alias="qv").withColumnRenamed("label", "query_id")


def signals(spark: SparkSession, d: str, lanes: list[str] | None = None, k: int = SIGNAL_DEPTH) -> DataFrame:
    """Top hits with a non-negative score per query and lane."""
    return vector_top_k(lane_vectors(spark, d, lanes), query_vectors(spark, d, lanes), k, 0.0)


def stored_signals(spark: SparkSession, d: str, lanes: list[str] | None = None) -> DataFrame:
    """The signals as a stored table, for queries that use them many times."""
    return cut_lineage(signals(spark, d, lanes))


def lanes(spark: SparkSession) -> DataFrame:
    return lane_config(spark)


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Events on a minute grid: video = user, frame = minutes since 2024-01-01."""
    e = table(spark, d, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200)
    return e.select(
        "event_id",
        F.concat(F.lit("U"), F.col("user_id")).alias("video_id"),
        F.floor(seconds / 60).cast("bigint").alias("frame_id"),
        "event_type",
        "value",
        "props",
        "ts",
        "user_id",
    )


def keyframes(spark: SparkSession, d: str) -> DataFrame:
    """Event-bearing keyframes of the timeline: half-day events over three action types."""
    t = timeline(spark, d).filter(F.col("event_type").isin("view", "click", "purchase"))
    return t.groupBy("video_id", "frame_id").agg(
        F.concat(F.lit("e"), F.floor(F.col("frame_id") / 720)).alias("event_id")
    )


def frame_events(spark: SparkSession, d: str) -> DataFrame:
    """Event-bearing keyframes of the frame table: every frame, 60 frame ids per event."""
    return frames(spark, d).select(
        "video_id", "frame_id", F.concat(F.lit("e"), F.floor(F.col("frame_id") / 60)).alias("event_id")
    )


def _lane_values() -> str:
    return ", ".join(f"('{n}', {lo}, {hi})" for n, (lo, hi) in LANE_RANGES.items())


def _config_values() -> str:
    from reelweave.schema import LANES

    rows = []
    for x in LANES:
        vf = f"'{x.visual_family}'" if x.visual_family else "NULL"
        cut = x.rank_cutoff if x.rank_cutoff is not None else "NULL"
        rows.append(f"('{x.name}', {x.weight}::DOUBLE, {x.floor}::DOUBLE, {x.ceiling}::DOUBLE, '{x.family}', {vf}, {cut}, {str(x.calibrated).lower()})")
    return ", ".join(rows)


cte("lane_dims", f"SELECT * FROM (VALUES {_lane_values()}) t(lane, lo, hi)")
cte("lane_config", f"SELECT * FROM (VALUES {_config_values()}) t(lane, weight, floor, ceiling, family, visual_family, rank_cutoff, calibrated)")
cte(
    "frames",
    "SELECT 'L' || label || '_V001' AS video_id, vec_id AS frame_id, CAST(label AS BIGINT) AS label, "
    "CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
)
cte(
    "lane_vectors",
    "SELECT lane, video_id, frame_id, label, embedding[lo:hi] AS v FROM frames CROSS JOIN lane_dims",
    "frames",
    "lane_dims",
)
cte(
    "label_means",
    "SELECT label AS query_id, list(m ORDER BY i) AS qv FROM (SELECT label, i, avg(x) AS m FROM "
    "(SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM frames) GROUP BY label, i) GROUP BY label",
    "frames",
)
cte(
    "query_vectors",
    "SELECT query_id, lane, qv[lo:hi] AS qv FROM label_means CROSS JOIN lane_dims",
    "label_means",
    "lane_dims",
)
cte(
    "scored",
    "SELECT q.query_id, c.lane, c.video_id, c.frame_id, round(list_cosine_similarity(c.v, q.qv), 6) AS score "
    "FROM lane_vectors c JOIN query_vectors q ON c.lane = q.lane",
    "lane_vectors",
    "query_vectors",
)
cte(
    "signals",
    "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, video_id, frame_id) AS INTEGER) AS rank "
    f"FROM scored WHERE score >= 0) WHERE rank <= {SIGNAL_DEPTH}",
    "scored",
)
cte("visual_signals", "SELECT * FROM signals WHERE lane IN ('visual_pe_core', 'visual_beit3', 'visual_siglip2')", "signals")
cte(
    "cut_signals",
    "SELECT s.*, coalesce(c.weight, 1.0) AS weight, c.floor, c.ceiling, c.family, c.visual_family, c.calibrated FROM signals s "
    "LEFT JOIN lane_config c USING (lane) WHERE c.rank_cutoff IS NULL OR s.rank <= c.rank_cutoff",
    "signals",
    "lane_config",
)
cte(
    "fused",
    "SELECT query_id, video_id, frame_id, round(sum(weight / (30 + rank)), 9) AS score, count(DISTINCT lane) AS n_lanes "
    "FROM cut_signals GROUP BY ALL",
    "cut_signals",
)
cte(
    "timeline",
    "SELECT event_id, 'U' || user_id AS video_id, CAST(floor((epoch(ts) - 1704067200) / 60) AS BIGINT) AS frame_id, "
    "event_type, value, props, ts, user_id FROM events",
)
cte(
    "keyframes",
    "SELECT video_id, frame_id, 'e' || CAST(floor(frame_id / 720) AS BIGINT) AS event_id FROM timeline "
    "WHERE event_type IN ('view', 'click', 'purchase') GROUP BY video_id, frame_id",
    "timeline",
)
cte(
    "frame_events",
    "SELECT video_id, frame_id, 'e' || CAST(floor(frame_id / 60) AS BIGINT) AS event_id FROM frames",
    "frames",
)
