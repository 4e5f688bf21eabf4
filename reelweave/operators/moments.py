"""Temporal pairs, neighbour context, hierarchies and moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.operators.ranking import best_row, ranked
from reelweave.operators.timeline import neighbour_totals
from reelweave.schema import DEFAULT_FPS

EPS = 1e-9


def with_fps(hits: DataFrame, videos: DataFrame) -> DataFrame:
    """Frames per second of each hit's video; missing or non-positive gives 25."""
    rate = videos.select("video_id", F.when(F.col("fps") > 0, F.col("fps")).alias("fps"))
    return hits.join(rate, "video_id", "left").withColumn("fps", F.coalesce("fps", F.lit(DEFAULT_FPS)))


def segment_key(video_id: Column, frame_id: Column, fps: Column, seconds: float) -> Column:
    """Fixed time bucket of a frame, named ``video::seg<n>``."""
    bucket = F.floor(frame_id / fps / F.lit(seconds)).cast("bigint")
    return F.concat(video_id, F.lit("::seg"), bucket)


def segment_pairs(starts: DataFrame, ends: DataFrame, videos: DataFrame, k: int, max_seconds: float = 120.0, min_seconds: float = 0.0, side_limit: int = 20) -> DataFrame:
    """Best (start, end) frame pairs of one video within a duration window.

    Each side keeps its first ``side_limit`` hits per query, so a query compares
    at most side_limit squared pairs.
    """
    order = [F.asc("rank")]
    a = ranked(starts, ["query_id"], order, side_limit, "_n").select(
        "query_id", "video_id", F.col("frame_id").alias("start_frame"), F.col("score").alias("start_score")
    )
    b = ranked(ends, ["query_id"], order, side_limit, "_n").select(
        "query_id", "video_id", F.col("frame_id").alias("end_frame"), F.col("score").alias("end_score")
    )
    pairs = with_fps(a.join(b, ["query_id", "video_id"]).filter("end_frame > start_frame"), videos)
    duration = (F.col("end_frame") - F.col("start_frame")) / F.col("fps")
    kept = pairs.withColumn("duration", duration).filter(F.col("duration").between(min_seconds, max_seconds))
    return ranked(
        kept.withColumn("score", F.round(F.col("start_score") + F.col("end_score"), 6)).drop("fps"),
        ["query_id"],
        [F.desc("score"), F.asc("video_id"), F.asc("start_frame"), F.asc("end_frame")],
        k,
    )


def _near(hits: DataFrame, videos: DataFrame, seconds: float) -> DataFrame:
    timed = with_fps(hits, videos).withColumn("_t", F.col("frame_id") / F.col("fps"))
    keys = ["query_id", "video_id"]
    near = neighbour_totals(timed, keys, "_t", "score", float(seconds) + EPS, chunk=600.0)
    return timed.join(near, [*keys, "_t"]).drop("_t", "fps")


def neighbour_sum(hits: DataFrame, videos: DataFrame, seconds: float = 5.0, include_center: bool = True) -> DataFrame:
    """Score plus the scores of all other hits of the video within ``seconds``."""
    total = F.col("sum_near") if include_center else F.col("sum_near") - F.col("score")
    out = _near(hits, videos, seconds).withColumn("total", F.round(total, 6)).withColumn("n_neighbours", F.col("n_near") - 1)
    return out.drop("sum_near", "n_near")


def neighbour_blend(hits: DataFrame, videos: DataFrame, seconds: float = 5.0, weight: float = 0.5) -> DataFrame:
    """Score plus a share of the mean score of the neighbours; lone hits keep theirs."""
    others = F.col("n_near") - 1
    mean = F.when(others > 0, (F.col("sum_near") - F.col("score")) / others).otherwise(0.0)
    out = _near(hits, videos, seconds).withColumn("blended", F.round(F.col("score") + F.lit(weight) * mean, 12))
    return out.drop("sum_near", "n_near")


AGGREGATES = {"max": F.max, "sum": F.sum}


def hierarchy(hits: DataFrame, segment: Column | str, videos_k: int, segments_k: int, frames_k: int, segment_agg: str = "max", video_agg: str = "max") -> DataFrame:
    """Frames under segments under videos, each tier cut before its parent is scored.

    ``segment`` is a column or the name of one (time buckets, event ids, ...).
    """
    hits = hits.withColumn("segment_id", F.col(segment) if isinstance(segment, str) else segment)
    by_segment = ["query_id", "video_id", "segment_id"]
    frames = ranked(hits.select(*by_segment, "frame_id", "score"), by_segment, [F.desc("score"), F.asc("frame_id")], frames_k, "frame_rank")
    segments = frames.groupBy(*by_segment).agg(F.round(AGGREGATES[segment_agg]("score"), 6).alias("segment_score"))
    segments = ranked(segments, ["query_id", "video_id"], [F.desc("segment_score"), F.asc("segment_id")], segments_k, "segment_rank")
    videos = segments.groupBy("query_id", "video_id").agg(F.round(AGGREGATES[video_agg]("segment_score"), 6).alias("video_score"))
    videos = ranked(videos, ["query_id"], [F.desc("video_score"), F.asc("video_id")], videos_k, "video_rank")
    return frames.join(segments, by_segment).join(videos, ["query_id", "video_id"])


def hierarchy_tree(tiers: DataFrame) -> DataFrame:
    """Nested form: one row per video with its segments and their frames."""
    segs = tiers.groupBy("query_id", "video_id", "video_rank", "video_score", "segment_rank", "segment_id", "segment_score").agg(
        F.sort_array(F.collect_list(F.struct("frame_rank", "frame_id", "score"))).alias("frames")
    )
    return segs.groupBy("query_id", "video_id", "video_rank", "video_score").agg(
        F.sort_array(F.collect_list(F.struct("segment_rank", "segment_id", "segment_score", "frames"))).alias("segments")
    )


def refine_moments(tiers: DataFrame, videos: DataFrame, k: int, seconds: float = 2.0, threshold: float = 0.5) -> DataFrame:
    """Tighten each segment to the run of frames around its peak.

    Scores are summed with near frames of the same segment; the run extends while
    the sum stays at ``threshold`` of the peak. Intervals are half-open.
    """
    seg = ["query_id", "video_id", "segment_id"]
    timed = with_fps(tiers.select(*seg, "frame_id", "score"), videos).withColumn("_t", F.col("frame_id") / F.col("fps"))
    near = neighbour_totals(timed, seg, "_t", "score", float(seconds) + EPS, chunk=600.0)
    agg = timed.join(near, [*seg, "_t"]).select(*seg, "frame_id", F.round("sum_near", 6).alias("agg"))
    peaks = best_row(agg, seg, [F.desc("agg"), F.asc("frame_id")]).select(
        *seg, F.col("frame_id").alias("peak_frame"), F.col("agg").alias("peak")
    )
    run = Window.partitionBy(*seg).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (
        agg.join(peaks, seg)
        .withColumn("_below", (F.col("agg") < F.col("peak") * F.lit(threshold)).cast("int"))
        .withColumn("_island", F.sum("_below").over(run))
    )
    kept = marked.filter("_below = 0").groupBy(*seg, "_island", "peak_frame", "peak").agg(
        F.min("frame_id").alias("start_frame"), (F.max("frame_id") + 1).alias("end_frame")
    )
    moments = kept.filter("peak_frame >= start_frame and peak_frame < end_frame").select(
        *seg, "start_frame", "end_frame", "peak_frame", F.col("peak").alias("score")
    )
    return ranked(moments, ["query_id"], [F.desc("score"), F.asc("video_id"), F.asc("start_frame")], k)
