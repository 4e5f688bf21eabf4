"""Event, cluster and video aggregation of ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.operators.fusion import KEY, base_lane, rank_fusion
from reelweave.operators.ranking import best_row, ranked
from reelweave.operators.timeline import asof, gap_islands, greedy_spaced, positions
from reelweave.schema import DEFAULTS
from reelweave.session import cut_lineage

EVENT = ["query_id", "video_id", "event_id"]


def attach_events(hits: DataFrame, keyframes: DataFrame, tolerance: int = DEFAULTS.event_tolerance) -> DataFrame:
    """Event of each hit: the exact keyframe's, else the nearest one within tolerance.

    Hits without an event keep a null ``event_id``.
    """
    frames = keyframes.select("video_id", F.col("frame_id").alias("_kf"), "event_id")
    return asof(hits, frames, ["video_id"], "frame_id", "_kf", ["event_id"], "nearest", tolerance).withColumnRenamed(
        "matched_pos", "event_frame"
    )


def _lane_shares(signals: DataFrame, weights: DataFrame, lane_key: Column) -> DataFrame:
    """Weight per (query, lane); clause lanes of one base share its weight.

    ``weights(lane, weight)`` may be given per ``query_id``.
    """
    on = ["query_id", "_base"] if "query_id" in weights.columns else ["_base"]
    own = weights.withColumnRenamed("lane", "_base").select(*on, "weight")
    own = own if "query_id" in on else F.broadcast(own)
    lanes = signals.select("query_id", "lane").distinct().withColumn("_base", lane_key)
    clauses = lanes.filter(F.col("lane").contains("__clause")).groupBy("query_id", "_base").agg(F.count("lane").alias("_n"))
    return (
        lanes.join(clauses, ["query_id", "_base"], "left")
        .join(own, on, "left")
        .select(
            "query_id",
            "lane",
            (
                F.coalesce("weight", F.lit(1.0))
                / F.when(F.col("lane").contains("__clause"), F.greatest(F.lit(1), F.col("_n"))).otherwise(F.lit(1))
            ).alias("_w"),
        )
    )


def _with_shares(rows: DataFrame, signals: DataFrame, weights: DataFrame, lane_key: Column) -> DataFrame:
    """``rows`` with the weight ``_w`` of their lane; where lanes alone decide it, rows are not moved."""
    if "query_id" in weights.columns:
        return rows.join(_lane_shares(signals, weights, lane_key), ["query_id", "lane"])
    clause = F.col("lane").contains("__clause")
    own = F.broadcast(weights.select(F.col("lane").alias("_base"), F.coalesce("weight", F.lit(1.0)).cast("double").alias("_own")))
    whole = rows.filter(~clause & F.col("query_id").isNotNull()).withColumn("_base", lane_key).join(own, "_base", "left")
    whole = whole.withColumn("_w", F.coalesce("_own", F.lit(1.0))).drop("_base", "_own")
    shares = _lane_shares(signals.filter(clause), weights, lane_key)
    return whole.unionByName(rows.filter(clause).join(shares, ["query_id", "lane"]).select(*whole.columns))


def event_votes(signals: DataFrame, keyframes: DataFrame, weights: DataFrame, k: int = DEFAULTS.rrf_k, tolerance: int = DEFAULTS.event_tolerance) -> DataFrame:
    """One vote per (lane, frame) at its best rank, placed in its event."""
    best = signals.groupBy("query_id", "lane", "video_id", "frame_id").agg(F.min("rank").alias("rank"))
    voted = _with_shares(best, signals, weights, base_lane(F.col("lane"))).withColumn(
        "vote", F.col("_w") / (F.lit(k) + F.greatest(F.lit(1), F.col("rank")))
    )
    # a frame that many queries found is placed once
    placed = attach_events(signals.select("video_id", "frame_id").distinct(), keyframes, tolerance).filter(F.col("event_id").isNotNull())
    placed = placed.select(F.col("video_id").alias("_v"), F.col("frame_id").alias("_f"), "event_frame", "event_id")
    same = F.col("video_id").eqNullSafe(F.col("_v")) & (F.col("frame_id") == F.col("_f"))
    return voted.join(placed, same).select("query_id", "lane", "video_id", "frame_id", "rank", "vote", "event_frame", "event_id")


def rank_events(votes: DataFrame) -> DataFrame:
    """Events by summed votes over the whole corpus."""
    events = votes.groupBy(*EVENT).agg(
        F.round(F.sum("vote"), 9).alias("score"),
        F.countDistinct("frame_id").alias("n_members"),
        F.countDistinct("lane").alias("n_lanes"),
    )
    return ranked(events, ["query_id"], [F.desc("score"), F.asc("video_id"), F.asc("event_id")])


def event_members(votes: DataFrame) -> DataFrame:
    """Member frames of events with their total and their visual-only score."""
    visual = F.when(F.col("lane").startswith("visual_"), F.col("vote"))
    return votes.groupBy(*EVENT, "frame_id").agg(
        F.round(F.sum("vote"), 9).alias("member_score"), F.round(F.sum(visual), 9).alias("visual_score")
    )


def local_event_votes(signals: DataFrame, keyframes: DataFrame, weights: DataFrame, allowed: DataFrame, tolerance: int = DEFAULTS.event_tolerance) -> DataFrame:
    """Votes inside shortlisted videos from scores normalised per lane.

    Min-max per lane; a flat lane keeps score / mean clipped to [0, 1].
    """
    rows = signals.join(allowed.select("query_id", "video_id").distinct(), ["query_id", "video_id"], "left_semi")
    best = rows.groupBy("query_id", "lane", "video_id", "frame_id").agg(F.max("score").alias("score"))
    stats = best.groupBy("query_id", "lane").agg(
        F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.avg("score").alias("_mean")
    )
    plain = base_lane(F.col("lane"))
    local_lane = F.when(plain.startswith("caption_"), F.lit("caption")).otherwise(plain)
    shares = _lane_shares(rows, weights, local_lane)
    flat = F.when(F.col("_mean") > 0, F.col("score") / F.col("_mean")).otherwise(1.0)
    norm = F.when(
        F.col("_hi") - F.col("_lo") > 1e-12, (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    ).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), flat)))
    voted = best.join(stats, ["query_id", "lane"]).join(shares, ["query_id", "lane"]).select(
        "query_id", "lane", "video_id", "frame_id", "score", (F.col("_w") * (F.lit(0.25) + F.lit(0.75) * norm)).alias("vote")
    )
    return attach_events(voted, keyframes, tolerance).filter(F.col("event_id").isNotNull())


def rank_local_events(votes: DataFrame) -> DataFrame:
    """Events by the sum over lanes of each lane's strongest vote."""
    lanes = votes.groupBy(*EVENT, "lane").agg(F.max("vote").alias("vote"))
    events = lanes.groupBy(*EVENT).agg(F.round(F.sum("vote"), 9).alias("score"), F.count("lane").alias("n_lanes"))
    members = votes.groupBy(*EVENT).agg(F.countDistinct("frame_id").alias("n_members"), F.min("frame_id").alias("first_frame"))
    return ranked(
        events.join(members, EVENT),
        ["query_id"],
        [F.desc("score"), F.desc("n_lanes"), F.asc("video_id"), F.asc("event_id")],
    )


def placed_events(keyframes: DataFrame, parts: int | None = None) -> DataFrame:
    """Events of each video in time order with bounds and size; ``parts`` tasks sort them, if given."""
    spans = keyframes.groupBy("video_id", "event_id").agg(
        F.min("frame_id").alias("start_frame"),
        F.max("frame_id").alias("end_frame"),
        F.count(F.lit(1)).alias("n_frames"),
    )
    return positions(spans if parts is None else cut_lineage(spans), ["video_id"], "start_frame", ["event_id"], "event_order", parts=parts)


def ordered_events(keyframes: DataFrame) -> DataFrame:
    """Events of each video in time order with bounds, size and neighbours."""
    placed = placed_events(keyframes)
    order = placed.select("video_id", "event_order", "event_id", "start_frame")
    before = order.select("video_id", (F.col("event_order") + 1).alias("event_order"), F.col("event_id").alias("prev_event"))
    after = order.select(
        "video_id",
        (F.col("event_order") - 1).alias("event_order"),
        F.col("event_id").alias("next_event"),
        F.col("start_frame").alias("next_start"),
    )
    return placed.join(before, ["video_id", "event_order"], "left").join(after, ["video_id", "event_order"], "left")


def coherence_boost(events: DataFrame, timeline: DataFrame, bonus: float = 0.10) -> DataFrame:
    """Lift events whose previous or next event in the video was also found."""
    bound = min(bonus, 0.25)
    order = timeline.select("video_id", "event_id", "prev_event", "next_event")
    present = events.select("query_id", "video_id", F.col("event_id").alias("_e"))
    placed = events.join(order, ["video_id", "event_id"], "left")
    for side in ("prev", "next"):
        near = present.select("query_id", "video_id", F.col("_e").alias(f"{side}_event"), F.lit(1).alias(f"_{side}"))
        placed = placed.join(near, ["query_id", "video_id", f"{side}_event"], "left")
    adjacent = F.coalesce("_prev", F.lit(0)) + F.coalesce("_next", F.lit(0))
    lifted = placed.withColumn("adjacent", adjacent).withColumn(
        "score", F.round(F.col("score") * (F.lit(1.0) + F.lit(bound) * F.col("adjacent")), 9)
    )
    return ranked(
        lifted.drop("rank"), ["query_id"], [F.desc("score"), F.desc("n_lanes"), F.asc("video_id"), F.asc("event_id")]
    ).select(*EVENT, "adjacent", "score", "n_lanes", "rank")


def gap_clusters(fused: DataFrame, signals: DataFrame, gap: int = DEFAULTS.gap_frames, k: int = DEFAULTS.rrf_k, lane_bonus: float = 0.15) -> DataFrame:
    """Collapse neighbouring frames: uniform rank fusion times a lane-agreement bonus.

    ``fused(query_id, video_id, frame_id)`` gives the members; the member with the
    best uniform score represents the cluster.
    """
    by = ["query_id", "video_id"]
    uniform = signals.groupBy(*KEY).agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("_u"), F.collect_set("lane").alias("_l")
    )
    placed = gap_islands(fused.select(*KEY).join(uniform, KEY, "left"), by, "frame_id", gap)
    rows = placed.select(*KEY, "island", F.coalesce("_u", F.lit(0.0)).alias("_u"), F.posexplode_outer("_l").alias("_i", "lane"))
    once = F.coalesce("_i", F.lit(0)) == 0
    per_lane = rows.groupBy(*by, "island", "lane").agg(
        F.sum(F.when(once, F.col("_u"))).alias("_u"),
        F.sum(once.cast("bigint")).alias("_n"),
        F.max("frame_id").alias("_end"),
        F.max(F.when(once, F.struct("_u", (-F.col("frame_id")).alias("f")))).alias("_lead"),
    )
    out = per_lane.groupBy(*by, "island").agg(
        F.sum("_u").alias("_u"),
        F.sum("_n").alias("n_members"),
        F.count("lane").alias("n_lanes"),
        F.max("_end").alias("end_frame"),
        F.max("_lead").alias("_lead"),
    )
    bonus = F.lit(1.0) + F.lit(lane_bonus) * F.greatest(F.lit(0), F.col("n_lanes") - 1)
    return out.select(
        *by,
        (-F.col("_lead.f")).alias("frame_id"),
        F.col("island").alias("start_frame"),
        "end_frame",
        "n_members",
        "n_lanes",
        F.round(F.col("_u") * bonus, 6).alias("score"),
    )


def diverse_members(members: DataFrame, gap: int = DEFAULTS.gap_frames, limit: int = DEFAULTS.frames_per_event) -> DataFrame:
    """Up to ``limit`` members per event, spaced at least ``gap`` frames, by score.

    Events with visual members take those first; places left over are filled
    with the best members that were too close.
    """
    has_visual = F.max(F.col("visual_score").isNotNull()).over(Window.partitionBy(*EVENT))
    second = F.col("_hv") & F.col("visual_score").isNull()
    flagged = members.dropna(subset=EVENT).withColumn("_hv", has_visual)
    score = F.when(second, F.col("member_score")).otherwise(F.coalesce("visual_score", "member_score"))
    rows = flagged.select(*EVENT, "frame_id", "member_score", second.cast("int").alias("_second"), (-score).alias("_score"))
    order = [F.col("_second"), F.col("_score"), F.concat_ws(":", "video_id", "frame_id")]
    spaced = greedy_spaced(rows, EVENT, "frame_id", order, gap, limit, fill=True)
    return spaced.select(*EVENT, "frame_id", "member_score", F.col("pick").alias("member_rank"))


def materialise_events(events: DataFrame, members: DataFrame, head: int = DEFAULTS.primary_event_head) -> DataFrame:
    """Frame list from ranked events: first members of the head events, their second
    members, ..., then the other events likewise; 1% decay per member."""
    rows = members.join(events.select(*EVENT, F.col("score").alias("event_score"), F.col("rank").alias("event_rank")), EVENT)
    rows = rows.withColumn("band", (F.col("event_rank") > head).cast("int")).withColumn(
        "score", F.round(F.col("event_score") * (F.lit(1.0) - F.lit(0.01) * (F.col("member_rank") - 1)), 6)
    )
    return ranked(rows, ["query_id"], [F.asc("band"), F.asc("member_rank"), F.asc("event_rank")])


def video_shortlist(signals: DataFrame, weights: DataFrame, limit: int = 20, visual_quota: int = 5, text_quota: int = 3, k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Videos for a deeper search: per-lane seeds first, then weighted rank fusion.

    Each lane counts only its best rank for a video.
    """
    best = signals.groupBy("query_id", "lane", "video_id").agg(F.min("rank").alias("best")).withColumn("_base", base_lane(F.col("lane")))
    weighted = best.join(weights.select(F.col("lane").alias("_base"), "weight"), "_base", "left").withColumn(
        "_v", F.coalesce("weight", F.lit(1.0)) / (F.lit(k) + F.col("best"))
    )
    quota = (
        F.when(F.col("lane").startswith("visual_"), F.lit(visual_quota))
        .when(F.col("_base").isin("ocr", "ocr_sqlite", "audio", "caption"), F.lit(text_quota))
        .otherwise(F.lit(0))
    )
    top = max(visual_quota, text_quota)
    seeds = (
        ranked(best.withColumn("_quota", quota), ["query_id", "lane"], [F.asc("best"), F.asc("video_id")], top, "_n")
        .filter(F.col("_n") <= F.col("_quota"))
        .select("query_id", "video_id")
        .distinct()
        .withColumn("_seed", F.lit(1))
    )
    videos = weighted.groupBy("query_id", "video_id").agg(
        F.round(F.sum("_v"), 9).alias("score"), F.min("best").alias("best_rank")
    )
    flagged = videos.join(seeds, ["query_id", "video_id"], "left").withColumn("is_seed", F.coalesce("_seed", F.lit(0)))
    seed_rank = F.when(F.col("is_seed") == 1, F.col("best_rank"))
    return ranked(
        flagged.drop("_seed"),
        ["query_id"],
        [F.desc("is_seed"), F.asc_nulls_last(seed_rank), F.desc("score"), F.asc("video_id")],
        limit,
    )


#: Fixed values that must match: words of an accent-free query that ask for screen text.
SCREEN_TEXT_MARKERS = ("slide", "tieu de", "so do", "tang 1", "tang 2")


def asks_for_screen_text(normalized: Column) -> Column:
    """Whether a search-normalised query has a marker of screen text."""
    out = F.lit(False)
    for marker in SCREEN_TEXT_MARKERS:
        out = out | normalized.contains(marker)
    return F.coalesce(out, F.lit(False))


def promoted_shortlist(shortlist: DataFrame, events: DataFrame, ocr_videos: DataFrame, queries: DataFrame, event_limit: int, promote: int, limit: int) -> DataFrame:
    """The per-lane shortlist, then videos of the first ``event_limit`` events in event order.

    Queries whose ``normalized`` text asks for screen text see its first ``promote`` videos
    before both. ``events`` are ranked events, ``ocr_videos`` ranked videos.
    """
    from reelweave.operators.ranking import ordered_union

    asking = queries.filter(asks_for_screen_text(F.col("normalized"))).select("query_id").distinct()
    first = ocr_videos.filter(F.col("rank") <= promote).join(asking, "query_id", "left_semi")
    behind = event_order_of_videos(events.filter(F.col("rank") <= event_limit))
    lists = [first, shortlist, behind]
    return ordered_union([x.select("query_id", "video_id", "rank") for x in lists], ["query_id", "video_id"], limit=limit)


def fused_frames(signals: DataFrame, lanes: DataFrame | None = None, k: int = DEFAULTS.rrf_k) -> DataFrame:
    return rank_fusion(signals, lanes, k).withColumn("score", F.round("score", 9))


def event_order_of_videos(events: DataFrame) -> DataFrame:
    """Videos in the order in which their best event ranks."""
    firsts = events.groupBy("query_id", "video_id").agg(F.min("rank").alias("_r"))
    return ranked(firsts, ["query_id"], [F.asc("_r"), F.asc("video_id")]).drop("_r")
