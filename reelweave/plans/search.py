"""Composed retrieval tasks over signals and corpus tables.

A task takes the signals of all queries at once. Intermediate tables that many
steps read are written once (``cut_lineage``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.operators import events as ev
from reelweave.operators import fusion as fu
from reelweave.operators import moments as mo
from reelweave.operators import ranking as rk
from reelweave.operators import retrieval as rt
from reelweave.operators import sequences as sq
from reelweave.operators.fusion import KEY
from reelweave.schema import DEFAULTS, Settings
from reelweave.session import cut_lineage

# Text lanes searched beside the visual ones by each multimodal mode; None means all.
MODES = {
    "none": None,
    "only_visual": (),
    "visual_ocr": ("ocr", "ocr_semantic"),
    "visual_asr": ("audio",),
}


@dataclass(frozen=True)
class SearchOptions:
    """Options of a known-item search."""

    mode: str = "none"
    fusion: str = "late"
    window_frames: int = 75
    #: None keeps the global ranking as it is.
    max_per_video: int | None = DEFAULTS.max_per_video
    top_k: int = 100
    with_events: bool = True
    cluster_gap: int | None = None
    #: Adds the best score of every modality to each result.
    with_modalities: bool = False


@dataclass(frozen=True)
class Lock:
    """Video-lock mode: a second search inside shortlisted videos, as a bounded rescue.

    ``queries(query_id, mode, normalized, temporal)`` route: only those of mode
    ``video_lock`` are searched again. ``vectors`` and ``query_vectors(query_id, clause,
    lane, qv)`` are searched in the videos; clause 0 is the whole query.
    """

    queries: DataFrame
    vectors: DataFrame
    query_vectors: DataFrame
    shortlist: int = 100
    local_videos: int = 50
    visual_quota: int = 5
    text_quota: int = 3
    event_limit: int = 128
    promote: int = 12
    frames_per_video: int = 24
    captions_per_video: int = 8
    clauses: tuple[int, ...] = (1, 2)
    #: Frames of the baseline that stay in front, and the most that are put behind them.
    protect: int = DEFAULTS.protected_head
    rescues: int = DEFAULTS.rescue_limit


@dataclass(frozen=True)
class Rescore:
    """Weighted raw cosines that re-order the first ``head`` results."""

    vectors: DataFrame
    query_vectors: DataFrame
    weights: dict[str, float]
    head: int


#: Columns of modality scores and the lanes they collect.
MODALITIES = {"visual_score": "visual", "ocr_score": "ocr", "audio_score": "audio", "caption_score": "caption"}
SEGMENT_LANES = ("audio", "caption")


def lane_rows(signals: DataFrame, specialists: tuple[str, ...] | None, window_frames: int) -> DataFrame:
    """Signals of a mode with visual lanes aligned in time.

    Where signals have an ``end_frame_id``, time ranges of speech and captions are put on the
    first frame inside them that a visual or screen-text lane has found.
    """
    rows = signals
    if specialists is not None:
        rows = rows.filter(F.col("lane").startswith("visual") | F.col("lane").isin(list(specialists)))
    visual = F.col("lane").startswith("visual_")
    aligned = fu.align_to_windows(rows.filter(visual), window_frames)
    others = rows.filter(~visual)
    if "end_frame_id" in signals.columns:
        ranges = F.col("lane").isin(list(SEGMENT_LANES))
        frames = aligned.select(*KEY).unionByName(others.filter(F.col("lane").startswith("ocr")).select(*KEY))
        snapped = fu.snap_to_frames(others.filter(ranges), frames)
        others = others.filter(~ranges).select(*aligned.columns).unionByName(snapped.select(*aligned.columns))
    return aligned.unionByName(others.select(*aligned.columns))


def lock_rescues(signals: DataFrame, fused: DataFrame, lanes: DataFrame, keyframes: DataFrame, lock: Lock, s: Settings = DEFAULTS) -> DataFrame:
    """Frames of the best events inside the shortlisted videos of locked queries, in order.

    Videos come from per-lane seeds, ranked events and, for questions about screen text, the
    text lane. In-video hits vote for events by lane-normalised scores; they never meet the global
    fusion. Sequences of clauses come first. Only frames the fusion knows are listed.
    """
    locked = lock.queries.filter("mode = 'video_lock'")
    rows = cut_lineage(signals.join(locked.select("query_id"), "query_id", "left_semi"))
    weights = lanes.select("lane", "weight")
    short = ev.video_shortlist(rows, weights, lock.shortlist, lock.visual_quota, lock.text_quota, s.rrf_k)
    found = ev.rank_events(ev.event_votes(rows, keyframes, weights, s.rrf_k, s.event_tolerance))
    firsts = rows.filter("lane = 'ocr'").groupBy("query_id", "video_id").agg(F.min("rank").alias("_best"))
    text = rk.ranked(firsts, ["query_id"], [F.asc("_best"), F.asc("video_id")])
    listed = cut_lineage(ev.promoted_shortlist(short, found, text, locked, lock.event_limit, lock.promote, lock.shortlist))
    local = listed.filter(F.col("rank") <= lock.local_videos)
    asked = lock.query_vectors.join(locked.select("query_id"), "query_id", "left_semi")
    hits = rt.clauses_in_videos(lock.vectors, asked, local, max(lock.frames_per_video, lock.captions_per_video))
    most = F.when(F.col("lane").startswith("caption"), lock.captions_per_video).otherwise(lock.frames_per_video)
    votes = cut_lineage(ev.local_event_votes(hits.filter(F.col("rank") <= most), keyframes, weights, listed, s.event_tolerance))
    event = ["query_id", "video_id", "event_id"]
    first = votes.groupBy(*event).agg(F.min("frame_id").alias("first_frame"))
    per_lane = cut_lineage(votes.groupBy(*event, "lane").agg(F.max("vote").alias("vote")).join(first, event))
    temporal = locked.filter("temporal").select("query_id")
    ordered = sq.clause_coverage(per_lane.join(temporal, "query_id", "left_semi"), list(lock.clauses), True)
    free = sq.clause_coverage(per_lane.join(temporal, "query_id", "left_anti"), list(lock.clauses), False)
    events = sq.flatten_coverage(cut_lineage(ordered.unionByName(free)), ev.rank_local_events(votes))
    members = ev.diverse_members(ev.event_members(votes), s.gap_frames, s.frames_per_event).join(fused.select(*KEY), KEY, "left_semi")
    members = rk.ranked(members.withColumnRenamed("member_rank", "_m"), event, [F.asc("_m")], name="member_rank")
    left = events.join(members.select(*event).distinct(), event, "left_semi").withColumnRenamed("rank", "_r")
    return ev.materialise_events(rk.ranked(left, ["query_id"], [F.asc("_r")]), members, s.primary_event_head)


def ranked_frames(
    signals: DataFrame,
    lanes: DataFrame,
    keyframes: DataFrame,
    intents: DataFrame | None = None,
    options: SearchOptions = SearchOptions(),
    s: Settings = DEFAULTS,
    lock: Lock | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Align lanes in time, fuse, add bonuses, put events first: all frames, and the fused rows.

    Late fusion adds the bonuses in every mode. The modes with a specialist use family
    weights, the others those of the lanes; early fusion without a mode is unweighted and
    knows no events. Frames of ranked events come first, all other fused frames after them. With
    ``lock`` the queries it names get rescues behind the protected head, with late fusion; one job
    answers locked and plain queries.
    """
    specialists = MODES[options.mode]
    both = cut_lineage(lane_rows(signals, specialists, options.window_frames))
    weights = fu.family_weights(both, lanes, specialists) if specialists else None
    if options.fusion == "early":
        if options.mode == "only_visual":
            weights = both.select("query_id", "lane").distinct().join(lanes.select("lane", "weight"), "lane", "left").fillna(1.0, ["weight"])
        fused = fu.early_fusion(both, weights).select(*KEY, "score")
    else:
        fused = fu.fuse_with_bonuses(both, lanes, intents, s, weights).select(*KEY, "score")
    base = rk.ranked(fused.withColumn("score", F.round("score", 9)), ["query_id"], rk.score_order())
    base = fused_rows = cut_lineage(base)
    if options.cluster_gap is not None:
        clusters = ev.gap_clusters(base, both, options.cluster_gap, s.rrf_k).select(*KEY, "score")
        base = rk.ranked(clusters, ["query_id"], rk.score_order())
    elif options.with_events and options.fusion == "late":
        voting = lanes.select("lane", "weight") if weights is None else weights
        votes = cut_lineage(ev.event_votes(both, keyframes, voting, s.rrf_k, s.event_tolerance))
        members = ev.diverse_members(ev.event_members(votes), s.gap_frames, s.frames_per_event)
        eventful = ev.materialise_events(ev.rank_events(votes), members, s.primary_event_head)
        merged = rk.ordered_union([eventful.select(*KEY, "rank"), base.select(*KEY, "rank")], KEY)
        if lock is not None:
            rescues = lock_rescues(signals, fused_rows, lanes, keyframes, lock, s)
            merged = rk.protected_merge(cut_lineage(merged), rescues, lock.protect, lock.rescues, None)
        base = merged.join(base.select(*KEY, "score"), KEY, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return base.select(*KEY, "score", "rank"), both


def known_item_search(
    signals: DataFrame,
    lanes: DataFrame,
    keyframes: DataFrame,
    videos: DataFrame,
    intents: DataFrame | None = None,
    options: SearchOptions = SearchOptions(),
    s: Settings = DEFAULTS,
    lock: Lock | None = None,
    rescore: Rescore | None = None,
) -> DataFrame:
    """Ranked frames, diversified and enriched; ``rescore`` re-orders the head of the final list."""
    rows, both = ranked_frames(signals, lanes, keyframes, intents, options, s, lock)
    if options.max_per_video is None:
        rows = rows.filter(F.col("rank") <= options.top_k)
    else:
        rows = rk.diversify(rows, options.max_per_video, options.top_k)
    if rescore is not None:
        rows = rt.rescore_head(cut_lineage(rows), rescore.vectors, rescore.query_vectors, rescore.weights, rescore.head).select(*KEY, "score", "rank")
    if options.with_modalities:
        told = fu.merge_modalities(both, MODALITIES).select(*KEY, *MODALITIES)
        return enrich(rows, videos).join(told, KEY, "left")
    return enrich(rows, videos)


def enrich(results: DataFrame, videos: DataFrame) -> DataFrame:
    """Results with time stamps and rounded scores."""
    out = mo.with_fps(results, videos)
    return out.select(
        *KEY, F.round("score", 4).alias("score"), F.round(F.col("frame_id") / F.col("fps"), 1).alias("timestamp_seconds"), "rank"
    )


def labelled(results: DataFrame, task: str) -> DataFrame:
    """Results of a question or conversational search carry their own task label."""
    return results.withColumn("task", F.lit(task))


def sequence_search(candidates: DataFrame, sizes: DataFrame, max_events: int, top_k: int, repair: DataFrame | None = None, priors: DataFrame | None = None, max_missing: int = 1, s: Settings = DEFAULTS) -> DataFrame:
    """Ordered event sequences: pooled candidates, optional in-video repairs and action
    priors, alignment and ranking, one slot per event."""
    pool = sq.candidate_pool(candidates, s.sequence_pool)
    if repair is not None:
        pool = pool.unionByName(repair)
    aligned = sq.align_sequences(cut_lineage(pool), sizes, max_events, max_missing)
    return sq.with_null_slots(sq.rank_sequences(aligned, top_k, priors, 0.0 if priors is None else 0.2), sizes)


def moment_search(hits: DataFrame, videos: DataFrame, top_k: int, bucket_seconds: float = 5.0) -> DataFrame:
    """Hits to video, segment and frame tiers, each segment tightened to its peak."""
    timed = mo.with_fps(hits, videos)
    key = mo.segment_key(F.col("video_id"), F.col("frame_id"), F.col("fps"), bucket_seconds)
    tiers = cut_lineage(mo.hierarchy(timed, key, 10, 3, 20))
    return mo.refine_moments(tiers, videos, top_k)


def two_query_segments(start_hits: DataFrame, end_hits: DataFrame, videos: DataFrame, top_k: int, seconds: float = 5.0, max_seconds: float = 120.0) -> DataFrame:
    """Start and end hits re-scored by their neighbours, then paired."""

    def smoothed(hits: DataFrame) -> DataFrame:
        summed = mo.neighbour_sum(hits, videos, seconds).select(*KEY, F.col("total").alias("score"))
        return rk.ranked(summed, ["query_id"], rk.score_order())

    return mo.segment_pairs(smoothed(start_hits), smoothed(end_hits), videos, top_k, max_seconds=max_seconds)
