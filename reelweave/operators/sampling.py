"""Sampling of frames, quotas, candidate pools and change points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.operators.events import attach_events, ordered_events
from reelweave.operators.fusion import KEY
from reelweave.operators.ranking import best_row, ordered_union, ranked
from reelweave.operators.timeline import asof, greedy_spaced, positions
from reelweave.session import cut_lineage

#: Frames of a cell in which windows and the grid meet.
WINDOW_CELL = 1024


def on_linspace(index: Column, n: Column, quota: Column) -> Column:
    """Whether the zero-based ``index`` is one of ``quota`` evenly spaced positions of n
    (ends included, halves to even; the middle for a quota of one)."""
    step = (n - 1) / (quota - 1)
    guess = F.rint(index / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        i = guess + shift
        hit = hit | ((i >= 0) & (i <= quota - 1) & (F.rint(i * step) == index))
    return (
        F.when(quota <= 0, False)
        .when(n <= quota, True)
        .when(quota == 1, index == F.floor(n / 2))
        .otherwise(F.coalesce(hit, F.lit(False)))
    )


def linspace_pick(rows: DataFrame, keys: Sequence[str], pos: str, quota: Column, single: str = "middle") -> DataFrame:
    """Evenly spaced rows of each ordered group; a quota of one takes the middle or the first."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    numbered = positions(rows, keys, pos, name="_i").join(sizes, list(keys))
    keep = on_linspace(F.col("_i") - 1, F.col("_n"), quota)
    if single == "first":
        keep = F.when(quota == 1, F.col("_i") == 1).otherwise(keep)
    return numbered.filter(keep).drop("_i", "_n")


def even_quota(rows: DataFrame, by: Sequence[str], order: Sequence[Column], budget: int) -> DataFrame:
    """Split a budget over the rows of a group, the remainder to the first ones."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranked(rows, by, order, name="_p").join(n, list(by))
    share = F.floor(F.lit(budget) / F.col("_n")) + (F.col("_p") <= F.pmod(F.lit(budget), F.col("_n"))).cast("int")
    return placed.withColumn("quota", share.cast("int")).drop("_n", "_p")


def divisor_quota(videos: DataFrame, limit: int, base: int = 12, cap: int = 35) -> DataFrame:
    """Slots per video: a base each, the rest one by one to the largest
    sqrt(events) / (slots + 1), at most ``cap`` per video.

    ``videos(query_id, video_id, position, n_events)``. The one-by-one rule equals
    taking the best (video, slot) pairs, so no loop is needed.
    """
    active = videos.filter("n_events > 0")
    n = active.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    start = active.join(n, "query_id").withColumn(
        "_base", F.least(F.lit(base), F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("_n")))).cast("int")
    )
    slots = start.filter(F.col("_base") < cap).withColumn("_slot", F.explode(F.sequence(F.col("_base"), F.lit(cap - 1)))).withColumn(
        "_priority", F.round(F.sqrt("n_events") / (F.col("_slot") + 1), 12)
    )
    taken = ranked(slots, ["query_id"], [F.desc("_priority"), F.asc("position"), F.asc("_slot")], name="_r").filter(
        F.col("_r") <= F.greatest(F.lit(0), F.lit(limit) - F.col("_base") * F.col("_n"))
    )
    extra = taken.groupBy("query_id", "video_id").agg(F.count(F.lit(1)).alias("_x"))
    return start.join(extra, ["query_id", "video_id"], "left").select(
        "query_id", "video_id", "position", "n_events", (F.col("_base") + F.coalesce("_x", F.lit(0))).cast("int").alias("quota")
    )


def snap_inside(targets: DataFrame, grid: DataFrame, pos: str, low: str, high: str) -> DataFrame:
    """Nearest grid frame of each target among those in [low, high]; equal distances go
    to the earlier frame. Adds ``snapped`` (null when the interval is empty)."""
    frames = grid.select("video_id", F.col("frame_id").alias("_g"))
    back = asof(targets, frames, ["video_id"], pos, "_g", [], "backward").withColumnRenamed("matched_pos", "_b")
    both = asof(back, frames, ["video_id"], pos, "_g", [], "forward").withColumnRenamed("matched_pos", "_f")
    b = F.when(F.col("_b") >= F.col(low), F.col("_b"))
    f = F.when(F.col("_f") <= F.col(high), F.col("_f"))
    nearer = b.isNull() | ((f - F.col(pos)) < (F.col(pos) - b))
    return both.withColumn("snapped", F.coalesce(F.when(nearer, f).otherwise(b), b, f)).drop("_b", "_f")


def sample_intervals(requests: DataFrame, grid: DataFrame, sample_fps: float, max_frames: int, required: DataFrame | None = None) -> DataFrame:
    """Existing keyframes spread evenly over intervals, required frames kept.

    ``requests(request_id, video_id, start_frame, end_frame, fps)``; ``grid(video_id,
    frame_id)`` distinct; ``required(request_id, frame_id)``.
    """
    seconds = (F.col("end_frame") - F.col("start_frame")) / F.col("fps")
    count = F.least(F.lit(max_frames), F.greatest(F.lit(1), F.ceil(seconds * sample_fps) + 1)).cast("int")
    spread = requests.withColumn("_n", count).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = F.when(F.col("_n") > 1, (F.col("end_frame") - F.col("start_frame")) / (F.col("_n") - 1)).otherwise(0.0)
    targets = spread.select(
        "request_id", "video_id", "start_frame", "end_frame", (F.col("start_frame") + step * F.col("_k")).alias("_x"), F.lit(False).alias("_req")
    )
    if required is not None:
        asked = required.select("request_id", F.col("frame_id").cast("double").alias("_x")).join(requests, "request_id")
        targets = targets.unionByName(
            asked.filter(F.col("_x").between(F.col("start_frame"), F.col("end_frame"))).select(
                "request_id", "video_id", "start_frame", "end_frame", "_x", F.lit(True).alias("_req")
            )
        )
    found = snap_inside(targets, grid, "_x", "start_frame", "end_frame").filter("snapped is not null")
    rows = found.groupBy("request_id", "video_id", F.col("snapped").alias("frame_id")).agg(F.max("_req").alias("required"))
    w = Window.partitionBy("request_id")
    sized = rows.withColumn("_all", F.count(F.lit(1)).over(w)).withColumn("_reqs", F.sum(F.col("required").cast("int")).over(w))
    index = F.row_number().over(Window.partitionBy("request_id", "required").orderBy("frame_id")) - 1
    keep = (
        (F.col("_all") <= max_frames)
        | (F.col("_reqs") >= max_frames)
        | F.col("required")
        | on_linspace(F.col("_i"), F.col("_all") - F.col("_reqs"), F.lit(max_frames) - F.col("_reqs"))
    )
    return sized.withColumn("_i", index).filter(keep).select("request_id", "video_id", "frame_id", "required")


def sample_windows(anchors: DataFrame, grid: DataFrame, seconds: float, sample_fps: float, max_frames: int, forward: bool = False) -> DataFrame:
    """Keyframes around (or from) an anchor: ``anchors(request_id, video_id, frame_id, fps)``.

    A forward window without any keyframe falls back to the rounded target frames.
    """
    anchor = F.col("frame_id") / F.col("fps")
    start = anchor if forward else F.greatest(F.lit(0.0), anchor - F.lit(seconds))
    timed = anchors.withColumn("_s", start).withColumn("_e", anchor + F.lit(seconds))
    low = F.col("frame_id") if forward else F.ceil(F.col("_s") * F.col("fps") - 1e-9)
    timed = timed.withColumn("_low", low).withColumn("_high", F.floor(F.col("_e") * F.col("fps") + 1e-9))
    n = F.least(F.lit(max_frames), F.greatest(F.lit(1), F.ceil(F.round((F.col("_e") - F.col("_s")) * sample_fps, 9)) + 1)).cast("int")
    spread = timed.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = F.when(F.col("_n") > 1, F.col("_s") + (F.col("_e") - F.col("_s")) / (F.col("_n") - 1) * F.col("_k")).otherwise(F.col("frame_id") / F.col("fps"))
    cols = ["request_id", "video_id", "_low", "_high"]
    targets = spread.select(*cols, F.round(at * F.col("fps"), 6).alias("_x"))
    if not forward:
        targets = targets.unionByName(timed.select(*cols, F.col("frame_id").cast("double").alias("_x")))
    found = snap_inside(targets, grid, "_x", "_low", "_high")
    if forward:
        found = found.withColumn("snapped", F.coalesce("snapped", F.rint("_x").cast("bigint")))
    return found.filter("snapped is not null").select("request_id", "video_id", F.col("snapped").alias("frame_id")).distinct()


def change_points(vectors: DataFrame, min_gap: int, limit: int = 8, floor: float = 0.0, rise: float = 0.0, spread: float = 4.0) -> DataFrame:
    """Strong changes between consecutive frame vectors of a video.

    The change of a frame is the mean absolute difference to the frame before;
    a change counts from max(floor, median + max(rise, spread * MAD)) on. The strongest
    come first, at least ``min_gap`` frames apart, at most ``limit`` per video.
    """
    numbered = positions(vectors.select("video_id", "frame_id", "embedding"), ["video_id"], "frame_id", name="_i")
    before = numbered.select("video_id", (F.col("_i") + 1).alias("_i"), F.col("embedding").alias("_prev"))
    diffs = F.zip_with("embedding", "_prev", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    changes = numbered.join(before, ["video_id", "_i"]).select(
        "video_id", "frame_id", F.round(F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x) / F.size("embedding"), 9).alias("change")
    )
    mid = changes.groupBy("video_id").agg(F.median("change").alias("_med"))
    dev = changes.join(mid, "video_id").withColumn("_d", F.abs(F.col("change") - F.col("_med"))).groupBy("video_id", "_med").agg(F.median("_d").alias("_mad"))
    limit_at = F.greatest(F.lit(floor), F.col("_med") + F.greatest(F.lit(rise), F.lit(spread) * F.col("_mad")))
    strong = changes.join(dev, "video_id").filter(F.col("change") >= limit_at).select("video_id", "frame_id", "change")
    return greedy_spaced(strong, ["video_id"], "frame_id", [-F.col("change"), -F.col("frame_id")], min_gap, limit)


def moment_seeds(results: DataFrame, keyframes: DataFrame, padding: int = 300, limit: int = 30, tolerance: int = 60) -> DataFrame:
    """Event-wide moments from ranked results: one per event, ending at the next event."""
    timeline = ordered_events(keyframes).select("video_id", "event_id", "start_frame", "end_frame", "next_start")
    placed = attach_events(results.select(*KEY, "score", "rank"), keyframes, tolerance).join(timeline, ["video_id", "event_id"], "left")
    group = F.coalesce("event_id", F.concat(F.lit("frame:"), F.floor(F.col("frame_id") / padding)))
    start = F.coalesce("start_frame", F.greatest(F.lit(0), F.col("frame_id") - padding))
    end = F.when(F.col("event_id").isNull(), F.col("frame_id") + padding + 1).otherwise(F.coalesce("next_start", F.col("end_frame") + padding))
    rows = placed.select(
        "query_id", "video_id", group.alias("event"), start.alias("start_frame"), end.alias("_end"), "score", F.col("rank").alias("coarse_rank")
    ).withColumn("end_frame", F.when(F.col("_end") <= F.col("start_frame"), F.col("start_frame") + padding).otherwise(F.col("_end")))
    first = best_row(rows, ["query_id", "video_id", "event"], [F.asc("coarse_rank")])
    kept = ranked(first, ["query_id"], [F.asc("coarse_rank")], limit, "seed_rank")
    return kept.withColumn("score", F.round(F.greatest("score", F.lit(1.0) / (F.col("coarse_rank") + 30)), 9)).drop("_end")


def interval_candidates(proposals: DataFrame, grid: DataFrame, count: int = 5, limit: int = 120) -> DataFrame:
    """Keyframes of ranked intervals: evenly spaced targets snapped to the grid, inside
    the interval where possible. ``proposals(query_id, video_id, start_frame, end_frame,
    score, rank)``; intervals that are empty are ignored, a count of one takes the middle."""
    ok = proposals.filter("end_frame > start_frame")
    if count <= 1:
        count, target = 1, F.floor((F.col("start_frame") + F.col("end_frame")) / 2)
    else:
        target = F.rint(F.col("start_frame") + (F.col("end_frame") - F.col("start_frame")) * F.col("_k") / F.lit(count - 1)).cast("bigint")
    spread = ok.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("_x", target)
    inside = snap_inside(spread, grid, "_x", "start_frame", "end_frame")
    frames = grid.select("video_id", F.col("frame_id").alias("_g"))
    snapped = asof(inside, frames, ["video_id"], "_x", "_g", [], "nearest").withColumn("frame_id", F.coalesce("snapped", "matched_pos", "_x"))
    one = best_row(snapped, ["query_id", "rank", "video_id", "frame_id"], [F.asc("_k")])
    local = ranked(one, ["query_id", "rank"], [F.asc("_k")], name="local_rank")
    scored = local.withColumn("candidate_score", F.round(F.col("score") + F.lit(1.0) / (F.col("local_rank") + 10), 9))
    best = best_row(scored, KEY, [F.desc("candidate_score"), F.asc("rank")]).withColumnRenamed("rank", "proposal_rank")
    return ranked(
        best, ["query_id"], [F.asc("proposal_rank"), F.desc("candidate_score"), F.asc("video_id"), F.asc("frame_id")], limit
    ).select(*KEY, "candidate_score", "proposal_rank", "local_rank", "rank")


def event_midpoints(keyframes: DataFrame) -> DataFrame:
    """Middle keyframe of every event."""
    sizes = keyframes.groupBy("video_id", "event_id").agg(F.count(F.lit(1)).alias("_n"))
    numbered = positions(keyframes.select("video_id", "event_id", "frame_id"), ["video_id", "event_id"], "frame_id", name="_i")
    return numbered.join(sizes, ["video_id", "event_id"]).filter(F.col("_i") - 1 == F.floor(F.col("_n") / 2)).select(
        "video_id", "event_id", F.col("frame_id").alias("mid_frame")
    )


def adjacent_events(pool: DataFrame, keyframes: DataFrame, temporal: bool, limit: int, anchors: int = 34, reach: int = 10, tolerance: int = 60) -> DataFrame:
    """Pool frames with the midpoints of neighbouring events.

    Temporal: the first anchors become numbered chains of previous, current and next
    midpoints, the pool follows. Otherwise a frame within ``reach`` of its event's
    border is followed by the neighbour's midpoint.
    """
    order = ordered_events(keyframes)
    mids = event_midpoints(keyframes)
    placed = attach_events(pool.select(*KEY, "rank"), keyframes, tolerance).join(
        order.select("video_id", "event_id", "start_frame", "end_frame", "prev_event", "next_event"), ["video_id", "event_id"], "left"
    )
    own = pool.select(*KEY, "rank", F.lit(0).alias("part"))
    if temporal:
        cells = F.array(*[F.struct(F.lit(i).alias("part"), F.col(c).alias("_e")) for i, c in enumerate(["prev_event", "event_id", "next_event"])])
        chain = placed.filter(F.col("rank") <= anchors).filter("event_id is not null").select("query_id", "video_id", "rank", F.explode(cells).alias("_c"))
        named = chain.select("query_id", "video_id", "rank", "_c.part", F.col("_c._e").alias("event_id")).filter("event_id is not null")
        extra = named.join(mids, ["video_id", "event_id"]).select("query_id", "video_id", F.col("mid_frame").alias("frame_id"), "rank", "part")
        return _first_places([extra.withColumn("band", F.lit(0)), own.withColumn("band", F.lit(1))], limit)
    at_end = (F.col("end_frame") - F.col("frame_id") <= reach) & F.col("next_event").isNotNull()
    at_start = (F.col("frame_id") - F.col("start_frame") <= reach) & F.col("prev_event").isNotNull()
    side = F.when(at_end, F.col("next_event")).when(at_start, F.col("prev_event"))
    near = placed.withColumn("_e", side).filter("_e is not null").select("query_id", "video_id", "rank", F.col("_e").alias("event_id"))
    extra = near.join(mids, ["video_id", "event_id"]).select("query_id", "video_id", F.col("mid_frame").alias("frame_id"), "rank", F.lit(1).alias("part"))
    return _first_places([own.unionByName(extra).withColumn("band", F.lit(0))], limit)


def _first_places(parts: Sequence[DataFrame], limit: int) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = best_row(rows, KEY, [F.asc("band"), F.asc("rank"), F.asc("part")])
    return ranked(
        first.withColumnRenamed("rank", "source_rank"), ["query_id"], [F.asc("band"), F.asc("source_rank"), F.asc("part"), F.asc("frame_id")], limit
    ).select(*KEY, "band", "source_rank", "part", "rank")


def critic_events(baseline: DataFrame, keyframes: DataFrame, events_k: int, seed_videos: int = 10) -> DataFrame:
    """The events a late critic looks at, ``event_position`` from 1.

    Events of rows that a deep lane brought (``deep_rank > 0``, by ``deep_event_rank``,
    ``deep_rank``, rank) come before events in baseline order. A query none of whose rows
    lies in an event takes the events of its first ``seed_videos`` videos in time order.
    """
    rows = baseline
    for name in ("deep_rank", "deep_event_rank"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("bigint"))
    deep = F.col("deep_rank") > 0
    last = F.lit(1e9)
    place = F.when(
        deep,
        F.struct(F.lit(0).alias("b"), F.coalesce("deep_event_rank", last).alias("e"), F.coalesce("deep_rank", last).alias("v"), F.col("rank").alias("r")),
    ).otherwise(F.struct(F.lit(1).alias("b"), F.lit(0.0).alias("e"), F.lit(0.0).alias("v"), F.col("rank").alias("r")))
    placed = attach_events(rows.select(*KEY, "rank", place.alias("_place")), keyframes).filter("event_id is not null")
    firsts = placed.groupBy("query_id", "video_id", "event_id").agg(F.min("_place").alias("_place"))
    found = ranked(firsts, ["query_id"], [F.asc("_place"), F.asc("video_id"), F.asc("event_id")], events_k, "event_position")
    empty = rows.join(placed.select("query_id").distinct(), "query_id", "left_anti").groupBy("query_id", "video_id").agg(F.min("rank").alias("_r"))
    videos = ranked(empty, ["query_id"], [F.asc("_r")], seed_videos, "_v")
    spans = ordered_events(keyframes.join(videos.select("video_id").distinct(), "video_id", "left_semi"))
    seeded = ranked(
        videos.join(spans.select("video_id", "event_id", "event_order"), "video_id"), ["query_id"], [F.asc("_v"), F.asc("event_order")], events_k, "event_position"
    )
    cols = ["query_id", "video_id", "event_id", "event_position"]
    return found.select(*cols).unionByName(seeded.select(*cols))


CRITIC_MODELS = ("visual_pe_core", "visual_beit3", "visual_siglip2")


def critic_pool(
    baseline: DataFrame,
    keyframes: DataFrame,
    local: DataFrame,
    events_k: int = 8,
    per_event: int = 50,
    pool_limit: int = 600,
    limit: int = 350,
    models: Sequence[str] = CRITIC_MODELS,
) -> DataFrame:
    """Frames for a late critic, parts in order, first occurrence of a frame wins: baseline
    head, even samples of the chosen events, in-event frames by fused model ranks, then each
    model's own list, then the rest of the baseline.

    ``baseline`` may carry ``deep_rank`` and ``deep_event_rank`` (see ``critic_events``).
    ``local`` are in-video signals, clause lanes of a model (``model__...``) included; at
    most ``per_event`` of a model's signals count in an event, in lane and score order. A
    query without any event keeps the baseline.
    """
    head = min(100, limit)
    budget = min(250, max(1, limit - head))
    head = max(1, min(100, limit - budget))
    events = critic_events(baseline, keyframes, events_k)
    quotas = even_quota(events, ["query_id"], [F.asc("event_position")], budget)
    members = quotas.join(keyframes, ["video_id", "event_id"])
    even = linspace_pick(members, ["query_id", "video_id", "event_id"], "frame_id", F.col("quota"))
    sampled = ranked(even.select(*KEY, "event_position"), ["query_id"], [F.asc("event_position"), F.asc("frame_id")])
    signals = local.select("query_id", "lane", F.split_part("lane", F.lit("__"), F.lit(1)).alias("model"), "video_id", "frame_id", "score")
    inside = attach_events(signals.filter(F.col("model").isin(*models)), keyframes).join(
        events.select("query_id", "video_id", "event_id"), ["query_id", "video_id", "event_id"], "left_semi"
    )
    capped = ranked(
        inside, ["query_id", "model", "video_id", "event_id"], [F.asc("lane"), F.desc("score"), F.asc("frame_id")], per_event, "_n"
    )
    best = capped.groupBy(*KEY, "model").agg(F.max("score").alias("score"))
    by_model = ranked(best, ["query_id", "model"], [F.desc("score"), F.asc("video_id"), F.asc("frame_id")])
    fused = by_model.groupBy(*KEY).agg(F.round(F.sum(F.lit(2.0) / (F.col("rank") + 30)), 9).alias("_s"))
    pooled = ranked(fused, ["query_id"], [F.desc("_s"), F.asc("video_id"), F.asc("frame_id")], pool_limit)
    lists = [by_model.filter(F.col("model") == m) for m in models]
    parts = [baseline.filter(F.col("rank") <= head), sampled, pooled, *lists, baseline]
    return ordered_union([p.select(*KEY, "rank") for p in parts], KEY, limit=limit).select(*KEY, "band", "rank")


def locked_video_candidates(videos: DataFrame, keyframes: DataFrame, local_events: DataFrame, limit: int, dense: int = 8, escapes: int = 4) -> DataFrame:
    """Frames of locked videos: dense samples of the strongest events, escape events
    along the timeline, then event midpoints; best local evidence first.

    ``videos(query_id, video_id, position)``; ``local_events`` ranked per query.
    """
    spans = ordered_events(keyframes)
    counts = spans.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_events"))
    quota = cut_lineage(divisor_quota(videos.join(counts, "video_id"), limit))
    placed = ranked(local_events.drop("rank"), ["query_id", "video_id"], [F.desc("score"), F.desc("n_lanes"), F.asc("event_id")], name="local_rank")
    ev_rank = cut_lineage(placed.join(quota, ["query_id", "video_id"]))
    top = ev_rank.filter(F.col("local_rank") <= F.least(F.lit(dense), F.col("quota")))
    n_top = top.groupBy("query_id", "video_id").agg(F.count(F.lit(1)).alias("_m"))
    alloc = top.join(n_top, ["query_id", "video_id"]).withColumn(
        "event_quota",
        F.floor(F.col("quota") / F.col("_m")) + (F.col("local_rank") <= F.pmod("quota", F.col("_m"))).cast("int"),
    )
    rows = alloc.select("query_id", "video_id", "event_id", "local_rank", "event_quota").join(keyframes, ["video_id", "event_id"])
    dense_rows = cut_lineage(
        linspace_pick(rows, ["query_id", "video_id", "event_id"], "frame_id", F.col("event_quota")).select(
            *KEY, "event_id", F.lit(0).alias("band"), F.col("local_rank").alias("_a")
        )
    )
    wanted = keyframes.join(quota.select("video_id").distinct(), "video_id", "left_semi")
    spans, mids = cut_lineage(ordered_events(wanted)), cut_lineage(event_midpoints(wanted))
    timeline = quota.join(spans.select("video_id", "event_id", "event_order"), "video_id").join(
        top.select("query_id", "video_id", "event_id"), ["query_id", "video_id", "event_id"], "left_anti"
    )
    used = dense_rows.select(*KEY).distinct().groupBy("query_id", "video_id").agg(F.count(F.lit(1)).alias("_used"))
    places = F.least(F.lit(escapes), F.greatest(F.lit(0), F.col("quota") - F.coalesce("_used", F.lit(0))))
    timeline = timeline.join(used, ["query_id", "video_id"], "left").withColumn("_places", places).filter(F.col("_places") > 0)
    spread = linspace_pick(timeline, ["query_id", "video_id"], "event_order", F.col("_places"), "first").join(mids, ["video_id", "event_id"])
    escape_rows = spread.select("query_id", "video_id", F.col("mid_frame").alias("frame_id"), "event_id", F.lit(1).alias("band"), F.col("event_order").alias("_a"))
    ranked_rest = ev_rank.filter(F.col("local_rank") > 16).join(mids, ["video_id", "event_id"]).select(
        "query_id", "video_id", F.col("mid_frame").alias("frame_id"), "event_id", F.lit(2).alias("band"), F.col("local_rank").alias("_a")
    )
    every = quota.join(spans.select("video_id", "event_id", "event_order"), "video_id").join(mids, ["video_id", "event_id"]).select(
        "query_id", "video_id", F.col("mid_frame").alias("frame_id"), "event_id", F.lit(3).alias("band"), F.col("event_order").alias("_a")
    )
    union = dense_rows.unionByName(escape_rows).unionByName(ranked_rest).unionByName(every)
    one = best_row(union, [*KEY, "event_id"], [F.asc("band"), F.asc("_a")])
    inside = ranked(one, ["query_id", "video_id"], [F.asc("band"), F.asc("_a"), F.asc("frame_id")], name="candidate_rank").join(
        quota.select("query_id", "video_id", "position", "quota"), ["query_id", "video_id"]
    ).filter(F.col("candidate_rank") <= F.col("quota"))
    found = ev_rank.select("query_id", "video_id", "event_id", F.col("score").alias("_es"), "local_rank")
    place = ranked(quota, ["query_id"], [F.asc("position")], name="video_rank").select("query_id", "video_id", "video_rank")
    scored = inside.join(found, ["query_id", "video_id", "event_id"], "left").join(place, ["query_id", "video_id"])
    score = F.lit(1.0) / (F.col("video_rank") + 10) + F.lit(1.0) / (F.col("candidate_rank") + 10) + F.coalesce("_es", F.lit(0.0))
    pool = ranked(scored.withColumn("score", F.round(score, 9)), ["query_id"], [F.asc("candidate_rank"), F.asc("video_rank")], limit, "_pool")
    return ranked(
        pool,
        ["query_id"],
        [F.desc("score"), F.asc(F.coalesce("local_rank", F.lit(0))), F.asc("video_rank"), F.asc("frame_id")],
    ).select(*KEY, "event_id", "band", "candidate_rank", "score", "rank")


def window_borders(anchors: DataFrame, grid: DataFrame, seconds: float | Column) -> DataFrame:
    """Anchors snapped to the grid with the borders of their windows, which end with the video."""
    frames = grid.select("video_id", F.col("frame_id").alias("_g"))
    snapped = asof(anchors, frames, ["video_id"], "frame_id", "_g", [], "nearest").withColumn("frame_id", F.col("matched_pos")).drop("matched_pos")
    ends = grid.groupBy("video_id").agg(F.min("frame_id").alias("_lo"), F.max("frame_id").alias("_hi"))
    half = F.lit(seconds) * F.col("fps") / 2
    return snapped.join(ends, "video_id").select(
        "request_id",
        "video_id",
        F.col("frame_id").alias("anchor_frame"),
        F.greatest(F.col("_lo"), F.floor(F.col("frame_id") - half)).alias("start_frame"),
        F.least(F.col("_hi"), F.ceil(F.col("frame_id") + half)).alias("end_frame"),
        "fps",
    )


def window_frames(anchors: DataFrame, grid: DataFrame, seconds: float | Column) -> DataFrame:
    """(request_id, video_id, frame_id): frames of the grid in the windows around the anchors; smaller windows
    hold no others. Windows and grid meet in cells, so what is joined grows with the windows' content."""
    cells = F.sequence(F.floor(F.col("start_frame") / WINDOW_CELL), F.floor(F.col("end_frame") / WINDOW_CELL))
    windows = window_borders(anchors, grid, seconds).select("request_id", "video_id", "start_frame", "end_frame", F.explode(cells).alias("_c"))
    frames = grid.select("video_id", "frame_id", F.floor(F.col("frame_id") / WINDOW_CELL).alias("_c"))
    inside = frames.join(windows, ["video_id", "_c"]).filter(F.col("frame_id").between(F.col("start_frame"), F.col("end_frame")))
    return inside.select("request_id", "video_id", "frame_id")


def anchored_timeline(anchors: DataFrame, grid: DataFrame, changes: DataFrame, seconds: float | Column, sample_fps: float, max_frames: int, near_seconds: float = 0.15) -> DataFrame:
    """Sampled frames around an anchor snapped to the grid, flagged as anchor or close
    to a change point. ``anchors(request_id, video_id, frame_id, fps)``; the window may be a
    column of theirs."""
    requests = window_borders(anchors, grid, seconds)
    required = requests.select("request_id", F.col("anchor_frame").alias("frame_id"))
    sampled = sample_intervals(requests.drop("anchor_frame"), grid, sample_fps, max_frames, required)
    flagged = asof(sampled, changes.select("video_id", F.col("frame_id").alias("_cp")), ["video_id"], "frame_id", "_cp", [], "nearest")
    out = flagged.join(requests.select("request_id", "anchor_frame", "fps"), "request_id")
    reach = F.greatest(F.lit(2.0), F.rint(F.col("fps") * near_seconds))
    return out.select(
        "request_id",
        "video_id",
        "frame_id",
        (F.col("frame_id") == F.col("anchor_frame")).alias("is_anchor"),
        F.coalesce(F.abs(F.col("matched_pos") - F.col("frame_id")) <= reach, F.lit(False)).alias("near_change"),
    )
