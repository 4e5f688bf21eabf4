"""As-of, proximity, pair, hierarchy and moment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelweave.catalog import standins as st
from reelweave.catalog.ranking import RN
from reelweave.catalog.registry import cte, query
from reelweave.operators import events as ev
from reelweave.operators import moments as mo
from reelweave.operators import timeline as tl

HIT = ["event_id", "video_id", "frame_id"]


def of_type(spark, d, *types):
    return st.timeline(spark, d).filter(F.col("event_type").isin(*types))


def points(spark, d, *types):
    """Distinct frames of some event types."""
    return of_type(spark, d, *types).select("video_id", "frame_id").distinct()


cte("hits_v", "SELECT event_id, video_id, frame_id, value FROM timeline WHERE event_type IN ('error', 'signup')", "timeline")


def hits_v(spark, d):
    return of_type(spark, d, "error", "signup").select(*HIT, "value")


@query(
    "nearest_event",
    """SELECT event_id, video_id, frame_id, kf AS event_frame, ev AS event FROM (
  SELECT h.event_id, h.video_id, h.frame_id, k.frame_id AS kf, k.event_id AS ev,
    row_number() OVER (PARTITION BY h.event_id ORDER BY abs(k.frame_id - h.frame_id) NULLS LAST, k.frame_id) AS n
  FROM hits_v h LEFT JOIN keyframes k ON k.video_id = h.video_id AND abs(k.frame_id - h.frame_id) <= 60) WHERE n = 1""",
    ("hits_v", "keyframes"),
)
def nearest_event(spark, d):
    """Hits resolved to the exact or nearest event keyframe within 60."""
    hits = hits_v(spark, d).drop("value").withColumnRenamed("event_id", "hit_id")
    out = ev.attach_events(hits, st.keyframes(spark, d), 60)
    return out.select(F.col("hit_id").alias("event_id"), "video_id", "frame_id", "event_frame", F.col("event_id").alias("event"))


@query(
    "nearest_keyframe",
    """SELECT event_id, video_id, frame_id, kf AS keyframe FROM (
  SELECT h.event_id, h.video_id, h.frame_id, k.frame_id AS kf, row_number() OVER (PARTITION BY h.event_id ORDER BY abs(k.frame_id - h.frame_id) NULLS LAST, k.frame_id) AS n
  FROM hits_v h LEFT JOIN keyframes k ON k.video_id = h.video_id AND abs(k.frame_id - h.frame_id) <= 5) WHERE n = 1""",
    ("hits_v", "keyframes"),
)
def nearest_keyframe(spark, d):
    out = tl.asof(
        hits_v(spark, d).drop("value"), points(spark, d, "view", "click", "purchase"), ["video_id"], "frame_id", "frame_id", [], "nearest", 5
    )
    return out.withColumnRenamed("matched_pos", "keyframe")


cte(
    "segments_v",
    "SELECT event_id AS seg_id, video_id, frame_id AS start_frame, frame_id + 1 + CAST(floor(value * 10) AS BIGINT) AS end_frame, row_number() OVER (PARTITION BY video_id ORDER BY frame_id, event_id) AS rank FROM timeline WHERE event_type = 'signup'",
    "timeline",
)


def segments_v(spark, d):
    t = of_type(spark, d, "signup").select(
        F.col("event_id").alias("seg_id"),
        "video_id",
        F.col("frame_id").alias("start_frame"),
        (F.col("frame_id") + 1 + F.floor(F.col("value") * 10)).alias("end_frame"),
    )
    return tl.positions(t, ["video_id"], "start_frame", ["seg_id"], "rank")


@query(
    "segment_snap",
    """SELECT seg_id, video_id, frame_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY rank) AS n FROM (
    SELECT seg_id, video_id, rank, coalesce((SELECT min(frame_id) FROM keyframes k WHERE k.video_id = s.video_id AND k.frame_id >= s.start_frame AND k.frame_id < s.end_frame), start_frame) AS frame_id FROM segments_v s)) WHERE n = 1""",
    ("segments_v", "keyframes"),
)
def segment_snap(spark, d):
    """Time ranges snapped to the earliest candidate frame inside them, best rank per frame."""
    from reelweave.operators.ranking import best_row

    frames = points(spark, d, "view", "click", "purchase")
    found = tl.asof(segments_v(spark, d), frames, ["video_id"], "start_frame", "frame_id", [], "forward")
    inside = F.col("matched_pos") < F.col("end_frame")
    placed = found.select(
        "seg_id", "video_id", F.when(inside, F.col("matched_pos")).otherwise(F.col("start_frame")).alias("frame_id"), "rank"
    )
    return best_row(placed, ["video_id", "frame_id"], [F.asc("rank")])


@query(
    "nearest_transcript_start",
    """SELECT event_id, video_id, frame_id, p AS segment_start FROM (
  SELECT h.event_id, h.video_id, h.frame_id, k.frame_id AS p, row_number() OVER (PARTITION BY h.event_id ORDER BY abs(k.frame_id - h.frame_id) NULLS LAST, k.frame_id) AS n
  FROM hits_v h LEFT JOIN (SELECT DISTINCT video_id, frame_id FROM timeline WHERE event_type = 'click') k ON k.video_id = h.video_id) WHERE n = 1""",
    ("hits_v", "timeline"),
)
def nearest_transcript_start(spark, d):
    """Nearest segment by its start, at any distance."""
    out = tl.asof(hits_v(spark, d).drop("value"), points(spark, d, "click"), ["video_id"], "frame_id", "frame_id", [], "nearest")
    return out.withColumnRenamed("matched_pos", "segment_start")


_TERMS = ["\"k\": 6", "\"k\": 77"]
cte(
    "text_rows",
    """SELECT video_id, frame_id AS s, CASE WHEN event_type = 'click' THEN frame_id ELSE frame_id + CAST(floor(value) AS BIGINT) END AS e, event_type, props
FROM timeline WHERE event_type IN ('click', 'view')""",
    "timeline",
)


def text_rows(spark, d):
    return of_type(spark, d, "click", "view").select(
        "video_id",
        F.col("frame_id").alias("s"),
        F.when(F.col("event_type") == "click", F.col("frame_id")).otherwise(F.col("frame_id") + F.floor("value")).alias("e"),
        "event_type",
        "props",
    )


def _evidence_sql(limit=None):
    cond = "(props LIKE '%\"k\": 6%' OR props LIKE '%\"k\": 77%')"
    near = f" AND greatest(0, s - frame_id, frame_id - e) <= {limit}" if limit else ""
    return f"""SELECT h.event_id, h.video_id, h.frame_id, CAST(min(CASE WHEN s IS NOT NULL THEN greatest(0, s - frame_id, frame_id - e) END) AS DOUBLE) AS distance FROM hits_v h
LEFT JOIN text_rows t ON t.video_id = h.video_id AND {cond}{near} GROUP BY ALL"""


@query("text_evidence_in_video", _evidence_sql(), ("hits_v", "text_rows"))
def text_evidence_in_video(spark, d):
    """Distance of each hit to the nearest text row of its video that has one of the terms."""
    rows = text_rows(spark, d).filter(F.exists(F.array(*[F.lit(t) for t in _TERMS]), lambda t: F.contains(F.col("props"), t)))
    out = tl.nearest_interval(hits_v(spark, d).drop("value"), rows, ["video_id"], "frame_id", "s", "e", [])
    return out.select(*HIT, "distance")


@query("text_evidence_near", _evidence_sql(600), ("hits_v", "text_rows"))
def text_evidence_near(spark, d):
    rows = text_rows(spark, d).filter(F.exists(F.array(*[F.lit(t) for t in _TERMS]), lambda t: F.contains(F.col("props"), t)))
    out = tl.nearest_interval(hits_v(spark, d).drop("value"), rows, ["video_id"], "frame_id", "s", "e", [], 600 + 1e-9)
    return out.select(*HIT, "distance")


@query(
    "nearest_text_display",
    """SELECT h.event_id, h.video_id, h.frame_id,
  (SELECT CAST(min(abs(s - h.frame_id)) AS DOUBLE) FROM text_rows t WHERE t.event_type = 'click' AND t.video_id = h.video_id AND abs(s - h.frame_id) < 50.1) AS ocr_distance,
  (SELECT CAST(min(greatest(0, s - h.frame_id, h.frame_id - e)) AS DOUBLE) FROM text_rows t WHERE t.event_type = 'view' AND t.video_id = h.video_id AND greatest(0, s - h.frame_id, h.frame_id - e) < 30.1) AS speech_distance
FROM hits_v h""",
    ("hits_v", "text_rows"),
)
def nearest_text_display(spark, d):
    """Nearest screen text within a strict point tolerance and nearest speech by interval distance."""
    rows = text_rows(spark, d)
    hits = hits_v(spark, d).drop("value")
    ocr = tl.asof(hits, rows.filter("event_type = 'click'").select("video_id", "s").distinct(), ["video_id"], "frame_id", "s", [], "nearest", 50.1, True)
    ocr = ocr.withColumn("ocr_distance", F.abs(F.col("matched_pos") - F.col("frame_id")).cast("double")).drop("matched_pos")
    out = tl.nearest_interval(ocr, rows.filter("event_type = 'view'"), ["video_id"], "frame_id", "s", "e", [], 30.1)
    return out.select(*HIT, "ocr_distance", F.col("distance").alias("speech_distance"))


@query(
    "nearest_boundaries",
    """SELECT event_id, video_id, frame_id, start_frame, distance, CAST(n AS INTEGER) AS rank FROM (
  SELECT h.event_id, h.video_id, h.frame_id, o.start_frame, abs(o.start_frame - h.frame_id) AS distance, row_number() OVER (PARTITION BY h.event_id ORDER BY abs(o.start_frame - h.frame_id), o.start_frame) AS n
  FROM hits_v h JOIN ordered_events o ON o.video_id = h.video_id) WHERE n <= 3""",
    ("hits_v", "ordered_events"),
)
def nearest_boundaries(spark, d):
    """The three event starts nearest to each hit."""
    events = ev.ordered_events(st.keyframes(spark, d)).select("video_id", "start_frame")
    return tl.nearest_k(hits_v(spark, d).drop("value"), events, ["video_id"], ["event_id"], "frame_id", "start_frame", 3)


def videos(spark, d):
    """Video metadata: 25 fps, 30 fps or unknown by label."""
    labels = st.frames(spark, d).groupBy("video_id", "label").agg(F.max("frame_id").alias("last_frame"))
    fps = F.when(F.pmod("label", F.lit(3)) == 0, 25.0).when(F.pmod("label", F.lit(3)) == 1, 30.0)
    return labels.select("video_id", fps.alias("fps"), (F.col("last_frame") / 25.0).alias("duration"))


cte(
    "videos",
    "SELECT video_id, CASE label % 3 WHEN 0 THEN 25.0::DOUBLE WHEN 1 THEN 30.0::DOUBLE END AS fps, max(frame_id) / 25.0 AS duration FROM frames GROUP BY video_id, label",
    "frames",
)
cte(
    "core_hits",
    "SELECT s.query_id, s.video_id, s.frame_id, s.score, s.rank, coalesce(fps, 25.0) AS fps FROM signals s JOIN videos USING (video_id) WHERE lane = 'visual_siglip2'",
    "signals",
    "videos",
)


def core_hits(spark, d):
    return st.signals(spark, d, ["visual_siglip2"]).drop("lane")


@query(
    "start_end_pairs",
    f"""SELECT * FROM (SELECT query_id, video_id, start_frame, end_frame, start_score, end_score, duration, score, {RN.format(o='score DESC, video_id, start_frame, end_frame')} AS rank FROM (
  SELECT a.query_id, a.video_id, a.frame_id AS start_frame, b.frame_id AS end_frame, a.score AS start_score, b.score AS end_score, (b.frame_id - a.frame_id) / fps AS duration, round(a.score + b.score, 6) AS score
  FROM (SELECT * FROM core_hits WHERE rank <= 20) a JOIN (SELECT query_id, video_id, frame_id, score FROM signals WHERE lane = 'visual_pe_core' AND rank <= 20) b USING (query_id, video_id)
  WHERE b.frame_id > a.frame_id AND (b.frame_id - a.frame_id) / fps BETWEEN 0 AND 10)) WHERE rank <= 10""",
    ("core_hits", "signals"),
)
def start_end_pairs(spark, d):
    """Start hits of one lane with end hits of another, at most 10 s apart."""
    ends = st.signals(spark, d, ["visual_pe_core"]).drop("lane")
    return mo.segment_pairs(core_hits(spark, d), ends, videos(spark, d), 10, max_seconds=10.0)


cte(
    "near_hits",
    """SELECT a.query_id, a.video_id, a.frame_id, a.score, a.rank, a.fps, sum(b.score) AS near, count(*) AS n FROM core_hits a
JOIN core_hits b ON a.query_id = b.query_id AND a.video_id = b.video_id AND abs(a.frame_id - b.frame_id) / a.fps <= 2.0 GROUP BY ALL""",
    "core_hits",
)


@query(
    "neighbour_sum",
    "SELECT query_id, video_id, frame_id, score, rank, round(near, 6) AS total, n - 1 AS n_neighbours FROM near_hits",
    ("near_hits",),
)
def neighbour_sum(spark, d):
    return mo.neighbour_sum(core_hits(spark, d), videos(spark, d), 2.0)


@query(
    "neighbour_sum_others",
    "SELECT query_id, video_id, frame_id, score, rank, round(near - score, 6) AS total, n - 1 AS n_neighbours FROM near_hits",
    ("near_hits",),
)
def neighbour_sum_others(spark, d):
    return mo.neighbour_sum(core_hits(spark, d), videos(spark, d), 2.0, include_center=False)


@query(
    "neighbour_blend",
    "SELECT query_id, video_id, frame_id, score, rank, round(score + 0.5 * CASE WHEN n > 1 THEN (near - score) / (n - 1) ELSE 0 END, 12) AS blended FROM near_hits",
    ("near_hits",),
)
def neighbour_blend(spark, d):
    return mo.neighbour_blend(core_hits(spark, d), videos(spark, d), 2.0)


@query(
    "neighbour_sum_events",
    """SELECT a.video_id, a.frame_id, round(sum(b.value), 4) AS sum_near, CAST(count(*) AS BIGINT) AS n_near FROM (SELECT DISTINCT video_id, frame_id FROM timeline) a
JOIN timeline b ON b.video_id = a.video_id AND abs(b.frame_id - a.frame_id) <= 1440 GROUP BY ALL""",
    ("timeline",),
)
def neighbour_sum_events(spark, d):
    """Value mass within a day around each event minute."""
    out = tl.neighbour_totals(st.timeline(spark, d), ["video_id"], "frame_id", "value", 1440)
    return out.select("video_id", "frame_id", F.round("sum_near", 4).alias("sum_near"), "n_near")


@query(
    "time_segment_keys",
    "SELECT video_id, frame_id, video_id || '::seg' || CAST(floor(frame_id / coalesce(fps, 25.0) / 5.0) AS BIGINT) AS segment_id FROM frames JOIN videos USING (video_id)",
    ("frames", "videos"),
)
def time_segment_keys(spark, d):
    f = mo.with_fps(st.frames(spark, d).select("video_id", "frame_id"), videos(spark, d))
    return f.select("video_id", "frame_id", mo.segment_key(F.col("video_id"), F.col("frame_id"), F.col("fps"), 5.0).alias("segment_id"))


def _tiers(agg):
    return f"""SELECT f.query_id, f.video_id, f.segment_id, f.frame_id, f.score, CAST(f.frame_rank AS INTEGER) AS frame_rank, s.segment_score, CAST(s.segment_rank AS INTEGER) AS segment_rank, v.video_score, CAST(v.video_rank AS INTEGER) AS video_rank
FROM tier_frames f JOIN tier_segments_{agg} s USING (query_id, video_id, segment_id) JOIN tier_videos_{agg} v USING (query_id, video_id)"""


cte(
    "tier_frames",
    """SELECT * FROM (SELECT query_id, video_id, frame_id, score, segment_id, row_number() OVER (PARTITION BY query_id, video_id, segment_id ORDER BY score DESC, frame_id) AS frame_rank FROM (
  SELECT *, video_id || '::seg' || CAST(floor(frame_id / fps / 5.0) AS BIGINT) AS segment_id FROM core_hits)) WHERE frame_rank <= 20""",
    "core_hits",
)
for _agg in ("max", "sum"):
    cte(
        f"tier_segments_{_agg}",
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY segment_score DESC, segment_id) AS segment_rank FROM (
  SELECT query_id, video_id, segment_id, round({_agg}(score), 6) AS segment_score FROM tier_frames GROUP BY ALL)) WHERE segment_rank <= 3""",
        "tier_frames",
    )
    cte(
        f"tier_videos_{_agg}",
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY video_score DESC, video_id) AS video_rank FROM (
  SELECT query_id, video_id, round({_agg}(segment_score), 6) AS video_score FROM tier_segments_{_agg} GROUP BY ALL)) WHERE video_rank <= 6""",
        f"tier_segments_{_agg}",
    )
    cte(f"tiers_{_agg}", _tiers(_agg), "tier_frames", f"tier_segments_{_agg}", f"tier_videos_{_agg}")


def tiers(spark, d, agg="max"):
    v = videos(spark, d)
    hits = mo.with_fps(core_hits(spark, d), v)
    key = mo.segment_key(F.col("video_id"), F.col("frame_id"), F.col("fps"), 5.0)
    return mo.hierarchy(hits, key, 6, 3, 20, agg, agg)


@query("hierarchy_max", "SELECT * FROM tiers_max", ("tiers_max",))
def hierarchy_max(spark, d):
    return tiers(spark, d)


@query("hierarchy_sum", "SELECT * FROM tiers_sum", ("tiers_sum",))
def hierarchy_sum(spark, d):
    return tiers(spark, d, "sum")


@query(
    "hierarchy_tree",
    """WITH f AS (SELECT * FROM (SELECT query_id, video_id, event_id, frame_id, score, row_number() OVER (PARTITION BY query_id, video_id, event_id ORDER BY score DESC, frame_id) AS fr FROM core_hits JOIN frame_events USING (video_id, frame_id)) WHERE fr <= 20),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY segment_score DESC, event_id) AS sr FROM (
  SELECT query_id, video_id, event_id, round(max(score), 6) AS segment_score, string_agg(frame_id, '+' ORDER BY fr) AS frames FROM f GROUP BY ALL)) WHERE sr <= 3)
SELECT * FROM (SELECT query_id, video_id, video_score, outline, CAST(row_number() OVER (PARTITION BY query_id ORDER BY video_score DESC, video_id) AS INTEGER) AS video_rank FROM (
  SELECT query_id, video_id, round(max(segment_score), 6) AS video_score, string_agg(event_id || ':' || frames, ' ' ORDER BY sr) AS outline FROM s GROUP BY ALL)) WHERE video_rank <= 6""".replace("WITH f AS", "SELECT * FROM (WITH f AS", 1)
    + ")",
    ("core_hits", "frame_events"),
)
def hierarchy_tree(spark, d):
    """Nested video, segment, frame tree over event ids as segments, printed as an outline."""
    hits = core_hits(spark, d).join(st.frame_events(spark, d), ["video_id", "frame_id"])
    tree = mo.hierarchy_tree(mo.hierarchy(hits, "event_id", 6, 3, 20))
    frames = lambda s: F.array_join(F.transform(s["frames"], lambda f: f["frame_id"].cast("string")), "+")
    outline = F.array_join(F.transform("segments", lambda s: F.concat(s["segment_id"], F.lit(":"), frames(s))), " ")
    return tree.select("query_id", "video_id", "video_score", outline.alias("outline"), "video_rank")


cte(
    "moment_agg",
    """SELECT a.query_id, a.video_id, a.segment_id, a.frame_id, round(sum(b.score), 6) AS agg FROM tiers_max a JOIN tiers_max b USING (query_id, video_id, segment_id)
JOIN videos v ON v.video_id = a.video_id WHERE abs(a.frame_id - b.frame_id) / coalesce(v.fps, 25.0) <= 1.0 GROUP BY ALL""",
    "tiers_max",
    "videos",
)
cte(
    "moment_runs",
    """SELECT *, sum(CASE WHEN agg < 0.7 * peak THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, video_id, segment_id ORDER BY frame_id) AS island FROM (
  SELECT *, first_value(frame_id) OVER w AS peak_frame, first_value(agg) OVER w AS peak FROM moment_agg WINDOW w AS (PARTITION BY query_id, video_id, segment_id ORDER BY agg DESC, frame_id))""",
    "moment_agg",
)
cte(
    "moments",
    f"""SELECT * FROM (SELECT query_id, video_id, segment_id, start_frame, end_frame, peak_frame, score, {RN.format(o='score DESC, video_id, start_frame')} AS rank FROM (
  SELECT query_id, video_id, segment_id, min(frame_id) AS start_frame, max(frame_id) + 1 AS end_frame, peak_frame, peak AS score FROM moment_runs WHERE agg >= 0.7 * peak
  GROUP BY query_id, video_id, segment_id, island, peak_frame, peak HAVING peak_frame BETWEEN min(frame_id) AND max(frame_id))) WHERE rank <= 15""",
    "moment_runs",
)


@query("moment_refinement", "SELECT * FROM moments", ("moments",))
def moment_refinement(spark, d):
    return mo.refine_moments(tiers(spark, d), videos(spark, d), 15, 1.0, 0.7)
