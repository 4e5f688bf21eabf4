"""Sampling, quota and candidate pool queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelweave.catalog import standins as st
from reelweave.catalog.events_q import local_votes
from reelweave.catalog.ranking import RN, fused_ranked
from reelweave.catalog.registry import cte, query
from reelweave.catalog.timeline_q import points
from reelweave.catalog.vectors_q import in_video
from reelweave.operators import events as ev
from reelweave.operators import ranking as rk
from reelweave.operators import sampling as sp
from reelweave.session import cut_lineage

KEY = ["query_id", "video_id", "frame_id"]


def grid(spark, d):
    return points(spark, d, "view", "click", "purchase")


cte("grid_v", "SELECT DISTINCT video_id, frame_id FROM keyframes", "keyframes")
cte(
    "requests",
    "SELECT event_id AS request_id, video_id, frame_id AS start_frame, frame_id + CAST(floor(value * 100) AS BIGINT) AS end_frame FROM timeline WHERE event_type = 'signup'",
    "timeline",
)


def requests(spark, d):
    t = st.timeline(spark, d).filter("event_type = 'signup'")
    return t.select(
        F.col("event_id").alias("request_id"),
        "video_id",
        F.col("frame_id").alias("start_frame"),
        (F.col("frame_id") + F.floor(F.col("value") * 100)).alias("end_frame"),
        F.lit(1.0).alias("fps"),
    )


def _nearest_inside(targets: str) -> str:
    return f"""SELECT * FROM (SELECT t.*, g.frame_id, row_number() OVER (PARTITION BY t.request_id, t.k ORDER BY abs(g.frame_id - t.x), g.frame_id) AS pick FROM ({targets}) t
JOIN grid_v g ON g.video_id = t.video_id AND g.frame_id BETWEEN t.lo AND t.hi) WHERE pick = 1"""


@query(
    "interval_sampling",
    "SELECT DISTINCT request_id, video_id, frame_id, false AS required FROM ("
    + _nearest_inside(
        "SELECT request_id, video_id, start_frame AS lo, end_frame AS hi, k, start_frame + CASE WHEN n > 1 THEN (end_frame - start_frame) / (n - 1) ELSE 0 END * k AS x "
        "FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, CAST(least(12, greatest(1, ceil((end_frame - start_frame) * 0.01::DOUBLE) + 1)) AS BIGINT) AS n FROM requests))"
    )
    + ")",
    ("requests", "grid_v"),
)
def interval_sampling(spark, d):
    """Keyframes spread over the interval of every request."""
    return sp.sample_intervals(requests(spark, d), grid(spark, d), 0.01, 12)


def _thinned(targets: str, maximum: int) -> str:
    """Distinct frames of targets (with ``req``), the free ones thinned to the maximum."""
    return f"""SELECT * FROM (
  SELECT *, count(*) OVER (PARTITION BY request_id) AS n_all, count(*) FILTER (required) OVER (PARTITION BY request_id) AS n_req,
    row_number() OVER (PARTITION BY request_id, required ORDER BY frame_id) - 1 AS i FROM (
    SELECT request_id, video_id, frame_id, bool_or(req) AS required FROM ({_nearest_inside(targets)}) GROUP BY ALL))
WHERE n_all <= {maximum} OR n_req >= {maximum} OR required OR list_contains(CASE WHEN {maximum} - n_req = 1 THEN [(n_all - n_req) // 2]
  ELSE list_transform(range(0, {maximum} - n_req), lambda j: CAST(round_even(j * ((n_all - n_req - 1) / ({maximum} - 1 - n_req)::DOUBLE), 0) AS BIGINT)) END, i)"""


@query(
    "interval_sampling_required",
    "SELECT request_id, video_id, frame_id, required FROM ("
    + _thinned(
        """SELECT request_id, video_id, start_frame AS lo, end_frame AS hi, k, start_frame + CASE WHEN n > 1 THEN (end_frame - start_frame) / (n - 1) ELSE 0 END * k AS x, false AS req
FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, CAST(least(6, greatest(1, ceil((end_frame - start_frame) * 0.01::DOUBLE) + 1)) AS BIGINT) AS n FROM requests))
UNION ALL SELECT r.request_id, r.video_id, start_frame, end_frame, -1 - e.frame_id, e.frame_id, true FROM requests r
JOIN (SELECT DISTINCT video_id, frame_id FROM timeline WHERE event_type = 'error') e ON e.video_id = r.video_id AND e.frame_id BETWEEN start_frame AND end_frame""",
        6,
    )
    + ")",
    ("requests", "grid_v", "timeline"),
)
def interval_sampling_required(spark, d):
    """The same with required frames (the request's errors), thinned to the maximum."""
    r = requests(spark, d)
    errors = points(spark, d, "error").join(r.select("video_id", "request_id", "start_frame", "end_frame"), "video_id")
    required = errors.filter("frame_id between start_frame and end_frame").select("request_id", "frame_id")
    return sp.sample_intervals(r, grid(spark, d), 0.01, 6, required)


def _window_sql(forward: bool) -> str:
    lo = "frame_id" if forward else "greatest(0, frame_id - 600)"
    span = "600" if forward else f"(frame_id + 600 - {lo})"
    targets = (
        f"SELECT request_id, video_id, {lo} AS lo, frame_id + 600 AS hi, k, round({lo} + {span} / (n - 1) * k, 6) AS x FROM (SELECT *, unnest(range(0, n)) AS k FROM "
        f"(SELECT event_id AS request_id, video_id, frame_id, CAST(ceil(round({span} * 0.01::DOUBLE, 9)) + 1 AS BIGINT) AS n FROM timeline WHERE event_type = 'error'))"
    )
    if not forward:
        targets += f" UNION ALL SELECT event_id, video_id, {lo}, frame_id + 600, -1, frame_id FROM timeline WHERE event_type = 'error'"
        return f"SELECT DISTINCT request_id, video_id, frame_id FROM ({_nearest_inside(targets)})"
    return f"""SELECT DISTINCT request_id, video_id, coalesce(frame_id, CAST(round_even(x, 0) AS BIGINT)) AS frame_id FROM (
  SELECT t.request_id, t.video_id, t.x, g.frame_id, row_number() OVER (PARTITION BY t.request_id, t.k ORDER BY abs(g.frame_id - t.x) NULLS LAST, g.frame_id) AS pick FROM ({targets}) t
  LEFT JOIN grid_v g ON g.video_id = t.video_id AND g.frame_id BETWEEN t.lo AND t.hi) WHERE pick = 1"""


def anchors(spark, d):
    t = st.timeline(spark, d).filter("event_type = 'error'")
    return t.select(F.col("event_id").alias("request_id"), "video_id", "frame_id", F.lit(1.0).alias("fps"))


@query("symmetric_window_sampling", _window_sql(False), ("timeline", "grid_v"))
def symmetric_window_sampling(spark, d):
    return sp.sample_windows(anchors(spark, d), grid(spark, d), 600.0, 0.01, 350)


@query("forward_window_sampling", _window_sql(True), ("timeline", "grid_v"))
def forward_window_sampling(spark, d):
    return sp.sample_windows(anchors(spark, d), grid(spark, d), 600.0, 0.01, 350, forward=True)


@query(
    "linspace_sampling",
    """SELECT video_id, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM grid_v)
WHERE n <= 7 OR i IN (SELECT CAST(round_even(k * (n - 1) / 6.0::DOUBLE, 0) AS BIGINT) FROM range(0, 7) t(k))""",
    ("grid_v",),
)
def linspace_sampling(spark, d):
    """Seven evenly spaced keyframes of every video."""
    return sp.linspace_pick(grid(spark, d), ["video_id"], "frame_id", F.lit(7)).select("video_id", "frame_id")


cte(
    "video_sizes",
    "SELECT l_returnflag AS query_id0, CAST(l_suppkey AS VARCHAR) AS video_id, l_suppkey AS position, count(*) AS n_events FROM lineitem GROUP BY ALL",
)


def video_sizes(spark, d):
    from reelweave.session import table

    li = table(spark, d, "lineitem")
    q = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).cast("bigint")
    return li.groupBy(q.alias("query_id"), F.col("l_suppkey").alias("position")).agg(F.count(F.lit(1)).alias("n_events")).withColumn(
        "video_id", F.col("position").cast("string")
    )


_Q = "CASE query_id0 WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END::BIGINT"


@query(
    "even_quota_split",
    f"""SELECT query_id, video_id, CAST(1000 // n + CASE WHEN p <= 1000 % n THEN 1 ELSE 0 END AS INTEGER) AS quota FROM (
  SELECT {_Q} AS query_id, video_id, count(*) OVER (PARTITION BY query_id0) AS n, row_number() OVER (PARTITION BY query_id0 ORDER BY position) AS p FROM video_sizes)""",
    ("video_sizes",),
)
def even_quota_split(spark, d):
    return sp.even_quota(video_sizes(spark, d), ["query_id"], [F.asc("position")], 1000).select("query_id", "video_id", "quota")


@query(
    "divisor_quota_split",
    f"""WITH b AS (SELECT {_Q} AS query_id, video_id, position, n_events, CAST(least(12, greatest(1, floor(1500 / count(*) OVER (PARTITION BY query_id0)))) AS BIGINT) AS base, count(*) OVER (PARTITION BY query_id0) AS n FROM video_sizes)
SELECT b.query_id, b.video_id, CAST(b.base + count(s.slot) AS INTEGER) AS quota FROM b LEFT JOIN (
  SELECT * FROM (SELECT query_id, video_id, slot, base, n, row_number() OVER (PARTITION BY query_id ORDER BY round(sqrt(n_events) / (slot + 1), 12) DESC, position, slot) AS r FROM (SELECT *, unnest(range(base, 35)) AS slot FROM b)) WHERE r <= greatest(0, 1500 - base * n)) s
USING (query_id, video_id) GROUP BY b.query_id, b.video_id, b.base""".replace("WITH b AS", "SELECT * FROM (WITH b AS", 1) + ")",
    ("video_sizes",),
)
def divisor_quota_split(spark, d):
    return sp.divisor_quota(video_sizes(spark, d), 1500).select("query_id", "video_id", "quota")


cte(
    "changes",
    """SELECT * FROM (SELECT *, median(abs(change - med)) OVER (PARTITION BY video_id) AS mad FROM (SELECT *, median(change) OVER (PARTITION BY video_id) AS med FROM (
  SELECT video_id, frame_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(embedding[i] - prev[i]))) / 64, 9) AS change FROM (
    SELECT video_id, frame_id, embedding, lag(embedding) OVER (PARTITION BY video_id ORDER BY frame_id) AS prev FROM frames) WHERE prev IS NOT NULL)))
WHERE change >= med + 0.5::DOUBLE * mad""",
    "frames",
)
cte("change_order", "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY change DESC, frame_id DESC) AS o FROM changes", "changes")
cte(
    "change_walk",
    """RECURSIVE SELECT video_id, o, frame_id, change, [frame_id] AS chosen, true AS picked FROM change_order WHERE o = 1
UNION ALL SELECT m.video_id, m.o, m.frame_id, m.change,
  CASE WHEN len(w.chosen) < 8 AND len(list_filter(w.chosen, lambda c: abs(c - m.frame_id) < 30)) = 0 THEN list_append(w.chosen, m.frame_id) ELSE w.chosen END,
  len(w.chosen) < 8 AND len(list_filter(w.chosen, lambda c: abs(c - m.frame_id) < 30)) = 0
FROM change_walk w JOIN change_order m ON m.video_id = w.video_id AND m.o = w.o + 1""",
    "change_order",
)


def changes(spark, d):
    return sp.change_points(st.frames(spark, d), 30, 8, spread=0.5)


@query(
    "vector_change_points",
    "SELECT video_id, frame_id, change, CAST(row_number() OVER (PARTITION BY video_id ORDER BY o) AS INTEGER) AS pick FROM change_walk WHERE picked",
    ("change_walk",),
)
def vector_change_points(spark, d):
    return changes(spark, d)


cte(
    "moment_seeds",
    f"""SELECT query_id, video_id, event, start_frame, end_frame, round(greatest(score, 1.0 / (30 + coarse_rank)), 9) AS score, coarse_rank, seed_rank FROM (
  SELECT query_id, video_id, event_id AS event, start_frame, coalesce(next_start, end_frame + 300) AS end_frame, score, rank AS coarse_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS seed_rank FROM (
    SELECT r.*, e.event_id, o.start_frame, o.end_frame, o.next_start, row_number() OVER (PARTITION BY query_id, r.video_id, e.event_id ORDER BY r.rank) AS n
    FROM visual_ranked r JOIN frame_events e USING (video_id, frame_id) JOIN frame_event_order o ON o.video_id = r.video_id AND o.event_id = e.event_id) WHERE n = 1) WHERE seed_rank <= 30""",    "visual_ranked",
    "frame_events",
    "frame_event_order",
)


@query("moment_seed_intervals", "SELECT * FROM moment_seeds", ("moment_seeds",))
def moment_seed_intervals(spark, d):
    return sp.moment_seeds(fused_ranked(spark, d, st.VISUAL_LANES), st.frame_events(spark, d))


def _nearer(b: str, f: str) -> str:
    return f"CASE WHEN {b} IS NULL THEN {f} WHEN {f} IS NULL THEN {b} WHEN x - {b} <= {f} - x THEN {b} ELSE {f} END"


cte(
    "seed_targets",
    f"""SELECT *, coalesce({_nearer("CASE WHEN b >= start_frame THEN b END", "CASE WHEN f <= end_frame THEN f END")}, {_nearer("b", "f")}, x) AS frame_id FROM (
  SELECT t.*, (SELECT max(g.frame_id) FROM frames g WHERE g.video_id = t.video_id AND g.frame_id <= t.x) AS b, (SELECT min(g.frame_id) FROM frames g WHERE g.video_id = t.video_id AND g.frame_id >= t.x) AS f FROM (
    SELECT query_id, video_id, start_frame, end_frame, score, seed_rank, k, CAST(round_even(start_frame + (end_frame - start_frame) * k / 4.0::DOUBLE, 0) AS BIGINT) AS x FROM (SELECT *, unnest(range(0, 5)) AS k FROM moment_seeds WHERE end_frame > start_frame)) t)""",
    "frames",
    "moment_seeds",
)


@query(
    "interval_frame_candidates",
    f"""SELECT * FROM (SELECT query_id, video_id, frame_id, candidate_score, proposal_rank, local_rank, {RN.format(o='proposal_rank, candidate_score DESC, video_id, frame_id')} AS rank FROM (
  SELECT query_id, video_id, frame_id, round(score + 1.0::DOUBLE / (local_rank + 10), 9) AS candidate_score, seed_rank AS proposal_rank, CAST(local_rank AS INTEGER) AS local_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, seed_rank ORDER BY k) AS local_rank FROM (SELECT query_id, video_id, seed_rank, score, frame_id, min(k) AS k FROM seed_targets GROUP BY ALL))
  QUALIFY row_number() OVER (PARTITION BY query_id, video_id, frame_id ORDER BY candidate_score DESC, proposal_rank) = 1)) WHERE rank <= 120""",
    ("seed_targets",),
)
def interval_frame_candidates(spark, d):
    """Five keyframes per seed moment, best per frame."""
    seeds = sp.moment_seeds(fused_ranked(spark, d, st.VISUAL_LANES), st.frame_events(spark, d))
    props = cut_lineage(seeds.select("query_id", "video_id", "start_frame", "end_frame", "score", F.col("seed_rank").alias("rank")))
    return sp.interval_candidates(props, st.frames(spark, d).select("video_id", "frame_id"))


cte(
    "mids",
    """SELECT video_id, event_id, frame_id AS mid FROM (SELECT *, row_number() OVER (PARTITION BY video_id, event_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY video_id, event_id) AS n FROM frame_events) WHERE i = n // 2""",
    "frame_events",
)
cte(
    "placed",
    """SELECT r.query_id, r.video_id, r.frame_id, r.rank, e.event_id, o.start_frame, o.end_frame, o.prev_event, o.next_event FROM (SELECT * FROM visual_ranked WHERE rank <= 40) r
JOIN frame_events e USING (video_id, frame_id) JOIN frame_event_order o ON o.video_id = r.video_id AND o.event_id = e.event_id""",
    "visual_ranked",
    "frame_events",
    "frame_event_order",
)
_FIRST = """SELECT * FROM (SELECT query_id, video_id, frame_id, CAST(band AS INTEGER) AS band, source_rank, CAST(part AS INTEGER) AS part, {rn} AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame_id ORDER BY band, source_rank, part) AS n FROM ({u})) WHERE n = 1) WHERE rank <= 80"""
_ORD = RN.format(o="band, source_rank, part, frame_id")


@query(
    "adjacent_event_chains",
    _FIRST.format(
        rn=_ORD,
        u="""SELECT query_id, p.video_id, mid AS frame_id, 0 AS band, rank AS source_rank, 0 AS part FROM placed p JOIN mids m ON m.video_id = p.video_id AND m.event_id = p.prev_event WHERE rank <= 20
  UNION ALL SELECT query_id, p.video_id, mid, 0, rank, 1 FROM placed p JOIN mids m ON m.video_id = p.video_id AND m.event_id = p.event_id WHERE rank <= 20
  UNION ALL SELECT query_id, p.video_id, mid, 0, rank, 2 FROM placed p JOIN mids m ON m.video_id = p.video_id AND m.event_id = p.next_event WHERE rank <= 20
  UNION ALL SELECT query_id, video_id, frame_id, 1, rank, 0 FROM placed""",
    ),
    ("placed", "mids"),
)
def adjacent_event_chains(spark, d):
    """Previous, current and next event midpoints of the first anchors, then the pool."""
    return sp.adjacent_events(fused_ranked(spark, d, st.VISUAL_LANES, 40), st.frame_events(spark, d), True, 80, anchors=20)


@query(
    "boundary_neighbours",
    _FIRST.format(
        rn=_ORD,
        u="""SELECT query_id, video_id, frame_id, 0 AS band, rank AS source_rank, 0 AS part FROM placed
  UNION ALL SELECT query_id, p.video_id, mid, 0, rank, 1 FROM placed p JOIN mids m ON m.video_id = p.video_id
    AND m.event_id = CASE WHEN end_frame - frame_id <= 10 AND next_event IS NOT NULL THEN next_event WHEN frame_id - start_frame <= 10 THEN prev_event END""",
    ),
    ("placed", "mids"),
)
def boundary_neighbours(spark, d):
    """Pool frames near an event border followed by the neighbour's midpoint."""
    return sp.adjacent_events(fused_ranked(spark, d, st.VISUAL_LANES, 40), st.frame_events(spark, d), False, 80)


cte(
    "critic_base",
    """SELECT r.query_id, r.video_id, r.frame_id, r.rank, e.event_id, deep_event_rank, deep_rank FROM (SELECT * FROM visual_ranked WHERE rank <= 60) r JOIN frame_events e USING (video_id, frame_id)
LEFT JOIN (SELECT query_id, video_id, event_id, rank AS deep_event_rank, min(rank) OVER (PARTITION BY query_id, video_id) AS deep_rank FROM local_events WHERE rank <= 5) l USING (query_id, video_id, event_id)""",
    "visual_ranked",
    "frame_events",
    "local_events",
)
cte(
    "critic_events",
    """SELECT * FROM (SELECT query_id, video_id, event_id, row_number() OVER (PARTITION BY query_id ORDER BY min(o)) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY deep_rank IS NULL, deep_event_rank, deep_rank, rank) AS o FROM critic_base) GROUP BY query_id, video_id, event_id) WHERE pos <= 8""",
    "critic_base",
)
_EVEN = """list_contains(CASE WHEN {q} = 1 THEN [{n} // 2] ELSE list_transform(range(0, {q}), lambda j: CAST(round_even(j * (({n} - 1) / ({q} - 1)::DOUBLE), 0) AS BIGINT)) END, {i})"""
cte(
    "critic_samples",
    f"""SELECT query_id, video_id, frame_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, frame_id) AS rank FROM (
  SELECT c.*, f.frame_id, row_number() OVER (PARTITION BY query_id, c.video_id, c.event_id ORDER BY f.frame_id) - 1 AS i, count(*) OVER (PARTITION BY query_id, c.video_id, c.event_id) AS n
  FROM (SELECT *, 30 // count(*) OVER w + CASE WHEN pos <= 30 % count(*) OVER w THEN 1 ELSE 0 END AS q FROM critic_events WINDOW w AS (PARTITION BY query_id)) c
  JOIN frame_events f ON f.video_id = c.video_id AND f.event_id = c.event_id) WHERE q > 0 AND (n <= q OR {_EVEN.format(q="q", n="n", i="i")})""",
    "critic_events",
    "frame_events",
)
cte(
    "critic_lists",
    """SELECT query_id, lane, video_id, frame_id, row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, video_id, frame_id) AS rank FROM (
  SELECT v.*, row_number() OVER (PARTITION BY v.query_id, lane, v.video_id, c.event_id ORDER BY score DESC, v.frame_id) AS n FROM in_video v JOIN frame_events f USING (video_id, frame_id)
  JOIN critic_events c ON c.query_id = v.query_id AND c.video_id = v.video_id AND c.event_id = f.event_id) WHERE n <= 5""",
    "in_video",
    "frame_events",
    "critic_events",
)


@query(
    "critic_candidate_pool",
    f"""SELECT * FROM (SELECT query_id, video_id, frame_id, CAST(band AS INTEGER) AS band, {RN.format(o="band, old, video_id, frame_id")} AS rank FROM (
  SELECT * FROM (SELECT query_id, video_id, frame_id, 0 AS band, rank AS old FROM critic_base WHERE rank <= 100
    UNION ALL SELECT query_id, video_id, frame_id, 1, rank FROM critic_samples
    UNION ALL SELECT * FROM (SELECT query_id, video_id, frame_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(2.0::DOUBLE / (30 + rank)), 9) DESC, video_id, frame_id) AS o FROM critic_lists GROUP BY query_id, video_id, frame_id) WHERE o <= 20
    UNION ALL SELECT query_id, video_id, frame_id, CASE lane WHEN 'visual_pe_core' THEN 3 WHEN 'visual_beit3' THEN 4 ELSE 5 END, rank FROM critic_lists
    UNION ALL SELECT query_id, video_id, frame_id, 6, rank FROM critic_base)
  QUALIFY row_number() OVER (PARTITION BY query_id, video_id, frame_id ORDER BY band, old) = 1)) WHERE rank <= 130""",
    ("critic_base", "critic_samples", "critic_lists"),
)
def critic_candidate_pool(spark, d):
    """Baseline of 60 frames, samples of eight events (those of the strongest local events first), model lists."""
    local = cut_lineage(ev.rank_local_events(local_votes(spark, d))).filter("rank <= 5")
    video = local.groupBy("query_id", "video_id").agg(F.min("rank").alias("deep_rank"))
    deep = local.select("query_id", "video_id", "event_id", F.col("rank").alias("deep_event_rank")).join(video, ["query_id", "video_id"])
    base = fused_ranked(spark, d, st.VISUAL_LANES, 60).join(st.frame_events(spark, d), ["video_id", "frame_id"]).join(deep, ["query_id", "video_id", "event_id"], "left")
    return sp.critic_pool(cut_lineage(base.drop("event_id")), st.frame_events(spark, d), cut_lineage(in_video(spark, d)), 8, 5, 20, 130)


cte(
    "locked_quota",
    """SELECT b.query_id, b.video_id, b.position, b.base + count(s.slot) AS quota, row_number() OVER (PARTITION BY b.query_id ORDER BY b.position) AS video_rank FROM (
  SELECT *, CAST(least(12, greatest(1, 60 // count(*) OVER (PARTITION BY query_id))) AS BIGINT) AS base FROM locked_videos) b LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sqrt(n_events) / (slot + 1), 12) DESC, position, slot) AS r FROM (
    SELECT *, unnest(range(base, 35)) AS slot FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, CAST(least(12, greatest(1, 60 // count(*) OVER (PARTITION BY query_id))) AS BIGINT) AS base FROM locked_videos)))
  WHERE r <= greatest(0, 60 - base * n)) s USING (query_id, video_id) GROUP BY b.query_id, b.video_id, b.position, b.base""",
    "locked_videos",
)
cte(
    "locked_videos",
    """SELECT * FROM (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), video_id) AS position FROM visual_ranked GROUP BY query_id, video_id)
JOIN (SELECT video_id, count(*) AS n_events FROM frame_event_order GROUP BY video_id) USING (video_id) WHERE position <= 4""",
    "visual_ranked",
    "frame_event_order",
)
cte(
    "locked_events",
    """SELECT query_id, video_id, event_id, score, quota, video_rank, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, n_lanes DESC, event_id) AS lr FROM local_events JOIN locked_quota USING (query_id, video_id)""",
    "local_events",
    "locked_quota",
)
cte(
    "locked_dense",
    f"""SELECT query_id, video_id, frame_id, event_id, lr FROM (
  SELECT t.*, f.frame_id, row_number() OVER (PARTITION BY query_id, t.video_id, t.event_id ORDER BY f.frame_id) - 1 AS i, count(*) OVER (PARTITION BY query_id, t.video_id, t.event_id) AS n FROM (
    SELECT *, quota // count(*) OVER w + CASE WHEN lr <= quota % count(*) OVER w THEN 1 ELSE 0 END AS q FROM locked_events WHERE lr <= least(8, quota) WINDOW w AS (PARTITION BY query_id, video_id)) t
  JOIN frame_events f ON f.video_id = t.video_id AND f.event_id = t.event_id) WHERE q > 0 AND (n <= q OR {_EVEN.format(q="q", n="n", i="i")})""",
    "locked_events",
    "frame_events",
)
cte(
    "locked_escapes",
    """SELECT query_id, video_id, event_id, event_order FROM (
  SELECT q.query_id, q.video_id, o.event_id, o.event_order, least(4, quota - coalesce(used, 0)) AS p, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY q.query_id, q.video_id) AS n
  FROM locked_quota q JOIN frame_event_order o ON o.video_id = q.video_id LEFT JOIN (SELECT query_id, video_id, count(*) AS used FROM locked_dense GROUP BY ALL) u ON u.query_id = q.query_id AND u.video_id = q.video_id
  WHERE NOT EXISTS (SELECT 1 FROM locked_events e WHERE e.query_id = q.query_id AND e.video_id = q.video_id AND e.event_id = o.event_id AND e.lr <= least(8, e.quota))
  WINDOW w AS (PARTITION BY q.query_id, q.video_id ORDER BY o.event_order)) WHERE p > 0 AND (n <= p OR list_contains(
  CASE WHEN p = 1 THEN [0] ELSE list_transform(range(0, p), lambda j: CAST(round_even(j * ((n - 1) / (p - 1)::DOUBLE), 0) AS BIGINT)) END, i))""",
    "locked_quota",
    "locked_dense",
    "locked_events",
    "frame_event_order",
)


@query(
    "locked_video_candidates",
    f"""SELECT query_id, video_id, frame_id, event_id, CAST(band AS INTEGER) AS band, CAST(c AS INTEGER) AS candidate_rank, score, {RN.format(o="score DESC, coalesce(lr, 0), video_rank, frame_id")} AS rank FROM (
  SELECT * FROM (SELECT x.*, e.lr, q.video_rank, round(1.0::DOUBLE / (q.video_rank + 10) + 1.0::DOUBLE / (c + 10) + coalesce(e.score, 0.0), 9) AS score,
    row_number() OVER (PARTITION BY x.query_id ORDER BY c, q.video_rank) AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY band, a, frame_id) AS c FROM (
      SELECT query_id, video_id, frame_id, event_id, 0 AS band, lr AS a FROM locked_dense
      UNION ALL SELECT query_id, t.video_id, mid, t.event_id, 1, event_order FROM locked_escapes t JOIN mids m ON m.video_id = t.video_id AND m.event_id = t.event_id
      UNION ALL SELECT query_id, t.video_id, mid, t.event_id, 2, lr FROM locked_events t JOIN mids m ON m.video_id = t.video_id AND m.event_id = t.event_id WHERE lr > 16
      UNION ALL SELECT query_id, q.video_id, mid, o.event_id, 3, event_order FROM locked_quota q JOIN frame_event_order o ON o.video_id = q.video_id JOIN mids m ON m.video_id = o.video_id AND m.event_id = o.event_id)
    QUALIFY row_number() OVER (PARTITION BY query_id, video_id, frame_id, event_id ORDER BY band, a) = 1) x
  JOIN locked_quota q ON q.query_id = x.query_id AND q.video_id = x.video_id LEFT JOIN locked_events e ON e.query_id = x.query_id AND e.video_id = x.video_id AND e.event_id = x.event_id WHERE c <= q.quota) WHERE p <= 60)""",
    ("locked_dense", "locked_escapes", "locked_events", "locked_quota", "mids", "frame_event_order"),
)
def locked_video_candidates(spark, d):
    """Frames of the first four videos: dense samples, escapes along the timeline, midpoints."""
    base = rk.group_by_video(cut_lineage(fused_ranked(spark, d, st.VISUAL_LANES))).filter("position <= 4")
    local = cut_lineage(ev.rank_local_events(local_votes(spark, d)))
    return sp.locked_video_candidates(base.select("query_id", "video_id", "position"), st.frame_events(spark, d), local, 60)


cte(
    "timeline_anchors",
    """SELECT request_id, video_id, anchor, greatest(lo, anchor - 100) AS s, least(hi, anchor + 100) AS e FROM (
  SELECT r.query_id AS request_id, r.video_id, first(g.frame_id ORDER BY abs(g.frame_id - r.frame_id - 1), g.frame_id) AS anchor, min(g.frame_id) AS lo, max(g.frame_id) AS hi
  FROM visual_ranked r JOIN frames g ON g.video_id = r.video_id WHERE r.rank = 1 GROUP BY ALL)""",
    "visual_ranked",
    "frames",
)


@query(
    "anchored_timeline",
    "SELECT t.request_id, t.video_id, t.frame_id, t.frame_id = a.anchor AS is_anchor, "
    "EXISTS (SELECT 1 FROM change_walk c WHERE c.picked AND c.video_id = t.video_id AND abs(c.frame_id - t.frame_id) <= 4) AS near_change FROM ("
    + _thinned(
        """SELECT request_id, video_id, s AS lo, e AS hi, k, s + CASE WHEN n > 1 THEN (e - s) / (n - 1) ELSE 0 END * k AS x, false AS req
FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, CAST(least(24, greatest(1, ceil((e - s) / 25.0::DOUBLE * 5.0::DOUBLE) + 1)) AS BIGINT) AS n FROM timeline_anchors))
UNION ALL SELECT request_id, video_id, s, e, -1, anchor, true FROM timeline_anchors""",
        24,
    ).replace("grid_v", "frames")
    + ") t JOIN timeline_anchors a USING (request_id)",
    ("timeline_anchors", "frames", "change_walk"),
)
def anchored_timeline(spark, d):
    """Frames around each query's best hit, flagged as anchor and near change points."""
    top = fused_ranked(spark, d, st.VISUAL_LANES, 1)
    a = top.select(F.col("query_id").alias("request_id"), "video_id", (F.col("frame_id") + 1).alias("frame_id"), F.lit(25.0).alias("fps"))
    g = st.frames(spark, d).select("video_id", "frame_id")
    return sp.anchored_timeline(cut_lineage(a), g, changes(spark, d), 8.0, 5.0, 24)
