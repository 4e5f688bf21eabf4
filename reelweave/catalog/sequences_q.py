"""Event sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelweave.catalog import standins as st
from reelweave.catalog.events_q import local_votes
from reelweave.catalog.ranking import RN, fused_ranked
from reelweave.catalog.registry import cte, query
from reelweave.catalog.timeline_q import videos
from reelweave.operators import events as ev
from reelweave.operators import moments as mo
from reelweave.operators import ranking as rk
from reelweave.operators import sequences as sq
from reelweave.operators import vectors as vx
from reelweave.session import cut_lineage, table

N_EVENTS = 3


def candidates(spark, d):
    """Sequence queries of three labels each: the fused hits of a label are its event's candidates."""
    hits = fused_ranked(spark, d, st.VISUAL_LANES, 60)
    top = hits.groupBy("query_id").agg(F.max("score").alias("_top"))
    timed = mo.with_fps(hits.join(top, "query_id"), videos(spark, d))
    out = timed.select(
        F.floor(F.col("query_id") / N_EVENTS).alias("query_id"),
        F.pmod("query_id", F.lit(N_EVENTS)).cast("int").alias("event_index"),
        "video_id",
        "frame_id",
        "score",
        F.round(F.col("score") / F.col("_top"), 9).alias("objective"),
        (F.col("frame_id") / F.col("fps")).alias("ts"),
    )
    return cut_lineage(out)


def sizes(spark, d):
    labels = st.query_vectors(spark, d, ["visual_siglip2"])
    return labels.groupBy(F.floor(F.col("query_id") / N_EVENTS).alias("query_id")).agg(F.count(F.lit(1)).alias("n_events"))


cte(
    "seq_cand",
    """SELECT query_id // 3 AS query_id, CAST(query_id % 3 AS INTEGER) AS event_index, video_id, frame_id, score, round(score / max(score) OVER (PARTITION BY query_id), 9) AS objective, frame_id / coalesce(fps, 25.0) AS ts
FROM (SELECT * FROM visual_ranked WHERE rank <= 60) JOIN videos USING (video_id)""",
    "visual_ranked",
    "videos",
)
cte("seq_sizes", "SELECT query_id // 3 AS query_id, count(*) AS n_events FROM label_means GROUP BY 1", "label_means")


@query(
    "sequence_video_proposals",
    f"""SELECT * FROM (SELECT query_id, video_id, coverage, score, {RN.format(o='coverage DESC, score DESC, video_id')} AS rank FROM (
  SELECT query_id, video_id, count(*) AS coverage, round(sum(1.0 / (10 + r)) + 0.25::DOUBLE * count(*) / n_events, 9) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, event_index ORDER BY best DESC, video_id) AS r FROM (SELECT query_id, event_index, video_id, max(objective) AS best FROM seq_cand GROUP BY ALL))
  JOIN seq_sizes USING (query_id) GROUP BY query_id, video_id, n_events)) WHERE rank <= 6""",
    ("seq_cand", "seq_sizes"),
)
def sequence_video_proposals(spark, d):
    return sq.propose_videos(candidates(spark, d), sizes(spark, d), 6)


def dp_ctes(prefix: str, cand: str, missing: int, penalty: float, scale: float, short: float, min_gap: float) -> None:
    """Slot-by-slot alignment of ``cand`` in SQL, one expression per event."""
    cte(
        f"{prefix}_use",
        f"""SELECT p.*, CAST(n_events - n_present AS INTEGER) AS missing FROM (SELECT query_id, video_id, count(DISTINCT event_index) AS n_present, list_sort(list(DISTINCT event_index)) AS events FROM {cand} GROUP BY ALL) p
JOIN seq_sizes USING (query_id) WHERE n_events - n_present <= {missing}""",
        cand,
        "seq_sizes",
    )
    cte(
        f"{prefix}_rows",
        f"""SELECT c.query_id, c.video_id, c.frame_id, c.score, c.objective, c.ts, list_position(u.events, c.event_index) AS slot, u.n_present, u.missing, u.events
FROM (SELECT * FROM {cand} QUALIFY row_number() OVER (PARTITION BY query_id, event_index, video_id, frame_id ORDER BY objective DESC, score DESC) = 1) c JOIN {prefix}_use u USING (query_id, video_id)""",
        cand,
        f"{prefix}_use",
    )
    cte(
        f"{prefix}_1",
        f"SELECT query_id, video_id, n_present, missing, events, frame_id AS pf, ts AS pt, round(objective, 9) AS total, [frame_id] AS frames, [score] AS scores FROM {prefix}_rows WHERE slot = 1",
        f"{prefix}_rows",
    )
    for i in range(2, N_EVENTS + 1):
        cte(
            f"{prefix}_{i}",
            f"""SELECT query_id, video_id, n_present, missing, events, frame AS pf, x.pt AS pt, x.total AS total, x.frames AS frames, x.scores AS scores FROM (
  SELECT query_id, video_id, n_present, missing, events, frame, max({{'total': total, 'earlier': earlier, 'pt': pt, 'frames': frames, 'scores': scores}}) AS x FROM (
    SELECT p.query_id, p.video_id, p.n_present, p.missing, p.events, coalesce(c.frame_id, p.pf) AS frame, -p.pf AS earlier,
      CASE WHEN c.frame_id IS NULL THEN p.total ELSE round(p.total + c.objective - ({penalty}::DOUBLE * ln(1 + greatest(0, c.ts - p.pt) / {scale}::DOUBLE)
        + CASE WHEN greatest(0, c.ts - p.pt) < {min_gap} THEN {short}::DOUBLE * (1 - greatest(0, c.ts - p.pt) / {min_gap}::DOUBLE) ELSE 0 END), 9) END AS total,
      coalesce(c.ts, p.pt) AS pt, CASE WHEN c.frame_id IS NULL THEN p.frames ELSE list_append(p.frames, c.frame_id) END AS frames, CASE WHEN c.frame_id IS NULL THEN p.scores ELSE list_append(p.scores, c.score) END AS scores
    FROM {prefix}_{i - 1} p LEFT JOIN (SELECT * FROM {prefix}_rows WHERE slot = {i}) c ON c.query_id = p.query_id AND c.video_id = p.video_id AND p.pf < c.frame_id
    WHERE c.frame_id IS NOT NULL OR p.n_present < {i}) GROUP BY ALL)""",
            f"{prefix}_{i - 1}",
            f"{prefix}_rows",
        )
    cte(
        f"{prefix}_best",
        f"""SELECT query_id, video_id, missing, events, x.frames AS frames, x.scores AS scores, x.total AS sequence_score FROM (
  SELECT query_id, video_id, missing, events, max({{'total': total, 'e': -pf, 'frames': frames, 'scores': scores}}) AS x FROM {prefix}_{N_EVENTS} GROUP BY ALL)""",
        f"{prefix}_{N_EVENTS}",
    )


dp_ctes("seq0", "seq_cand", 0, 0.03, 45.0, 0.20, 2.0)
dp_ctes("seq1", "seq_cand", 1, 0.03, 45.0, 0.20, 2.0)
_PATH = "array_to_string(frames, ',') AS path"


@query(
    "sequence_alignment",
    f"SELECT query_id, video_id, {_PATH}, sequence_score FROM seq0_best",
    ("seq0_best",),
)
def sequence_alignment(spark, d):
    out = sq.align_sequences(sq.candidate_pool(candidates(spark, d)), sizes(spark, d), N_EVENTS)
    return out.select("query_id", "video_id", F.array_join("frames", ",").alias("path"), "sequence_score")


cte(
    "seq_ranked",
    f"SELECT * FROM (SELECT *, {RN.format(o='missing, sequence_score DESC, video_id')} AS rank FROM seq1_best) WHERE rank <= 8",
    "seq1_best",
)


def ranked_sequences(spark, d):
    aligned = sq.align_sequences(candidates(spark, d), sizes(spark, d), N_EVENTS, max_missing=1)
    return sq.rank_sequences(aligned, 8)


@query(
    "sequence_ranking",
    f"SELECT query_id, video_id, array_to_string(events, ',') AS present, {_PATH}, missing, sequence_score, rank FROM seq_ranked",
    ("seq_ranked",),
)
def sequence_ranking(spark, d):
    out = ranked_sequences(spark, d)
    return out.select(
        "query_id", "video_id", F.array_join(F.transform("events", lambda e: e.cast("string")), ",").alias("present"),
        F.array_join("frames", ",").alias("path"), "missing", "sequence_score", "rank",
    )


@query(
    "flattened_sequences",
    "SELECT query_id, video_id, rank, e AS event_index, f AS frame_id FROM (SELECT query_id, video_id, rank, unnest(events) AS e, unnest(frames) AS f FROM seq_ranked)",
    ("seq_ranked",),
)
def flattened_sequences(spark, d):
    """Null-padded slots, flattened back to frame rows."""
    return sq.flatten_sequences(sq.with_null_slots(ranked_sequences(spark, d), sizes(spark, d)))


def repair_local(spark, d):
    props = sq.propose_videos(candidates(spark, d), sizes(spark, d), 6)
    labels = st.query_vectors(spark, d, ["visual_siglip2"]).select("query_id")
    pairs = labels.join(props.select(F.col("query_id").alias("_s"), "video_id"), F.floor(F.col("query_id") / N_EVENTS) == F.col("_s")).select("query_id", "video_id")
    hits = vx.in_video_top_n(st.lane_vectors(spark, d, st.VISUAL_LANES), st.query_vectors(spark, d, st.VISUAL_LANES), pairs, 6)
    whole = ["query_id", "lane"]
    return cut_lineage(rk.ranked(hits.drop("rank"), whole, [F.desc("score"), F.asc("video_id"), F.asc("frame_id")]))


def repair(spark, d):
    cand = candidates(spark, d)
    hits = fused_ranked(spark, d, st.VISUAL_LANES, 60)
    scale = hits.groupBy(F.col("query_id").alias("pair_id")).agg(F.max("score").alias("top_score")).select(
        "pair_id", F.floor(F.col("pair_id") / N_EVENTS).alias("query_id"), F.pmod("pair_id", F.lit(N_EVENTS)).cast("int").alias("event_index"), "top_score"
    )
    return cut_lineage(sq.repair_candidates(repair_local(spark, d), cand, scale, videos(spark, d), 75))


@query("sequence_repair_candidates")
def sequence_repair_candidates(spark, d):
    """Targeted in-video candidates of each event, capped by the global evidence."""
    return repair(spark, d)


@query("repaired_sequence_ranking")
def repaired_sequence_ranking(spark, d):
    """Sequence ranking over global and repaired candidates."""
    both = candidates(spark, d).unionByName(repair(spark, d))
    out = sq.rank_sequences(sq.align_sequences(both, sizes(spark, d), N_EVENTS, max_missing=1), 8)
    return out.select("query_id", "video_id", F.array_join("frames", ",").alias("path"), "missing", "sequence_score", "rank")


cte(
    "act_cand",
    """SELECT query_id // 3 AS query_id, CAST(query_id % 3 AS INTEGER) AS event_index, video_id, frame_id, c AS score, c AS objective, frame_id / coalesce(fps, 25.0) AS ts FROM (
  SELECT *, round(greatest(0.0, least(1.0, (score - 0.1::DOUBLE) / 0.45::DOUBLE)) / (1 + greatest(rank - 1, 0) / 500.0::DOUBLE), 9) AS c FROM signals WHERE lane = 'audio') JOIN videos USING (video_id) WHERE c > 0""",
    "signals",
    "videos",
)
dp_ctes("act", "act_cand", 0, 0.01, 60.0, 0.10, 2.0)


@query(
    "action_order_prior",
    "SELECT query_id, video_id, round(list_sum(scores) / n_events, 9) AS prior FROM act_best JOIN seq_sizes USING (query_id)",
    ("act_best", "seq_sizes"),
)
def action_order_prior(spark, d):
    hits = mo.with_fps(st.signals(spark, d, ["audio"]), videos(spark, d))
    conf = F.round(sq.action_confidence(F.col("score"), F.col("rank"), floor=0.1), 9)
    cand = hits.select(
        F.floor(F.col("query_id") / N_EVENTS).alias("query_id"),
        F.pmod("query_id", F.lit(N_EVENTS)).cast("int").alias("event_index"),
        "video_id",
        "frame_id",
        conf.alias("score"),
        conf.alias("objective"),
        (F.col("frame_id") / F.col("fps")).alias("ts"),
    )
    return sq.action_priors(cand, sizes(spark, d), N_EVENTS)


cte(
    "lane_votes",
    """SELECT v.*, first_frame FROM (SELECT query_id, video_id, event_id, lane, max(vote) AS vote FROM local_votes GROUP BY ALL) v
JOIN (SELECT query_id, video_id, event_id, min(frame_id) AS first_frame FROM local_votes GROUP BY ALL) USING (query_id, video_id, event_id)""",
    "local_votes",
)
cte(
    "clause_events",
    """SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY frame, event_id) AS o FROM (
  SELECT query_id, video_id, event_id, min(first_frame) AS frame, round(sum(CASE WHEN lane LIKE '%__clause1' THEN vote ELSE 0 END), 9) AS s1, round(sum(CASE WHEN lane LIKE '%__clause2' THEN vote ELSE 0 END), 9) AS s2 FROM lane_votes GROUP BY ALL)""",
    "lane_votes",
)
cte(
    "cover_temporal",
    """SELECT query_id, video_id, [e1, e2] AS events, [s1, s2] AS scores FROM (
  SELECT a.query_id, a.video_id, a.event_id AS e1, b.event_id AS e2, a.s1, b.s2, row_number() OVER (PARTITION BY a.query_id, a.video_id ORDER BY round(round(ln(a.s1 + 1e-9), 9) + ln(b.s2 + 1e-9), 9) DESC, b.o, round(ln(a.s1 + 1e-9), 9) DESC, a.o) AS n
  FROM clause_events a JOIN clause_events b ON a.query_id = b.query_id AND a.video_id = b.video_id AND a.frame <= b.frame WHERE a.s1 > 0 AND b.s2 > 0) WHERE n = 1""",
    "clause_events",
)
cte(
    "cover_free",
    """SELECT query_id, video_id, list(event_id ORDER BY c) AS events, list(s ORDER BY c) AS scores FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, video_id, c ORDER BY s DESC, o) AS n FROM (
    SELECT query_id, video_id, event_id, o, 1 AS c, s1 AS s FROM clause_events UNION ALL SELECT query_id, video_id, event_id, o, 2, s2 FROM clause_events) WHERE s > 0) WHERE n = 1 GROUP BY ALL""",
    "clause_events",
)
for _k in ("temporal", "free"):
    cte(
        f"covered_{_k}",
        f"""SELECT query_id, video_id, events, len(scores) / 2.0::DOUBLE AS coverage,
  round((len(scores) / 2.0::DOUBLE) * (len(scores) / 2.0::DOUBLE) * exp(list_sum(list_transform(scores, lambda x: ln(x + 1e-9))) / len(scores)) * (0.5 + 0.5::DOUBLE * list_min(scores)), 9) AS sequence_score FROM cover_{_k}""",
        f"cover_{_k}",
    )


def lane_votes(spark, d):
    v = local_votes(spark, d)
    best = v.groupBy("query_id", "video_id", "event_id", "lane").agg(F.max("vote").alias("vote"))
    first = v.groupBy("query_id", "video_id", "event_id").agg(F.min("frame_id").alias("first_frame"))
    return best.join(first, ["query_id", "video_id", "event_id"])


@query(
    "clause_coverage_temporal",
    "SELECT query_id, video_id, array_to_string(events, ',') AS events, coverage, sequence_score FROM covered_temporal",
    ("covered_temporal",),
)
def clause_coverage_temporal(spark, d):
    out = sq.clause_coverage(lane_votes(spark, d), [1, 2], True)
    return out.select("query_id", "video_id", F.array_join("events", ",").alias("events"), "coverage", "sequence_score")


@query(
    "clause_coverage_free",
    "SELECT query_id, video_id, array_to_string(events, ',') AS events, coverage, sequence_score FROM covered_free",
    ("covered_free",),
)
def clause_coverage_free(spark, d):
    out = sq.clause_coverage(lane_votes(spark, d), [1, 2], False)
    return out.select("query_id", "video_id", F.array_join("events", ",").alias("events"), "coverage", "sequence_score")


@query(
    "clause_coverage_ranking",
    f"""SELECT query_id, video_id, event_id, CAST(band AS INTEGER) AS band, score, {RN.format(o='band, a, b')} AS rank FROM (
  SELECT query_id, video_id, e AS event_id, 0 AS band, seq AS a, i AS b, round(sequence_score * (1 - 0.01::DOUBLE * i), 6) AS score FROM (
    SELECT *, unnest(ev) AS e, unnest(range(0, len(ev))) AS i FROM (SELECT query_id, video_id, sequence_score, CASE WHEN events[1] = events[2] THEN events[1:1] ELSE events END AS ev,
      row_number() OVER (PARTITION BY query_id ORDER BY sequence_score DESC, coverage DESC, video_id) AS seq FROM covered_temporal))
  UNION ALL SELECT query_id, video_id, event_id, 1, rank, 0, round(score, 6) FROM local_events l WHERE NOT EXISTS (SELECT 1 FROM covered_temporal c WHERE c.query_id = l.query_id AND c.video_id = l.video_id AND list_contains(c.events, l.event_id)))""",
    ("covered_temporal", "local_events"),
)
def clause_coverage_ranking(spark, d):
    seqs = sq.clause_coverage(lane_votes(spark, d), [1, 2], True)
    return sq.flatten_coverage(seqs, ev.rank_local_events(local_votes(spark, d))).select("query_id", "video_id", "event_id", "band", "score", "rank")


def chains(spark, d):
    """A chain per user and day bucket: one frame per action type, confidence from the value."""
    t = st.timeline(spark, d).filter(F.col("event_type").isin("view", "click", "purchase"))
    idx = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return t.groupBy((F.col("user_id") * 100 + F.floor(F.col("frame_id") / 4320)).alias("query_id"), idx.alias("event_index")).agg(
        F.min("frame_id").alias("frame_id"), F.round(F.max("value") / 100.0, 6).alias("confidence")
    )


cte(
    "chains",
    """SELECT user_id * 100 + CAST(floor(frame_id / 4320) AS BIGINT) AS query_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS event_index, min(frame_id) AS frame_id, round(max(value) / 100.0, 6) AS confidence
FROM timeline WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL""",
    "timeline",
)


@query(
    "chain_validation",
    """SELECT query_id, status, CAST(i - 1 AS INTEGER) AS event_index, fs[i] AS frame_id, cs[i] AS confidence FROM (
  SELECT query_id, status, CASE WHEN status = 'repaired' THEN list_sort(f) ELSE f END AS fs, CASE WHEN status = 'repaired' THEN list_transform(c, lambda x: least(x, 0.6)) ELSE c END AS cs, unnest(range(1, len(f) + 1)) AS i FROM (
    SELECT query_id, f, c, CASE WHEN list_sort(f) = f AND len(list_distinct(f)) = len(f) THEN 'valid' WHEN len(list_distinct(f)) = len(f) THEN 'repaired' ELSE 'rejected' END AS status FROM (
      SELECT query_id, list(frame_id ORDER BY event_index) AS f, list(confidence ORDER BY event_index) AS c FROM chains GROUP BY query_id)))""",
    ("chains",),
)
def chain_validation(spark, d):
    return sq.check_chains(chains(spark, d))


def options(spark, d):
    """Ranked options per order: event = line parity, option = line order, candidate from the part."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("query_id"),
        F.pmod(F.col("l_linenumber") - 1, F.lit(3)).cast("int").alias("event_index"),
        F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("option_rank"),
        F.col("l_partkey").alias("candidate"),
    ).distinct()


cte(
    "options",
    "SELECT DISTINCT l_orderkey AS query_id, (l_linenumber - 1) % 3 AS event_index, (l_linenumber - 1) // 3 AS option_rank, l_partkey AS candidate FROM lineitem",
)
cte(
    "opts",
    """SELECT query_id, event_index, candidate, anchor, row_number() OVER (PARTITION BY query_id, event_index ORDER BY option_rank, candidate) - 1 AS r FROM (
  SELECT o.*, anchor FROM (SELECT query_id, event_index, candidate, min(option_rank) AS option_rank FROM options WHERE option_rank < 5 GROUP BY ALL) o JOIN (SELECT o_orderkey AS query_id, o_custkey % 500 AS anchor FROM orders) USING (query_id) WHERE candidate >= anchor)""",
    "options",
)


@query(
    "cheapest_option_chain",
    """SELECT query_id, cost, c1 || ',' || c2 || ',' || c3 AS path FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, c3 - c1, abs(c1 - anchor), c1, c2, c3) AS n FROM (
    SELECT a.query_id, a.anchor, a.c AS c1, b.candidate AS c2, x.candidate AS c3, round(a.r * 100.0::DOUBLE + abs(a.c - a.anchor) * 0.01::DOUBLE + b.r * 100 + x.r * 100, 6) AS cost FROM (
      SELECT o.query_id, o.anchor, coalesce(candidate, o.anchor) AS c, coalesce(r, 0) AS r FROM (SELECT o_orderkey AS query_id, o_custkey % 500 AS anchor FROM orders) o LEFT JOIN (SELECT * FROM opts WHERE event_index = 0) p ON p.query_id = o.query_id) a
    JOIN opts b ON b.query_id = a.query_id AND b.event_index = 1 AND b.candidate > a.c JOIN opts x ON x.query_id = a.query_id AND x.event_index = 2 AND x.candidate > b.candidate)) WHERE n = 1""",
    ("opts",),
)
def cheapest_option_chain(spark, d):
    anchors = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.pmod("o_custkey", F.lit(500)).alias("anchor"))
    out = sq.cheapest_chain(options(spark, d), anchors, 3)
    return out.select("query_id", "cost", F.array_join("path", ",").alias("path"))


@query(
    "first_positive_check",
    """SELECT b.query_id, CASE WHEN c BETWEEN lower AND upper THEN c END AS candidate FROM (
  SELECT b.*, CASE WHEN n > 0 THEN first ELSE pick END AS c FROM (SELECT o_orderkey AS query_id, CAST(1 AS BIGINT) AS lower, 2 + o_custkey % 3 AS upper, 1 + o_orderkey % 5 AS pick FROM orders) b
  LEFT JOIN (SELECT l_orderkey AS query_id, count(*) AS n, min(CAST(l_linenumber AS BIGINT)) FILTER (l_discount > 0.08) AS first FROM lineitem GROUP BY ALL) k USING (query_id)) b""",
)
def first_positive_check(spark, d):
    li = table(spark, d, "lineitem")
    checks = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("bigint").alias("candidate"), (F.col("l_discount") > 0.08).alias("match"))
    o = table(spark, d, "orders")
    bounds = o.select(
        F.col("o_orderkey").alias("query_id"),
        F.lit(1).cast("bigint").alias("lower"),
        (F.pmod("o_custkey", F.lit(3)) + 2).alias("upper"),
        (F.pmod("o_orderkey", F.lit(5)) + 1).alias("pick"),
    )
    return sq.first_positive(checks, bounds)
