"""Fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelweave.catalog import standins as st
from reelweave.catalog.registry import cte, query
from reelweave.operators import fusion as fu
from reelweave.operators import ranking as rk
from reelweave.session import table

KEY = ["query_id", "video_id", "frame_id"]


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


@query(
    "weighted_rank_fusion",
    "SELECT query_id, video_id, frame_id, score, n_lanes FROM fused",
    ("fused",),
)
def weighted_rank_fusion(spark, d):
    out = fu.rank_fusion(st.signals(spark, d), st.lanes(spark))
    return out.select(*KEY, F.round("score", 9).alias("score"), "n_lanes")


MEASURES = {"price": "l_extendedprice", "quantity": "l_quantity", "discount": "l_discount"}
#: Classes of frames whose best scores bound the k-th score of a list.
SLOTS = 1024


def reachable_measures(li, k):
    """``query_id, video_id, frame_id, lane, score`` of the measures that can be among a list's first k frames.

    A frame's slot depends on its key alone, so the k-th best of the slots' best scores is
    reached by k different frames, and what lies below it is in no list. Finding it takes ``SLOTS``
    numbers per query and measure, however many lines there are.
    """
    li = li.select(
        F.col("l_linenumber").cast("bigint").alias("query_id"), F.col("l_suppkey").cast("string").alias("video_id"), F.col("l_partkey").alias("frame_id"),
        F.pmod(F.xxhash64("l_suppkey", "l_partkey"), F.lit(SLOTS)).alias("slot"), *[F.col(c).cast("double").alias(n) for n, c in MEASURES.items()],
    )
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("lane"), F.col(n).alias("score")) for n in MEASURES])).alias("_m")
    slots = li.groupBy("query_id", "slot").agg(*[F.max(n).alias(n) for n in MEASURES]).select("query_id", long).select("query_id", "_m.*")
    kth = rk.ranked(slots, ["query_id", "lane"], [F.desc("score")], k).filter(F.col("rank") == k)
    bounds = kth.groupBy("query_id").pivot("lane", list(MEASURES)).agg(F.first("score"))
    bounds = bounds.select(F.col("query_id").alias("_q"), *[F.col(n).alias(f"_{n}") for n in MEASURES])
    rows = li.join(F.broadcast(bounds), F.col("query_id").eqNullSafe(F.col("_q")), "left")
    near = F.array(*[F.when(F.col(f"_{n}").isNull() | (F.col(n) >= F.col(f"_{n}")), F.struct(F.lit(n).alias("lane"), F.col(n).alias("score"))) for n in MEASURES])
    return rows.select("query_id", "video_id", "frame_id", F.explode(near).alias("_m")).filter(F.col("_m").isNotNull()).select("query_id", "video_id", "frame_id", "_m.*")


def lineitem_signals(spark, d, k=100):
    """Three ranked lists per query over all order lines: query = line number."""
    rows = reachable_measures(table(spark, d, "lineitem"), k)
    best = rows.groupBy("query_id", "lane", "video_id", "frame_id").agg(F.max("score").alias("score"))
    return rk.ranked(best, ["query_id", "lane"], [F.desc("score"), F.asc("video_id"), F.asc("frame_id")], k)


cte(
    "line_signals",
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, video_id, frame_id) AS INTEGER) AS rank FROM (
  SELECT CAST(l_linenumber AS BIGINT) AS query_id, CAST(l_suppkey AS VARCHAR) AS video_id, l_partkey AS frame_id, lane, max(score) AS score FROM (
    SELECT l_linenumber, l_suppkey, l_partkey, 'price' AS lane, l_extendedprice AS score FROM lineitem
    UNION ALL SELECT l_linenumber, l_suppkey, l_partkey, 'quantity', l_quantity FROM lineitem
    UNION ALL SELECT l_linenumber, l_suppkey, l_partkey, 'discount', l_discount FROM lineitem)
  GROUP BY ALL)) WHERE rank <= 100""",
)


@query(
    "rank_fusion_lineitem",
    "SELECT query_id, video_id, frame_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(DISTINCT lane) AS n_lanes FROM line_signals GROUP BY ALL",
    ("line_signals",),
)
def rank_fusion_lineitem(spark, d):
    return fu.rank_fusion(lineitem_signals(spark, d), k=60).select(*KEY, F.round("score", 9).alias("score"), "n_lanes")


@query(
    "merged_lanes",
    """SELECT query_id, lane, video_id, frame_id, score, CAST(row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, video_id, frame_id) AS INTEGER) AS rank
FROM (SELECT query_id, lane, video_id, frame_id, max(score) AS score FROM (
  SELECT query_id, 'visual' AS lane, video_id, frame_id, score FROM signals WHERE lane = 'visual_pe_core'
  UNION ALL SELECT query_id, 'visual', video_id, frame_id, score FROM signals WHERE lane = 'visual_siglip2') GROUP BY ALL)""",
    ("signals",),
)
def merged_lanes(spark, d):
    s = st.signals(spark, d, ["visual_pe_core", "visual_siglip2"]).drop("rank")
    one = s.filter("lane = 'visual_pe_core'").withColumn("lane", F.lit("visual"))
    two = s.filter("lane = 'visual_siglip2'").withColumn("lane", F.lit("visual"))
    return fu.merge_lanes(one, two)


@query(
    "max_normalised_fusion",
    """SELECT query_id, video_id, frame_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, frame_id) AS rank FROM (
    SELECT query_id, video_id, frame_id, round(sum(CASE WHEN top > 0 THEN score / top ELSE 0 END * w / 1.0), 6) AS score FROM (
      SELECT s.*, max(score) OVER (PARTITION BY query_id, s.lane) AS top, w FROM visual_signals s
      JOIN (VALUES ('visual_pe_core', 0.5::DOUBLE), ('visual_beit3', 0.3::DOUBLE), ('visual_siglip2', 0.2::DOUBLE)) t(lane, w) ON s.lane = t.lane WHERE rank <= 40)
    GROUP BY ALL)) WHERE rank <= 30""",
    ("visual_signals",),
)
def max_normalised_fusion(spark, d):
    s = st.signals(spark, d, st.VISUAL_LANES)
    return fu.max_normalised_fusion(s, {"visual_pe_core": 0.5, "visual_beit3": 0.3, "visual_siglip2": 0.2}, 40, 30)


@query(
    "early_fusion",
    """SELECT query_id, video_id, frame_id, round(avg(v), 6) AS score FROM (
  SELECT s.*,
    CASE WHEN max(score) OVER l > min(score) OVER l THEN (score - min(score) OVER l) / (max(score) OVER l - min(score) OVER l) ELSE 0.0 END AS v
  FROM signals s WINDOW l AS (PARTITION BY query_id, lane)) GROUP BY ALL""",
    ("signals",),
)
def early_fusion(spark, d):
    return fu.early_fusion(st.signals(spark, d)).select(*KEY, *r6("score"))


_CONF = """CASE WHEN NOT coalesce(calibrated, true) THEN 0.0 WHEN score < floor THEN 0.0 WHEN ceiling <= floor THEN 1.0
  ELSE least(1.0, greatest(0.0, (score - floor) / (ceiling - floor))) END"""
cte("confident", f"SELECT *, {_CONF} AS confidence FROM cut_signals", "cut_signals")


@query(
    "lane_confidence",
    "SELECT query_id, lane, video_id, frame_id, round(confidence, 6) AS confidence FROM confident",
    ("confident",),
)
def lane_confidence(spark, d):
    out = fu.lane_confidence(st.signals(spark, d), st.lanes(spark))
    return out.select("query_id", "lane", "video_id", "frame_id", *r6("confidence"))


def label_intents(spark, d):
    """Intent per query from its label: one third each screen text, speech, default."""
    q = st.query_vectors(spark, d, ["visual_siglip2"]).select("query_id").distinct()
    m = F.pmod("query_id", F.lit(3))
    return q.withColumn("intent", F.when(m == 0, "ocr").when(m == 1, "asr").otherwise("default"))


cte(
    "intents",
    "SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'asr' ELSE 'default' END AS intent FROM label_means",
    "label_means",
)
cte(
    "bonuses",
    """SELECT query_id, video_id, frame_id, 0.012 * sum(confidence) AS confidence_bonus,
  0.018::DOUBLE * greatest(0, count(DISTINCT visual_family) - 1) AS visual_bonus,
  0.012::DOUBLE * greatest(0, count(DISTINCT family) - 1) AS modality_bonus,
  0.018 * sum(CASE WHEN (lane = 'caption' OR (intent = 'asr' AND lane = 'audio') OR (intent = 'ocr' AND lane IN ('ocr', 'ocr_semantic')))
    AND confidence >= 0.6 THEN confidence ELSE 0 END) AS specialist_bonus
FROM (SELECT query_id, video_id, frame_id, lane, family, visual_family, max(confidence) AS confidence FROM confident GROUP BY ALL)
JOIN intents USING (query_id) GROUP BY ALL""",
    "confident",
    "intents",
)
cte(
    "topic_bonuses",
    """SELECT query_id, topic, 0.010 * mass / peak * least(1.0, (lanes - 1) / 2.0) AS topic_bonus FROM (
  SELECT *, max(mass) OVER (PARTITION BY query_id) AS peak FROM (
    SELECT query_id, topic, sum(1.0 / (30 + best)) AS mass, count(*) AS lanes FROM (
      SELECT query_id, split_part(video_id, '_', 1) AS topic, lane, min(rank) AS best FROM cut_signals WHERE rank <= 10 GROUP BY ALL)
    GROUP BY ALL)) WHERE lanes >= 2""",
    "cut_signals",
)
cte(
    "fused_bonus",
    """SELECT f.query_id, f.video_id, f.frame_id, n_lanes, f.score AS rrf, confidence_bonus, visual_bonus, modality_bonus, specialist_bonus,
  coalesce(topic_bonus, 0) AS topic_bonus,
  f.score + confidence_bonus + visual_bonus + modality_bonus + specialist_bonus + coalesce(topic_bonus, 0) AS score
FROM fused f JOIN bonuses b USING (query_id, video_id, frame_id)
LEFT JOIN topic_bonuses t ON f.query_id = t.query_id AND split_part(f.video_id, '_', 1) = t.topic""",
    "fused",
    "bonuses",
    "topic_bonuses",
)


@query(
    "consensus_bonuses",
    """SELECT query_id, video_id, frame_id, round(confidence_bonus, 6) AS confidence_bonus, round(visual_bonus, 6) AS visual_bonus,
  round(modality_bonus, 6) AS modality_bonus, round(specialist_bonus, 6) AS specialist_bonus FROM bonuses""",
    ("bonuses",),
)
def consensus_bonuses(spark, d):
    out = fu.consensus_bonuses(st.signals(spark, d), st.lanes(spark), label_intents(spark, d))
    return out.select(*KEY, *r6("confidence_bonus", "visual_bonus", "modality_bonus", "specialist_bonus"))


@query(
    "topic_prior",
    "SELECT query_id, topic, round(topic_bonus, 6) AS topic_bonus FROM topic_bonuses",
    ("topic_bonuses",),
)
def topic_prior(spark, d):
    out = fu.topic_support(st.signals(spark, d), st.lanes(spark), 30)
    return out.select("query_id", "topic", *r6("topic_bonus"))


@query(
    "fusion_with_bonuses",
    "SELECT query_id, video_id, frame_id, n_lanes, rrf, round(topic_bonus, 6) AS topic_bonus, round(score, 6) AS score FROM fused_bonus",
    ("fused_bonus",),
)
def fusion_with_bonuses(spark, d):
    out = fu.fuse_with_bonuses(st.signals(spark, d), st.lanes(spark), label_intents(spark, d))
    return out.select(*KEY, "n_lanes", F.round("rrf", 9).alias("rrf"), *r6("topic_bonus", "score"))


@query(
    "modality_merge",
    """SELECT query_id, video_id, frame_id, max(score) FILTER (lane LIKE 'visual%') AS visual_score, max(score) FILTER (lane LIKE 'ocr%') AS ocr_score,
  max(score) FILTER (lane = 'audio') AS audio_score, max(score) FILTER (lane = 'caption') AS caption_score, count(DISTINCT lane) AS n_lanes, min(rank) AS best_rank
FROM signals GROUP BY ALL""",
    ("signals",),
)
def modality_merge(spark, d):
    return fu.merge_modalities(
        st.signals(spark, d),
        {"visual_score": "visual", "ocr_score": "ocr", "audio_score": "audio", "caption_score": "caption"},
    )


# The greedy chain of anchors, walked one window at a time.
cte(
    "anchor_chain",
    """RECURSIVE SELECT query_id, video_id, min(frame_id) AS anchor FROM visual_signals GROUP BY ALL
UNION ALL
SELECT query_id, video_id, nxt FROM (
  SELECT a.query_id, a.video_id, (SELECT min(frame_id) FROM visual_signals s WHERE s.query_id = a.query_id AND s.video_id = a.video_id AND s.frame_id > a.anchor + 75) AS nxt
  FROM anchor_chain a) WHERE nxt IS NOT NULL""",
    "visual_signals",
)
cte(
    "aligned",
    """SELECT query_id, lane, video_id, frame_id, score, CAST(row_number() OVER (PARTITION BY query_id, lane ORDER BY rank, score DESC, video_id, frame_id) AS INTEGER) AS rank FROM (
  SELECT query_id, lane, video_id, target AS frame_id, rank, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, lane, video_id, target ORDER BY rank, score DESC) AS n FROM (
      SELECT *, first_value(frame_id) OVER (PARTITION BY query_id, video_id, anchor ORDER BY rank, frame_id) AS target FROM (
        SELECT s.*, (SELECT max(anchor) FROM anchor_chain a WHERE a.query_id = s.query_id AND a.video_id = s.video_id AND a.anchor <= s.frame_id) AS anchor
        FROM visual_signals s))) WHERE n = 1)""",
    "anchor_chain",
    "visual_signals",
)


@query("window_alignment", "SELECT * FROM aligned", ("aligned",))
def window_alignment(spark, d):
    return fu.align_to_windows(st.stored_signals(spark, d, st.VISUAL_LANES), 75)


@query(
    "intent_lane_weights",
    """SELECT query_id, intent, lane, f * CASE WHEN lane IN ('visual_spatial_beit3', 'ocr_semantic') THEN weight ELSE 1.0 END AS weight
FROM intents CROSS JOIN (SELECT lane, weight, family FROM lane_config)
JOIN (VALUES ('default','visual',1.0::DOUBLE),('default','audio',1.0),('default','ocr',1.0),('default','caption',1.0),('default','graph',1.0),
 ('ocr','visual',0.6),('ocr','audio',0.6),('ocr','ocr',3.0),('ocr','caption',0.6),('ocr','graph',0.6),
 ('asr','visual',0.6),('asr','audio',3.0),('asr','ocr',0.6),('asr','caption',0.6),('asr','graph',0.6)) p(intent, family, f) USING (intent, family)""",
    ("intents", "lane_config"),
)
def intent_lane_weights(spark, d):
    return fu.intent_weights(label_intents(spark, d), st.lanes(spark))


@query(
    "budget_lane_weights",
    """SELECT query_id, lane, round(CASE WHEN v THEN 0.35 ELSE 0.65 END / count(*) OVER (PARTITION BY query_id, v), 9) AS weight
FROM (SELECT DISTINCT query_id, lane, lane LIKE 'visual%' AS v FROM signals)""",
    ("signals",),
)
def budget_lane_weights(spark, d):
    out = fu.budget_weights(st.signals(spark, d), 0.35, 0.65)
    return out.select("query_id", "lane", F.round("weight", 9).alias("weight"))


def critic_lists(spark, d):
    s = st.signals(spark, d, st.VISUAL_LANES)
    name = F.when(F.col("lane") == "visual_pe_core", "local").when(F.col("lane") == "visual_beit3", "critic_a").otherwise("critic_b")
    return s.filter("rank <= 30").select(
        "query_id", name.alias("critic"), "video_id", "frame_id", "rank", (F.col("score") < 0.1).alias("rejected")
    )


cte(
    "fused_ranked",
    "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, frame_id) AS INTEGER) AS rank FROM fused",
    "fused",
)


@query(
    "critic_rank_fusion",
    """SELECT query_id, video_id, frame_id, band, score AS critic_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY band, score DESC, rank) AS INTEGER) AS rank FROM (
  SELECT r.query_id, r.video_id, r.frame_id, r.rank, coalesce(c.s, 0.0) AS score, CAST(CASE WHEN c.s IS NULL THEN 2 ELSE rejected END AS INTEGER) AS band FROM fused_ranked r
  LEFT JOIN (SELECT query_id, video_id, frame_id, round(sum(CASE lane WHEN 'visual_pe_core' THEN 1.0 WHEN 'visual_beit3' THEN 1.2 ELSE 0.9 END::DOUBLE / (10 + rank)), 9) AS s,
    max(CASE WHEN score < 0.1 THEN 1 ELSE 0 END) AS rejected FROM visual_signals WHERE rank <= 30 GROUP BY ALL) c USING (query_id, video_id, frame_id))""",
    ("fused_ranked", "visual_signals"),
)
def critic_rank_fusion(spark, d):
    s = st.signals(spark, d)
    fused = fu.rank_fusion(s, st.lanes(spark)).withColumn("score", F.round("score", 9))
    base = rk.ranked(fused, ["query_id"], rk.score_order())
    return fu.critic_fusion(critic_lists(spark, d), {"local": 1.0, "critic_a": 1.2, "critic_b": 0.9}, base)


@query(
    "lane_preference",
    """SELECT query_id, 'ocr' AS lane, video_id, frame_id, rank, score FROM signals WHERE lane = 'ocr' AND score >= 0.6
UNION ALL SELECT query_id, 'ocr', video_id, frame_id, rank, score FROM signals WHERE lane = 'ocr_semantic'
  AND query_id NOT IN (SELECT query_id FROM signals WHERE lane = 'ocr' AND score >= 0.6)""",
    ("signals",),
)
def lane_preference(spark, d):
    s = st.signals(spark, d, ["ocr", "ocr_semantic"])
    cols = ["query_id", "lane", "video_id", "frame_id", "rank", "score"]
    full = s.filter("lane = 'ocr' and score >= 0.6").select(*cols)
    return fu.prefer_lane(full, s.filter("lane = 'ocr_semantic'").select(*cols), "ocr")


def clause_signals(spark, d):
    """Clause lanes: each model's list split in two clause lists by frame parity."""
    s = st.stored_signals(spark, d)
    clause = F.concat(F.col("lane"), F.lit("__clause"), F.pmod("frame_id", F.lit(2)) + 1)
    return s.withColumn("lane", clause)


cte(
    "clause_signals",
    "SELECT query_id, lane || '__clause' || (frame_id % 2 + 1) AS lane, video_id, frame_id, rank, score FROM signals",
    "signals",
)


@query(
    "clause_lane_names",
    "SELECT lane, split_part(lane, '__clause', 1) AS base, count(*) AS n_hits FROM clause_signals GROUP BY ALL",
    ("clause_signals",),
)
def clause_lane_names(spark, d):
    return clause_signals(spark, d).groupBy("lane", fu.base_lane(F.col("lane")).alias("base")).agg(F.count(F.lit(1)).alias("n_hits"))


@query(
    "collapsed_clauses",
    """SELECT query_id, lane, video_id, frame_id, score, CAST(row_number() OVER (PARTITION BY query_id, lane, video_id ORDER BY score DESC, frame_id) AS INTEGER) AS rank FROM (
  SELECT query_id, split_part(lane, '__clause', 1) AS lane, video_id, frame_id, max(score) AS score FROM clause_signals GROUP BY ALL)""",
    ("clause_signals",),
)
def collapsed_clauses(spark, d):
    return fu.collapse_clauses(clause_signals(spark, d))
