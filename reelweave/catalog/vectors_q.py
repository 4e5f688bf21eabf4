"""Vector retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelweave.catalog import standins as st
from reelweave.catalog.events_q import weights
from reelweave.catalog.ranking import RN, fused_ranked
from reelweave.catalog.registry import cte, query
from reelweave.catalog.timeline_q import videos
from reelweave.functions import identifiers as ids
from reelweave.functions.text import REGION_AXES
from reelweave.operators import moments as mo
from reelweave.operators import ranking as rk
from reelweave.operators import retrieval as rt
from reelweave.operators import vectors as vx

KEY = ["query_id", "video_id", "frame_id"]
COLS = "query_id, lane, video_id, frame_id, score, rank"


@query("vector_top_k", f"SELECT {COLS} FROM signals", ("signals",))
def vector_top_k(spark, d):
    """Exact top 50 of every lane for every label's mean vector."""
    return st.signals(spark, d)


cte(
    "self_scored",
    "SELECT q.vec_id AS query_id, c.video_id, c.frame_id, round(list_cosine_similarity(c.embedding, CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, frames c",
    "frames",
)


@query(
    "example_vector_search",
    f"SELECT query_id, 'visual_siglip2' AS lane, video_id, frame_id, score, rank FROM (SELECT *, {RN.format(o='score DESC, video_id, frame_id')} AS rank FROM self_scored) WHERE rank <= 10",
    ("self_scored",),
)
def example_vector_search(spark, d):
    """Every stored vector as the example of a query: its ten nearest frames."""
    f = st.frames(spark, d)
    vectors = f.select(F.lit("visual_siglip2").alias("lane"), "video_id", "frame_id", "embedding")
    queries = f.select(F.col("frame_id").alias("query_id"), F.lit("visual_siglip2").alias("lane"), F.col("embedding").alias("qv"))
    return vx.vector_top_k(vectors, queries, 10)


@query("approximate_vector_top_k")
def approximate_vector_top_k(spark, d):
    """K-means cells with exact scores inside them (``approximate_vector_recall`` tells how many are found)."""
    return rt.approximate_top_k(st.lane_vectors(spark, d, ["visual_siglip2"]), st.query_vectors(spark, d, ["visual_siglip2"]), 20)


@query(
    "approximate_vector_recall",
    """SELECT count(DISTINCT query_id) AS n_queries, true AS found_enough, true AS scored_fewer FROM (SELECT label AS query_id FROM embeddings)""",
)
def approximate_vector_recall(spark, d):
    """Nine tenths of the exact hits are found while at most four fifths of all pairs are scored."""
    v, q = st.lane_vectors(spark, d, ["visual_siglip2"]), st.query_vectors(spark, d, ["visual_siglip2"])
    key = ["query_id", "lane", "video_id", "frame_id"]
    exact, near = vx.vector_top_k(v, q, 20), rt.approximate_top_k(v, q, 20)
    found = exact.select(*key).join(near.select(*key, F.lit(1).alias("_hit")), key, "left")
    recall = found.agg((F.sum("_hit") >= 0.9 * F.count(F.lit(1))).alias("found_enough"), F.countDistinct("query_id").alias("n_queries"), F.lit(1).alias("_one"))
    pairs = near.select("query_id", "n_scored").distinct().agg(F.sum("n_scored").alias("_s"), F.lit(1).alias("_one"))
    rows = v.agg(F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_one"))
    return recall.join(pairs, "_one").join(rows, "_one").select("n_queries", "found_enough", (F.col("_s") <= 0.8 * F.col("_n") * F.col("n_queries")).alias("scored_fewer"))


cte("short5", "SELECT query_id, video_id FROM (SELECT query_id, video_id, min(rank) AS best FROM visual_ranked GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best, video_id) <= 5", "visual_ranked")


def short5(spark, d):
    return rk.group_by_video(fused_ranked(spark, d, st.VISUAL_LANES)).filter("position <= 5").select("query_id", "video_id")


cte(
    "in_video",
    """SELECT * FROM (SELECT query_id, lane, video_id, frame_id, score, CAST(row_number() OVER (PARTITION BY query_id, lane, video_id ORDER BY score DESC, frame_id) AS INTEGER) AS rank
FROM scored JOIN short5 USING (query_id, video_id) WHERE lane LIKE 'visual%') WHERE rank <= 8""",
    "scored",
    "short5",
)


def in_video(spark, d, n=8):
    return vx.in_video_top_n(st.lane_vectors(spark, d, st.VISUAL_LANES), st.query_vectors(spark, d, st.VISUAL_LANES), short5(spark, d), n)


@query("in_video_top_n", f"SELECT {COLS} FROM in_video", ("in_video",))
def in_video_top_n(spark, d):
    """Top 8 frames inside each query's five shortlisted videos, per lane."""
    return in_video(spark, d)


def clause_queries(spark, d, lane="visual_siglip2"):
    """Two clause vectors per label: the means of its even and its odd frames."""
    f = st.frames(spark, d).withColumn("clause", F.pmod("frame_id", F.lit(2)) + 1)
    m = vx.mean_vector(f, ["label", "clause"], "embedding", st.DIM)
    return m.select(F.col("label").alias("query_id"), "clause", F.lit(lane).alias("lane"), F.col("embedding").alias("qv"))


cte(
    "clause_vectors",
    """SELECT label AS query_id, clause, list(m ORDER BY i) AS qv FROM (SELECT label, clause, i, avg(x) AS m FROM (
  SELECT label, frame_id % 2 + 1 AS clause, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM frames) GROUP BY ALL) GROUP BY ALL""",
    "frames",
)
cte(
    "clause_hits",
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, clause ORDER BY score DESC, video_id, frame_id) AS INTEGER) AS rank FROM (
  SELECT query_id, clause, video_id, frame_id, round(list_cosine_similarity(embedding, qv), 6) AS score FROM frames, clause_vectors)) WHERE rank <= 30""",
    "frames",
    "clause_vectors",
)


def clause_hits(spark, d, k=30):
    return rt.clause_top_k(st.lane_vectors(spark, d, ["visual_siglip2"]), clause_queries(spark, d), k)


@query(
    "clause_union_protected",
    f"""SELECT * FROM (SELECT query_id, video_id, frame_id, score, full_rank, clause_rank,
  {RN.format(o='CASE WHEN full_rank <= 10 THEN 0 ELSE 1 END, CASE WHEN full_rank <= 10 THEN full_rank END, score DESC, full_rank IS NULL, coalesce(full_rank, clause_rank), video_id, frame_id')} AS rank FROM (
  SELECT query_id, video_id, frame_id, max(score) AS score, min(fr) AS full_rank, min(cr) AS clause_rank FROM (
    SELECT query_id, video_id, frame_id, score, rank AS fr, NULL::INTEGER AS cr FROM signals WHERE lane = 'visual_siglip2'
    UNION ALL SELECT query_id, video_id, frame_id, score, NULL, rank FROM clause_hits) GROUP BY ALL)) WHERE rank <= 60""",
    ("signals", "clause_hits"),
)
def clause_union_protected(spark, d):
    return rt.clause_union(st.signals(spark, d, ["visual_siglip2"]), clause_hits(spark, d), 60, protect=10)


@query(
    "clause_lane_expansion",
    f"""SELECT query_id, lane, video_id, frame_id, score, rank FROM signals WHERE lane = 'visual_siglip2'
UNION ALL SELECT query_id, 'visual_siglip2__clause' || clause, video_id, frame_id, score, rank FROM clause_hits""",
    ("signals", "clause_hits"),
)
def clause_lane_expansion(spark, d):
    return rt.clause_lanes(st.signals(spark, d, ["visual_siglip2"]), clause_hits(spark, d))


REGION_LANES = {"left": (1, 16), "right": (17, 32), "top": (33, 48), "bottom": (49, 64)}
_REGIONS = list(REGION_AXES)
cte("axis_dims", "SELECT * FROM (VALUES ('left', 1, 16), ('right', 17, 32), ('top', 33, 48), ('bottom', 49, 64)) t(lane, lo, hi)")
cte(
    "axis_hits",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, video_id, frame_id) AS rank FROM (
  SELECT query_id, lane, video_id, frame_id, round(list_cosine_similarity(embedding[lo:hi], qv[lo:hi]), 6) AS score FROM frames, label_means, axis_dims)) WHERE rank <= 60""",
    "frames",
    "label_means",
    "axis_dims",
)
cte(
    "regions",
    "SELECT query_id, ['" + "', '".join(_REGIONS) + "'][1 + query_id % 8] AS region FROM label_means",
    "label_means",
)
cte(
    "region_axes",
    "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{a}', {1.0 / len(p)}::DOUBLE)" for r, p in REGION_AXES.items() for a in p) + ") t(region, lane, share)",
)


@query(
    "regional_search",
    f"""SELECT * FROM (SELECT query_id, video_id, frame_id, region, score, n_axes, best_axis_score, {RN.format(o='score DESC, n_axes DESC, best_axis_score DESC, video_id, frame_id')} AS rank FROM (
  SELECT query_id, video_id, frame_id, region, round(sum(share / (60 + rank)), 9) AS score, count(DISTINCT lane) AS n_axes, max(score) AS best_axis_score
  FROM axis_hits JOIN regions USING (query_id) JOIN region_axes USING (region, lane) GROUP BY ALL)) WHERE rank <= 30""",
    ("axis_hits", "regions", "region_axes"),
)
def regional_search(spark, d):
    f = st.frames(spark, d)
    vectors = vx.lane_slices(f, REGION_LANES)
    means = vx.mean_vector(f, ["label"], "embedding", st.DIM)
    queries = vx.lane_slices(means, REGION_LANES, alias="qv").withColumnRenamed("label", "query_id")
    hits = vx.vector_top_k(vectors, queries, 60)
    names = F.array(*[F.lit(r) for r in _REGIONS])
    regions = means.select(F.col("label").alias("query_id"), F.element_at(names, (F.pmod("label", F.lit(8)) + 1).cast("int")).alias("region"))
    return rt.regional_search(hits, regions, 30)


@query(
    "transcript_vector_search",
    """SELECT query_id, s.video_id, frame_id AS segment, CAST(round_even(frame_id * 0.7::DOUBLE * coalesce(fps, 25.0), 0) AS BIGINT) AS start_frame,
  greatest(CAST(round_even((frame_id * 0.7::DOUBLE + 20) * coalesce(fps, 25.0), 0) AS BIGINT), CAST(round_even(frame_id * 0.7::DOUBLE * coalesce(fps, 25.0), 0) AS BIGINT) + 1) AS end_frame, score, rank
FROM signals s JOIN videos USING (video_id) WHERE lane = 'audio'""",
    ("signals", "videos"),
)
def transcript_vector_search(spark, d):
    """Speech segments by vector, as rounded half-open frame ranges."""
    hits = mo.with_fps(st.signals(spark, d, ["audio"]), videos(spark, d))
    start = F.col("frame_id") * F.lit(0.7)
    rng = ids.speech_frames(start, start + 20, F.col("fps"))
    return hits.select(
        "query_id", "video_id", F.col("frame_id").alias("segment"), rng["start_frame"].alias("start_frame"), rng["end_frame"].alias("end_frame"), "score", "rank"
    )


@query(
    "speech_fallback_tail",
    f"""SELECT * FROM (SELECT query_id, video_id, frame_id, score, variant, {RN.format(o='variant, r')} AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame_id ORDER BY variant, r) AS n FROM (
    SELECT query_id, video_id, frame_id, score, rank AS r, 0 AS variant FROM signals WHERE lane = 'audio' AND rank <= 36
    UNION ALL SELECT query_id, video_id, frame_id, score, rank, 1 FROM signals WHERE lane = 'ocr' AND rank <= 4
    UNION ALL SELECT query_id, video_id, frame_id, score, rank, 2 FROM signals WHERE lane = 'caption' AND rank <= 4)) WHERE n = 1) WHERE rank <= 40""",
    ("signals",),
)
def speech_fallback_tail(spark, d):
    s = st.signals(spark, d, ["audio", "ocr", "caption"])
    variant = F.when(F.col("lane") == "ocr", 1).otherwise(2)
    cols = ["query_id", "video_id", "frame_id", "score", "rank"]
    return rt.primary_with_fallback(
        s.filter("lane = 'audio'").select(*cols), s.filter("lane <> 'audio'").select(*cols, variant.alias("variant")), 40
    )


def occurrences(spark, d):
    """Text rows of the frame table: each occurs in two or three places."""
    f = st.frames(spark, d)

    def at(shift, conf):
        return F.struct(F.col("video_id"), (F.col("frame_id") + shift).alias("frame_id"), conf.alias("confidence"))

    none = F.lit(None).cast("double")
    occ = F.array(at(0, none), at(7, F.lit(0.9)), at(14, F.lit(1.5)))
    return f.select(F.col("frame_id").alias("evidence_id"), F.concat(F.lit("t"), "frame_id").alias("text"), occ.alias("occurrences"))


@query(
    "occurrence_expansion",
    f"""SELECT * FROM (SELECT query_id, video_id, frame_id, score, dense_rank, text, {RN.format(o='score DESC, dense_rank, video_id, frame_id')} AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame_id ORDER BY score DESC, dense_rank) AS n FROM (
    SELECT query_id, video_id, frame_id + shift AS frame_id, round(least(1.0, greatest(0.0, score)) * conf, 6) AS score, rank AS dense_rank, 't' || frame_id AS text
    FROM signals, (VALUES (0, 1.0::DOUBLE), (7, 0.9::DOUBLE), (14, 1.0::DOUBLE)) o(shift, conf) WHERE lane = 'ocr_semantic')) WHERE n = 1) WHERE rank <= 40""",
    ("signals",),
)
def occurrence_expansion(spark, d):
    hits = st.signals(spark, d, ["ocr_semantic"]).select("query_id", F.col("frame_id").alias("evidence_id"), "score", "rank")
    return rt.expand_occurrences(hits, occurrences(spark, d), 40)


FIELDS = {"visual_siglip2": "visual_description", "audio": "actions", "ocr": "entities"}


def field_hits(spark, d):
    s = st.signals(spark, d, list(FIELDS))
    field = F.create_map(*[x for a, b in FIELDS.items() for x in (F.lit(a), F.lit(b))])[F.col("lane")]
    return s.select("query_id", field.alias("field"), F.concat(F.lit("r"), "frame_id").alias("record_id"), "video_id", "frame_id", "score", "rank")


cte(
    "field_hits",
    "SELECT query_id, CASE lane WHEN 'visual_siglip2' THEN 'visual_description' WHEN 'audio' THEN 'actions' ELSE 'entities' END AS field, 'r' || frame_id AS record_id, video_id, frame_id, score, rank FROM signals WHERE lane IN ('visual_siglip2', 'audio', 'ocr')",
    "signals",
)


@query(
    "field_caption_search",
    f"""SELECT * FROM (SELECT query_id, record_id, fused, score, CASE WHEN f > 0 THEN 'visual_description of ' || record_id WHEN a > 0 THEN 'actions of ' || record_id ELSE 'entities of ' || record_id END AS snippet, {RN.format(o='fused DESC, record_id')} AS rank FROM (
  SELECT query_id, record_id, round(sum(CASE field WHEN 'visual_description' THEN 1.0 WHEN 'actions' THEN 0.9 ELSE 0.7 END::DOUBLE / (60 + rank)), 9) AS fused, max(score) AS score,
    count(*) FILTER (field = 'visual_description') AS f, count(*) FILTER (field = 'actions') AS a FROM field_hits GROUP BY ALL)) WHERE rank <= 30""",
    ("field_hits",),
)
def field_caption_search(spark, d):
    f = st.frames(spark, d).select(F.concat(F.lit("r"), "frame_id").alias("record_id"))
    rows = f.withColumn("field", F.explode(F.array(*[F.lit(x) for x in FIELDS.values()]))).withColumn("text", F.concat("field", F.lit(" of "), "record_id"))
    return rt.field_caption_search(field_hits(spark, d), rows, 30)


@query(
    "caption_time_ranges",
    """SELECT t.query_id, t.video_id, t.start_frame, t.end_frame, t.score, t.rank, substring(string_agg(text, ' . ' ORDER BY s DESC, text), 1, 600) AS text FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, start_frame) AS INTEGER) AS rank FROM (
    SELECT query_id, video_id, frame_id // 25 * 25 AS start_frame, frame_id // 25 * 25 + 25 AS end_frame, max(score) AS score FROM in_video GROUP BY ALL)) t
JOIN (SELECT query_id, video_id, frame_id // 25 * 25 AS start_frame, 'caption ' || frame_id AS text, max(score) AS s FROM in_video GROUP BY ALL) USING (query_id, video_id, start_frame)
WHERE t.rank <= 4 GROUP BY ALL""",
    ("in_video",),
)
def caption_time_ranges(spark, d):
    """In-video hits of all lanes collapsed to time ranges of 25 frames."""
    start = F.floor(F.col("frame_id") / 25) * 25
    hits = in_video(spark, d).select(
        "query_id", "video_id", start.alias("start_frame"), (start + 25).alias("end_frame"), "score", F.concat(F.lit("caption "), "frame_id").alias("text")
    )
    return rt.collapse_time_ranges(hits, 4)


@query(
    "global_prior_in_videos",
    """SELECT query_id, lane, video_id, frame_id, score, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS n FROM signals s JOIN short5 USING (query_id, video_id) WHERE lane = 'audio') WHERE n <= 2""",
    ("signals", "short5"),
)
def global_prior_in_videos(spark, d):
    return rt.global_prior_in_videos(st.signals(spark, d, ["audio"]), short5(spark, d), 2)


@query(
    "anchor_seeds",
    """SELECT query_id, coalesce(v, rv) AS video_id,
  CASE WHEN v IS NULL THEN rf WHEN f IS NOT NULL THEN f WHEN NOT t THEN 0 ELSE coalesce(sf, tf, 0) END AS frame_id,
  CASE WHEN v IS NULL THEN 'kis_anchor' WHEN f IS NOT NULL THEN 'manual_video_frame' WHEN NOT t THEN 'manual_video_start' WHEN sf IS NOT NULL THEN 'kis_manual_video' WHEN tf IS NOT NULL THEN 'targeted_anchor' ELSE 'manual_video_start' END AS source FROM (
  SELECT r.*, (SELECT video_id FROM visual_ranked x WHERE x.query_id = r.query_id AND rank = 1) AS rv, (SELECT frame_id FROM visual_ranked x WHERE x.query_id = r.query_id AND rank = 1) AS rf,
    (SELECT arg_min(frame_id, rank) FROM visual_ranked x WHERE x.query_id = r.query_id AND x.video_id = r.v AND rank <= 5) AS sf,
    (SELECT first(frame_id ORDER BY rank, score DESC, frame_id) FROM in_video x WHERE x.query_id = r.query_id AND x.video_id = r.v) AS tf
  FROM (SELECT query_id, CASE WHEN query_id % 5 <> 0 THEN 'L' || query_id || '_V001' END AS v, CASE WHEN query_id % 5 = 1 THEN query_id * 10 END AS f, query_id % 5 <> 2 AS t FROM label_means) r)""",
    ("visual_ranked", "in_video", "label_means"),
)
def anchor_seeds(spark, d):
    """Anchors of requests that give a video, a frame, a text, or none of them."""
    q = st.query_vectors(spark, d, ["visual_siglip2"]).select("query_id")
    m = F.pmod("query_id", F.lit(5))
    requests = q.select(
        "query_id",
        F.when(m != 0, F.concat(F.lit("L"), "query_id", F.lit("_V001"))).alias("video_id"),
        F.when(m == 1, F.col("query_id") * 10).alias("frame_id"),
        (m != 2).alias("has_text"),
    )
    return rt.anchor_seeds(requests, fused_ranked(spark, d, st.VISUAL_LANES, 5), in_video(spark, d))


@query(
    "vector_validation",
    """SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'dimension' END AS violation, round(embedding[1] / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first_component FROM embeddings""",
)
def vector_validation(spark, d):
    """Vector rules and unit normalisation."""
    from reelweave.session import table

    e = table(spark, d, "embeddings")
    return e.select(
        "vec_id",
        vx.vector_violation(F.col("embedding"), 64).alias("violation"),
        F.round(vx.l2_normalize(F.col("embedding"))[0], 6).alias("first_component"),
    )


def _sims_sql(results: str) -> str:
    return f"""SELECT r.query_id, r.video_id, r.frame_id, q.lane, list_cosine_similarity(c.v, q.qv) AS sim FROM {results} r
JOIN lane_vectors c ON c.video_id = r.video_id AND c.frame_id = r.frame_id JOIN query_vectors q ON q.query_id = r.query_id AND q.lane = c.lane"""


cte("result_sims", _sims_sql("fused_ranked"), "fused_ranked", "lane_vectors", "query_vectors")


@query(
    "embedding_head_rescore",
    f"""SELECT query_id, video_id, frame_id, score, old_rank, raw, {RN.format(o='old_rank > 30, raw DESC NULLS LAST, old_rank')} AS rank FROM (
  SELECT f.query_id, f.video_id, f.frame_id, f.score, f.rank AS old_rank, CASE WHEN f.rank <= 30 THEN coalesce(raw, 0.0) END AS raw FROM fused_ranked f
  LEFT JOIN (SELECT query_id, video_id, frame_id, round(sum(sim * CASE lane WHEN 'visual_pe_core' THEN 1.0 ELSE 0.5 END::DOUBLE), 6) AS raw FROM result_sims WHERE lane IN ('visual_pe_core', 'visual_beit3') GROUP BY ALL) USING (query_id, video_id, frame_id))""",
    ("fused_ranked", "result_sims"),
)
def embedding_head_rescore(spark, d):
    lanes = ["visual_pe_core", "visual_beit3"]
    return rt.rescore_head(
        fused_ranked(spark, d), st.lane_vectors(spark, d, lanes), st.query_vectors(spark, d, lanes), {"visual_pe_core": 1.0, "visual_beit3": 0.5}, 30
    )


@query(
    "text_hit_verification",
    f"""SELECT query_id, video_id, frame_id, score, old_rank, visual_sim, verified_score, {RN.format(o='verified_score DESC, old_rank')} AS rank FROM (
  SELECT f.query_id, f.video_id, f.frame_id, f.score, f.rank AS old_rank, visual_sim, round(CASE WHEN visual_sim >= 0.1 THEN f.score + 0.15::DOUBLE * visual_sim WHEN visual_sim < 0.02 THEN f.score - 0.3 ELSE f.score END, 9) AS verified_score FROM fused_ranked f
  JOIN (SELECT query_id, video_id, frame_id, max(score) FILTER (lane LIKE 'visual%') AS vs, max(score) FILTER (lane NOT LIKE 'visual%') AS ts FROM signals GROUP BY ALL) m USING (query_id, video_id, frame_id)
  LEFT JOIN (SELECT query_id, video_id, frame_id, round(avg(sim), 6) AS s FROM result_sims WHERE lane IN ('visual_pe_core', 'visual_beit3') GROUP BY ALL) x USING (query_id, video_id, frame_id),
  LATERAL (SELECT CASE WHEN coalesce(ts, 0) > 0 AND NOT coalesce(vs, 0) > 0 THEN s END AS visual_sim) y)""",
    ("fused_ranked", "signals", "result_sims"),
)
def text_hit_verification(spark, d):
    lanes = ["visual_pe_core", "visual_beit3"]
    s = st.signals(spark, d)
    is_visual = F.col("lane").startswith("visual")
    m = s.groupBy(*KEY).agg(F.max(F.when(is_visual, F.col("score"))).alias("visual_score"), F.max(F.when(~is_visual, F.col("score"))).alias("text_score"))
    base = fused_ranked(spark, d).join(m, KEY)
    out = rt.verify_text_hits(base, st.lane_vectors(spark, d, lanes), st.query_vectors(spark, d, lanes), agree=0.1, disagree=0.02)
    return out.select(*KEY, "score", "old_rank", "visual_sim", "verified_score", "rank")


cte(
    "selections",
    "SELECT query_id, video_id, best_rank AS position FROM (SELECT query_id, video_id, min(rank) AS best_rank FROM text_ranked GROUP BY ALL)",
    "text_ranked",
)


def selections(spark, d):
    """Videos a user selected: those of the text results, with a seed frame each."""
    v = rk.group_by_video(fused_ranked(spark, d, ["ocr", "audio", "caption"]))
    return v.select("query_id", "video_id", F.col("best_rank").alias("position"), F.lit(7).cast("bigint").alias("seed_frame"))


@query(
    "selected_video_refinement",
    f"""SELECT * FROM (SELECT query_id, video_id, frame_id, score, best, CAST(position AS INTEGER) AS position, fallback, band, {RN.format(o='band, CASE WHEN band = 0 THEN position END NULLS LAST, score DESC, best DESC NULLS LAST, position, frame_id')} AS rank FROM (
  SELECT *, CAST(CASE WHEN row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, best DESC NULLS LAST, frame_id) = 1 THEN 0 ELSE 1 END AS INTEGER) AS band FROM (
    SELECT i.query_id, i.video_id, frame_id, round(sum(weight / (30 + i.rank)), 9) AS score, max(i.score) AS best, position, false AS fallback FROM in_video i
      JOIN lane_config USING (lane) JOIN selections s ON s.query_id = i.query_id AND s.video_id = i.video_id GROUP BY ALL
    UNION ALL SELECT query_id, video_id, 7, 0.0, NULL, position, true FROM selections s WHERE NOT EXISTS (SELECT 1 FROM in_video i WHERE i.query_id = s.query_id AND i.video_id = s.video_id)))) WHERE rank <= 100""",
    ("in_video", "lane_config", "selections"),
)
def selected_video_refinement(spark, d):
    """Frames of the selected videos, one per video first."""
    return rt.refine_selected_videos(in_video(spark, d), selections(spark, d), weights(spark)).select(
        *KEY, "score", "best", "position", "fallback", "band", "rank"
    )
