"""Ranking, band and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelweave.catalog import standins as st
from reelweave.catalog.fusion import lineitem_signals
from reelweave.catalog.registry import cte, query
from reelweave.operators import fusion as fu
from reelweave.operators import ranking as rk
from reelweave.session import table

KEY = ["query_id", "video_id", "frame_id"]


def fused_ranked(spark, d, lanes=None, k=None):
    fused = fu.rank_fusion(st.signals(spark, d, lanes), st.lanes(spark)).select(
        *KEY, F.round("score", 9).alias("score")
    )
    return rk.ranked(fused, ["query_id"], rk.score_order(), k)


RN = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY {o}) AS INTEGER)"
cte(
    "fused_visual",
    "SELECT query_id, video_id, frame_id, round(sum(weight / (30 + rank)), 9) AS score FROM cut_signals WHERE lane LIKE 'visual%' GROUP BY ALL",
    "cut_signals",
)
cte(
    "fused_text",
    "SELECT query_id, video_id, frame_id, round(sum(weight / (30 + rank)), 9) AS score FROM cut_signals WHERE lane IN ('ocr', 'audio', 'caption') GROUP BY ALL",
    "cut_signals",
)
cte(
    "fused_ocr",
    "SELECT query_id, video_id, frame_id, round(sum(weight / (30 + rank)), 9) AS score FROM cut_signals WHERE lane = 'ocr' GROUP BY ALL",
    "cut_signals",
)
cte("ocr_ranked", f"SELECT *, {RN.format(o='score DESC, video_id, frame_id')} AS rank FROM fused_ocr", "fused_ocr")
cte("visual_ranked", f"SELECT *, {RN.format(o='score DESC, video_id, frame_id')} AS rank FROM fused_visual", "fused_visual")
cte("text_ranked", f"SELECT *, {RN.format(o='score DESC, video_id, frame_id')} AS rank FROM fused_text", "fused_text")
TEXT_LANES = ["ocr", "audio", "caption"]


@query(
    "diversified_search",
    """SELECT query_id, video_id, frame_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY old) AS rank FROM (
    SELECT query_id, video_id, frame_id, score, rank AS old, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS n FROM visual_ranked) WHERE n <= 3)
WHERE rank <= 10""",
    ("visual_ranked",),
)
def diversified_search(spark, d):
    """Vector lanes, rank fusion, at most three frames per video, top ten."""
    return rk.diversify(fused_ranked(spark, d, st.VISUAL_LANES), 3, 10)


@query(
    "diversified_lineitem",
    """SELECT query_id, video_id, frame_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY old) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY old) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, frame_id) AS old FROM (
        SELECT query_id, video_id, frame_id, round(sum(1.0 / (30 + rank)), 9) AS score FROM line_signals GROUP BY ALL))) WHERE n <= 2)
WHERE rank <= 50""",
    ("line_signals",),
)
def diversified_lineitem(spark, d):
    fused = fu.rank_fusion(lineitem_signals(spark, d), k=30).select(*KEY, F.round("score", 9).alias("score"))
    return rk.diversify(rk.ranked(fused, ["query_id"], rk.score_order()), 2, 50)


@query(
    "lane_rerank",
    """SELECT query_id, lane, video_id, frame_id, score, CAST(row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, video_id, frame_id) AS INTEGER) AS rank
FROM signals WHERE score > 0.15""",
    ("signals",),
)
def lane_rerank(spark, d):
    """Ranks rebuilt after a filter on the hits."""
    return rk.rerank(st.signals(spark, d).filter("score > 0.15")).select(
        "query_id", "lane", "video_id", "frame_id", "score", "rank"
    )


@query(
    "top_k_orders_per_customer",
    """SELECT query_id, video_id, frame_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT o_custkey AS query_id, o_orderstatus AS video_id, o_orderkey AS frame_id, o_totalprice AS score,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderstatus, o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
)
def top_k_orders_per_customer(spark, d):
    o = table(spark, d, "orders")
    return rk.top_k(
        o.select(
            F.col("o_custkey").alias("query_id"),
            F.col("o_orderstatus").alias("video_id"),
            F.col("o_orderkey").alias("frame_id"),
            F.col("o_totalprice").alias("score"),
        ),
        3,
    )


@query(
    "global_top_k",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
)
def global_top_k(spark, d):
    """Single ranked list: sort and limit, planned as TakeOrderedAndProject."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return li.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


_PROTECTED = """SELECT query_id, video_id, frame_id, CAST(band AS INTEGER) AS band, {rn} AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame_id ORDER BY band, rank) AS first FROM (
    SELECT query_id, video_id, frame_id, rank, 0 AS band FROM visual_ranked WHERE rank <= {head}
    UNION ALL
    SELECT query_id, video_id, frame_id, n AS rank, 1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM text_ranked t
      WHERE NOT EXISTS (SELECT 1 FROM visual_ranked v WHERE v.rank <= {head} AND v.query_id = t.query_id AND v.video_id = t.video_id AND v.frame_id = t.frame_id)) WHERE n <= {rescue}
    UNION ALL
    SELECT query_id, video_id, frame_id, rank, 2 FROM visual_ranked WHERE rank > {head})) WHERE first = 1"""


def _protected(head, rescue, limit):
    inner = _PROTECTED.format(rn=RN.format(o="band, rank, video_id, frame_id"), head=head, rescue=rescue)
    return f"SELECT * FROM ({inner}) WHERE rank <= {limit}"


@query("protected_head_rescue", _protected(20, 10, 100), ("visual_ranked", "text_ranked"))
def protected_head_rescue(spark, d):
    """Visual top 20 kept, ten unseen text hits, then the rest of the visual list."""
    base = fused_ranked(spark, d, st.VISUAL_LANES).drop("score")
    extra = fused_ranked(spark, d, TEXT_LANES).drop("score")
    return rk.protected_merge(base, extra, 20, 10, 100).select(*KEY, "band", "rank")


@query("refinement_merge", _protected(40, 60, 120), ("visual_ranked", "text_ranked"))
def refinement_merge(spark, d):
    """Refinement candidates merged behind a protected head of 40."""
    base = fused_ranked(spark, d, st.VISUAL_LANES).drop("score")
    extra = fused_ranked(spark, d, TEXT_LANES).drop("score")
    return rk.protected_merge(base, extra, 40, 60, 120).select(*KEY, "band", "rank")


@query(
    "ordered_band_union",
    f"""SELECT query_id, video_id, frame_id, band, {RN.format(o='band, old, video_id, frame_id')} AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame_id ORDER BY band, old) AS n FROM (
    SELECT query_id, video_id, frame_id, rank AS old, 0 AS band FROM text_ranked UNION ALL SELECT query_id, video_id, frame_id, rank, 1 FROM visual_ranked)) WHERE n = 1""",
    ("visual_ranked", "text_ranked"),
)
def ordered_band_union(spark, d):
    parts = [fused_ranked(spark, d, lanes).drop("score") for lanes in (TEXT_LANES, st.VISUAL_LANES)]
    return rk.ordered_union(parts, KEY).select(*KEY, "band", "rank")


@query(
    "export_top_up",
    f"""SELECT * FROM (SELECT query_id, video_id, frame_id, band, {RN.format(o='band, old, video_id, frame_id')} AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame_id ORDER BY band, old) AS n FROM (
    SELECT query_id, video_id, frame_id, rank AS old, 0 AS band FROM text_ranked WHERE rank <= 15 UNION ALL SELECT query_id, video_id, frame_id, rank, 1 FROM visual_ranked)) WHERE n = 1) WHERE rank <= 100""",
    ("visual_ranked", "text_ranked"),
)
def export_top_up(spark, d):
    """Chosen rows first, then the best remaining results up to 100."""
    chosen = fused_ranked(spark, d, TEXT_LANES, 15).drop("score")
    return rk.top_up(chosen, fused_ranked(spark, d, st.VISUAL_LANES).drop("score"), 100).select(*KEY, "band", "rank")


@query(
    "unseen_backfill",
    "SELECT query_id, video_id, frame_id, score, rank FROM text_ranked t WHERE NOT EXISTS (SELECT 1 FROM visual_ranked v WHERE v.query_id = t.query_id AND v.video_id = t.video_id AND v.frame_id = t.frame_id)",
    ("visual_ranked", "text_ranked"),
)
def unseen_backfill(spark, d):
    """Set difference by key."""
    return rk.unseen(fused_ranked(spark, d, TEXT_LANES), fused_ranked(spark, d, st.VISUAL_LANES), KEY).select(*KEY, "score", "rank")


@query(
    "shortlist_restriction",
    "SELECT query_id, video_id, frame_id, score, rank FROM visual_ranked v WHERE EXISTS (SELECT 1 FROM text_ranked t WHERE t.rank <= 5 AND t.query_id = v.query_id AND t.video_id = v.video_id)",
    ("visual_ranked", "text_ranked"),
)
def shortlist_restriction(spark, d):
    """Hits restricted to the videos of another list's head."""
    allowed = fused_ranked(spark, d, TEXT_LANES, 5)
    return rk.restrict(fused_ranked(spark, d, st.VISUAL_LANES), allowed, ["query_id", "video_id"]).select(*KEY, "score", "rank")


@query(
    "results_by_video",
    f"SELECT *, {RN.format(o='best_rank, video_id')} AS position FROM (SELECT query_id, video_id, count(*) AS n_hits, min(rank) AS best_rank FROM visual_ranked GROUP BY ALL)",
    ("visual_ranked",),
)
def results_by_video(spark, d):
    return rk.group_by_video(fused_ranked(spark, d, st.VISUAL_LANES))


_ESC = """SELECT query_id, video_id, frame_id, CAST(band AS INTEGER) AS band, {rn} AS rank FROM ({inner})"""
cte(
    "esc_base",
    f"""SELECT *, {RN.format(o='score DESC, video_id, frame_id')} AS rank FROM (
  SELECT f.*, m.visual_score, m.ocr_score, m.audio_score, m.caption_score FROM (SELECT query_id, video_id, frame_id, score FROM fused) f
  JOIN (SELECT query_id, video_id, frame_id, max(score) FILTER (lane LIKE 'visual%') AS visual_score, max(score) FILTER (lane LIKE 'ocr%') AS ocr_score,
    max(score) FILTER (lane = 'audio') AS audio_score, max(score) FILTER (lane = 'caption') AS caption_score FROM signals GROUP BY ALL) m USING (query_id, video_id, frame_id))""",
    "fused",
    "signals",
)
cte("esc0", "SELECT query_id, video_id, frame_id, rank, 0 AS band FROM esc_base WHERE rank <= 23", "esc_base")
for _i, (_c, _q) in enumerate([("visual_score", 2), ("ocr_score", 2), ("audio_score", 1), ("caption_score", 2)], start=1):
    cte(
        f"esc{_i}",
        f"""SELECT * FROM esc{_i - 1} UNION ALL SELECT query_id, video_id, frame_id, CAST(n AS INTEGER), {_i} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_c} DESC, rank) AS n FROM esc_base b WHERE {_c} > 0
    AND NOT EXISTS (SELECT 1 FROM esc{_i - 1} e WHERE e.query_id = b.query_id AND e.video_id = b.video_id AND e.frame_id = b.frame_id)) WHERE n <= {_q}""",
        f"esc{_i - 1}",
        "esc_base",
    )


@query(
    "specialist_escape_shortlist",
    f"""SELECT * FROM (SELECT query_id, video_id, frame_id, CAST(band AS INTEGER) AS band, {RN.format(o='band, rank')} AS rank FROM (
  SELECT * FROM esc4 UNION ALL SELECT query_id, video_id, frame_id, rank, 5 FROM esc_base b
  WHERE NOT EXISTS (SELECT 1 FROM esc4 e WHERE e.query_id = b.query_id AND e.video_id = b.video_id AND e.frame_id = b.frame_id))) WHERE rank <= 30""",
    ("esc4", "esc_base"),
)
def specialist_escape_shortlist(spark, d):
    s = st.signals(spark, d)
    merged = fu.merge_modalities(
        s, {"visual_score": "visual", "ocr_score": "ocr", "audio_score": "audio", "caption_score": "caption"}
    ).drop("n_lanes", "best_rank")
    fused = fu.rank_fusion(s, st.lanes(spark)).select(*KEY, F.round("score", 9).alias("score"))
    base = rk.ranked(fused.join(merged, KEY), ["query_id"], rk.score_order())
    quotas = {
        "visual": ("visual_score", 2),
        "ocr": ("ocr_score", 2),
        "audio": ("audio_score", 1),
        "caption": ("caption_score", 2),
    }
    return rk.specialist_escape(base, quotas, 30).select(*KEY, "band", "rank")


@query(
    "critic_answer_sanitiser",
    """SELECT query_id, candidate_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN said IS NULL THEN 1 ELSE 0 END, said, position) AS INTEGER) AS rank, coalesce(critic_score, 0.0) AS critic_score FROM (
  SELECT c.query_id, c.candidate_id, c.position, a.said, a.critic_score FROM
    (SELECT conv_id AS query_id, role || turn AS candidate_id, turn AS position FROM conversations) c
  LEFT JOIN (SELECT * FROM (
    SELECT query_id, candidate_id, position AS said, least(1.0, greatest(0.0, score)) AS critic_score, row_number() OVER (PARTITION BY query_id, candidate_id ORDER BY position) AS n,
      max(least(1.0, greatest(0.0, score))) OVER (PARTITION BY query_id) AS top FROM (
      SELECT conv_id AS query_id, 'user' || (7 - turn) AS candidate_id, turn AS position, (length(text) - 300) / 500 AS score FROM conversations) x
    WHERE candidate_id IN (SELECT role || turn FROM conversations k WHERE k.conv_id = x.query_id)) WHERE n = 1 AND top > 0) a USING (query_id, candidate_id))""",
)
def critic_answer_sanitiser(spark, d):
    """Each conversation as a candidate list and a critic's (partly wrong) answer about it."""
    c = table(spark, d, "conversations")
    candidates = c.select(
        F.col("conv_id").alias("query_id"), F.concat("role", "turn").alias("candidate_id"), F.col("turn").alias("position")
    )
    wire = c.groupBy(F.col("conv_id").alias("query_id")).agg(
        F.to_json(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.col("turn").alias("position"),
                        F.concat(F.lit("user"), 7 - F.col("turn")).alias("id"),
                        ((F.length("text") - 300) / 500).alias("score"),
                    )
                )
            )
        ).alias("answer")
    )
    said = wire.select(
        "query_id",
        F.explode(F.from_json("answer", "ARRAY<STRUCT<position:BIGINT,id:STRING,score:DOUBLE>>")).alias("_a"),
    ).select("query_id", F.col("_a.position").alias("position"), F.col("_a.id").alias("candidate_id"), F.col("_a.score").alias("score"))
    return rk.sanitise_ranking(candidates, said)


@query(
    "critic_index_ranking",
    """SELECT query_id, candidate_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN said IS NULL THEN 1 ELSE 0 END, said, p) AS INTEGER) AS rank, bool_or(said IS NOT NULL) OVER (PARTITION BY query_id) AS applied FROM (
  SELECT c.*, a.said FROM (SELECT conv_id AS query_id, role || turn AS candidate_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role || turn) AS p FROM conversations) c
  LEFT JOIN (SELECT conv_id AS query_id, length(text) % 9 - 1 AS i, min(turn) AS said FROM conversations WHERE conv_id % 5 <> 4 GROUP BY ALL) a ON a.query_id = c.query_id AND a.i = c.p - 1)""",
)
def critic_index_ranking(spark, d):
    """Each conversation as a candidate list and a critic's answer by index, in five forms (one is no JSON)."""
    c = table(spark, d, "conversations")
    candidates = c.select(F.col("conv_id").alias("query_id"), F.concat("role", "turn").alias("candidate_id"), F.col("turn").alias("position"))
    lists = c.groupBy(F.col("conv_id").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", (F.char_length("text") % 9 - 1).alias("i")))), lambda x: x["i"]).alias("v")
    )

    def objects(name):
        return F.to_json(F.transform("v", lambda x: F.struct(x.alias(name))))

    form = F.pmod("query_id", F.lit(5))
    raw = (
        F.when(form == 0, F.concat(F.lit('{"ranked_indices":'), F.to_json("v"), F.lit("}")))
        .when(form == 1, F.concat(F.lit('{"ranking":'), objects("index"), F.lit("}")))
        .when(form == 2, F.concat(F.lit('{"ranked_indices":[],"indices":'), F.to_json("v"), F.lit("}")))
        .when(form == 3, F.concat(F.lit('{"candidates":'), objects("id"), F.lit("}")))
        .otherwise("the second one fits best")
    )
    return rk.index_ranking(candidates, lists.select("query_id", raw.alias("raw")))


@query(
    "natural_sort",
    """SELECT source, string_agg(CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(length(regexp_replace(p, '^0+(.)', '\1'))::VARCHAR, 10, '0') || ':' || regexp_replace(p, '^0+(.)', '\1') ELSE p END, '' ORDER BY i) AS sort_key FROM (
  SELECT source, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT DISTINCT source, regexp_extract_all(lower(source), '([0-9]+|[^0-9]+)') AS ps FROM documents)) GROUP BY source""",
)
def natural_sort(spark, d):
    docs = table(spark, d, "documents").select("source").distinct()
    return docs.select("source", rk.natural_key(F.col("source")).alias("sort_key"))


@query(
    "resource_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS resource, count(*) AS n_rows FROM {t}" for t in ["embeddings", "documents", "events", "conversations", "benchmark", "labels", "pages", "lineitem", "orders"]),
)
def resource_counts(spark, d):
    names = ["embeddings", "documents", "events", "conversations", "benchmark", "labels", "pages", "lineitem", "orders"]
    return rk.count_by({n: table(spark, d, n) for n in names})
