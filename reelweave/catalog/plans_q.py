"""Composed task queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from reelweave.catalog import sequences_q as seq
from reelweave.catalog import standins as st
from reelweave.catalog.fusion import label_intents
from reelweave.catalog.lexical_q import document_index
from reelweave.catalog.ranking import RN
from reelweave.catalog.registry import cte, ctes, query
from reelweave.catalog.text_q import keyword_list, norm_search
from reelweave.catalog.timeline_q import core_hits, videos
from reelweave.catalog.vectors_q import _sims_sql as sims_sql
from reelweave.catalog.vectors_q import clause_queries
from reelweave.functions import text as tx
from reelweave.operators import lexical as lx
from reelweave.plans import search as ps
from reelweave.session import table


def kis(spark, d, **options):
    return ps.known_item_search(
        st.stored_signals(spark, d), st.lanes(spark), st.frame_events(spark, d), videos(spark, d), label_intents(spark, d), ps.SearchOptions(**options)
    )


cte(
    "mode_signals",
    """SELECT query_id, lane, video_id, frame_id, score, rank FROM aligned
UNION ALL SELECT query_id, lane, video_id, frame_id, score, rank FROM signals WHERE lane NOT LIKE 'visual%'""",
    "aligned",
    "signals",
)
_KIS_TAIL = """SELECT query_id, video_id, frame_id, round(score, 4) AS score, round(frame_id / coalesce(fps, 25.0), 1) AS timestamp_seconds, rank FROM (
  SELECT *, {rn} AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY o) AS n FROM ({base})) WHERE n <= 3) JOIN videos USING (video_id) WHERE rank <= 100"""


def _kis_sql(scored: str) -> str:
    base = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, frame_id) AS o FROM ({scored})"
    return _KIS_TAIL.format(rn=RN.format(o="o"), base=base)


def _derived(names: list[str], mode: str) -> None:
    """The twins' expressions again over those of a mode; the first of them exists already."""
    for name in names[1:]:
        needs, body = ctes()[name]
        for other in names:
            body = re.sub(rf"\b{other}\b", f"{other}_{mode}", body)
        # members of one event keep 75 frames apart here, not the 20 of the twin of the operator
        cte(f"{name}_{mode}", body.replace("< 20)", "< 75)"), *[f"{n}_{mode}" if n in names else n for n in needs])


def _search_twin(mode: str, where: str, weights: str, source: str = "mode_signals") -> None:
    """Late fusion of a mode: its rows, lane weights, bonuses, event votes and order."""
    cte(f"rows_{mode}", f"SELECT * FROM {source} WHERE {where}", source)
    cte(f"weights_{mode}", weights.format(rows=f"rows_{mode}"), f"rows_{mode}", "lane_config")
    cte(
        f"cut_{mode}",
        f"""SELECT s.*, w.weight, c.floor, c.ceiling, c.family, c.visual_family, c.calibrated FROM rows_{mode} s JOIN weights_{mode} w USING (query_id, lane)
LEFT JOIN lane_config c USING (lane) WHERE c.rank_cutoff IS NULL OR s.rank <= c.rank_cutoff""",
        f"rows_{mode}",
        f"weights_{mode}",
        "lane_config",
    )
    for name, source in (("confident", "cut_signals"), ("bonuses", "confident"), ("topic_bonuses", "cut_signals")):
        needs, body = ctes()[name]
        used = f"cut_{mode}" if source == "cut_signals" else f"{source}_{mode}"
        cte(f"{name}_{mode}", re.sub(rf"\b{source}\b", used, body), *[used if n == source else n for n in needs])
    cte(
        f"total_{mode}",
        f"""SELECT f.query_id, f.video_id, f.frame_id, round(f.rrf + confidence_bonus + visual_bonus + modality_bonus + specialist_bonus + coalesce(topic_bonus, 0), 9) AS score
FROM (SELECT query_id, video_id, frame_id, sum(weight / (30 + rank)) AS rrf FROM cut_{mode} GROUP BY ALL) f JOIN bonuses_{mode} b USING (query_id, video_id, frame_id)
LEFT JOIN topic_bonuses_{mode} t ON f.query_id = t.query_id AND split_part(f.video_id, '_', 1) = t.topic""",
        f"cut_{mode}",
        f"bonuses_{mode}",
        f"topic_bonuses_{mode}",
    )
    cte(
        f"votes_{mode}",
        f"""SELECT s.query_id, s.lane, s.video_id, s.frame_id, s.rank, e.event_id, w.weight / (30 + s.rank) AS vote
FROM (SELECT query_id, lane, video_id, frame_id, min(rank) AS rank FROM rows_{mode} GROUP BY ALL) s JOIN weights_{mode} w USING (query_id, lane) JOIN frame_events e USING (video_id, frame_id)""",
        f"rows_{mode}",
        f"weights_{mode}",
        "frame_events",
    )
    _derived(["votes", "ranked_events", "members", "member_order", "spaced_walk", "diverse"], mode)
    cte(
        f"listed_{mode}",
        f"""SELECT query_id, video_id, frame_id, 0 AS band, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN e.rank > 10 THEN 1 ELSE 0 END, member_rank, e.rank) AS o
FROM diverse_{mode} d JOIN ranked_events_{mode} e USING (query_id, video_id, event_id)
UNION ALL SELECT query_id, video_id, frame_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, frame_id) FROM total_{mode}""",
        f"diverse_{mode}",
        f"ranked_events_{mode}",
        f"total_{mode}",
    )
    cte(
        f"ordered_{mode}",
        f"""SELECT query_id, video_id, frame_id, coalesce(t.score, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY band, o) AS o FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame_id ORDER BY band, o) AS n FROM listed_{mode}) LEFT JOIN total_{mode} t USING (query_id, video_id, frame_id) WHERE n = 1""",
        f"listed_{mode}",
        f"total_{mode}",
    )


_OWN = "SELECT DISTINCT query_id, lane, coalesce(weight, 1.0) AS weight FROM {rows} LEFT JOIN lane_config USING (lane)"
_FAMILY = """SELECT query_id, lane, CASE WHEN lane LIKE 'visual%' THEN 0.35::DOUBLE / (SELECT count(*) FROM lane_config WHERE lane LIKE 'visual%')
  ELSE 0.65::DOUBLE / count(*) OVER (PARTITION BY query_id, lane LIKE 'visual%') END AS weight FROM (SELECT DISTINCT query_id, lane FROM {rows})"""
_search_twin("all", "true", _OWN)
_search_twin("visual", "lane LIKE 'visual%'", _OWN)
_search_twin("screen", "lane LIKE 'visual%' OR lane IN ('ocr', 'ocr_semantic')", _FAMILY)
_search_twin("speech", "lane LIKE 'visual%' OR lane = 'audio'", _FAMILY)


def _late(mode: str) -> str:
    return _KIS_TAIL.format(rn=RN.format(o="o"), base=f"SELECT * FROM ordered_{mode}")


@query("known_item_search", _late("all"), ("ordered_all", "videos"))
def known_item_search(spark, d):
    """All lanes, late fusion with bonuses; frames of ranked events first."""
    return kis(spark, d)


@query(
    "known_item_search_global",
    """SELECT query_id, video_id, frame_id, round(score, 4) AS score, round(frame_id / coalesce(fps, 25.0), 1) AS timestamp_seconds, CAST(o AS INTEGER) AS rank
FROM ordered_all JOIN videos USING (video_id) WHERE o <= 100""",
    ("ordered_all", "videos"),
)
def known_item_search_global(spark, d):
    """The global ranking as it is, without a bound per video."""
    return kis(spark, d, max_per_video=None)


@query(
    "known_item_search_early",
    _kis_sql(
        """SELECT query_id, video_id, frame_id, round(avg(v), 9) AS score FROM (
  SELECT m.*, CASE WHEN max(score) OVER l > min(score) OVER l THEN (score - min(score) OVER l) / (max(score) OVER l - min(score) OVER l) ELSE 0.0 END AS v
  FROM mode_signals m WINDOW l AS (PARTITION BY query_id, lane)) GROUP BY ALL"""
    ),
    ("mode_signals", "videos"),
)
def known_item_search_early(spark, d):
    """Unweighted mean of normalised lane scores; no events."""
    return kis(spark, d, fusion="early")


@query(
    "known_item_search_early_speech",
    _kis_sql(
        """SELECT query_id, video_id, frame_id, round(sum(weight * v) / sum(weight), 9) AS score FROM (
  SELECT m.*, CASE WHEN max(score) OVER l > min(score) OVER l THEN (score - min(score) OVER l) / (max(score) OVER l - min(score) OVER l) ELSE 0.0 END AS v
  FROM rows_speech m WINDOW l AS (PARTITION BY query_id, lane)) JOIN weights_speech USING (query_id, lane) GROUP BY ALL"""
    ),
    ("rows_speech", "weights_speech", "videos"),
)
def known_item_search_early_speech(spark, d):
    """Explicit modes weigh the mean by family."""
    return kis(spark, d, mode="visual_asr", fusion="early")


@query("known_item_search_screen_text", _late("screen"), ("ordered_screen", "videos"))
def known_item_search_screen_text(spark, d):
    """Visual and screen-text lanes with family weights."""
    return kis(spark, d, mode="visual_ocr")


@query("known_item_search_speech", _late("speech"), ("ordered_speech", "videos"))
def known_item_search_speech(spark, d):
    return kis(spark, d, mode="visual_asr")


@query("known_item_search_visual", _late("visual"), ("ordered_visual", "videos"))
def known_item_search_visual(spark, d):
    """Visual lanes with their configured weights."""
    return kis(spark, d, mode="only_visual")


# Video lock for odd queries; every fourth of them (1, 5, 9) tells its clauses in order.
LOCK = {"shortlist": 6, "local_videos": 4, "visual_quota": 2, "text_quota": 1, "event_limit": 32, "promote": 2, "frames_per_video": 8, "captions_per_video": 3, "protect": 5, "rescues": 4}
cte("rows_short", "SELECT * FROM signals WHERE query_id % 2 = 1", "signals")
cte(
    "votes_short",
    """SELECT s.query_id, s.lane, s.video_id, s.frame_id, s.rank, e.event_id, coalesce(weight, 1.0) / (30 + s.rank) AS vote
FROM rows_short s LEFT JOIN lane_config USING (lane) JOIN frame_events e USING (video_id, frame_id)""",
    "rows_short",
    "lane_config",
    "frame_events",
)
_derived(["votes", "ranked_events"], "short")
cte(
    "lock_seeds",
    """SELECT *, CASE WHEN n <= CASE WHEN lane LIKE 'visual%' THEN 2 WHEN lane IN ('ocr', 'audio', 'caption') THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS seed FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY best, video_id) AS n FROM (
    SELECT query_id, lane, video_id, min(rank) AS best FROM rows_short GROUP BY ALL)) LEFT JOIN lane_config USING (lane)""",
    "rows_short",
    "lane_config",
)
cte(
    "lock_list",
    f"""SELECT * FROM (SELECT query_id, video_id, {RN.format(o='band, o, video_id')} AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY band, o) AS n FROM (
    SELECT query_id, video_id, 0 AS band, row_number() OVER (PARTITION BY query_id ORDER BY best, video_id) AS o FROM (SELECT query_id, video_id, min(rank) AS best FROM rows_short WHERE lane = 'ocr' AND query_id % 3 = 0 GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best, video_id) <= 2
    UNION ALL SELECT query_id, video_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, CASE WHEN s = 1 THEN b END NULLS LAST, score DESC, video_id) FROM (
      SELECT query_id, video_id, max(seed) AS s, min(best) AS b, round(sum(coalesce(weight, 1.0) / (30 + best)), 9) AS score FROM lock_seeds GROUP BY ALL)
    UNION ALL SELECT query_id, video_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY best, video_id) FROM (SELECT query_id, video_id, min(rank) AS best FROM ranked_events_short WHERE rank <= 32 GROUP BY ALL))) WHERE n = 1) WHERE rank <= 6""",
    "rows_short",
    "lock_seeds",
    "ranked_events_short",
)
cte(
    "lock_hits",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lane, video_id ORDER BY score DESC, frame_id) AS rank FROM (
  SELECT query_id, lane, video_id, frame_id, score FROM scored WHERE lane LIKE 'visual%' OR lane = 'caption'
  UNION ALL SELECT query_id, 'visual_siglip2__clause' || clause, video_id, frame_id, round(list_cosine_similarity(embedding, qv), 6) FROM frames, clause_vectors)
  JOIN (SELECT query_id, video_id, rank AS place FROM lock_list) USING (query_id, video_id) WHERE place <= 4) WHERE rank <= CASE WHEN lane = 'caption' THEN 3 ELSE 8 END""",
    "scored",
    "frames",
    "clause_vectors",
    "lock_list",
)
cte(
    "local_votes_lock",
    """SELECT b.query_id, b.lane, b.video_id, b.frame_id, b.score, e.event_id, w * (0.25 + 0.75 * CASE WHEN hi - lo > 1e-12 THEN (score - lo) / (hi - lo)
   ELSE greatest(0.0, least(1.0, CASE WHEN mean > 0 THEN score / mean ELSE 1.0 END)) END) AS vote FROM (
  SELECT *, min(score) OVER l AS lo, max(score) OVER l AS hi, avg(score) OVER l AS mean FROM lock_hits WINDOW l AS (PARTITION BY query_id, lane)) b
JOIN (SELECT query_id, l.lane, coalesce(weight, 1.0) / CASE WHEN l.lane LIKE '%__clause%' THEN count(*) OVER (PARTITION BY query_id, base, l.lane LIKE '%__clause%') ELSE 1 END AS w FROM (
  SELECT DISTINCT query_id, lane, split_part(lane, '__clause', 1) AS base FROM lock_hits) l LEFT JOIN lane_config c ON c.lane = l.base) x USING (query_id, lane)
JOIN frame_events e USING (video_id, frame_id)""",
    "lock_hits",
    "lane_config",
    "frame_events",
)
_derived(["local_votes", "local_events", "lane_votes", "clause_events", "cover_temporal", "cover_free", "covered_temporal", "covered_free"], "lock")
cte("votes_inside", "SELECT * FROM local_votes_lock", "local_votes_lock")
_derived(["votes", "members", "member_order", "spaced_walk", "diverse"], "inside")
cte(
    "lock_covered",
    """SELECT query_id, video_id, sequence_score, events, row_number() OVER (PARTITION BY query_id ORDER BY sequence_score DESC, coverage DESC, video_id) AS seq FROM (
  SELECT * FROM covered_temporal_lock WHERE query_id % 4 = 1 UNION ALL SELECT * FROM covered_free_lock WHERE query_id % 4 <> 1)""",
    "covered_temporal_lock",
    "covered_free_lock",
)
cte(
    "lock_events",
    """SELECT query_id, video_id, event_id, row_number() OVER (PARTITION BY query_id ORDER BY band, a, b) AS o FROM (
  SELECT query_id, video_id, unnest(ev) AS event_id, 0 AS band, seq AS a, unnest(range(0, len(ev))) AS b FROM (
    SELECT query_id, video_id, seq, CASE WHEN events[1] = events[2] THEN events[1:1] ELSE events END AS ev FROM lock_covered)
  UNION ALL SELECT query_id, video_id, event_id, 1, rank, 0 FROM local_events_lock l WHERE NOT EXISTS (
    SELECT 1 FROM lock_covered c WHERE c.query_id = l.query_id AND c.video_id = l.video_id AND list_contains(c.events, l.event_id)))""",
    "lock_covered",
    "local_events_lock",
)
cte(
    "lock_rescues",
    """SELECT query_id, video_id, frame_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN e > 10 THEN 1 ELSE 0 END, m, e) AS o FROM (
  SELECT query_id, video_id, frame_id, row_number() OVER (PARTITION BY query_id, video_id, event_id ORDER BY member_rank) AS m, dense_rank() OVER (PARTITION BY query_id ORDER BY e.o) AS e
  FROM diverse_inside d JOIN lock_events e USING (query_id, video_id, event_id) JOIN total_all t USING (query_id, video_id, frame_id))""",
    "diverse_inside",
    "lock_events",
    "total_all",
)
cte(
    "ordered_lock",
    """SELECT query_id, video_id, frame_id, score, row_number() OVER (PARTITION BY query_id ORDER BY band, o) AS o FROM (
  SELECT b.query_id, b.video_id, b.frame_id, b.score, CASE WHEN b.o <= 5 THEN 0 WHEN r.n IS NOT NULL THEN 1 ELSE 2 END AS band, CASE WHEN b.o <= 5 OR r.n IS NULL THEN b.o ELSE r.n END AS o FROM ordered_all b LEFT JOIN (
    SELECT query_id, video_id, frame_id, row_number() OVER (PARTITION BY query_id ORDER BY o) AS n FROM lock_rescues r WHERE NOT EXISTS (
      SELECT 1 FROM ordered_all b WHERE b.o <= 5 AND b.query_id = r.query_id AND b.video_id = r.video_id AND b.frame_id = r.frame_id)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o) <= 4) r ON b.query_id = r.query_id AND b.video_id = r.video_id AND b.frame_id = r.frame_id)""",
    "ordered_all",
    "lock_rescues",
)


def video_lock(spark, d):
    """Odd queries are locked; 3 and 9 ask for screen text, 1, 5 and 9 tell clauses in order."""
    ids = st.query_vectors(spark, d, ["visual_siglip2"]).select("query_id").distinct()
    queries = ids.select(
        "query_id",
        F.when(F.pmod("query_id", F.lit(2)) == 1, "video_lock").otherwise("standard").alias("mode"),
        F.when(F.pmod("query_id", F.lit(3)) == 0, "the slide with a title").otherwise("a person walks").alias("normalized"),
        (F.pmod("query_id", F.lit(4)) == 1).alias("temporal"),
    )
    lanes = [*st.VISUAL_LANES, "caption"]
    whole = st.query_vectors(spark, d, lanes).select("query_id", F.lit(0).cast("bigint").alias("clause"), "lane", "qv")
    clauses = clause_queries(spark, d).select("query_id", F.col("clause").cast("bigint").alias("clause"), "lane", "qv")
    return ps.Lock(queries, st.lane_vectors(spark, d, lanes), whole.unionByName(clauses), **LOCK)


@query("known_item_search_locked", _KIS_TAIL.format(rn=RN.format(o="o"), base="SELECT * FROM ordered_lock"), ("ordered_lock", "videos"))
def known_item_search_locked(spark, d):
    """Locked and plain queries in one job: rescues from inside the shortlisted videos."""
    return ps.known_item_search(
        st.stored_signals(spark, d), st.lanes(spark), st.frame_events(spark, d), videos(spark, d), label_intents(spark, d), lock=video_lock(spark, d)
    )


# Speech and caption hits as ranges of 40 frames, put on frames found by the other lanes.
cte(
    "snapped_signals",
    """SELECT query_id, lane, video_id, frame_id, score, rank FROM mode_signals WHERE lane NOT IN ('audio', 'caption')
UNION ALL SELECT query_id, lane, video_id, frame_id, score, rank FROM (
  SELECT query_id, lane, video_id, coalesce((SELECT min(m.frame_id) FROM mode_signals m WHERE m.lane NOT IN ('audio', 'caption') AND m.query_id = s.query_id AND m.video_id = s.video_id
    AND m.frame_id >= s.frame_id AND m.frame_id < s.frame_id + 40), s.frame_id) AS frame_id, score, rank FROM signals s WHERE lane IN ('audio', 'caption'))
QUALIFY row_number() OVER (PARTITION BY query_id, lane, video_id, frame_id ORDER BY rank) = 1""",
    "mode_signals",
    "signals",
)
_search_twin("snapped", "true", _OWN, "snapped_signals")
cte("final_snapped", _late("snapped"), "ordered_snapped", "videos")
cte("final_sims", sims_sql("final_snapped"), "final_snapped", "lane_vectors", "query_vectors")


@query(
    "known_item_search_evidence",
    f"""SELECT query_id, video_id, frame_id, score, timestamp_seconds, {RN.format(o='rank > 20, raw DESC NULLS LAST, rank')} AS rank, visual_score, ocr_score, audio_score, caption_score FROM (
  SELECT f.*, CASE WHEN rank <= 20 THEN coalesce(raw, 0.0) END AS raw FROM final_snapped f LEFT JOIN (
    SELECT query_id, video_id, frame_id, round(sum(sim * CASE lane WHEN 'visual_pe_core' THEN 1.0 ELSE 0.5 END::DOUBLE), 6) AS raw FROM final_sims WHERE lane IN ('visual_pe_core', 'visual_beit3') GROUP BY ALL) USING (query_id, video_id, frame_id))
JOIN (SELECT query_id, video_id, frame_id, max(score) FILTER (lane LIKE 'visual%') AS visual_score, max(score) FILTER (lane LIKE 'ocr%') AS ocr_score, max(score) FILTER (lane = 'audio') AS audio_score,
  max(score) FILTER (lane = 'caption') AS caption_score FROM rows_snapped GROUP BY ALL) USING (query_id, video_id, frame_id)""",
    ("final_snapped", "final_sims", "rows_snapped"),
)
def known_item_search_evidence(spark, d):
    """Time ranges snapped to frames, head re-ordered by raw cosines, one score per modality."""
    lanes = ["visual_pe_core", "visual_beit3"]
    signals = st.stored_signals(spark, d).withColumn("end_frame_id", F.when(F.col("lane").isin("audio", "caption"), F.col("frame_id") + 40))
    rescore = ps.Rescore(st.lane_vectors(spark, d, lanes), st.query_vectors(spark, d, lanes), {"visual_pe_core": 1.0, "visual_beit3": 0.5}, 20)
    return ps.known_item_search(
        signals, st.lanes(spark), st.frame_events(spark, d), videos(spark, d), label_intents(spark, d), ps.SearchOptions(with_modalities=True), rescore=rescore
    )


cte(
    "question_frames",
    """SELECT query_id, video_id, frame_id, u FROM total_all JOIN (
  SELECT query_id, video_id, frame_id, round(sum(1.0 / (30 + rank)), 9) AS u FROM rows_all GROUP BY ALL) USING (query_id, video_id, frame_id)""",
    "total_all",
    "rows_all",
)
cte(
    "question_islands",
    """SELECT *, max(start_at) OVER (PARTITION BY query_id, video_id ORDER BY frame_id) AS island FROM (
  SELECT *, CASE WHEN frame_id - lag(frame_id, 1, -1000000) OVER (PARTITION BY query_id, video_id ORDER BY frame_id) > 75 THEN frame_id END AS start_at FROM question_frames)""",
    "question_frames",
)
cte(
    "question_clusters",
    """SELECT query_id, video_id, frame_id, round(u * (1 + 0.15::DOUBLE * greatest(0, n_lanes - 1)), 6) AS score FROM (
  SELECT query_id, video_id, island, sum(u) AS u, arg_max(frame_id, u * 1e6 - frame_id * 1e-6) AS frame_id FROM question_islands GROUP BY ALL)
JOIN (SELECT i.query_id, i.video_id, i.island, count(DISTINCT lane) AS n_lanes FROM question_islands i JOIN rows_all s USING (query_id, video_id, frame_id) GROUP BY ALL) USING (query_id, video_id, island)""",
    "question_islands",
    "rows_all",
)


@query(
    "question_evidence_search",
    f"SELECT *, 'qa' AS task FROM ({_kis_sql('SELECT * FROM question_clusters')})",
    ("question_clusters", "videos"),
)
def question_evidence_search(spark, d):
    """The same ranking for questions, clustered instead of grouped by event."""
    return ps.labelled(kis(spark, d, cluster_gap=75), "qa")


cte(
    "turn_context",
    """SELECT conv_id * 1000 + turn AS query_id, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' ') AS text
FROM conversations WHERE role = 'user'""",
)


@query(
    "conversational_search",
    f"""SELECT query_id, doc_id, matches, rank, 'conversation' AS task FROM (SELECT query_id, doc_id, matches, {RN.format(o='matches DESC, doc_id')} AS rank FROM (
  SELECT query_id, doc_id, count(*) AS matches FROM (SELECT DISTINCT query_id, unnest({keyword_list(norm_search('text'))}) AS token FROM turn_context)
  JOIN (SELECT doc_id, unnest(list_distinct(t)) AS token FROM doc_texts) USING (token) GROUP BY ALL)) WHERE rank <= 10""",
    ("turn_context", "doc_texts"),
)
def conversational_search(spark, d):
    """Every user turn with its context as a full-text query over the documents."""
    turns = tx.user_context(table(spark, d, "conversations"))
    queries = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("context").alias("text"))
    return ps.labelled(lx.keyword_overlap(document_index(spark, d), queries, 10), "conversation")


@query("event_sequence_search")
def event_sequence_search(spark, d):
    """Global candidates, in-video repairs and action priors, aligned and ranked."""
    out = ps.sequence_search(seq.candidates(spark, d), seq.sizes(spark, d), seq.N_EVENTS, 8, seq.repair(spark, d), seq.action_order_prior(spark, d))
    path = F.array_join(F.transform("frame_ids", lambda f: F.coalesce(f.cast("string"), F.lit("-"))), ",")
    return out.select("query_id", "video_id", path.alias("path"), "missing", "ranking_score", "rank")


# The tiers and moments of the operators' twins with the cuts of the plan.
for _name, _old, _new in (
    ("tier_videos_max", "video_rank <= 6", "video_rank <= 10"),
    ("tiers_max", "", ""),
    ("moment_agg", "<= 1.0 GROUP", "<= 2.0 GROUP"),
    ("moment_runs", "0.7 * peak", "0.5 * peak"),
    ("moments", "0.7 * peak", "0.5 * peak"),
):
    _needs, _body = ctes()[_name]
    _body = _body.replace(_old, _new) if _old else _body
    for _other in ("tier_videos_max", "tiers_max", "moment_agg", "moment_runs"):
        _body = re.sub(rf"\b{_other}\b", f"{_other}_plan", _body)
    cte(f"{_name}_plan", _body.replace("rank <= 15", "rank <= 20"), *[f"{n}_plan" if n in ("tier_videos_max", "tiers_max", "moment_agg", "moment_runs") else n for n in _needs])


@query("moment_search", "SELECT * FROM moments_plan", ("moments_plan",))
def moment_search(spark, d):
    return ps.moment_search(core_hits(spark, d), videos(spark, d), 20)


@query(
    "two_query_segments",
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, frame_id) AS rank FROM (
  SELECT a.lane, a.query_id, a.video_id, a.frame_id, round(sum(b.score), 6) AS score FROM signals a JOIN signals b ON a.lane = b.lane AND a.query_id = b.query_id AND a.video_id = b.video_id
  JOIN videos v ON v.video_id = a.video_id WHERE a.lane = 'visual_siglip2' AND abs(a.frame_id - b.frame_id) / coalesce(v.fps, 25.0) <= 5.0 GROUP BY ALL)),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, frame_id) AS rank FROM (
  SELECT a.lane, a.query_id, a.video_id, a.frame_id, round(sum(b.score), 6) AS score FROM signals a JOIN signals b ON a.lane = b.lane AND a.query_id = b.query_id AND a.video_id = b.video_id
  JOIN videos v ON v.video_id = a.video_id WHERE a.lane = 'visual_pe_core' AND abs(a.frame_id - b.frame_id) / coalesce(v.fps, 25.0) <= 5.0 GROUP BY ALL))
SELECT * FROM (SELECT query_id, video_id, start_frame, end_frame, start_score, end_score, duration, score, {RN.format(o='score DESC, video_id, start_frame, end_frame')} AS rank FROM (
  SELECT s.query_id, s.video_id, s.frame_id AS start_frame, e.frame_id AS end_frame, s.score AS start_score, e.score AS end_score, (e.frame_id - s.frame_id) / coalesce(fps, 25.0) AS duration, round(s.score + e.score, 6) AS score
  FROM s JOIN e USING (query_id, video_id) JOIN videos USING (video_id) WHERE s.rank <= 20 AND e.rank <= 20 AND e.frame_id > s.frame_id) WHERE duration BETWEEN 0 AND 120) WHERE rank <= 10""".replace("WITH s AS", "SELECT * FROM (WITH s AS", 1)
    + ")",
    ("signals", "videos"),
)
def two_query_segments(spark, d):
    s = st.stored_signals(spark, d, ["visual_siglip2", "visual_pe_core"])
    return ps.two_query_segments(s.filter("lane = 'visual_siglip2'").drop("lane"), s.filter("lane = 'visual_pe_core'").drop("lane"), videos(spark, d), 10)
