"""Queries of tasks composed over known-item search."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from reelweave.catalog import plans_q as pq
from reelweave.catalog import sequences_q as seq
from reelweave.catalog import standins as st
from reelweave.catalog.fusion import label_intents
from reelweave.catalog.lexical_q import document_index
from reelweave.catalog.ranking import RN, fused_ranked
from reelweave.catalog.registry import cte, ctes, query, twin
from reelweave.catalog.sampling_q import changes
from reelweave.catalog.text_q import keyword_list, marker, norm_search
from reelweave.catalog.timeline_q import videos
from reelweave.functions import text as tx
from reelweave.operators import lexical as lx
from reelweave.operators import retrieval as rt
from reelweave.operators import sampling as sp
from reelweave.operators import vectors as vx
from reelweave.plans import search as ps
from reelweave.plans import tasks
from reelweave.session import cut_lineage, table

N = seq.N_EVENTS

# --- conversations: the length of the context stands in for its encoder --------------------------
cte("talk", "SELECT query_id, text, length(text) % 10 AS label FROM turn_context", "turn_context")
cte(
    "talk_text",
    f"""SELECT query_id, 'ocr' AS lane, coalesce(source, 'unknown') AS video_id, doc_id AS frame_id, least(0.89::DOUBLE, matches / 12.7::DOUBLE) AS score, rank FROM (
  SELECT * FROM (SELECT query_id, doc_id, matches, {RN.format(o='matches DESC, doc_id')} AS rank FROM (
    SELECT query_id, doc_id, count(*) AS matches FROM (SELECT DISTINCT query_id, unnest({keyword_list(norm_search('text'))}) AS token FROM turn_context)
    JOIN (SELECT doc_id, unnest(list_distinct(t)) AS token FROM doc_texts) USING (token) GROUP BY ALL)) WHERE rank <= 10) JOIN documents USING (doc_id)""",
    "turn_context",
    "doc_texts",
)
cte(
    "talk_signals",
    """SELECT t.query_id, lane, video_id, frame_id, score, rank FROM talk t JOIN aligned a ON a.query_id = t.label
UNION ALL SELECT query_id, lane, video_id, frame_id, score, rank FROM talk_text""",
    "talk",
    "aligned",
    "talk_text",
)
cte(
    "intents_talk",
    f"SELECT query_id, CASE WHEN {marker('n', tx.OCR_MARKERS)} THEN 'ocr' WHEN {marker('n', tx.ASR_MARKERS)} THEN 'asr' ELSE 'default' END AS intent FROM (SELECT query_id, {norm_search('text')} AS n FROM turn_context)",
    "turn_context",
)
pq._search_twin("talk", "true", pq._OWN, "talk_signals")
_needs, _body = ctes()["bonuses_talk"]
cte("bonuses_talk", re.sub(r"\bintents\b", "intents_talk", _body), *["intents_talk" if n == "intents" else n for n in _needs])


@query(
    "conversational_known_item_search",
    f"SELECT *, 'conversation' AS task FROM ({pq._late('talk').replace('JOIN videos', 'LEFT JOIN videos')})",
    ("ordered_talk", "videos"),
)
def conversational_known_item_search(spark, d):
    """Every user turn with its context through known-item search: visual lanes and text of documents."""
    turns = tx.user_context(table(spark, d, "conversations"))
    talk = cut_lineage(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("context").alias("text")))
    docs = table(spark, d, "documents").select("doc_id", "source")
    label = talk.select("query_id", F.pmod(F.char_length("text"), F.lit(10)).cast("bigint").alias("label"))
    seen = st.stored_signals(spark, d, st.VISUAL_LANES).withColumnRenamed("query_id", "label").join(label, "label").drop("label")
    hits = lx.keyword_overlap(document_index(spark, d), talk, 10).join(docs, "doc_id")
    text = hits.select(
        "query_id", F.lit("ocr").alias("lane"), F.coalesce("source", F.lit("unknown")).alias("video_id"), F.col("doc_id").alias("frame_id"),
        F.least(F.lit(0.89), F.col("matches") / 12.7).alias("score"), "rank",
    )
    intents = talk.select("query_id", tx.query_intent(tx.normalize_for_search(F.col("text"))).alias("intent"))
    columns = ["query_id", "lane", "video_id", "frame_id", "score", "rank"]
    signals = cut_lineage(seen.select(columns).unionByName(text.select(columns)))
    return tasks.conversational_search(signals, st.lanes(spark), st.frame_events(spark, d), videos(spark, d), cut_lineage(intents))


# --- sequences of three events: every label is the search of one event --------------------------
cte(
    "event_cand",
    """SELECT query_id // 3 AS query_id, CAST(query_id % 3 AS INTEGER) AS event_index, video_id, frame_id, score, round(score / max(score) OVER (PARTITION BY query_id), 9) AS objective, frame_id / coalesce(fps, 25.0) AS ts
FROM (SELECT * FROM ordered_all WHERE o <= 100) JOIN videos USING (video_id)""",
    "ordered_all",
    "videos",
)
cte(
    "event_props",
    f"""SELECT * FROM (SELECT query_id, video_id, coverage, score, {RN.format(o='coverage DESC, score DESC, video_id')} AS rank FROM (
  SELECT query_id, video_id, count(*) AS coverage, round(sum(1.0 / (10 + r)) + 0.25::DOUBLE * count(*) / n_events, 9) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, event_index ORDER BY best DESC, video_id) AS r FROM (SELECT query_id, event_index, video_id, max(objective) AS best FROM event_cand GROUP BY ALL))
  JOIN seq_sizes USING (query_id) GROUP BY query_id, video_id, n_events)) WHERE rank <= 4""",
    "event_cand",
    "seq_sizes",
)


def _repaired(mode: str, cand: str, props: str, top: str) -> None:
    """In-video hits of proposed videos, aligned, fused and held below what is known globally."""
    cte(
        f"visual_signals_{mode}",
        f"""SELECT query_id, lane, video_id, frame_id, score, CAST(row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, video_id, frame_id) AS INTEGER) AS rank FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.query_id, lane, s.video_id ORDER BY s.score DESC, frame_id) AS n FROM scored s JOIN {props} p ON p.query_id = s.query_id // 3 AND p.video_id = s.video_id WHERE lane LIKE 'visual%') WHERE n <= 6""",
        "scored",
        props,
    )
    pq._derived(["visual_signals", "anchor_chain", "aligned"], mode)
    cte(
        f"repair_{mode}",
        f"""SELECT query_id, event_index, video_id, frame_id, round(top_score * objective, 9) AS score, objective, ts FROM (
  SELECT f.pair // 3 AS query_id, CAST(f.pair % 3 AS INTEGER) AS event_index, f.video_id, frame_id, top_score, frame_id / coalesce(fps, 25.0) AS ts, round(least(least(1.0, s / ceiling), coalesce(cap, 0.5)), 9) AS objective
  FROM (SELECT query_id AS pair, video_id, frame_id, sum(1.0::DOUBLE / (10 + rank)) AS s FROM aligned_{mode} GROUP BY ALL) f
  JOIN (SELECT query_id AS pair, count(DISTINCT lane) / 11.0::DOUBLE AS ceiling FROM aligned_{mode} GROUP BY ALL) USING (pair)
  JOIN ({top}) USING (pair) JOIN videos USING (video_id)
  LEFT JOIN (SELECT query_id * 3 + event_index AS pair, video_id, max(objective) AS cap FROM {cand} GROUP BY ALL) c ON c.pair = f.pair AND c.video_id = f.video_id)""",
        f"aligned_{mode}",
        cand,
        "videos",
        *re.findall(r"FROM \(?(?:SELECT \* FROM )?(\w+)", top),
    )
    cte(f"both_{mode}", f"SELECT query_id, event_index, video_id, frame_id, score, objective, ts FROM {cand} UNION ALL SELECT * FROM repair_{mode}", cand, f"repair_{mode}")


_repaired("event", "event_cand", "event_props", "SELECT query_id AS pair, max(score) AS top_score FROM (SELECT * FROM ordered_all WHERE o <= 100) GROUP BY ALL")
seq.dp_ctes("evs", "both_event", 1, 0.03, 45.0, 0.20, 2.0)

# the same for sequences over fused visual hits
cte(
    "seq_props",
    ctes()["event_props"][1].replace("event_cand", "seq_cand").replace("rank <= 4", "rank <= 6"),
    "seq_cand",
    "seq_sizes",
)
_repaired("seq", "seq_cand", "seq_props", "SELECT query_id AS pair, max(score) AS top_score FROM (SELECT * FROM visual_ranked WHERE rank <= 60) GROUP BY ALL")
seq.dp_ctes("rep", "both_seq", 1, 0.03, 45.0, 0.20, 2.0)
twin("sequence_repair_candidates", "SELECT * FROM repair_seq", ("repair_seq",))
twin(
    "repaired_sequence_ranking",
    f"""SELECT * FROM (SELECT query_id, video_id, array_to_string(frames, ',') AS path, missing, sequence_score, {RN.format(o='missing, sequence_score DESC, video_id')} AS rank FROM rep_best) WHERE rank <= 8""",
    ("rep_best",),
)
twin(
    "event_sequence_search",
    f"""SELECT * FROM (SELECT query_id, video_id, array_to_string(list_transform(range(0, n_events), lambda i: coalesce(CAST(frames[list_position(events, CAST(i AS INTEGER))] AS VARCHAR), '-')), ',') AS path,
  missing, ranking_score, {RN.format(o='missing, ranking_score DESC, video_id')} AS rank FROM (
  SELECT r.*, n_events, round(r.sequence_score + 0.2::DOUBLE * coalesce(round(list_sum(a.scores) / n_events, 9), 0.0), 9) AS ranking_score
  FROM rep_best r JOIN seq_sizes USING (query_id) LEFT JOIN act_best a ON a.query_id = r.query_id AND a.video_id = r.video_id)) WHERE rank <= 8""",
    ("rep_best", "seq_sizes", "act_best"),
)
cte(
    "event_sequences",
    f"""SELECT * FROM (SELECT e.*, n_events, {RN.format(o='missing, sequence_score DESC, video_id')} AS rank FROM evs_best e JOIN seq_sizes USING (query_id)) WHERE rank <= 8""",
    "evs_best",
    "seq_sizes",
)


@query(
    "event_sequence_search_per_event",
    f"""SELECT query_id, video_id, array_to_string(list_transform(range(0, n_events), lambda i: coalesce(CAST(frames[list_position(events, CAST(i AS INTEGER))] AS VARCHAR), '-')), ',') AS path,
  missing, sequence_score, CAST(band AS INTEGER) AS band, critic_score, rank FROM (
  SELECT * EXCLUDE (rank), {RN.format(o='band, critic_score DESC, old')} AS rank FROM (
    SELECT *, rank AS old, CASE WHEN frames[1] % 7 = 0 THEN 1 ELSE 0 END AS band, round(1.0::DOUBLE / (10 + row_number() OVER (PARTITION BY query_id ORDER BY video_id)) + 0.5::DOUBLE / (10 + row_number() OVER (PARTITION BY query_id ORDER BY frames[1] DESC, video_id)), 9) AS critic_score
    FROM event_sequences)) WHERE rank <= 6""",
    ("event_sequences",),
)
def event_sequence_search_per_event(spark, d):
    """Known-item search of all events at once, then proposals, repairs, alignment, ranking and two critics."""
    results, _ = ps.ranked_frames(st.stored_signals(spark, d), st.lanes(spark), st.frame_events(spark, d), label_intents(spark, d))
    labels = st.query_vectors(spark, d, ["visual_siglip2"]).select(F.col("query_id").alias("event_query")).distinct()
    events = cut_lineage(labels.select("event_query", F.floor(F.col("event_query") / N).alias("query_id"), F.pmod("event_query", F.lit(N)).cast("int").alias("event_index")))
    found = cut_lineage(
        tasks.sequence_search(
            results.filter("rank <= 100"), events, st.lane_vectors(spark, d, st.VISUAL_LANES), st.query_vectors(spark, d, st.VISUAL_LANES), videos(spark, d),
            max_events=N, proposals=4, per_video=6, max_missing=1, top_k=8,
        )
    )
    first = F.element_at(F.filter("frame_ids", lambda f: f.isNotNull()), 1)
    seen = found.withColumn("_f", first).withColumn("rejected", F.pmod("_f", F.lit(7)) == 0)
    columns = ["query_id", F.col("critic"), "video_id", "rank", "rejected"]
    one = rk_by(seen, [F.asc("video_id")], "order").select(columns)
    two = rk_by(seen, [F.desc("_f"), F.asc("video_id")], "late").select(columns)
    out = tasks.with_critics(found, tasks.Critics(one.unionByName(two), {"order": 1.0, "late": 0.5}), 6)
    path = F.array_join(F.transform("frame_ids", lambda f: F.coalesce(f.cast("string"), F.lit("-"))), ",")
    return out.select("query_id", "video_id", path.alias("path"), "missing", "sequence_score", "band", "critic_score", "rank")


def rk_by(rows, order, critic):
    from reelweave.operators import ranking as rk

    return rk.ranked(rows.drop("rank"), ["query_id"], order).withColumn("critic", F.lit(critic))


# --- anchored windows of 4 and 16 seconds: odd requests name their video ------------------------
WINDOWS = {4.0: "4", 16.0: "16"}
ACCEPT = 0.1
cte(
    "window_requests",
    """SELECT request_id, video_id, fps, CASE WHEN request_id % 2 = 0 THEN rf ELSE coalesce(sf, tf) END AS frame_id, CASE WHEN request_id % 2 = 0 THEN 'kis_anchor' WHEN sf IS NOT NULL THEN 'kis_manual_video' ELSE 'targeted_anchor' END AS source FROM (
  SELECT request_id, rf, tf, sf, CASE WHEN request_id % 2 = 0 THEN rv ELSE v END AS video_id FROM (
    SELECT r.*, (SELECT video_id FROM visual_ranked x WHERE x.query_id = 3 * request_id AND rank = 1) AS rv, (SELECT frame_id FROM visual_ranked x WHERE x.query_id = 3 * request_id AND rank = 1) AS rf,
      (SELECT arg_min(frame_id, rank) FROM visual_ranked x WHERE x.query_id = 3 * request_id AND x.video_id = r.v AND rank <= 100) AS sf,
      (SELECT first(frame_id ORDER BY score DESC, frame_id) FROM scored x WHERE x.query_id = 3 * request_id AND x.video_id = r.v AND lane = 'visual_siglip2') AS tf
    FROM (SELECT DISTINCT query_id // 3 AS request_id, 'L' || (query_id // 3 + 4) || '_V001' AS v FROM label_means) r))
JOIN (SELECT video_id, coalesce(fps, 25.0) AS fps FROM videos) USING (video_id)""",
    "visual_ranked",
    "scored",
    "label_means",
    "videos",
)
cte(
    "window_anchors",
    """SELECT r.request_id, r.video_id, r.fps, r.source, first(g.frame_id ORDER BY abs(g.frame_id - r.frame_id), g.frame_id) AS anchor, min(g.frame_id) AS lo, max(g.frame_id) AS hi
FROM window_requests r JOIN frames g ON g.video_id = r.video_id GROUP BY ALL""",
    "window_requests",
    "frames",
)
cte(
    "window_critic",
    "SELECT a.request_id, CAST(s.query_id - 3 * a.request_id AS INTEGER) AS event_index, s.frame_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, s.score)) AS confidence FROM window_anchors a JOIN scored s ON s.query_id // 3 = a.request_id AND s.video_id = a.video_id WHERE lane = 'visual_siglip2'",
    "window_anchors",
    "scored",
)
_open = "window_anchors"
for _w, _n in WINDOWS.items():
    cte(
        f"window_frames_{_n}",
        f"""SELECT request_id, anchor, frame_id, EXISTS (SELECT 1 FROM change_walk c WHERE c.picked AND c.video_id = x.video_id AND abs(c.frame_id - x.frame_id) <= greatest(2.0, round_even(fps * 0.15, 0))) AS near FROM (
  SELECT DISTINCT request_id, video_id, fps, anchor, frame_id FROM (
    SELECT t.*, g.frame_id, row_number() OVER (PARTITION BY request_id, k ORDER BY abs(g.frame_id - x), g.frame_id) AS n FROM (
      SELECT *, s + CASE WHEN k < 0 THEN anchor - s WHEN c > 1 THEN (e - s) / (c - 1) * k ELSE 0 END AS x FROM (
        SELECT *, unnest(range(-1, c)) AS k FROM (SELECT *, CAST(least(350, greatest(1, ceil((e - s) / fps * 5.0) + 1)) AS BIGINT) AS c FROM (
          SELECT *, greatest(lo, floor(anchor - {_w} * fps / 2)) AS s, least(hi, ceil(anchor + {_w} * fps / 2)) AS e FROM {_open})))) t
    JOIN frames g ON g.video_id = t.video_id AND g.frame_id BETWEEN s AND e) WHERE n = 1) x""",
        _open,
        "frames",
        "change_walk",
    )
    cte(
        f"window_options_{_n}",
        f"""SELECT request_id, event_index, frame_id, row_number() OVER (PARTITION BY request_id, event_index ORDER BY r, frame_id) - 1 AS r FROM (
  SELECT request_id, event_index, frame_id, anchor, row_number() OVER (PARTITION BY request_id, event_index ORDER BY confidence DESC, frame_id) - 1 AS r
  FROM window_frames_{_n} JOIN window_critic USING (request_id, frame_id) WHERE confidence >= {ACCEPT}) WHERE r < 5 AND frame_id >= anchor""",
        f"window_frames_{_n}",
        "window_critic",
    )
    cte(
        f"window_chain_{_n}",
        f"""SELECT request_id, {_w}::DOUBLE AS window_seconds, f1, f2, f3 FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(round(round(r1 * 100.0::DOUBLE + abs(f1 - anchor) * 0.01::DOUBLE, 6) + r2 * 100.0, 6) + r3 * 100.0, 6), f3 - f1, abs(f1 - anchor), f1, f2, f3) AS n FROM (
    SELECT a.request_id, a.anchor, coalesce(o.frame_id, a.anchor) AS f1, coalesce(o.r, 0) AS r1, b.frame_id AS f2, b.r AS r2, c.frame_id AS f3, c.r AS r3
    FROM {_open} a LEFT JOIN window_options_{_n} o ON o.request_id = a.request_id AND o.event_index = 0
    JOIN window_options_{_n} b ON b.request_id = a.request_id AND b.event_index = 1 AND b.frame_id > coalesce(o.frame_id, a.anchor)
    JOIN window_options_{_n} c ON c.request_id = a.request_id AND c.event_index = 2 AND c.frame_id > b.frame_id)) WHERE n = 1""",
        _open,
        f"window_options_{_n}",
    )
    cte(f"window_open_{_n}", f"SELECT * FROM {_open} WHERE request_id NOT IN (SELECT request_id FROM window_chain_{_n})", _open, f"window_chain_{_n}")
    cte(
        f"window_found_{_n}",
        f"""SELECT c.*, (SELECT count(*) FROM window_frames_{_n} f WHERE f.request_id = c.request_id) AS n_candidates, (SELECT count(*) FROM window_frames_{_n} f WHERE f.request_id = c.request_id AND near) AS n_near_change FROM window_chain_{_n} c""",
        f"window_chain_{_n}",
        f"window_frames_{_n}",
    )
    _open = f"window_open_{_n}"


@query(
    "anchored_window_search",
    """SELECT request_id, video_id, window_seconds, source, n_candidates, n_near_change, f1 || ',' || f2 || ',' || f3 AS path,
  round(0.7::DOUBLE * list_min(c) + 0.3::DOUBLE * (list_sum(c) / 3), 4) AS ranking_score FROM (
  SELECT w.*, a.video_id, a.source, [coalesce(x.confidence, 0.0), coalesce(y.confidence, 0.0), coalesce(z.confidence, 0.0)] AS c FROM (SELECT * FROM window_found_4 UNION ALL SELECT * FROM window_found_16) w
  JOIN window_anchors a USING (request_id) LEFT JOIN window_critic x ON x.request_id = w.request_id AND x.event_index = 0 AND x.frame_id = f1
  LEFT JOIN window_critic y ON y.request_id = w.request_id AND y.event_index = 1 AND y.frame_id = f2 LEFT JOIN window_critic z ON z.request_id = w.request_id AND z.event_index = 2 AND z.frame_id = f3)""",
    ("window_found_4", "window_found_16", "window_anchors", "window_critic"),
)
def anchored_window_search(spark, d):
    """Anchors, windows of 4 and then 16 seconds, judged frames, cheapest chain and its score."""
    hits = fused_ranked(spark, d, st.VISUAL_LANES).filter(F.pmod("query_id", F.lit(N)) == 0).withColumn("query_id", (F.col("query_id") / N).cast("bigint"))
    one = ["visual_siglip2"]
    label = cut_lineage(st.query_vectors(spark, d, one))
    ids = label.select(F.floor(F.col("query_id") / N).alias("query_id")).distinct()
    odd = F.pmod("query_id", F.lit(2)) == 1
    asked = cut_lineage(
        ids.select("query_id", F.when(odd, F.concat(F.lit("L"), F.col("query_id") + 4, F.lit("_V001"))).alias("video_id"), F.lit(None).cast("bigint").alias("frame_id"), F.lit(True).alias("has_text"))
    )
    firsts = label.filter(F.pmod("query_id", F.lit(N)) == 0).withColumn("query_id", (F.col("query_id") / N).cast("bigint"))
    local = vx.in_video_top_n(st.lane_vectors(spark, d, one), firsts, asked.filter("video_id is not null").select("query_id", "video_id"), 5)
    seeds = cut_lineage(rt.anchor_seeds(asked, cut_lineage(hits), local))
    rate = videos(spark, d).select("video_id", F.coalesce("fps", F.lit(25.0)).alias("fps"))
    requests = cut_lineage(seeds.withColumnRenamed("query_id", "request_id").join(rate, "video_id"))
    grid = cut_lineage(st.frames(spark, d).select("video_id", "frame_id"))
    near = cut_lineage(sp.window_frames(requests, grid, max(WINDOWS)))  # no other frame is ever judged
    windows = st.lane_vectors(spark, d, one).join(near.select("video_id", "frame_id").distinct(), ["video_id", "frame_id"], "left_semi")
    pairs = requests.select(F.explode(F.sequence(F.col("request_id") * N, F.col("request_id") * N + N - 1)).alias("query_id"), "video_id")
    judged = vx.in_video_top_n(windows, label, pairs, max(1, near.count()))
    critic = judged.select(
        F.floor(F.col("query_id") / N).alias("request_id"), F.pmod("query_id", F.lit(N)).cast("int").alias("event_index"), "frame_id",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("confidence"),
    )
    out = tasks.anchored_windows(requests, grid, changes(spark, d), critic, n_events=N, window_seconds=min(WINDOWS), max_seconds=max(WINDOWS), accept=ACCEPT)
    return out.select("request_id", "video_id", "window_seconds", "source", "n_candidates", "n_near_change", F.array_join("frame_ids", ",").alias("path"), "ranking_score")
