"""Source, contract and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelweave.catalog import standins as st
from reelweave.catalog.lexical_q import captions, frame_map, source_videos
from reelweave.catalog.ranking import fused_ranked
from reelweave.catalog.registry import cte, query
from reelweave.catalog.timeline_q import videos
from reelweave.operators import moments as mo
from reelweave.session import table
from reelweave.sources import tables as src


@query("frame_catalog_scan", "SELECT 'L' || label || '_V001' AS video_id, vec_id AS frame_id FROM embeddings")
def frame_catalog_scan(spark, d):
    """Frame keys of all embeddings parsed into video and frame."""
    e = table(spark, d, "embeddings").select(F.concat(F.lit("L"), "label", F.lit("_V001_"), "vec_id").alias("key"))
    return src.frame_catalog(e)


@query("video_fps_lookup", "SELECT f.video_id, f.frame_id, coalesce(fps, 25.0) AS fps FROM frames f JOIN videos USING (video_id)", ("frames", "videos"))
def video_fps_lookup(spark, d):
    return mo.with_fps(st.frames(spark, d).select("video_id", "frame_id"), videos(spark, d))


@query("fps_overrides", "SELECT video_id, fps FROM videos WHERE coalesce(fps, 25.0) <> 25.0", ("videos",))
def fps_overrides(spark, d):
    return src.fps_overrides(videos(spark, d))


@query(
    "ocr_corpus_scan",
    "SELECT source || '_' || doc_id AS doc_id, source AS video_id, doc_id AS frame_id, length(text) AS n_chars, md5(text) AS digest FROM documents WHERE lang <> 'es'",
)
def ocr_corpus_scan(spark, d):
    """JSON maps of record by document; Spanish ones carry an unusable frame number."""
    docs = table(spark, d, "documents")
    frame = F.when(F.col("lang") == "es", "x").otherwise(F.col("doc_id").cast("string"))
    json = F.to_json(F.create_map(F.concat_ws("_", "source", "doc_id"), F.struct(frame.alias("frame_id"), F.col("text").alias("text"))))
    out = src.ocr_records(docs.select(json.alias("json")))
    return out.select("doc_id", "video_id", "frame_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "frame_map_contract",
    """SELECT video_id, frame_id, 'flag_mismatch' AS rule FROM (SELECT source AS video_id, doc_id AS frame_id FROM documents WHERE lang = 'de')
UNION ALL SELECT source, doc_id, 'duplicate' FROM documents WHERE lang = 'es'
UNION ALL SELECT source, doc_id, 'distance' FROM documents WHERE lang = 'fr'""",
)
def frame_map_contract(spark, d):
    """A frame map over all documents with faults planted by language."""
    docs = table(spark, d, "documents")
    rows = docs.select(
        F.col("source").alias("video_id"),
        F.col("doc_id").alias("frame_id"),
        F.col("doc_id").alias("ocr_frame_id"),
        F.when(F.col("lang") == "fr", -1.0).otherwise(0.0).alias("temporal_distance_seconds"),
        (F.col("lang") != "de").alias("is_representative"),
        F.when(F.col("lang") == "es", 2).otherwise(1).alias("times"),
    )
    twice = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "col")
    return src.frame_map_violations(twice)


@query("frame_map_inheritors", "SELECT video_id, frame_id, ocr_frame_id, temporal_distance_seconds FROM frame_map", ("frame_map",))
def frame_map_inheritors(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en'").select(
        F.col("source").alias("video_id"), F.col("doc_id").alias("frame_id"), F.col("doc_id").alias("ocr_frame_id"), F.lit(0.0).alias("temporal_distance_seconds"), F.lit(True).alias("is_representative")
    )
    return src.inheritors(docs.unionByName(frame_map(spark, d).withColumn("is_representative", F.lit(False))))


@query(
    "semantic_row_contract",
    "SELECT vec_id AS row_index, CASE label WHEN 0 THEN 'embedding_row' WHEN 1 THEN 'evidence_id' WHEN 2 THEN 'occurrence_key' WHEN 3 THEN 'confidence' END AS rule FROM embeddings WHERE label IN (0, 1, 2, 3)",
)
def semantic_row_contract(spark, d):
    """Semantic text rows with faults planted by label."""
    e = table(spark, d, "embeddings")
    occ = F.array(
        F.struct(
            F.lit("v").alias("video_id"),
            F.when(F.col("label") == 2, -1).otherwise(F.col("vec_id")).alias("frame_id"),
            F.when(F.col("label") == 3, 1.5).when(F.col("label") > 4, 0.5).alias("confidence"),
        )
    )
    rows = e.select(
        F.col("vec_id").alias("row_index"),
        (F.col("vec_id") + F.when(F.col("label") == 0, 1).otherwise(0)).alias("embedding_row"),
        F.when(F.col("label") == 1, " ").otherwise(F.concat(F.lit("e"), "vec_id")).alias("evidence_id"),
        F.lit("t").alias("text"),
        occ.alias("occurrences"),
    )
    return src.semantic_row_violations(rows)


def segments(spark, d):
    """Transcripts in two granularities, one view per conversation."""
    c = table(spark, d, "conversations")
    start = F.col("turn") * 20.0
    coarse = c.select("conv_id", start.alias("start_seconds"), (start + 20).alias("end_seconds"), "text", F.lit("coarse").alias("granularity"))
    halves = c.select("conv_id", start.alias("s"), "text", F.explode(F.array(F.lit(0.0), F.lit(10.0))).alias("h"))
    fine = halves.select("conv_id", (F.col("s") + F.col("h")).alias("start_seconds"), (F.col("s") + F.col("h") + 10.0).alias("end_seconds"), "text", F.lit("fine").alias("granularity"))
    return coarse.unionByName(fine).withColumnRenamed("conv_id", "video_id").withColumn("view", F.col("video_id"))


@query(
    "transcript_granularity",
    """SELECT conv_id AS video_id, 20.0::DOUBLE * turn + h AS start_seconds, 20.0::DOUBLE * turn + h + 10 AS end_seconds, 'fine' AS granularity FROM conversations, (VALUES (0), (10)) t(h) WHERE conv_id % 2 = 0
UNION ALL SELECT conv_id, 20.0::DOUBLE * turn, 20.0::DOUBLE * turn + 20, 'coarse' FROM conversations WHERE conv_id % 2 = 1""",
)
def transcript_granularity(spark, d):
    """The index of an odd conversation misses the last half of each turn."""
    rows = segments(spark, d)
    vectors = rows.filter((F.pmod("video_id", F.lit(2)) == 0) | (F.pmod("start_seconds", F.lit(20)) == 0)).select("view", "granularity")
    return src.preferred_segments(rows, vectors).drop("text", "view")


@query(
    "transcript_envelopes",
    """SELECT conv_id AS video_id, 20.0::DOUBLE * turn AS start_seconds, CASE WHEN role = 'system' THEN 20.0::DOUBLE * turn ELSE 20.0::DOUBLE * turn + 20 END AS end_seconds, md5(trim(text)) AS digest FROM conversations WHERE trim(text) <> ''""",
)
def transcript_envelopes(spark, d):
    """Every message as transcript JSON in one of three envelopes with its own field names."""
    c = table(spark, d, "conversations")
    start = F.col("turn") * 20.0
    bare = F.to_json(F.array(F.struct(start.alias("start"), (start + 20).alias("end"), F.col("text").alias("text"))))
    boxed = F.to_json(F.struct(F.array(F.struct(start.alias("start_seconds"), (start + 20).alias("stop"), F.col("text").alias("transcript"))).alias("segments")))
    late = F.to_json(F.struct(F.array(F.struct(start.cast("string").alias("begin"), (start - 5).alias("endTime"), F.col("text").alias("content"))).alias("asr")))
    payload = F.when(F.col("role") == "user", bare).when(F.col("role") == "assistant", boxed).otherwise(late)
    out = src.transcript_segments(c.select(F.col("conv_id").alias("video_id"), payload.alias("payload")))
    return out.select("video_id", "start_seconds", "end_seconds", F.md5("text").alias("digest"))


@query(
    "caption_record_scan",
    "SELECT 'r' || doc_id AS record_id, source AS video_id, length(text) >= 300 AS parsed, CASE WHEN length(text) >= 300 THEN string_split(text, chr(10))[1] END AS head FROM documents",
)
def caption_record_scan(spark, d):
    """Caption JSON lines written and read back; unparsed records stay null."""
    back = src.caption_records(captions(spark, d).select(F.to_json(F.struct("*")).alias("json")))
    return back.select("record_id", "video_id", F.col("record").isNotNull().alias("parsed"), F.col("record.visual_description").alias("head"))


@query(
    "caption_field_counts",
    """SELECT 'actions' AS field, (SELECT count(*) FROM embeddings) AS n_rows, (SELECT count(*) FROM embeddings WHERE label <> 0) AS n_vectors""",
)
def caption_field_counts(spark, d):
    """Fields whose rows and vectors differ in number: one field lost a label's vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.explode(F.array(F.lit("visual_description"), F.lit("actions"), F.lit("entities"))).alias("field"))
    return src.field_table_violations(e, e.filter("field <> 'actions' or label <> 0"))


@query(
    "event_segmentation_scan",
    "SELECT video_id, frame_id, event_id FROM keyframes",
    ("keyframes",),
)
def event_segmentation_scan(spark, d):
    """Event map JSON per keyframe, parsed back into rows."""
    k = st.keyframes(spark, d)
    json = F.to_json(F.struct(F.create_map("video_id", F.create_map(F.col("frame_id").cast("string"), F.col("event_id"))).alias("segments")))
    return src.event_segmentation(k.select(json.alias("json")))


@query(
    "scene_triple_scan",
    "SELECT 'c' || conv_id AS video_id, turn AS frame_id, CAST(i AS INTEGER) AS fn, role AS s, 'says' AS v, CASE i WHEN 0 THEN 'text' ELSE 'turn' || turn END AS o FROM conversations, (VALUES (0), (1)) t(i)",
)
def scene_triple_scan(spark, d):
    c = table(spark, d, "conversations")
    triples = F.array(F.array("role", F.lit("says"), F.lit("text")), F.array(F.col("role"), F.lit("says"), F.concat(F.lit("turn"), "turn")))
    json = F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("video_id"), F.col("turn").alias("frame_id"), triples.alias("triplets")))
    return src.scene_triples(c.select(json.alias("json")))


@query(
    "shard_merge",
    "SELECT source, CAST(bucket AS BIGINT) AS bucket, lang, doc_id FROM (SELECT source, doc_id // 100 AS bucket, lang, max(doc_id) AS doc_id, row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY lang DESC) AS n FROM documents GROUP BY source, doc_id // 100, lang) WHERE n = 1",
)
def shard_merge(spark, d):
    """Rows of the same key from several shards (one per language): the last shard wins."""
    docs = table(spark, d, "documents").groupBy("source", F.floor(F.col("doc_id") / 100).alias("bucket"), "lang").agg(F.max("doc_id").alias("doc_id"))
    return src.merge_shards(docs, ["source", "bucket"], "lang")


@query(
    "lane_provenance",
    "SELECT lane, CASE lane WHEN 'audio' THEN 'dimension' WHEN 'ocr' THEN 'row_count' WHEN 'visual_jina_v5' THEN 'missing' ELSE 'norm' END AS rule FROM (VALUES ('audio'), ('ocr'), ('visual_jina_v5'), ('visual_pe_core')) t(lane)",
)
def lane_provenance(spark, d):
    """Vector lanes against their expected dimension, size and normalisation."""
    v = st.lane_vectors(spark, d)
    n = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    expected = spark.createDataFrame(
        [("audio", 32, 0, False), ("ocr", 16, 1, False), ("visual_pe_core", 32, 0, True), ("visual_siglip2", 64, 0, True), ("visual_jina_v5", 8, 0, False)],
        "lane STRING, dim INT, extra BIGINT, normalised BOOLEAN",
    )
    expected = expected.select("lane", "dim", (n.scalar() + F.col("extra")).alias("n_rows"), "normalised")
    return src.lane_violations(v, expected)


_FILE = "'Query-' || conv_id || CASE role WHEN 'user' THEN '-kis' WHEN 'assistant' THEN '-QA' ELSE '-note' END || '.txt'"


@query(
    "query_catalog_scan",
    f"""SELECT filename, label, task, n_chars, answer_count, string_agg(CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(length(regexp_replace(p, '^0+(.)', '\\1'))::VARCHAR, 10, '0') || ':' || regexp_replace(p, '^0+(.)', '\\1') ELSE p END, '' ORDER BY i) AS sort_key FROM (
  SELECT *, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT f.*, coalesce(n, 0) AS answer_count, regexp_extract_all(lower(filename), '([0-9]+|[^0-9]+)') AS ps FROM (
    SELECT {_FILE} AS filename, conv_id::VARCHAR AS label, CASE role WHEN 'user' THEN 'kis' ELSE 'qa' END AS task, sum(length(trim(text))) ::BIGINT AS n_chars FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL) f
  LEFT JOIN (SELECT 'Query-' || doc_id || '-kis.txt' AS filename, count(*) AS n FROM documents GROUP BY ALL) a USING (filename))) GROUP BY ALL""",
)
def query_catalog_scan(spark, d):
    """Turns of a speaker as query files, documents of the same number as their saved answers."""
    c = table(spark, d, "conversations")
    name = F.concat(F.lit("Query-"), "conv_id", F.when(F.col("role") == "user", "-kis").when(F.col("role") == "assistant", "-QA").otherwise("-note"), F.lit(".txt"))
    answers = table(spark, d, "documents").select(F.concat(F.lit("Query-"), "doc_id", F.lit("-kis.txt")).alias("filename"))
    rows = src.catalog_rows(c.select(name.alias("filename"), F.col("text").alias("content")), answers)
    by = ["filename", "label", "task", "answer_count", "sort_key"]
    return rows.groupBy(*by).agg(F.sum(F.char_length("content")).alias("n_chars"))


# lane, dimension, rows beyond those of the table, encoder, model, metric, normalised
LANE_METADATA = [
    ("audio", 32, 0, "sound", "a1", "inner_product", True),
    ("ocr", 16, 1, None, "o1", "inner_product", True),
    ("visual_pe_core", 32, 0, "image", "p1", "l2", True),
    ("visual_siglip2", 64, 0, "image", "s1", "inner_product", False),
    ("visual_beit3", None, 0, "image", "b1", "inner_product", None),
    ("visual_jina_v5", 8, 0, "image", "j1", None, True),
]
LANE_EXPECTED = [("audio", "sound", "a2"), ("ocr", "text", None), ("visual_pe_core", "image", "p1"), ("visual_beit3", None, "b1")]


def _values(rows) -> str:
    def cell(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()

    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


@query(
    "lane_metadata_contract",
    f"""SELECT lane, unnest(list_filter([CASE WHEN n IS NULL THEN 'missing' END, CASE WHEN dim <> d THEN 'dimension' END, CASE WHEN n + extra <> n THEN 'row_count' END, CASE WHEN model <> x.m THEN 'model' END,
  CASE WHEN x.e IS NOT NULL AND encoder IS DISTINCT FROM x.e THEN 'encoder' END, CASE WHEN metric <> 'inner_product' OR NOT coalesce(normalised, true) THEN 'metric' END], lambda r: r IS NOT NULL)) AS rule
FROM (VALUES {_values(LANE_METADATA)}) t(lane, dim, extra, encoder, model, metric, normalised) LEFT JOIN (SELECT lane, len(v) AS d, count(*) AS n FROM lane_vectors GROUP BY ALL) s USING (lane)
LEFT JOIN (VALUES {_values(LANE_EXPECTED)}) x(lane, e, m) USING (lane)""",
    ("lane_vectors",),
)
def lane_metadata_contract(spark, d):
    """Descriptions of vector lanes against their rows and the encoders of the queries."""
    n = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    described = spark.createDataFrame(LANE_METADATA, "lane STRING, dim INT, extra BIGINT, encoder STRING, model STRING, metric STRING, normalised BOOLEAN")
    expected = spark.createDataFrame(LANE_EXPECTED, "lane STRING, encoder STRING, model STRING")
    metadata = described.withColumn("n_rows", n.scalar() + F.col("extra")).drop("extra")
    return src.lane_metadata_violations(st.lane_vectors(spark, d), metadata, expected)


@query(
    "kis_submission_lines",
    "SELECT query_id, rank AS line_no, video_id || ',' || frame_id AS line FROM fused_ranked WHERE rank <= 100",
    ("fused_ranked",),
)
def kis_submission_lines(spark, d):
    return src.submission_lines(fused_ranked(spark, d), "kis")


@query(
    "qa_submission_lines",
    """SELECT query_id, rank AS line_no, video_id || ',' || frame_id || ',"frame ""' || frame_id || '"", maybe"' AS line FROM fused_ranked WHERE rank <= 100""",
    ("fused_ranked",),
)
def qa_submission_lines(spark, d):
    rows = fused_ranked(spark, d).withColumn("answer", F.concat(F.lit('frame "'), "frame_id", F.lit('", maybe')))
    return src.submission_lines(rows, "qa")


@query(
    "sequence_submission_lines",
    "SELECT query_id, rank AS line_no, video_id || ',' || frame_id || ',' || (frame_id + 5) AS line FROM fused_ranked WHERE rank <= 100",
    ("fused_ranked",),
)
def sequence_submission_lines(spark, d):
    rows = fused_ranked(spark, d).withColumn("frame_ids", F.array(F.col("frame_id"), F.col("frame_id") + 5))
    return src.submission_lines(rows, "trake")


@query(
    "submission_contract",
    """SELECT event_id AS query_id, CASE event_type WHEN 'click' THEN 'columns' WHEN 'purchase' THEN 'answer_length' WHEN 'error' THEN 'frame_negative' WHEN 'signup' THEN 'frame_count' END AS rule FROM events""",
)
def submission_contract(spark, d):
    """Answer lines with one fault per event type."""
    t = st.timeline(spark, d)
    kind = F.col("event_type")
    line = (
        F.when(kind == "click", F.col("video_id"))
        .when(kind == "purchase", F.concat_ws(",", "video_id", "frame_id", F.repeat(F.lit("a"), F.lit(101))))
        .when(kind == "error", F.concat("video_id", F.lit(",-1")))
        .when(kind == "signup", F.concat_ws(",", "video_id", "frame_id", "frame_id"))
        .otherwise(F.concat_ws(",", "video_id", "frame_id"))
    )
    task = F.when(kind == "purchase", "qa").when(kind == "signup", "trake").otherwise("kis")
    lines = t.select(F.col("event_id").alias("query_id"), task.alias("task"), line.alias("line"))
    script = F.concat(F.lit("E1: a\n  e2: b\nE3 : "), "event_type")
    wanted = t.select(F.col("event_id").alias("query_id"), src.event_line_count(script).alias("n_frames"))
    return src.check_submissions(lines, wanted).select("query_id", "rule")


@query(
    "capped_append",
    """SELECT query_id, arrival, CAST(line_no AS INTEGER) AS line_no FROM (SELECT user_id AS query_id, event_id AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id) AS line_no FROM events) WHERE line_no <= 30""",
)
def capped_append(spark, d):
    """Saved answers (views) followed by new ones, thirty per query at most."""
    rows = st.timeline(spark, d).select(F.col("user_id").alias("query_id"), F.col("event_id").alias("arrival"), "event_type")
    old = rows.filter("event_type = 'view'").drop("event_type")
    return src.append_capped(old, rows.filter("event_type <> 'view'").drop("event_type"), 30)


@query(
    "keyframe_grid",
    """SELECT DISTINCT video_id, frame_id FROM timeline WHERE event_type = 'view' AND value > 20
UNION ALL SELECT DISTINCT video_id, frame_id FROM keyframes WHERE video_id NOT IN (SELECT video_id FROM timeline WHERE event_type = 'view' AND value > 20)""",
    ("timeline", "keyframes"),
)
def keyframe_grid(spark, d):
    own = st.timeline(spark, d).filter("event_type = 'view' and value > 20")
    return src.keyframe_grid(own, st.keyframes(spark, d))


@query(
    "video_transcript_listing",
    "SELECT conv_id AS video_id, 20.0::DOUBLE * turn AS start_seconds, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') ORDER BY 1, 2",
)
def video_transcript_listing(spark, d):
    """Transcripts of the conversations with a system message, in time order."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), (F.col("turn") * 20.0).alias("start_seconds"), "role")
    return src.video_listing(c, c.filter("role = 'system'"), "start_seconds")


@query(
    "hit_contract",
    "SELECT event_id, CASE event_type WHEN 'error' THEN 'frame_id' WHEN 'signup' THEN 'fps' ELSE 'score' END AS rule FROM events WHERE event_type IN ('error', 'signup') OR value > 50",
)
def hit_contract(spark, d):
    t = st.timeline(spark, d)
    hits = t.select(
        "event_id",
        "video_id",
        F.when(F.col("event_type") == "error", -1).otherwise(F.col("frame_id")).alias("frame_id"),
        F.when(F.col("value") > 50, float("nan")).otherwise(F.col("value")).alias("score"),
        F.when(F.col("event_type") == "signup", 0.0).otherwise(25.0).alias("fps"),
    )
    v = src.hit_violations(hits)
    order = F.when(F.col("frame_id") < 0, "frame_id").when(F.col("fps") <= 0, "fps").otherwise("score")
    return v.select("event_id", order.alias("rule"))


@query(
    "result_enrichment",
    """SELECT r.query_id, r.video_id, r.frame_id, round(r.score, 4) AS score, round(r.frame_id / coalesce(v.fps, 25.0), 1) AS timestamp_seconds, r.rank FROM fused_ranked r LEFT JOIN videos v USING (video_id)""",
    ("fused_ranked", "videos"),
)
def result_enrichment(spark, d):
    """Results with rounded scores and time stamps."""
    out = mo.with_fps(fused_ranked(spark, d), videos(spark, d))
    return out.select(
        "query_id", "video_id", "frame_id", F.round("score", 4).alias("score"), F.round(F.col("frame_id") / F.col("fps"), 1).alias("timestamp_seconds"), "rank"
    )


cte("source_videos", "SELECT DISTINCT source AS video_id, CASE WHEN source LIKE '%1' THEN 30.0::DOUBLE END AS fps FROM documents")


@query("source_fps", "SELECT video_id, coalesce(fps, 25.0) AS fps FROM source_videos", ("source_videos",))
def source_fps(spark, d):
    return source_videos(spark, d).select("video_id", F.coalesce("fps", F.lit(25.0)).alias("fps"))
