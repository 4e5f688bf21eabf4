"""Readers of retrieval artifacts and their contracts.

Contracts return the violating rows; an empty result means the artifact is valid.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelweave.functions.identifiers import parse_frame_key
from reelweave.operators.ranking import natural_key, ranked
from reelweave.operators.vectors import norm
from reelweave.schema import CAPTION_RECORD_TYPE, DEFAULT_FPS, DETECTION_TYPE, FRAME_MAP_SCHEMA

OCR_JSON = f"MAP<STRING,STRUCT<video_id:STRING,frame_id:STRING,text:STRING,detections:{DETECTION_TYPE}>>"
EVENT_JSON = "STRUCT<segments:MAP<STRING,MAP<STRING,STRING>>>"


def frame_catalog(keys: DataFrame, column: str = "key") -> DataFrame:
    """Frame keys ``video_frame`` as (video_id, frame_id); malformed keys are dropped."""
    parsed = keys.select(parse_frame_key(F.col(column)).alias("_k")).filter("_k is not null")
    return parsed.select("_k.video_id", "_k.frame_id")


def fps_overrides(videos: DataFrame) -> DataFrame:
    """Videos whose frame rate differs from the default."""
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(DEFAULT_FPS)
    return videos.select("video_id", rate.alias("fps")).filter(F.col("fps") != DEFAULT_FPS)


def ocr_records(documents: DataFrame, column: str = "json") -> DataFrame:
    """Screen-text records from JSON maps of document id to record.

    The video falls back to the id's prefix; records without a usable frame number
    are dropped.
    """
    pairs = documents.select(F.explode(F.from_json(F.col(column), OCR_JSON)).alias("doc_id", "_r"))
    video = F.coalesce("_r.video_id", F.when(F.contains("doc_id", F.lit("_")), F.regexp_extract("doc_id", r"^(.*)_[^_]*$", 1)).otherwise(F.col("doc_id")))
    return pairs.select(
        "doc_id",
        video.alias("video_id"),
        F.coalesce(F.col("_r.frame_id"), F.lit("0")).try_cast("bigint").alias("frame_id"),
        F.col("_r.text").alias("text"),
        F.col("_r.detections").alias("detections"),
    ).filter("frame_id is not null")


def read_ocr_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Screen-text JSON files, one map per file."""
    return ocr_records(spark.read.text(path, wholetext=True), "value")


def read_frame_map(spark: SparkSession, path: str) -> DataFrame:
    """Frame-map shards (JSON lines); unreadable lines keep their text in ``_corrupt_record``."""
    return spark.read.schema(FRAME_MAP_SCHEMA + ", _corrupt_record STRING").option("mode", "PERMISSIVE").json(path)


def frame_map_violations(frame_map: DataFrame) -> DataFrame:
    """Rows of a frame map that break a rule, with the rule's name."""
    rule = (
        F.when(F.coalesce(F.trim("video_id"), F.lit("")) == "", "video_id")
        .when(F.col("frame_id").isNull() | F.col("ocr_frame_id").isNull(), "frame_type")
        .when((F.col("frame_id") < 0) | (F.col("ocr_frame_id") < 0), "negative_frame")
        .when(F.col("temporal_distance_seconds").isNull() | F.isnan("temporal_distance_seconds") | (F.col("temporal_distance_seconds") < 0), "distance")
        .when(F.col("is_representative").isNull(), "flag_type")
        .when(F.col("is_representative") != (F.col("frame_id") == F.col("ocr_frame_id")), "flag_mismatch")
    )
    broken = frame_map.withColumn("rule", rule).filter("rule is not null").select("video_id", "frame_id", "rule")
    twice = frame_map.groupBy("video_id", "frame_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return broken.unionByName(twice.select("video_id", "frame_id", F.lit("duplicate").alias("rule")))


def inheritors(frame_map: DataFrame) -> DataFrame:
    """Frames that inherit text from a representative."""
    return frame_map.filter("not is_representative").drop("is_representative")


def semantic_row_violations(rows: DataFrame) -> DataFrame:
    """Semantic text rows that break a rule: ``rows(row_index, embedding_row, evidence_id,
    text, occurrences)``."""
    bad_occurrence = F.exists(
        "occurrences",
        lambda o: (F.coalesce(F.trim(o["video_id"]), F.lit("")) == "") | o["frame_id"].isNull() | (o["frame_id"] < 0),
    )
    bad_confidence = F.exists(
        "occurrences", lambda o: F.coalesce(F.isnan(o["confidence"]) | ~o["confidence"].between(0, 1), F.lit(False))
    )
    rule = (
        F.when(F.col("embedding_row").isNull() | (F.col("embedding_row") != F.col("row_index")), "embedding_row")
        .when(F.coalesce(F.trim("evidence_id"), F.lit("")) == "", "evidence_id")
        .when(F.col("text").isNull(), "text")
        .when(F.col("occurrences").isNull(), "occurrences")
        .when(bad_occurrence, "occurrence_key")
        .when(bad_confidence, "confidence")
    )
    return rows.withColumn("rule", rule).filter("rule is not null").select("row_index", "rule")


def preferred_segments(segments: DataFrame, vectors: DataFrame) -> DataFrame:
    """The fine transcript view where it has as many vectors as segments, else the coarse one.

    ``vectors`` has one row per indexed vector with its ``view`` and ``granularity``; a view
    is a corpus with an index of its own (``view`` of ``segments``). A fine view without
    segments, or with another number of vectors, is not used.
    """
    fine = F.col("granularity") == "fine"
    have = segments.filter(fine).groupBy("view").agg(F.count(F.lit(1)).alias("_n"))
    indexed = vectors.filter(fine).groupBy("view").agg(F.count(F.lit(1)).alias("_m"))
    good = have.join(indexed, "view").filter(F.col("_n") == F.col("_m")).select("view", F.lit("fine").alias("_use"))
    rows = segments.join(good, "view", "left")
    return rows.filter(F.col("granularity") == F.coalesce("_use", F.lit("coarse"))).drop("_use")


_SEGMENT = (
    "STRUCT<start:STRING,start_seconds:STRING,start_time:STRING,begin:STRING,startTime:STRING,"
    "end:STRING,end_seconds:STRING,end_time:STRING,stop:STRING,endTime:STRING,"
    "text:STRING,transcript:STRING,asr:STRING,caption:STRING,content:STRING>"
)


def transcript_segments(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Transcript JSON in any of its envelopes as (video_id, start, end, text) rows.

    A bare list or an object with ``segments``, ``data``, ``results`` or ``asr``; several
    names for start, end and text; blank texts dropped, end at least start.
    """
    item = f"ARRAY<{_SEGMENT}>"
    raw = F.col(column)
    listed = F.from_json(F.when(F.ltrim(raw).startswith("["), raw), item)
    boxed = F.from_json(
        F.when(F.ltrim(raw).startswith("{"), raw), f"STRUCT<segments:{item},data:{item},results:{item},asr:{item}>"
    )
    rows = payloads.select(
        "video_id", F.explode(F.coalesce(listed, boxed["segments"], boxed["data"], boxed["results"], boxed["asr"])).alias("_s")
    )

    def number(*names: str) -> Column:
        tries = [F.col(f"_s.{n}").try_cast("double") for n in names]
        return F.coalesce(*[F.when(t >= 0, t) for t in tries])

    texts = [F.when(F.trim(f"_s.{n}") != "", F.trim(f"_s.{n}")) for n in ("text", "transcript", "asr", "caption", "content")]
    start = number("start", "start_seconds", "start_time", "begin", "startTime")
    end = number("end", "end_seconds", "end_time", "stop", "endTime")
    out = rows.select("video_id", start.alias("start_seconds"), end.alias("_e"), F.coalesce(*texts).alias("text"))
    return out.filter("start_seconds is not null and text is not null").select(
        "video_id", "start_seconds", F.greatest("start_seconds", F.coalesce("_e", "start_seconds")).alias("end_seconds"), "text"
    )


def caption_records(rows: DataFrame, column: str = "json") -> DataFrame:
    """Caption JSON lines; a record that cannot be read stays as a null record."""
    schema = f"STRUCT<record_id:STRING,video_id:STRING,start_seconds:DOUBLE,end_seconds:DOUBLE,record:{CAPTION_RECORD_TYPE}>"
    return rows.select(F.from_json(F.col(column), schema).alias("_c")).select("_c.*")


def field_table_violations(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Caption fields whose number of rows and of vectors differ."""
    left = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n_rows"))
    right = vectors.groupBy("field").agg(F.count(F.lit(1)).alias("n_vectors"))
    both = left.join(right, "field", "full").select("field", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))
    return both.filter("n_rows <> n_vectors")


def event_segmentation(documents: DataFrame, column: str = "json") -> DataFrame:
    """Event map ``{segments: {video: {frame: event}}}`` as rows."""
    videos = documents.select(F.explode(F.from_json(F.col(column), EVENT_JSON)["segments"]).alias("video_id", "_m"))
    return videos.select("video_id", F.explode("_m").alias("_f", "event_id")).select(
        "video_id", F.col("_f").try_cast("bigint").alias("frame_id"), "event_id"
    ).filter("frame_id is not null")


def scene_triples(documents: DataFrame, column: str = "json") -> DataFrame:
    """Scene-graph JSON as one row per triple."""
    schema = "STRUCT<video_id:STRING,frame_id:BIGINT,triplets:ARRAY<ARRAY<STRING>>>"
    rows = documents.select(F.from_json(F.col(column), schema).alias("_g")).select("_g.video_id", "_g.frame_id", F.posexplode("_g.triplets").alias("fn", "_t"))
    return rows.select("video_id", "frame_id", "fn", *[F.get("_t", F.lit(i)).alias(r) for i, r in enumerate("svo")])


def feature_files(spark: SparkSession, path: str) -> DataFrame:
    """Per-frame ``<video>/<frame>.npy`` files as vectors; unreadable files are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    named = files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+\.npy$", 1).alias("video_id"),
        F.regexp_extract("path", r"(\d+)\.npy$", 1).try_cast("bigint").alias("frame_id"),
        "content",
    ).filter("frame_id is not null")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        def load(raw: bytes) -> list[float] | None:
            try:
                return np.load(io.BytesIO(raw), allow_pickle=False).astype("float32").ravel().tolist()
            except (ValueError, OSError, EOFError):
                return None

        for pdf in batches:
            vectors = pdf["content"].map(load)
            out = pdf[["video_id", "frame_id"]].assign(embedding=vectors)
            yield out[vectors.notna()]

    return named.mapInPandas(decode, "video_id STRING, frame_id BIGINT, embedding ARRAY<FLOAT>")


def merge_shards(rows: DataFrame, key: list[str], shard: str) -> DataFrame:
    """One row per key: the one of the last shard by name."""
    payload = F.struct(*[F.col(c) for c in rows.columns if c not in key])
    merged = rows.groupBy(*key).agg(F.max_by(payload, F.col(shard)).alias("_p"))
    return merged.select(*key, "_p.*")


def query_catalog(spark: SparkSession, query_path: str, answers: DataFrame | None = None) -> DataFrame:
    """Files ``query-<label>-<task>.txt`` with their text and number of saved answers."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return catalog_rows(spark.read.text(query_path, wholetext=True).select(name.alias("filename"), F.col("value").alias("content")), answers)


def catalog_rows(files: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Catalog of ``files(filename, content)`` named ``query-<label>-<task>.txt``; others are left out.

    ``answers(filename, ...)`` holds one row per saved answer line.
    """
    pattern = r"(?i)^query-(.+)-(kis|qa|trake)\.txt$"
    parsed = files.select(
        "filename", F.regexp_extract("filename", pattern, 1).alias("label"), F.lower(F.regexp_extract("filename", pattern, 2)).alias("task"), F.trim("content").alias("content")
    ).filter("label <> ''")
    if answers is None:
        counted = parsed.withColumn("answer_count", F.lit(0).cast("bigint"))
    else:
        counts = answers.groupBy("filename").agg(F.count(F.lit(1)).alias("answer_count"))
        counted = parsed.join(counts, "filename", "left").fillna({"answer_count": 0})
    return counted.withColumn("sort_key", natural_key(F.col("filename"))).orderBy("sort_key")


def lane_violations(vectors: DataFrame, expected: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Vector lanes that differ from their expected dimension, row count or unit norm.

    ``expected(lane, dim, n_rows, normalised)``; one aggregate per lane.
    """
    seen = vectors.groupBy("lane").agg(
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
        F.min(norm(F.col("embedding"))).alias("min_norm"),
        F.max(norm(F.col("embedding"))).alias("max_norm"),
        F.count(F.lit(1)).alias("seen_rows"),
    )
    joined = expected.join(seen, "lane", "left")
    rule = (
        F.when(F.col("seen_rows").isNull(), "missing")
        .when((F.col("min_dim") != F.col("dim")) | (F.col("max_dim") != F.col("dim")), "dimension")
        .when(F.col("seen_rows") != F.col("n_rows"), "row_count")
        .when(F.col("normalised") & ((F.col("min_norm") < 1 - tolerance) | (F.col("max_norm") > 1 + tolerance)), "norm")
    )
    return joined.withColumn("rule", rule).filter("rule is not null").select("lane", "rule")


def lane_metadata_violations(vectors: DataFrame, metadata: DataFrame, expected: DataFrame) -> DataFrame:
    """What the descriptions of vector lanes promise against their rows and what a search expects.

    ``metadata(lane, dim, n_rows, encoder, model, metric, normalised)`` describes how a lane was
    built, nulls where a description does not say; ``expected(lane, encoder, model)`` is what
    queries are encoded with, nulls where it does not matter. One row per problem: ``dimension``
    and ``row_count`` against the rows, ``model``, ``encoder``, and ``metric`` for lanes that are
    not normalised inner products; ``missing`` for a lane without rows.
    """
    seen = vectors.groupBy("lane").agg(
        F.min(F.size("embedding")).alias("_lo"), F.max(F.size("embedding")).alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    wanted = expected.select("lane", F.col("encoder").alias("_encoder"), F.col("model").alias("_model"))
    rows = metadata.join(seen, "lane", "left").join(wanted, "lane", "left")
    there = F.col("_n").isNotNull()
    rules = {
        "missing": ~there,
        "dimension": there & ((F.col("dim") != F.col("_lo")) | (F.col("dim") != F.col("_hi"))),
        "row_count": there & (F.col("n_rows") != F.col("_n")),
        "model": F.col("model") != F.col("_model"),
        "encoder": F.col("_encoder").isNotNull() & ~F.col("encoder").eqNullSafe(F.col("_encoder")),
        "metric": (F.col("metric") != "inner_product") | ~F.coalesce("normalised", F.lit(True)),
    }
    problems = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]))
    return rows.select("lane", F.explode(problems).alias("rule"))


def keyframe_grid(frames: DataFrame, event_frames: DataFrame) -> DataFrame:
    """Distinct keyframes per video; videos without any use their event frames."""
    own = frames.select("video_id", "frame_id").distinct()
    spare = event_frames.select("video_id", "frame_id").distinct().join(own.select("video_id").distinct(), "video_id", "left_anti")
    return own.unionByName(spare)


def video_listing(rows: DataFrame, wanted: DataFrame, order: str) -> DataFrame:
    """Rows of the wanted videos in time order."""
    return rows.join(wanted.select("video_id").distinct(), "video_id", "left_semi").orderBy("video_id", order)


def hit_violations(hits: DataFrame) -> DataFrame:
    """Hits that break the contract: video, frame, score or frame rate."""
    rule = (
        F.when(F.coalesce(F.trim("video_id"), F.lit("")) == "", "video_id")
        .when(F.col("frame_id").isNull() | (F.col("frame_id") < 0), "frame_id")
        .when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), "score")
        .when(F.col("fps").isNull() | (F.col("fps") <= 0), "fps")
    )
    return hits.withColumn("rule", rule).filter("rule is not null")


def require_valid(df: DataFrame, violations: DataFrame, message: str) -> DataFrame:
    """``df``, failing the job when there are violations."""
    count = violations.agg(F.count(F.lit(1))).scalar()
    return df.filter(F.when(count == 0, True).otherwise(F.raise_error(message).cast("boolean")))


MAX_ROWS = 100
VIDEO_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def quoted(cell: Column) -> Column:
    """CSV cell, quoted only where it has to be."""
    doubled = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.rlike('[",\r\n]'), doubled).otherwise(cell)


def submission_lines(rows: DataFrame, task: str) -> DataFrame:
    """Answer lines of a task, at most 100 per query in rank order.

    kis ``video,frame``; qa with an answer; trake with all frames of ``frame_ids``.
    """
    top = ranked(rows.withColumnRenamed("rank", "_r"), ["query_id"], [F.asc("_r")], MAX_ROWS, "line_no").drop("_r")
    if task == "kis":
        cells = [F.col("frame_id").cast("string")]
    elif task == "qa":
        cells = [F.col("frame_id").cast("string"), quoted(F.col("answer"))]
    elif task == "trake":
        cells = [F.array_join(F.transform("frame_ids", lambda f: f.cast("string")), ",")]
    else:
        raise ValueError(f"unknown task {task!r}")
    return top.select("query_id", "line_no", F.concat_ws(",", quoted(F.col("video_id")), *cells).alias("line"))


def write_submission(lines: DataFrame, path: str) -> None:
    """One folder per query, lines ended by CRLF."""
    lines.repartition("query_id").sortWithinPartitions("query_id", "line_no").select("query_id", "line").write.partitionBy(
        "query_id"
    ).option("lineSep", "\r\n").text(path)


def check_submissions(lines: DataFrame, expected_frames: DataFrame | None = None) -> DataFrame:
    """Rule broken by each answer line, null for valid ones.

    ``lines(query_id, task, line)``; ``expected_frames(query_id, n_frames)`` gives the number
    of events of sequence queries.
    """
    csv = F.from_csv("line", F.lit("a STRING, b STRING, rest STRING"), {"mode": "PERMISSIVE"})
    plain = F.split("line", ",")
    n = F.size(plain)
    frames = F.slice(plain, F.lit(2), F.greatest(n - 1, F.lit(0)))
    answer = F.when(csv["rest"].isNotNull(), csv["rest"])
    bad_frame = lambda f: ~F.coalesce(F.trim(f).rlike(r"^[+-]?\d+$"), F.lit(False))
    negative = lambda f: F.trim(f).startswith("-")
    rows = lines if expected_frames is None else lines.join(expected_frames, "query_id", "left")
    want = F.lit(None).cast("int") if expected_frames is None else F.col("n_frames")
    rule = (
        F.when(F.col("line").contains("\u0000"), "nul")
        .when(F.trim("line") == "", "empty")
        .when((F.col("task") == "kis") & (n != 2), "columns")
        .when((F.col("task") == "qa") & (F.coalesce(F.trim(answer), F.lit("")) == ""), "columns")
        .when((F.col("task") == "qa") & (F.length(answer) > 100), "answer_length")
        .when((F.col("task") == "trake") & (n < 2), "columns")
        .when(~F.trim(plain[0]).rlike(VIDEO_ID), "video_id")
        .when(F.col("task") == "qa", F.when(bad_frame(plain[1]), "frame_type").when(negative(plain[1]), "frame_negative"))
        .when(F.exists(frames, bad_frame), "frame_type")
        .when(F.exists(frames, negative), "frame_negative")
        .when((F.col("task") == "trake") & want.isNotNull() & (n - 1 != want), "frame_count")
    )
    return rows.withColumn("rule", rule).select(*lines.columns, "rule")


def event_line_count(text: Column) -> Column:
    """Number of ``E<n>:`` lines of a sequence query."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?im)^\s*(E\d+)\s*:"), F.lit(1)))


def append_capped(existing: DataFrame, new: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """Existing answers, then new ones in arrival order, up to the limit per query."""
    both = existing.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)))
    return ranked(both, ["query_id"], [F.asc("_part"), F.asc("arrival")], limit, "line_no").drop("_part")
