"""Schemas and the lane configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULT_FPS = 25.0

SIGNAL_COLUMNS = ["query_id", "lane", "video_id", "frame_id", "rank", "score"]

VIDEO_SCHEMA = "video_id STRING, fps DOUBLE, duration DOUBLE, watch_url STRING"
DETECTION_TYPE = "ARRAY<STRUCT<text:STRING,confidence:DOUBLE,searchable:BOOLEAN>>"
OCR_RECORD_SCHEMA = (
    f"doc_id STRING, video_id STRING, frame_id BIGINT, text STRING, detections {DETECTION_TYPE}"
)
FRAME_MAP_SCHEMA = (
    "video_id STRING, frame_id BIGINT, ocr_frame_id BIGINT, "
    "temporal_distance_seconds DOUBLE, is_representative BOOLEAN"
)
SEGMENT_SCHEMA = (
    "video_id STRING, start_seconds DOUBLE, end_seconds DOUBLE, text STRING, granularity STRING"
)
CAPTION_TEXT_FIELDS = ["visual_description", "scene", "spoken_summary"]
CAPTION_LIST_FIELDS = ["actions", "visible_text", "entities"]
CAPTION_RECORD_TYPE = (
    "STRUCT<visual_description:STRING,scene:STRING,spoken_summary:STRING,"
    "actions:ARRAY<STRING>,visible_text:ARRAY<STRING>,entities:ARRAY<STRING>>"
)


@dataclass(frozen=True)
class Lane:
    """One retrieval lane: fusion weight, confidence range and evidence families."""

    name: str
    weight: float
    floor: float
    ceiling: float
    family: str
    visual_family: str | None = None
    rank_cutoff: int | None = None
    calibrated: bool = True


# Default lane settings.
LANES: tuple[Lane, ...] = (
    Lane("visual_pe_core", 2.0, 0.20, 0.35, "visual", "visual_pe_core"),
    Lane("visual_beit3", 2.0, 0.40, 0.70, "visual", "visual_beit3"),
    Lane("visual_siglip2", 2.0, 0.20, 0.50, "visual", "visual_siglip2"),
    Lane("visual_jina_v5", 2.0, 0.0, 1.0, "visual", "visual_jina_v5"),
    Lane("visual_spatial_beit3", 1.0, 0.0, 1.0, "visual", "visual_beit3", calibrated=False),
    Lane("audio", 1.0, 0.50, 0.80, "audio"),
    Lane("ocr", 1.0, 0.55, 0.90, "ocr"),
    Lane("ocr_semantic", 1.0, 0.0, 1.0, "ocr"),
    Lane("caption", 1.25, 0.65, 0.90, "caption", rank_cutoff=5),
    Lane("graph", 1.0, 0.0, 1.0, "graph"),
)


@dataclass(frozen=True)
class Settings:
    """Numeric defaults of the composed queries."""

    rrf_k: int = 30
    late_rrf_k: int = 10
    confidence_bonus: float = 0.012
    visual_consensus_bonus: float = 0.018
    modality_consensus_bonus: float = 0.012
    specialist_bonus: float = 0.018
    specialist_gate: float = 0.60
    topic_bonus: float = 0.010
    topic_head: int = 10
    window_seconds: float = 3.0
    event_tolerance: int = 60
    keyframe_tolerance: int = 5
    gap_frames: int = 75
    frames_per_event: int = 3
    primary_event_head: int = 10
    protected_head: int = 20
    rescue_limit: int = 10
    max_per_video: int = 3
    sequence_gap_penalty: float = 0.03
    sequence_gap_scale: float = 45.0
    sequence_short_penalty: float = 0.20
    sequence_min_gap: float = 2.0
    sequence_pool: int = 200


DEFAULTS = Settings()

LANE_CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("lane", T.StringType(), False),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("floor", T.DoubleType(), False),
        T.StructField("ceiling", T.DoubleType(), False),
        T.StructField("family", T.StringType(), False),
        T.StructField("visual_family", T.StringType(), True),
        T.StructField("rank_cutoff", T.IntegerType(), True),
        T.StructField("calibrated", T.BooleanType(), False),
    ]
)


def lane_config(spark: SparkSession, lanes: tuple[Lane, ...] = LANES) -> DataFrame:
    """The lane table; its size is the number of lanes, so joins may broadcast it."""
    rows = [
        (
            lane.name,
            lane.weight,
            lane.floor,
            lane.ceiling,
            lane.family,
            lane.visual_family,
            lane.rank_cutoff,
            lane.calibrated,
        )
        for lane in lanes
    ]
    return spark.createDataFrame(rows, LANE_CONFIG_SCHEMA)
