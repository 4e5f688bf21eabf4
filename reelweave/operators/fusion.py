"""Rank and score fusion of lanes.

All totals are plain ``groupBy`` sums (partial aggregation before the shuffle).
Per-lane extremes are aggregated and joined back, so no window has to hold a
whole lane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.operators.ranking import best_row, ranked
from reelweave.schema import DEFAULTS, Settings

KEY = ["query_id", "video_id", "frame_id"]


def base_lane(lane: Column) -> Column:
    """Lane name without the clause suffix."""
    return F.split_part(lane, F.lit("__clause"), F.lit(1))


def within_cutoff(signals: DataFrame, lanes: DataFrame) -> DataFrame:
    """Signals joined with their lane settings, rank cutoffs applied."""
    return signals.join(F.broadcast(lanes), "lane", "left").filter(
        F.col("rank_cutoff").isNull() | (F.col("rank") <= F.col("rank_cutoff"))
    )


def rank_fusion(signals: DataFrame, lanes: DataFrame | None = None, k: int | Column = DEFAULTS.rrf_k, by: list[str] | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion; a key listed twice in a lane counts twice.

    ``weights(query_id, lane, weight)`` replaces the lanes' own weights.
    """
    rows = signals
    weight: Column = F.lit(1.0)
    if lanes is not None:
        rows = within_cutoff(signals, lanes)
        if weights is not None:
            rows = rows.drop("weight").join(weights.select("query_id", "lane", "weight"), ["query_id", "lane"], "left")
        weight = F.coalesce("weight", F.lit(1.0))
    k_col = k if isinstance(k, Column) else F.lit(k)
    bad = F.col("rank") <= 0
    share = F.when(bad, F.raise_error("ranks are one-based")).otherwise(weight / (k_col + F.col("rank")))
    return rows.groupBy(*(by or KEY)).agg(
        F.sum(share.cast("double")).alias("score"), F.countDistinct("lane").alias("n_lanes")
    )


def merge_lanes(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Best score per (query, lane, frame) of two signal sets, ranks rebuilt."""
    union = base.unionByName(extra).groupBy("query_id", "lane", "video_id", "frame_id").agg(F.max("score").alias("score"))
    return ranked(union, ["query_id", "lane"], [F.desc("score"), F.asc("video_id"), F.asc("frame_id")])


def max_normalised_fusion(signals: DataFrame, weights: dict[str, float], pool: int, k: int) -> DataFrame:
    """Top ``pool`` per lane, divided by the lane maximum, weighted sum over lanes.

    Weights are renormalised over the configured lanes.
    """
    total = float(sum(weights.values())) or 1.0
    share = F.create_map(*[x for n, w in weights.items() for x in (F.lit(n), F.lit(w / total))])
    rows = signals.filter(F.col("lane").isin(list(weights)) & (F.col("rank") <= pool))
    top = rows.groupBy("query_id", "lane").agg(F.max("score").alias("_top"))
    scored = rows.join(top, ["query_id", "lane"]).withColumn(
        "_v", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(0.0) * share[F.col("lane")]
    )
    fused = scored.groupBy(*KEY).agg(F.sum("_v").alias("score"))
    return ranked(
        fused.withColumn("score", F.round("score", 6)),
        ["query_id"],
        [F.desc("score"), F.asc("video_id"), F.asc("frame_id")],
        k,
    )


def early_fusion(signals: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Per-lane min-max scores, mean over the lanes where the frame appears.

    The mean is unweighted unless ``weights(query_id, lane, weight)`` are given; lanes
    without a positive weight then do not count.
    """
    ends = signals.groupBy("query_id", "lane").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    rows = (
        signals.join(ends, ["query_id", "lane"])
        .withColumn(
            "_v",
            F.when(F.col("_hi") - F.col("_lo") > 1e-12, (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0),
        )
        .withColumn("_w", F.lit(1.0))
    )
    if weights is not None:
        rows = rows.drop("_w").join(weights.select("query_id", "lane", F.col("weight").alias("_w")), ["query_id", "lane"]).filter("_w > 0")
    return rows.groupBy(*KEY).agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("score"))


def linear_confidence(score: Column, floor: Column, ceiling: Column) -> Column:
    """0 below the floor, 1 from the ceiling on, linear between."""
    slope = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - floor) / (ceiling - floor)))
    return F.when(score < floor, 0.0).when(ceiling <= floor, 1.0).otherwise(slope)


def lane_confidence(signals: DataFrame, lanes: DataFrame) -> DataFrame:
    """Signals with their calibrated confidence; uncalibrated lanes give 0."""
    rows = within_cutoff(signals, lanes)
    conf = linear_confidence(
        F.col("score"), F.coalesce("floor", F.lit(0.0)), F.coalesce("ceiling", F.lit(1.0))
    )
    return rows.withColumn("confidence", F.when(F.coalesce("calibrated", F.lit(True)), conf).otherwise(0.0))


def _family_bits(rows: DataFrame, lanes: DataFrame, column: str, family: Column) -> DataFrame:
    """``rows`` with the bit of their ``family`` among those of the lane table, null for others (lanes the table
    does not know, each a family of its own)."""
    known = lanes.select(F.col(column).alias("_family")).dropna().distinct()
    place = F.row_number().over(Window.orderBy("_family")) - 1  # the lane table is small
    bit = F.when(place < 64, F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).otherwise(F.raise_error(F.lit("more than 64 families of lanes")).cast("bigint"))
    bits = F.broadcast(known.select("_family", bit.alias(f"{column}_bit")))
    return rows.withColumn("_of", family).join(bits, F.col("_of") == F.col("_family"), "left").drop("_of", "_family")


def consensus_bonuses(signals: DataFrame, lanes: DataFrame, intents: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Confidence, agreement and specialist bonuses per fused document.

    ``intents(query_id, intent)`` makes the speech or screen-text lanes eligible
    as specialists; captions always are.
    """
    # dealt by frame once, for both aggregates and what is joined to them
    rows = lane_confidence(signals.repartition(*KEY), lanes)
    rows = _family_bits(_family_bits(rows, lanes, "family", F.coalesce("family", F.col("lane"))), lanes, "visual_family", F.col("visual_family"))
    per_lane = rows.groupBy(*KEY, "lane").agg(
        F.max("confidence").alias("confidence"),
        F.max("family_bit").alias("family_bit"),
        F.max("visual_family_bit").alias("visual_family_bit"),
    )
    if intents is None:
        per_lane = per_lane.withColumn("intent", F.lit("default"))
    else:
        per_lane = per_lane.join(intents.select("query_id", "intent"), "query_id", "left")
    eligible = (
        (F.col("lane") == "caption")
        | ((F.col("intent") == "asr") & (F.col("lane") == "audio"))
        | ((F.col("intent") == "ocr") & F.col("lane").isin("ocr", "ocr_semantic"))
    )
    strong = F.when(eligible & (F.col("confidence") >= s.specialist_gate), F.col("confidence")).otherwise(0.0)
    return per_lane.groupBy(*KEY).agg(
        (F.lit(s.confidence_bonus) * F.sum("confidence")).alias("confidence_bonus"),
        (F.lit(s.visual_consensus_bonus) * F.greatest(F.lit(0), F.bit_count(F.coalesce(F.bit_or("visual_family_bit"), F.lit(0))) - 1)).alias("visual_bonus"),
        (F.lit(s.modality_consensus_bonus) * F.greatest(F.lit(0), F.bit_count(F.coalesce(F.bit_or("family_bit"), F.lit(0))) + F.count_if(F.col("family_bit").isNull() & F.col("lane").isNotNull()) - 1)).alias("modality_bonus"),
        (F.lit(s.specialist_bonus) * F.sum(strong)).alias("specialist_bonus"),
    )


def topic_group(video_id: Column) -> Column:
    """Collection prefix: ``L<digits>`` before ``_V`` or ``_``, else the text before ``_``."""
    prefix = F.regexp_extract(video_id, r"(?i)^(L\d+)(_V|_)", 1)
    return F.when(prefix != "", F.upper(prefix)).otherwise(F.split_part(video_id, F.lit("_"), F.lit(1)))


def topic_support(signals: DataFrame, lanes: DataFrame, k: int, s: Settings = DEFAULTS) -> DataFrame:
    """Bonus per (query, topic) where at least two lanes agree in their heads."""
    heads = within_cutoff(signals, lanes).filter(F.col("rank") <= s.topic_head)
    per_lane = heads.groupBy("query_id", topic_group(F.col("video_id")).alias("topic"), "lane").agg(F.min("rank").alias("best"))
    topics = per_lane.groupBy("query_id", "topic").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("best"))).alias("mass"), F.count("lane").alias("lanes")
    )
    peak = topics.groupBy("query_id").agg(F.max("mass").alias("_peak"))
    return (
        topics.join(peak, "query_id")
        .filter(F.col("lanes") >= 2)
        .select(
            "query_id",
            "topic",
            (
                F.lit(s.topic_bonus) * F.col("mass") / F.col("_peak") * F.least(F.lit(1.0), (F.col("lanes") - 1) / F.lit(2.0))
            ).alias("topic_bonus"),
        )
    )


def fuse_with_bonuses(signals: DataFrame, lanes: DataFrame, intents: DataFrame | None = None, s: Settings = DEFAULTS, weights: DataFrame | None = None) -> DataFrame:
    """Rank fusion plus all bonuses, one row per (query, frame) with its breakdown."""
    base = rank_fusion(signals, lanes, s.rrf_k, weights=weights).withColumnRenamed("score", "rrf")
    bonus = consensus_bonuses(signals, lanes, intents, s)
    topics = topic_support(signals, lanes, s.rrf_k, s)
    out = base.join(bonus, KEY, "left").withColumn("topic", topic_group(F.col("video_id"))).join(topics, ["query_id", "topic"], "left")
    parts = ["confidence_bonus", "visual_bonus", "modality_bonus", "specialist_bonus", "topic_bonus"]
    for p in parts:
        out = out.withColumn(p, F.coalesce(p, F.lit(0.0)))
    total = F.col("rrf")
    for p in parts:
        total = total + F.col(p)
    return out.select(*KEY, "n_lanes", "rrf", *parts, total.alias("score"))


def merge_modalities(signals: DataFrame, families: dict[str, str]) -> DataFrame:
    """One row per (query, frame): best score per modality, and the text of its best rank.

    ``families`` maps an output column to the lane prefix it collects. Signals with a
    ``text`` give ``<column>_snippet`` too.
    """
    aggs = [
        F.max(F.when(F.col("lane").startswith(prefix), F.col("score"))).alias(column)
        for column, prefix in families.items()
    ]
    if "text" in signals.columns:
        for column, prefix in families.items():
            told = F.col("lane").startswith(prefix) & F.col("text").isNotNull()
            aggs.append(F.min(F.when(told, F.struct("rank", "lane", "text")))["text"].alias(f"{column}_snippet"))
    return signals.groupBy(*KEY).agg(
        *aggs, F.countDistinct("lane").alias("n_lanes"), F.min("rank").alias("best_rank")
    )


def align_to_windows(signals: DataFrame, window_frames: int) -> DataFrame:
    """Retarget nearby hits of all lanes to the best-ranked hit of their greedy window.

    One vote per lane and window remains; lane ranks are rebuilt.
    """
    from reelweave.operators.timeline import greedy_anchors

    placed = greedy_anchors(signals, ["query_id", "video_id"], "frame_id", window_frames)
    inside = Window.partitionBy("query_id", "video_id", "anchor").orderBy("rank", "frame_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = placed.filter(F.col("query_id").isNotNull() & F.col("video_id").isNotNull() & F.col("anchor").isNotNull())
    moved = known.select("query_id", "lane", "video_id", F.first("frame_id").over(inside).alias("frame_id"), "rank", "score")
    one = best_row(moved, ["query_id", "lane", "video_id", "frame_id"], [F.asc("rank"), F.desc("score")])
    return ranked(
        one.withColumnRenamed("rank", "_r"),
        ["query_id", "lane"],
        [F.asc("_r"), F.desc("score"), F.asc("video_id"), F.asc("frame_id")],
    ).drop("_r")


def snap_to_frames(segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """Time ranges retargeted to the earliest candidate frame inside [frame_id, end_frame_id).

    ``segments(query_id, lane, video_id, frame_id, end_frame_id, rank, ...)`` without a
    candidate inside keep their own frame; of those that meet on one frame a lane keeps its best rank.
    """
    from reelweave.operators.timeline import asof

    frames = candidates.select("query_id", "video_id", F.col("frame_id").alias("_p")).distinct()
    found = asof(segments, frames, ["query_id", "video_id"], "frame_id", "_p", [], "forward")
    inside = F.col("matched_pos") < F.col("end_frame_id")
    placed = found.withColumn("frame_id", F.when(inside, F.col("matched_pos")).otherwise(F.col("frame_id"))).drop("matched_pos")
    return best_row(placed, ["query_id", "lane", "video_id", "frame_id"], [F.asc("rank")])


# Lane factors of the query intents, by evidence family.
INTENT_FACTORS = {
    "default": {"visual": 1.0, "audio": 1.0, "ocr": 1.0, "caption": 1.0, "graph": 1.0},
    "ocr": {"visual": 0.6, "audio": 0.6, "ocr": 3.0, "caption": 0.6, "graph": 0.6},
    "asr": {"visual": 0.6, "audio": 3.0, "ocr": 0.6, "caption": 0.6, "graph": 0.6},
}


def intent_weights(queries: DataFrame, lanes: DataFrame) -> DataFrame:
    """Lane weights per query from its intent: ``queries(query_id, intent)``.

    Lanes derived from another lane's encoder or text (regional visual, semantic
    screen text) keep their own weight as an extra factor.
    """
    spark = lanes.sparkSession
    profiles = spark.createDataFrame(
        [(i, f, v) for i, factors in INTENT_FACTORS.items() for f, v in factors.items()],
        "intent STRING, family STRING, factor DOUBLE",
    )
    derived = F.when(F.col("lane").isin("visual_spatial_beit3", "ocr_semantic"), F.col("weight")).otherwise(1.0)
    per_intent = lanes.select("lane", "family", derived.alias("_own")).join(profiles, "family").select(
        "intent", "lane", (F.col("factor") * F.col("_own")).alias("weight")
    )
    return queries.select("query_id", "intent").join(per_intent, "intent").select("query_id", "intent", "lane", "weight")


def budget_weights(active: DataFrame, visual_budget: float, text_budget: float) -> DataFrame:
    """Split a visual and a text budget evenly over the lanes a query has hits in."""
    lanes = active.select("query_id", "lane", F.col("lane").startswith("visual_").alias("is_visual")).distinct()
    sizes = lanes.groupBy("query_id", "is_visual").agg(F.count("lane").alias("n"))
    return lanes.join(sizes, ["query_id", "is_visual"]).select(
        "query_id",
        "lane",
        (F.when(F.col("is_visual"), F.lit(visual_budget)).otherwise(F.lit(text_budget)) / F.col("n")).alias("weight"),
    )


def family_weights(signals: DataFrame, lanes: DataFrame, specialists: tuple[str, ...], visual: float = 0.35, text: float = 0.65) -> DataFrame:
    """Weights of an explicit mode: ``query_id, lane, weight`` of the lanes a query has hits in.

    The visual budget is divided over all configured visual lanes, with hits or not; the
    text budget over the specialist lanes in which the query has hits.
    """
    is_visual = F.col("lane").startswith("visual")
    names = lanes.filter(is_visual).select("lane", F.lit(1).alias("_one")).distinct()
    share = names.join(names.groupBy("_one").agg(F.count(F.lit(1)).alias("_n")), "_one")
    hit = signals.select("query_id", "lane").distinct()
    seen = hit.filter(is_visual).join(share, "lane").select("query_id", "lane", (F.lit(visual) / F.col("_n")).alias("weight"))
    spoken = hit.filter(F.col("lane").isin(list(specialists)))
    n = spoken.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return seen.unionByName(spoken.join(n, "query_id").select("query_id", "lane", (F.lit(text) / F.col("_n")).alias("weight")))


def critic_fusion(critics: DataFrame, weights: dict[str, float], results: DataFrame, k: int = DEFAULTS.late_rrf_k) -> DataFrame:
    """Fuse critic rankings late; rejected rows after eligible ones, unjudged rows last.

    ``critics(query_id, critic, video_id, frame_id, rank, rejected)``.
    """
    w = F.create_map(*[x for n, v in weights.items() for x in (F.lit(n), F.lit(float(v)))])
    fused = critics.groupBy(*KEY).agg(
        F.round(F.sum(w[F.col("critic")] / (F.lit(k) + F.col("rank"))), 9).alias("critic_score"),
        F.max(F.col("rejected").cast("int")).alias("rejected"),
    )
    joined = results.join(fused, KEY, "left").withColumn(
        "band", F.when(F.col("critic_score").isNull(), 2).otherwise(F.col("rejected"))
    )
    return ranked(
        joined.withColumnRenamed("rank", "_r"),
        ["query_id"],
        [F.asc("band"), F.desc(F.coalesce("critic_score", F.lit(0.0))), F.asc("_r")],
    ).select(*KEY, "band", F.coalesce("critic_score", F.lit(0.0)).alias("critic_score"), "rank")


def prefer_lane(primary: DataFrame, fallback: DataFrame, name: str) -> DataFrame:
    """Primary lane where a query has hits in it, else the fallback; both renamed."""
    missing = fallback.join(primary.select("query_id").distinct(), "query_id", "left_anti")
    return primary.unionByName(missing).withColumn("lane", F.lit(name))


def collapse_clauses(signals: DataFrame) -> DataFrame:
    """One list per model: best score per frame over its clauses, ranked inside the video."""
    best = signals.withColumn("lane", base_lane(F.col("lane"))).groupBy("query_id", "lane", "video_id", "frame_id").agg(
        F.max("score").alias("score")
    )
    return ranked(best, ["query_id", "lane", "video_id"], [F.desc("score"), F.asc("frame_id")])
