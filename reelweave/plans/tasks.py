"""Tasks composed over known-item search: conversations, event sequences, anchored windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.functions.identifiers import retry_windows
from reelweave.operators import fusion as fu
from reelweave.operators import moments as mo
from reelweave.operators import ranking as rk
from reelweave.operators import sampling as sp
from reelweave.operators import sequences as sq
from reelweave.operators.fusion import KEY
from reelweave.operators.vectors import in_video_top_n
from reelweave.plans import search as ps
from reelweave.schema import DEFAULTS, Settings
from reelweave.session import cut_lineage


def conversational_search(signals: DataFrame, lanes: DataFrame, keyframes: DataFrame, videos: DataFrame, intents: DataFrame, options: ps.SearchOptions = ps.SearchOptions()) -> DataFrame:
    """Known-item search of every user turn with its context, labelled as a conversation.

    ``signals`` and ``intents`` are those of the contexts (``functions.text.user_context``), one
    query a turn, so all turns of all conversations are one job.
    """
    return ps.labelled(ps.known_item_search(signals, lanes, keyframes, videos, intents, options), "conversation")


def event_candidates(results: DataFrame, events: DataFrame, videos: DataFrame) -> DataFrame:
    """Ranked frames of single events as candidates of their sequence.

    ``results`` are ranked by ``query_id``, the number of one event; ``events(event_query,
    query_id, event_index)`` tells the sequence it belongs to.
    """
    top = results.groupBy("query_id").agg(F.max("score").alias("_top"))
    timed = mo.with_fps(results.join(top, "query_id"), videos).withColumnRenamed("query_id", "event_query")
    objective = F.when(F.col("_top") > 0, F.round(F.col("score") / F.col("_top"), 9)).otherwise(0.0)
    return timed.join(events, "event_query").select(
        "query_id", "event_index", "video_id", "frame_id", "score", objective.alias("objective"), (F.col("frame_id") / F.col("fps")).alias("ts")
    )


@dataclass(frozen=True)
class Critics:
    """Rankings of finished sequences: ``rows(query_id, critic, video_id, rank, rejected)``."""

    rows: DataFrame
    weights: dict[str, float]


def sequence_search(results: DataFrame, events: DataFrame, vectors: DataFrame, query_vectors: DataFrame, videos: DataFrame, *, max_events: int, proposals: int = 50, per_video: int = 24, window_frames: int = 75, max_missing: int = 0, top_k: int = 10, s: Settings = DEFAULTS) -> DataFrame:
    """Sequences of events: candidates of each event, repaired inside proposed videos, aligned, ranked.

    ``results(query_id, video_id, frame_id, score, rank)`` is the known-item search of all
    events of all sequences at once; ``query_vectors`` are those of single events.
    """
    results = cut_lineage(results)
    found = cut_lineage(event_candidates(results, events, videos))
    sizes = events.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_events"))
    wanted = sq.propose_videos(found, sizes, proposals).select("query_id", "video_id")
    pairs = wanted.join(events, "query_id").select(F.col("event_query").alias("query_id"), "video_id")
    hits = in_video_top_n(vectors, query_vectors, cut_lineage(pairs), per_video)
    local = cut_lineage(rk.ranked(hits.drop("rank"), ["query_id", "lane"], [F.desc("score"), F.asc("video_id"), F.asc("frame_id")]))
    top = results.groupBy(F.col("query_id").alias("pair_id")).agg(F.max("score").alias("top_score"))
    scale = top.join(events.withColumnRenamed("event_query", "pair_id"), "pair_id")
    repaired = sq.repair_candidates(local, found, scale, videos, window_frames)
    return ps.sequence_search(found, sizes, max_events, top_k, cut_lineage(repaired), None, max_missing, s)


def with_critics(sequences: DataFrame, critics: Critics, k: int) -> DataFrame:
    """The first ``k`` sequences after late fusion of critics' rankings.

    A sequence stands for its first frame there; the critics' ``band`` and ``critic_score``
    and the new ``rank`` are added.
    """
    first = F.element_at(F.filter("frame_ids", lambda f: f.isNotNull()), 1)
    rows = cut_lineage(sequences.withColumn("frame_id", first))
    judged = critics.rows.join(rows.select(*KEY), ["query_id", "video_id"])
    order = fu.critic_fusion(judged, critics.weights, rows.select(*KEY, "rank"))
    return rows.drop("rank", "frame_id").join(order.drop("frame_id"), ["query_id", "video_id"]).filter(F.col("rank") <= k)


def anchored_windows(requests: DataFrame, grid: DataFrame, changes: DataFrame, critic: DataFrame, *, n_events: int, window_seconds: float = 30.0, max_seconds: float = 180.0, scan_fps: float = 5.0, candidates: int = 350, accept: float = 0.5, options: int = 5) -> DataFrame:
    """One chain of frames per request from a window around its anchor.

    ``requests(request_id, video_id, frame_id, source, fps)`` come from ``anchor_seeds``;
    ``critic(request_id, event_index, frame_id, confidence)`` judges frames for events. A
    window is sampled around the anchor on the grid; the best judged frames of an event are its options
    and the cheapest increasing chain is taken. Requests without a chain of all events go on to
    the next larger window, until none is left or the largest has been searched: the number of
    open requests is all the driver sees.

    Returns the request, the window that decided, its number of candidates and of those near a
    change point, frames, confidences and ``ranking_score`` of every decided request.
    """
    windows = retry_windows(F.lit(float(window_seconds)), F.lit(float(max_seconds)))
    waiting = cut_lineage(requests.withColumn("windows", windows))
    turns = int(waiting.agg(F.max(F.size("windows"))).head()[0] or 0)
    critic = cut_lineage(critic)
    changes = cut_lineage(changes.select("video_id", "frame_id"))  # each turn reads them
    decided = None
    for turn in range(1, turns + 1):
        asked = waiting.filter(F.size("windows") >= turn).withColumn("window", F.element_at("windows", turn))
        frames = cut_lineage(sp.anchored_timeline(asked.drop("windows"), grid, changes, F.col("window"), scan_fps, candidates))
        judged = frames.join(critic, ["request_id", "frame_id"]).filter(F.col("confidence") >= accept)
        best = rk.ranked(judged, ["request_id", "event_index"], [F.desc("confidence"), F.asc("frame_id")], options)
        listed = best.select(F.col("request_id").alias("query_id"), "event_index", (F.col("rank") - 1).alias("option_rank"), F.col("frame_id").alias("candidate"))
        starts = frames.filter("is_anchor").select(F.col("request_id").alias("query_id"), F.col("frame_id").alias("anchor"))
        chains = cut_lineage(sq.cheapest_chain(cut_lineage(listed), cut_lineage(starts), n_events, options))
        steps = chains.select(F.col("query_id").alias("request_id"), F.posexplode("path").alias("event_index", "frame_id"))
        steps = steps.join(critic, ["request_id", "event_index", "frame_id"], "left")
        checked = sq.check_chains(steps.select(F.col("request_id").alias("query_id"), "event_index", "frame_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence")))
        whole = checked.filter("status <> 'rejected'").groupBy(F.col("query_id").alias("request_id")).agg(
            F.sort_array(F.collect_list(F.struct("event_index", "frame_id", "confidence"))).alias("_l")
        )
        whole = whole.filter(F.size("_l") == n_events)
        counts = frames.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("near_change").alias("n_near_change"))
        confidences = F.transform("_l", lambda x: x["confidence"])
        out = whole.join(counts, "request_id").join(asked, "request_id").select(
            "request_id", "video_id", F.col("window").alias("window_seconds"), "source", "n_candidates", "n_near_change",
            F.transform("_l", lambda x: x["frame_id"]).alias("frame_ids"), confidences.alias("confidences"), F.round(sq.chain_score(confidences), 4).alias("ranking_score"),
        )
        out = cut_lineage(out)
        decided = out if decided is None else decided.unionByName(out)
        waiting = cut_lineage(waiting.join(out.select("request_id"), "request_id", "left_anti"))
        if waiting.isEmpty():
            break
    if decided is None:
        empty = requests.select("request_id", "video_id", F.lit(0.0).alias("window_seconds"), "source", F.lit(0).cast("long").alias("n_candidates"), F.lit(0).cast("long").alias("n_near_change"))
        return empty.select("*", F.array().cast("array<bigint>").alias("frame_ids"), F.array().cast("array<double>").alias("confidences"), F.lit(0.0).alias("ranking_score")).limit(0)
    return decided
