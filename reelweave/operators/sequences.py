"""Ordered event sequences: proposals, alignment, priors, coverage and chain checks.

Candidates arrive from per-event result lists cut to a pool (a top-k report), so a
query compares at most pool x pool candidate pairs per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.operators.fusion import align_to_windows, rank_fusion
from reelweave.operators.ranking import ranked
from reelweave.schema import DEFAULTS


def candidate_pool(candidates: DataFrame, pool: int = DEFAULTS.sequence_pool) -> DataFrame:
    """First ``pool`` candidates of each event."""
    return ranked(candidates, ["query_id", "event_index"], [F.desc("objective"), F.asc("video_id"), F.asc("frame_id")], pool, "_n").drop("_n")


def propose_videos(candidates: DataFrame, sizes: DataFrame, k: int, rrf_k: int = 10, coverage_weight: float = 0.25) -> DataFrame:
    """Videos by event coverage, then by fused per-event video ranks.

    ``sizes(query_id, n_events)``.
    """
    best = candidates.groupBy("query_id", "event_index", "video_id").agg(F.max("objective").alias("best"))
    placed = ranked(best, ["query_id", "event_index"], [F.desc("best"), F.asc("video_id")], name="video_rank")
    fused = placed.groupBy("query_id", "video_id").agg(
        F.count(F.lit(1)).alias("coverage"), F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("video_rank"))).alias("_s")
    )
    scored = fused.join(sizes, "query_id").select(
        "query_id",
        "video_id",
        "coverage",
        F.round(F.col("_s") + F.lit(coverage_weight) * F.col("coverage") / F.col("n_events"), 9).alias("score"),
    )
    return ranked(scored, ["query_id"], [F.desc("coverage"), F.desc("score"), F.asc("video_id")], k)


def transition_cost(gap: Column, penalty: float, scale: float, short_penalty: float, min_gap: float) -> Column:
    """Slowly growing cost of a long gap plus a linear cost of a very short one."""
    cost = F.lit(penalty) * F.log1p(gap / F.lit(scale))
    if min_gap > 0:
        cost = cost + F.when(gap < min_gap, F.lit(short_penalty) * (F.lit(1.0) - gap / F.lit(min_gap))).otherwise(0.0)
    return cost


def align_sequences(
    candidates: DataFrame,
    sizes: DataFrame,
    max_events: int,
    max_missing: int = 0,
    gap_penalty: float = DEFAULTS.sequence_gap_penalty,
    gap_scale: float = DEFAULTS.sequence_gap_scale,
    short_penalty: float = DEFAULTS.sequence_short_penalty,
    min_gap: float = DEFAULTS.sequence_min_gap,
) -> DataFrame:
    """Best strictly increasing frame per event in every video.

    ``candidates(query_id, event_index, video_id, frame_id, score, objective, ts)``.
    Videos missing at most ``max_missing`` events align on the events they have.
    Returns (query_id, video_id, events, frames, scores, missing, sequence_score);
    the arrays hold the present events in order.
    """
    key = ["query_id", "video_id"]
    one = ranked(candidates, [*key, "event_index", "frame_id"], [F.desc("objective"), F.desc("score")], 1, "_n").drop("_n")
    present = one.select(*key, "event_index").distinct()
    slots = present.withColumn("slot", F.row_number().over(Window.partitionBy(*key).orderBy("event_index")))
    counts = present.groupBy(*key).agg(F.count(F.lit(1)).alias("n_present"), F.sort_array(F.collect_set("event_index")).alias("events"))
    usable = counts.join(sizes, "query_id").filter(F.col("n_events") - F.col("n_present") <= max_missing).withColumn(
        "missing", (F.col("n_events") - F.col("n_present")).cast("int")
    )
    rows = one.join(slots, [*key, "event_index"])
    state = (
        rows.filter("slot = 1")
        .join(usable, key)
        .select(
            *key,
            "n_present",
            "missing",
            "events",
            F.col("frame_id").alias("pf"),
            F.col("ts").alias("pt"),
            F.round("objective", 9).alias("total"),
            F.array("frame_id").alias("frames"),
            F.array("score").alias("scores"),
        )
    )
    for slot in range(2, max_events + 1):
        step = rows.filter(F.col("slot") == slot).select(
            F.col("query_id").alias("_q"),
            F.col("video_id").alias("_v"),
            F.col("frame_id").alias("f"),
            F.col("ts").alias("t"),
            F.col("score").alias("s"),
            F.col("objective").alias("o"),
        )
        joined = state.join(
            step, (F.col("query_id") == F.col("_q")) & (F.col("video_id") == F.col("_v")) & (F.col("pf") < F.col("f")), "left"
        ).filter(F.col("f").isNotNull() | (F.col("n_present") < slot))
        gap = F.greatest(F.lit(0.0), F.col("t") - F.col("pt"))
        cost = transition_cost(gap, gap_penalty, gap_scale, short_penalty, min_gap)
        moved = F.col("f").isNotNull()
        nxt = joined.select(
            *key,
            "n_present",
            "missing",
            "events",
            F.coalesce("f", "pf").alias("frame"),
            F.struct(
                F.when(moved, F.round(F.col("total") + F.col("o") - cost, 9)).otherwise(F.col("total")).alias("total"),
                (-F.col("pf")).alias("_earlier"),
                F.when(moved, F.col("t")).otherwise(F.col("pt")).alias("pt"),
                F.when(moved, F.concat("frames", F.array("f"))).otherwise(F.col("frames")).alias("frames"),
                F.when(moved, F.concat("scores", F.array("s"))).otherwise(F.col("scores")).alias("scores"),
            ).alias("_x"),
        )
        best = nxt.groupBy(*key, "n_present", "missing", "events", "frame").agg(F.max("_x").alias("_x"))
        state = best.select(
            *key, "n_present", "missing", "events", F.col("frame").alias("pf"), "_x.pt", "_x.total", "_x.frames", "_x.scores"
        )
    last = state.groupBy(*key, "missing", "events").agg(F.max(F.struct("total", (-F.col("pf")).alias("e"), "frames", "scores")).alias("_x"))
    return last.select(*key, "events", "_x.frames", "_x.scores", "missing", F.col("_x.total").alias("sequence_score"))


def rank_sequences(aligned: DataFrame, k: int, priors: DataFrame | None = None, prior_weight: float = 0.0) -> DataFrame:
    """Alignments by missing events, then by sequence score plus weighted prior."""
    rows = aligned
    if priors is None:
        rows = rows.withColumn("prior", F.lit(0.0))
    else:
        rows = rows.join(priors.select("query_id", "video_id", "prior"), ["query_id", "video_id"], "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    rows = rows.withColumn("ranking_score", F.round(F.col("sequence_score") + F.lit(prior_weight) * F.col("prior"), 9))
    return ranked(rows, ["query_id"], [F.asc("missing"), F.desc("ranking_score"), F.asc("video_id")], k)


def with_null_slots(ranked_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One array element per requested event, null where the event is missing."""
    joined = ranked_rows.join(sizes, "query_id")

    def slot(i: Column) -> Column:
        at = F.array_position("events", i)
        return F.when(at > 0, F.element_at("frames", at.cast("int")))

    return joined.withColumn("frame_ids", F.transform(F.sequence(F.lit(0), F.col("n_events").cast("int") - 1), slot)).drop("n_events")


def flatten_sequences(sequences: DataFrame) -> DataFrame:
    """Frame rows with their event index, missing slots skipped."""
    rows = sequences.select("query_id", "video_id", "rank", F.posexplode("frame_ids").alias("event_index", "frame_id"))
    return rows.filter("frame_id is not null")


def repair_candidates(local: DataFrame, candidates: DataFrame, raw_scale: DataFrame, fps: DataFrame, window_frames: int, k: int = 10) -> DataFrame:
    """Candidates from a search inside proposed videos, never trusted above the global ones.

    ``local`` are in-video signals whose ``query_id`` is the pair's id in
    ``raw_scale(pair_id, query_id, event_index, top_score)``.
    """
    aligned = align_to_windows(local, window_frames)
    lanes = aligned.groupBy(F.col("query_id").alias("pair_id")).agg((F.countDistinct("lane") / F.lit(k + 1.0)).alias("ceiling"))
    fused = rank_fusion(aligned, None, k).withColumnRenamed("query_id", "pair_id").join(lanes, "pair_id")
    found = fused.join(raw_scale, "pair_id").withColumn("objective", F.least(F.lit(1.0), F.col("score") / F.col("ceiling")))
    known = candidates.groupBy("query_id", "event_index", "video_id").agg(F.max("objective").alias("_cap"))
    capped = found.join(known, ["query_id", "event_index", "video_id"], "left").withColumn(
        "objective", F.round(F.least("objective", F.coalesce("_cap", F.lit(0.5))), 9)
    )
    timed = capped.join(fps.select("video_id", "fps"), "video_id", "left")
    return timed.select(
        "query_id",
        "event_index",
        "video_id",
        "frame_id",
        F.round(F.col("top_score") * F.col("objective"), 9).alias("score"),
        "objective",
        (F.col("frame_id") / F.coalesce("fps", F.lit(25.0))).alias("ts"),
    )


def action_confidence(score: Column, rank: Column, floor: float = 0.35, span: float = 0.45) -> Column:
    """Confidence of a coarse action hit from its similarity and its global rank."""
    semantic = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - F.lit(floor)) / F.lit(span)))
    return semantic / (F.lit(1.0) + F.greatest(rank - 1, F.lit(0)) / F.lit(500.0))


def action_priors(candidates: DataFrame, sizes: DataFrame, max_events: int) -> DataFrame:
    """Mean confidence of the best action order of videos that have every event."""
    aligned = align_sequences(
        candidates.filter("objective > 0"), sizes, max_events, 0, gap_penalty=0.01, gap_scale=60.0, short_penalty=0.10, min_gap=2.0
    )
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return aligned.join(sizes, "query_id").select("query_id", "video_id", F.round(total / F.col("n_events"), 9).alias("prior"))


def clause_coverage(lane_votes: DataFrame, clauses: list[int], temporal: bool) -> DataFrame:
    """Per video the best event for every clause and the coverage score of the sequence.

    ``lane_votes(query_id, video_id, event_id, lane, vote, first_frame)``. Temporal
    queries take events in non-decreasing order of their first frame.
    Returns (query_id, video_id, events, clause_scores, coverage, sequence_score).
    """
    key = ["query_id", "video_id"]
    number = F.regexp_extract("lane", r"__clause(\d+)$", 1).try_cast("int")
    sums = [
        F.round(F.sum(F.when(number == c, F.col("vote")).otherwise(0.0)), 9).alias(f"s{c}") for c in clauses
    ]
    events = lane_votes.groupBy(*key, "event_id").agg(F.min("first_frame").alias("frame"), *sums)
    order = Window.partitionBy(*key).orderBy("frame", "event_id")
    events = events.withColumn("_o", F.row_number().over(order))
    if temporal:
        upto = Window.partitionBy(*key).orderBy("frame").rangeBetween(Window.unboundedPreceding, 0)

        def state(total: Column, names: Column, scores: Column, when: Column) -> Column:
            return F.when(when, F.struct(F.round(total, 9).alias("total"), (-F.col("_o")).alias("first"), names.alias("events"), scores.alias("scores")))

        first = clauses[0]
        rows = events.withColumn(
            "_st", state(F.log(F.col(f"s{first}") + 1e-9), F.array("event_id"), F.array(f"s{first}"), F.col(f"s{first}") > 0)
        )
        for c in clauses[1:]:
            rows = rows.withColumn("_best", F.max("_st").over(upto))
            s = F.col(f"s{c}")
            rows = rows.withColumn(
                "_st",
                state(
                    F.col("_best.total") + F.log(s + 1e-9),
                    F.concat("_best.events", F.array("event_id")),
                    F.concat("_best.scores", F.array(s)),
                    (s > 0) & F.col("_best").isNotNull(),
                ),
            )
        chosen = rows.groupBy(*key).agg(F.max("_st").alias("_st")).filter("_st is not null").select(*key, "_st.events", "_st.scores")
    else:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("clause"), F.col(f"s{c}").alias("s")) for c in clauses])).alias("_c")
        long = events.select(*key, "event_id", "_o", cells).select(*key, "event_id", "_o", "_c.clause", "_c.s").filter("s > 0")
        best = ranked(long, [*key, "clause"], [F.desc("s"), F.asc("_o")], 1, "_n")
        packed = best.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("clause", "event_id", "s"))).alias("_l"))
        chosen = packed.select(
            *key, F.transform("_l", lambda x: x["event_id"]).alias("events"), F.transform("_l", lambda x: x["s"]).alias("scores")
        )
    n = F.size("scores")
    coverage = n / F.lit(float(len(clauses)))
    geometric = F.exp(F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.log(x + 1e-9)) / n)
    score = coverage * coverage * geometric * (F.lit(0.5) + F.lit(0.5) * F.array_min("scores"))
    return chosen.select(
        *key, "events", F.col("scores").alias("clause_scores"), coverage.alias("coverage"), F.round(score, 9).alias("sequence_score")
    )


def flatten_coverage(sequences: DataFrame, events: DataFrame) -> DataFrame:
    """Events of the ranked sequences in order (1% decay each), then all other events."""
    key = ["query_id", "video_id"]
    order = ranked(sequences, ["query_id"], [F.desc("sequence_score"), F.desc("coverage"), F.asc("video_id")], name="_seq")
    picked = order.select(*key, "_seq", "sequence_score", F.posexplode(F.array_distinct("events")).alias("_i", "event_id")).select(
        *key, "event_id", F.lit(0).alias("band"), F.col("_seq").alias("_a"), F.col("_i").alias("_b"),
        F.round(F.col("sequence_score") * (F.lit(1.0) - F.lit(0.01) * F.col("_i")), 6).alias("score"),
    )
    rest = events.join(picked.select(*key, "event_id"), [*key, "event_id"], "left_anti").select(
        *key, "event_id", F.lit(1).alias("band"), F.col("rank").alias("_a"), F.lit(0).alias("_b"), F.round("score", 6).alias("score")
    )
    return ranked(picked.unionByName(rest), ["query_id"], [F.asc("band"), F.asc("_a"), F.asc("_b")]).drop("_a", "_b")


def check_chains(chains: DataFrame, repair_cap: float = 0.6) -> DataFrame:
    """Validate one frame per event in strictly increasing order; a complete chain in the
    wrong order is re-ordered by time with its confidence capped.

    ``chains(query_id, event_index, frame_id, confidence)``; ``n_events`` rows each.
    """
    packed = chains.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("event_index", "frame_id", "confidence"))).alias("_l"),
        F.countDistinct("event_index").alias("_events"),
        F.countDistinct("frame_id").alias("_frames"),
    )
    frames = F.transform("_l", lambda x: x["frame_id"])
    conf = F.transform("_l", lambda x: x["confidence"])
    steps = F.zip_with(F.slice(frames, 1, F.size(frames) - 1), F.slice(frames, F.lit(2), F.size(frames) - 1), lambda a, b: a < b)
    single = F.col("_events") == F.size("_l")
    rising = F.when(F.size("_l") > 1, F.forall(steps, lambda x: x)).otherwise(True)
    status = F.when(~single, "rejected").when(rising, "valid").when(F.col("_frames") == F.size("_l"), "repaired").otherwise("rejected")
    out = packed.withColumn("status", status)
    repaired = F.col("status") == "repaired"
    pairs = F.arrays_zip(
        F.when(repaired, F.sort_array(frames)).otherwise(frames).alias("frame_id"),
        F.when(repaired, F.transform(conf, lambda c: F.least(c, F.lit(repair_cap)))).otherwise(conf).alias("confidence"),
    )
    return out.select("query_id", "status", F.posexplode(pairs).alias("event_index", "_p")).select(
        "query_id", "status", "event_index", "_p.frame_id", "_p.confidence"
    )


def cheapest_chain(options: DataFrame, anchors: DataFrame, n_events: int, max_options: int = 5) -> DataFrame:
    """Cheapest strictly increasing chain of ranked options.

    ``options(query_id, event_index, option_rank, candidate)`` with zero-based
    indices; ``anchors(query_id, anchor)``. The first event defaults to the anchor;
    options before the anchor are ignored; every event needs one.
    """
    usable = options.filter(F.col("option_rank") < max_options).join(anchors, "query_id").filter("candidate >= anchor")
    first = ranked(usable, ["query_id", "event_index", "candidate"], [F.asc("option_rank")], 1, "_n").drop("_n")
    near = Window.partitionBy("query_id", "event_index").orderBy("option_rank", "candidate")
    opts = first.withColumn("option_rank", F.row_number().over(near) - 1)
    start = anchors.join(opts.filter("event_index = 0").drop("anchor"), "query_id", "left").select(
        "query_id", "anchor", F.coalesce("candidate", "anchor").alias("c"), F.coalesce("option_rank", F.lit(0)).alias("r")
    )
    state = start.select(
        "query_id",
        "anchor",
        "c",
        F.round(F.col("r") * 100.0 + F.abs(F.col("c") - F.col("anchor")) * 0.01, 6).alias("cost"),
        F.array("c").alias("path"),
    )
    for e in range(1, n_events):
        step = opts.filter(F.col("event_index") == e).select(F.col("query_id").alias("_q"), F.col("candidate").alias("n"), F.col("option_rank").alias("r"))
        joined = state.join(step, (F.col("query_id") == F.col("_q")) & (F.col("c") < F.col("n")))
        # chains that go on from the same option compare as the whole ones will: the later start has the smaller span
        begin = F.element_at("path", 1)
        best = joined.groupBy("query_id", "anchor", "n", "r").agg(
            F.min(F.struct("cost", (F.col("n") - begin).alias("span"), F.abs(begin - F.col("anchor")).alias("off"), "path")).alias("_x")
        )
        state = best.select(
            "query_id",
            "anchor",
            F.col("n").alias("c"),
            F.round(F.col("_x.cost") + F.col("r") * 100.0, 6).alias("cost"),
            F.concat("_x.path", F.array("n")).alias("path"),
        )
    span = F.element_at("path", -1) - F.element_at("path", 1)
    final = state.groupBy("query_id").agg(
        F.min(F.struct("cost", span.alias("span"), F.abs(F.element_at("path", 1) - F.col("anchor")).alias("off"), "path")).alias("_x")
    )
    return final.select("query_id", "_x.cost", "_x.path")


def first_positive(checks: DataFrame, bounds: DataFrame) -> DataFrame:
    """First candidate with a true check inside its bounds.

    ``checks(query_id, candidate, match)``; ``bounds(query_id, lower, upper, pick)``.
    A checklist without a positive overrules the stated pick; without a checklist
    the pick counts. A choice outside its bounds is rejected.
    """
    found = checks.groupBy("query_id").agg(F.min(F.when(F.col("match"), F.col("candidate"))).alias("positive"), F.lit(True).alias("checked"))
    rows = bounds.join(found, "query_id", "left")
    choice = F.when(F.col("checked"), F.col("positive")).otherwise(F.col("pick"))
    return rows.select("query_id", F.when(choice.between(F.col("lower"), F.col("upper")), choice).alias("candidate"))


def chain_score(confidences: Column) -> Column:
    """0.7 of the weakest plus 0.3 of the mean confidence."""
    mean = F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x) / F.size(confidences)
    return F.lit(0.7) * F.array_min(confidences) + F.lit(0.3) * mean
