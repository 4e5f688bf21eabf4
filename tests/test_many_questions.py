"""Known-item search of many questions: rows are dealt by question and frame, not by lane."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from reelweave.operators import events as ev
from reelweave.operators import fusion as fu
from reelweave.operators import timeline as tl
from reelweave.schema import DEFAULTS, LANES, lane_config

SIGNALS = "query_id long, lane string, video_id string, frame_id long, rank int, score double"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _signals(spark, seed=1, n=300):
    rng = random.Random(seed)
    lanes = ["visual_pe_core", "visual_beit3", "visual_spatial_beit3", "ocr", "ocr_semantic", "caption", "strange", "visual", "other", None]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(lanes), rng.choice(["a", "b", None]), rng.randrange(6), rng.randrange(1, 9), rng.random()) for _ in range(n)]
    return rows, spark.createDataFrame(rows, SIGNALS)


def test_rows_are_not_dealt_by_lane(spark):
    _, signals = _signals(spark)
    frames = spark.createDataFrame([("a", 1, "e0")], "video_id string, frame_id long, event_id string")
    for out in (
        fu.rank_fusion(signals, lane_config(spark)),
        fu.consensus_bonuses(signals, lane_config(spark)),
        ev.event_votes(signals, frames, lane_config(spark).select("lane", "weight")),
    ):
        assert not re.search(r"hashpartitioning\((lane|_base)#\d+,", _plan(out))


def test_consensus_counts_families_as_brute_force(spark):
    rows, signals = _signals(spark)
    known = {x.name: x for x in LANES}
    lanes_of, want = {}, {}
    for q, lane, video, frame, rank, _ in rows:
        cut = known[lane].rank_cutoff if lane in known else None
        if cut is None or rank <= cut:
            lanes_of.setdefault((q, video, frame), set()).add(lane)
    for key, lanes in lanes_of.items():
        families = {known[x].family if x in known else x for x in lanes} - {None}
        visual = {known[x].visual_family for x in lanes if x in known} - {None}
        want[key] = (round(DEFAULTS.visual_consensus_bonus * max(0, len(visual) - 1), 9), round(DEFAULTS.modality_consensus_bonus * max(0, len(families) - 1), 9))
    got = fu.consensus_bonuses(signals, lane_config(spark)).collect()
    assert {(r.query_id, r.video_id, r.frame_id): (round(r.visual_bonus, 9), round(r.modality_bonus, 9)) for r in got} == want


def test_votes_of_clauses_share_the_weight_of_their_lane(spark):
    rows = [(1, "ocr", "v", 10, 1, 0.5), (1, "visual_pe_core__clause1", "v", 10, 1, 0.5), (1, "visual_pe_core__clause2", "v", 500, 2, 0.5), (2, "strange", "v", 11, 3, 0.5), (None, "ocr", "v", 10, 1, 0.5)]
    frames = spark.createDataFrame([("v", 10, "e0"), ("v", 400, "e6")], "video_id string, frame_id long, event_id string")
    got = ev.event_votes(spark.createDataFrame(rows, SIGNALS), frames, lane_config(spark).select("lane", "weight"), 30, 60)
    assert {(r.query_id, r.lane, r.event_id, r.event_frame, round(r.vote, 9)) for r in got.collect()} == {
        (1, "ocr", "e0", 10, round(1 / 31, 9)),
        (1, "visual_pe_core__clause1", "e0", 10, round(1 / 31, 9)),
        (2, "strange", "e0", 10, round(1 / 33, 9)),
    }


@pytest.mark.parametrize("seed", range(3))
def test_spaced_rows_of_many_groups(spark, seed):
    rng = random.Random(seed)
    rows = [(g, p, rng.randrange(5)) for g in range(40) for p in rng.sample(range(200), rng.choice([1, 2, 30]))]
    df = spark.createDataFrame(rows, "video_id int, frame_id long, score int")
    for fill in (False, True):
        got = tl.greedy_spaced(df, ["video_id"], "frame_id", [-F.col("score"), F.col("frame_id")], 25, 3, fill=fill)
        assert got.columns == ["video_id", "frame_id", "score", "pick"]
        want = set()
        for g in range(40):
            mine = sorted((-s, p) for x, p, s in rows if x == g)
            picks = []
            for _, p in mine:
                if len(picks) < 3 and all(abs(p - x) >= 25 for x in picks):
                    picks.append(p)
            if fill:
                picks = (picks + [p for _, p in mine if p not in picks])[:3]
            want |= {(g, p, n) for n, p in enumerate(picks, 1)}
        assert {(r.video_id, r.frame_id, r.pick) for r in got.collect()} == want
