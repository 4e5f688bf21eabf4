"""Files, contracts, sinks and streaming forms."""

from __future__ import annotations

import datetime
import random
import time

import numpy as np
from pyspark.sql import functions as F

from reelweave.operators import team as tm
from reelweave.sources import tables as src
from reelweave.streaming import team as stream


def test_feature_files_skip_unreadable(spark, tmp_path):
    folder = tmp_path / "L01_V001"
    folder.mkdir()
    np.save(folder / "7.npy", np.array([1.0, 2.0], dtype="float32"))
    (folder / "8.npy").write_bytes(b"broken")
    got = src.feature_files(spark, str(tmp_path)).collect()
    assert [(r.video_id, r.frame_id, r.embedding) for r in got] == [("L01_V001", 7, [1.0, 2.0])]


def test_query_catalog_order_and_counts(spark, tmp_path):
    for name in ("query-10-kis.txt", "query-2-trake.txt", "notes.txt"):
        (tmp_path / name).write_text(f"text of {name}\n")
    answers = spark.createDataFrame([("query-2-trake.txt",)] * 3, "filename STRING")
    got = src.query_catalog(spark, str(tmp_path), answers).collect()
    assert [(r.label, r.task, r.answer_count) for r in got] == [("2", "trake", 3), ("10", "kis", 0)]


def test_submission_roundtrip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "v", 3, 1, 'a "b", c')], "query_id BIGINT, video_id STRING, frame_id BIGINT, rank INT, answer STRING")
    lines = src.submission_lines(rows, "qa")
    out = tmp_path / "out"
    src.write_submission(lines, str(out))
    files = list(out.rglob("part-*"))
    assert files[0].read_bytes() == b'v,3,"a ""b"", c"\r\n'
    checked = src.check_submissions(lines.withColumn("task", F.lit("qa")).select("query_id", "task", "line"))
    assert checked.filter("rule is not null").count() == 0


def test_answer_length_limit(spark):
    rows = [(1, "qa", "v,3," + "a" * 100), (2, "qa", "v,3," + "a" * 101), (3, "kis", "v,x"), (4, "kis", "a/b,3"), (5, "trake", "v,1,-2")]
    df = spark.createDataFrame(rows, "query_id BIGINT, task STRING, line STRING")
    got = {r.query_id: r.rule for r in src.check_submissions(df).collect()}
    assert got == {1: None, 2: "answer_length", 3: "frame_type", 4: "video_id", 5: "frame_negative"}


LOG = "session STRING, seq BIGINT, action STRING, name STRING, item_id STRING, flag BOOLEAN"
EVENTS = [
    ("s", 1, "ADD_FRAME", "u", "old", None),
    ("s", 2, "CLEAR_QUEUE", "u", None, None),
    ("s", 3, "ADD_FRAME", "u", "a", None),
    ("s", 4, "VOTE_FRAME", "u", "a", None),
    ("s", 5, "VOTE_FRAME", "w", "a", None),
    ("s", 6, "VOTE_FRAME", "u", "a", None),
    ("s", 7, "TOGGLE_PIN", "u", "a", True),
    ("s", 8, "ADD_FRAME", "u", "b", None),
    ("s", 9, "REMOVE_FRAME", "u", "b", None),
    ("s", 10, "SUBMIT_DONE", "w", "a", None),
]


def test_queue_fold_and_votes(spark):
    log = spark.createDataFrame(EVENTS, LOG)
    got = tm.queue(log).collect()
    assert [(r.item_id, r.added, r.pinned, r.done, r.submitted_by) for r in got] == [("a", 3, True, True, "w")]
    assert [(r.item_id, r.n_votes, r.first_voter) for r in tm.votes(log).collect()] == [("a", 1, "w")]


def test_queue_stream_agrees_with_the_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame(EVENTS, LOG).coalesce(1).write.json(str(tmp_path / "in"))
    log = spark.readStream.schema(LOG).json(str(tmp_path / "in"))
    q = stream.queue_stream(log).writeStream.format("memory").queryName("queue_out").outputMode("update").option(
        "checkpointLocation", str(tmp_path / "ck")
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.item_id: r for r in spark.table("queue_out").collect()}
    assert got["a"].present and got["a"].pinned and got["a"].done and list(got["a"].voters) == ["w"]
    assert not got["b"].present and not got["old"].present


def test_first_answers_and_continuous_search(spark, tmp_path):
    rows = [("e", "x", "2024-01-01 00:00:00"), ("e", "x", "2024-01-01 00:00:05"), ("e", "y", "2024-01-01 00:00:06")]
    df = spark.createDataFrame(rows, "evaluation STRING, answer STRING, t STRING").select("evaluation", "answer", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    answers = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.continuous_search(answers, lambda b: b.groupBy("answer").count(), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {r.answer: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"x": 2, "y": 1}
    d = stream.first_answers(answers).writeStream.format("memory").queryName("first_out").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    d.awaitTermination(120)
    assert sorted(r.answer for r in spark.table("first_out").collect()) == ["x", "y"]


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
BEATS = "session STRING, name STRING, seq BIGINT, action STRING, status STRING, colour STRING, ts TIMESTAMP"


def run_stream(df, checkpoint):
    rows = []
    q = df.writeStream.foreachBatch(lambda batch, _: rows.extend(batch.collect())).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return rows


def at(second):
    return datetime.datetime(2024, 1, 1, 12, 0, 0) + datetime.timedelta(seconds=second)


def test_presence_stream_tells_of_silence_like_the_fold(spark, tmp_path):
    spark.conf.set(*ROCKS)
    first = [("s", "ann", 1, "heartbeat", "busy", "#111", at(0)), ("s", "bob", 2, "heartbeat", None, None, at(1)), ("s", "cy", 3, "heartbeat", "x", None, at(2)), ("s", " ", 4, "heartbeat", "x", None, at(2))]
    # twelve seconds after ann's beat she is online still, bob goes on, cy leaves, a beat of another session moves the clock
    later = [("s", "bob", 5, "heartbeat", "back", None, at(12)), ("s", "cy", 6, "leave", None, None, at(12)), ("t", "dan", 7, "heartbeat", None, None, at(12))]
    clock = [("t", "dan", 8, "heartbeat", None, None, at(20))]
    seen = {}
    for i, rows in enumerate((first, later, clock, clock[:0])):
        folder = tmp_path / "in"
        spark.createDataFrame(rows or [("t", "dan", 9, "heartbeat", None, None, at(21))], BEATS).coalesce(1).write.mode("append").parquet(str(folder))
        log = spark.readStream.schema(BEATS).parquet(str(folder))
        for r in run_stream(stream.presence_stream(log, event_time=True), str(tmp_path / "ck")):
            seen[r.session, r.name] = r
        if i == 1:
            assert seen["s", "ann"].online
    every = spark.read.parquet(str(tmp_path / "in"))
    want = {(r.session, r.name): (r.status, r.colour, r.online) for r in tm.presence(every, F.lit(at(20)).cast("timestamp")).collect()}
    assert {k: (r.status, r.colour, r.online) for k, r in seen.items() if r.online is not None} == want
    assert want["s", "ann"] == ("busy", "#111", False) and want["s", "bob"][2] and seen["s", "cy"].online is None


def test_presence_stream_by_the_clusters_clock(spark, tmp_path):
    spark.conf.set(*ROCKS)
    spark.createDataFrame([("s", "ann", 1, "heartbeat", None, None, at(0))], BEATS).coalesce(1).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(BEATS).parquet(str(tmp_path / "in"))
    q = stream.presence_stream(log, online_seconds=1).writeStream.format("memory").queryName("presence_clock").outputMode("update").option(
        "checkpointLocation", str(tmp_path / "ck")
    ).trigger(processingTime="1 second").start()
    deadline = time.time() + 60
    while time.time() < deadline and not any(r.online is False for r in spark.table("presence_clock").collect()):
        time.sleep(1)
    q.stop()
    assert [r.online for r in spark.table("presence_clock").orderBy(F.desc("online")).collect()] == [True, False]


STAGE_LOG = "session STRING, seq BIGINT, action STRING, name STRING, item_id STRING, value STRING"
STAGE_EVENTS = [
    ("s", 1, "ADD_STAGE", "u", "gone", None),
    ("s", 2, "CLEAR_TRAKE", "u", None, None),
    ("s", 3, "MAKE_KEY", "u", None, "V7"),
    ("s", 4, "ADD_STAGE", "u", "one", None),
    ("s", 5, "ADD_STAGE", "u", "two", None),
    ("s", 6, "CLAIM_STAGE", "u", "one", None),
    ("s", 7, "CLAIM_STAGE", "w", "one", None),
    ("s", 8, "CLAIM_STAGE", " ", "one", None),
    ("s", 9, "PROPOSE_STAGE_FRAME", "u", "one", "c1"),
    ("s", 10, "VOTE_STAGE_FRAME", "w", "one", "c1"),
    ("s", 11, "VOTE_STAGE_FRAME", "w", "one", "unknown"),
    ("t", 12, "ADD_STAGE", "z", "one", None),
    ("s", 13, "CLAIM_STAGE", "w", "one", None),
    ("s", 14, "PROPOSE_STAGE_FRAME", "w", "one", "c2"),
    ("s", 15, "LOCK_STAGE_FRAME", "w", "one", "c1"),
    ("s", 16, "VOTE_STAGE_FRAME", "u", "one", "c1"),
    ("s", 17, "LOCK_STAGE_FRAME", "w", "two", "nothing"),
    ("t", 18, "PROPOSE_STAGE_FRAME", "z", "one", "c9"),
    ("t", 19, "LOCK_STAGE_FRAME", "z", "one", "c9"),
    ("t", 20, "REMOVE_STAGE_FRAME", "z", "one", "c9"),
    ("s", 21, "ADD_STAGE", "u", "three", None),
    ("s", 22, "REMOVE_STAGE", "u", "three", None),
    ("s", 23, "UNLOCK_VIDEO", "u", None, None),
]


def test_stage_stream_agrees_with_the_replay_after_a_restart_and_from_a_snapshot(spark, tmp_path):
    spark.conf.set(*ROCKS)
    whole = spark.createDataFrame(STAGE_EVENTS, STAGE_LOG)
    want = {(r.session, r.item_id): (r.n_assignees, r.n_candidates, r.n_votes, r.locked_candidate) for r in tm.stage_board(whole).collect()}
    assert want["s", "one"] == (1, 2, 2, "c1") and want["t", "one"] == (0, 0, 0, None)
    for cut in (8, 13, 18):
        halves = [spark.createDataFrame([e for e in STAGE_EVENTS if (e[1] <= cut) == early], STAGE_LOG).coalesce(1) for early in (True, False)]
        folder, alone = str(tmp_path / f"in{cut}"), str(tmp_path / f"late{cut}")
        state = {}
        for i, half in enumerate(halves):  # the second run restarts from the checkpoint
            half.write.mode("append").json(folder)
            log = spark.readStream.schema(STAGE_LOG).json(folder)
            for r in run_stream(stream.stage_stream(log), str(tmp_path / f"ck{cut}")):
                state[r.session, r.item_id] = r
        assert {k: tuple(r[2:6]) for k, r in state.items() if r.present} == want
        assert state["s", "one"].locked_video is None
        halves[1].write.json(alone)
        log = spark.readStream.schema(STAGE_LOG).json(alone)
        late = {(r.session, r.item_id): r for r in run_stream(stream.stage_stream(log, tm.stage_snapshot(halves[0])), str(tmp_path / f"ck_late{cut}"))}
        assert all(want[k] == tuple(r[2:6]) for k, r in late.items() if r.present)
        assert late["s", "one"].present


def test_lists_and_markings_as_streams_agree_with_their_folds(spark, tmp_path):
    spark.conf.set(*ROCKS)
    rng = random.Random(11)
    actions = ["pick"] * 6 + ["ADD_HISTORY"] * 6 + ["TOGGLE_MARK"] * 6 + ["CLEAR_HISTORY", "CLEAR_MARKING"]
    schema = LOG + ", value STRING"
    events = [
        (rng.choice("st"), i, rng.choice(actions), rng.choice(["ann", "bob", ""]), f"f{rng.randrange(8)}", rng.random() < 0.6, rng.choice(["incorrect", "caution", "other", None]))
        for i in range(240)
    ]
    forms = {
        "picks": (stream.picks_stream, lambda x: tm.picks(x, 4), 4),
        "shared": (stream.history_stream, lambda x: tm.shared_history(x, 10), 10),
        "own": (stream.personal_history_stream, lambda x: tm.personal_history(x, 5), 5),
    }
    seen = {form: {} for form in [*forms, "marks"]}
    for lo, hi in ((0, 110), (110, 240)):  # the second run restarts from the checkpoints
        spark.createDataFrame(events[lo:hi], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        log = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        for form, (build, _, limit) in forms.items():
            for r in run_stream(build(log, limit), str(tmp_path / form)):
                seen[form][r.owner, r.place] = (r.item_id, r.seq) if r.present else None
        for r in run_stream(stream.markings_stream(log), str(tmp_path / "marks")):
            seen["marks"][r.session, r.item_id] = r.kind
        whole = spark.createDataFrame(events[:hi], schema)
        for form, (_, fold, _) in forms.items():
            owner = "name" if form == "own" else "session"
            want = {(r[owner], r["rank"]): (r.item_id, r.seq) for r in fold(whole).collect()}
            assert {k: v for k, v in seen[form].items() if v} == want, form
        marked = {(r.session, r.item_id): r.kind for r in tm.markings(whole).collect()}
        assert {k: v for k, v in seen["marks"].items() if v} == marked


def test_similar_ids_compare_few_and_miss_none(spark, monkeypatch):
    import difflib
    import random

    from reelweave.functions import identifiers as ids

    rng = random.Random(4)
    names = sorted({"N" + "".join(rng.choices("0123", k=3)) + "_V00" + rng.choice("123") for _ in range(120)})
    typed = ["N" + "".join(rng.choices("0123", k=3)) + "_V" + rng.choice("O4") for _ in range(15)] + [""]
    want = set()
    for t in typed:
        ratios = sorted(((difflib.SequenceMatcher(None, t, k).ratio(), k) for k in names), reverse=True)
        cut = max(0.75, ratios[5][0])
        want |= {(t, k, r) for r, k in ratios if r >= cut and t}
    known = spark.createDataFrame([(k, k) for k in names], "video_id string, key string")
    asked = spark.createDataFrame([(t, t) for t in sorted(set(typed))], "typed string, key string")
    assert {tuple(r) for r in ids.similar_ids(asked, known, 0.75, 6).collect()} == want
    monkeypatch.setattr(ids, "ROUND_BYTES", 200)  # several rounds: more rows, the same first ones
    assert {tuple(r) for r in ids.similar_ids(asked, known, 0.75, 6).collect()} >= want
    calls = spark.sparkContext.accumulator(0)
    real = difflib.SequenceMatcher

    class Counted(real):
        def __init__(self, *a):
            calls.add(1)
            super().__init__(*a)

    monkeypatch.setattr(ids.difflib, "SequenceMatcher", Counted)
    batch = __import__("pyarrow").record_batch([["N123_VO"], ["N123_VO"]], names=["typed", "key"])
    keys = [f"N{a}{b}{c}_V00{v}" for a in range(10) for b in range(10) for c in range(10) for v in range(1, 8)]
    held = type("Held", (), {"value": (keys, keys)})
    assert sum(b.num_rows for b in ids._closest(held, 0.75, 6)(iter([batch]))) >= 6
    assert calls.value < len(keys) / 10
