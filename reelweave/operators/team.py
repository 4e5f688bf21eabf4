"""Team state as folds over an append-only event log.

``log(session, seq, action, name, item_id, value, ts)``: ``seq`` is the processing
order, the last message wins. Every fold is a handful of grouped aggregates with
partial aggregation; the streaming forms are in ``reelweave.streaming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave.operators.ranking import ranked

ONLINE_SECONDS = 12
MAX_PICKS = 16
MAX_HISTORY = 100
MAX_PERSONAL = 60
DEFAULT_COLOUR = "#8b6bff"
MARKS = ("incorrect", "caution")


def _latest(value: Column, when: Column) -> Column:
    """Value of the last row for which ``when`` holds."""
    return F.max_by(value, F.when(when, F.col("seq")))


def after_clear(log: DataFrame, clear: str) -> DataFrame:
    """Messages of each session after its last ``clear`` message."""
    cleared = log.filter(F.col("action") == clear).groupBy("session").agg(F.max("seq").alias("_at"))
    return log.join(cleared, "session", "left").filter(F.col("_at").isNull() | (F.col("seq") > F.col("_at"))).drop("_at")


def presence(log: DataFrame, now: Column) -> DataFrame:
    """Members with their last status and colour; a leave forgets both."""
    msgs = log.filter(F.col("action").isin("heartbeat", "leave") & (F.trim("name") != ""))
    left = msgs.filter("action = 'leave'").groupBy("session", "name").agg(F.max("seq").alias("_left"))
    beats = msgs.filter("action = 'heartbeat'").join(left, ["session", "name"], "left").filter("_left is null or seq > _left")
    said = F.coalesce(F.col("status"), F.lit("")) != ""
    painted = F.coalesce(F.col("colour"), F.lit("")) != ""
    members = beats.groupBy("session", "name").agg(
        F.coalesce(_latest(F.col("status"), said), F.lit("")).alias("status"),
        F.coalesce(_latest(F.col("colour"), painted), F.lit(DEFAULT_COLOUR)).alias("colour"),
        F.max_by("ts", "seq").alias("_seen"),
    )
    ago = F.unix_micros(now) - F.unix_micros(F.col("_seen").cast("timestamp"))
    return members.select(
        "session", "name", "status", "colour", (ago <= ONLINE_SECONDS * 1000000).alias("online"), F.floor(ago / 1000000).alias("seconds_ago")
    )


def picks(log: DataFrame, limit: int = MAX_PICKS) -> DataFrame:
    """Newest pick per (member, frame), newest first."""
    last = log.filter("action = 'pick'").groupBy("session", "name", "item_id").agg(F.max("seq").alias("seq"))
    return ranked(last, ["session"], [F.desc("seq")], limit)


def queue(log: DataFrame) -> DataFrame:
    """Queue items: added and not removed since the last clear, with pin and submit state.

    Adding a present item changes nothing, so its place is its first add after the
    last removal; the newest item comes first.
    """
    live = after_clear(log, "CLEAR_QUEUE").filter(F.col("action") != "CLEAR_QUEUE")
    gone = live.filter("action = 'REMOVE_FRAME'").groupBy("session", "item_id").agg(F.max("seq").alias("_gone"))
    kept = live.join(gone, ["session", "item_id"], "left").filter("_gone is null or seq > _gone")
    added = kept.filter("action = 'ADD_FRAME'").groupBy("session", "item_id").agg(F.min("seq").alias("added"))
    later = kept.join(added, ["session", "item_id"]).filter("seq >= added")
    is_pin = F.col("action") == "TOGGLE_PIN"
    is_done = F.col("action") == "SUBMIT_DONE"
    return later.groupBy("session", "item_id", "added").agg(
        F.coalesce(_latest(F.col("flag"), is_pin), F.lit(False)).alias("pinned"),
        F.coalesce(F.max(is_done), F.lit(False)).alias("done"),
        _latest(F.col("name"), is_done).alias("submitted_by"),
    )


def votes(log: DataFrame) -> DataFrame:
    """Active votes of present queue items: an odd number of toggles since the add."""
    items = queue(log).select("session", "item_id", "added")
    cast = log.filter((F.col("action") == "VOTE_FRAME") & (F.trim("name") != ""))
    toggles = cast.join(items, ["session", "item_id"]).filter("seq > added").groupBy("session", "item_id", "name").agg(F.count(F.lit(1)).alias("_n"))
    return toggles.filter("_n % 2 = 1").groupBy("session", "item_id").agg(F.count("name").alias("n_votes"), F.min("name").alias("first_voter"))


def markings(log: DataFrame) -> DataFrame:
    """Marked frames: the last toggle of each frame since the last clear."""
    live = after_clear(log, "CLEAR_MARKING").filter("action = 'TOGGLE_MARK'")
    last = live.groupBy("session", "item_id").agg(
        F.max_by(F.struct(F.col("value").alias("kind"), F.col("flag").alias("marked")), "seq").alias("_l")
    )
    return last.filter(F.col("_l.marked") & F.col("_l.kind").isin(*MARKS)).select("session", "item_id", F.col("_l.kind").alias("kind"))


def shared_history(log: DataFrame, limit: int = MAX_HISTORY) -> DataFrame:
    live = after_clear(log, "CLEAR_HISTORY").filter("action = 'ADD_HISTORY'")
    return ranked(live.select("session", "seq", "name", "item_id"), ["session"], [F.desc("seq")], limit)


def personal_history(log: DataFrame, limit: int = MAX_PERSONAL) -> DataFrame:
    """Newest distinct (query, task) entries of each member."""
    last = log.filter("action = 'ADD_HISTORY'").groupBy("name", "item_id", "value").agg(F.max("seq").alias("seq"))
    return ranked(last, ["name"], [F.desc("seq")], limit)


def duplicate_answers(answers: DataFrame) -> DataFrame:
    """Answers with the first sender per evaluation; repeats are flagged.

    ``answers(evaluation, answer, name, seq)``.
    """
    first = answers.groupBy("evaluation", "answer").agg(F.min("seq").alias("first_seq"), F.min_by("name", "seq").alias("first_by"))
    return answers.join(first, ["evaluation", "answer"]).withColumn("duplicate", F.col("seq") > F.col("first_seq"))


def shared_answers(answers: DataFrame, limit: int = MAX_HISTORY) -> DataFrame:
    """Newest answers of each evaluation by their first submission."""
    first = answers.groupBy("evaluation", "answer").agg(F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"))
    return ranked(first, ["evaluation"], [F.desc("seq")], limit)


NAMED_ACTIONS = ("CLAIM_STAGE", "PROPOSE_STAGE_FRAME", "VOTE_STAGE_FRAME")


def _stage_parts(log: DataFrame) -> dict[str, DataFrame]:
    """Stages, active claims, candidates, active votes and locks of every session."""
    nameless = F.col("action").isin(*NAMED_ACTIONS) & (F.trim(F.coalesce("name", F.lit(""))) == "")
    live = after_clear(log, "CLEAR_TRAKE").filter(~nameless)
    key = ["session", "item_id"]
    stages = live.filter(F.col("action").isin("ADD_STAGE", "REMOVE_STAGE")).groupBy(*key).agg(
        F.max_by("action", "seq").alias("_last"), F.max(F.when(F.col("action") == "ADD_STAGE", F.col("seq"))).alias("_since")
    ).filter("_last = 'ADD_STAGE'").select(*key, "_since")
    msgs = live.join(stages, key).filter("seq >= _since")
    claims = msgs.filter("action = 'CLAIM_STAGE'").groupBy(*key, "name").agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1")
    cand = [*key, "value"]
    proposed = msgs.filter(F.col("action").isin("PROPOSE_STAGE_FRAME", "REMOVE_STAGE_FRAME")).groupBy(*cand).agg(
        F.max_by("action", "seq").alias("_last"), F.max(F.when(F.col("action") == "PROPOSE_STAGE_FRAME", F.col("seq"))).alias("_p")
    ).filter("_last = 'PROPOSE_STAGE_FRAME'").select(*cand, "_p")
    ballots = msgs.filter(F.col("action").isin("PROPOSE_STAGE_FRAME", "VOTE_STAGE_FRAME")).join(proposed, cand).filter("seq >= _p")
    active = ballots.groupBy(*cand, "name").agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1")
    locks = msgs.filter(F.col("action").isin("LOCK_STAGE_FRAME", "UNLOCK_STAGE_FRAME")).groupBy(*key).agg(
        F.max_by(F.struct("action", "value"), "seq").alias("_l")
    ).filter("_l.action = 'LOCK_STAGE_FRAME'").select(*key, F.col("_l.value").alias("value"))
    return {
        "stage": stages.select(*key),
        "claim": claims.select(*key, "name"),
        "candidate": proposed.select(*cand),
        "vote": active.select(*cand, "name"),
        "lock": locks,
    }


def stage_board(log: DataFrame) -> DataFrame:
    """Stage coordination: per stage its assignees, candidates, votes and locked candidate.

    Uses ``item_id`` as stage and ``value`` as candidate. The proposer's own vote counts
    as one toggle; a lock holds while its candidate is present. Claims, proposals and votes without
    a name do not count.
    """
    parts, key = _stage_parts(log), ["session", "item_id"]
    cand = [*key, "value"]
    assignees = parts["claim"].groupBy(*key).agg(F.count("name").alias("n_assignees"))
    votes_of = parts["vote"].groupBy(*cand).agg(F.count("name").alias("_v"))
    boards = parts["candidate"].join(votes_of, cand, "left").groupBy(*key).agg(
        F.count("value").alias("n_candidates"), F.sum(F.coalesce("_v", F.lit(0))).alias("n_votes")
    )
    locked = parts["lock"].join(parts["candidate"], cand, "left_semi").withColumnRenamed("value", "locked_candidate")
    out = parts["stage"].join(assignees, key, "left").join(boards, key, "left").join(locked, key, "left")
    return out.fillna({"n_assignees": 0, "n_candidates": 0, "n_votes": 0})


def stage_snapshot(log: DataFrame) -> DataFrame:
    """State of all boards as rows, to start a stream from: ``session, kind, item_id, value, name``."""
    rows = [part.withColumn("kind", F.lit(kind)) for kind, part in _stage_parts(log).items()]
    video = locked_video(log).select("session", F.lit(None).cast("string").alias("item_id"), F.col("video_id").alias("value"), F.col("locked_by").alias("name"), F.lit("video").alias("kind"))
    out = video
    for part in rows:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select("session", "kind", "item_id", "value", "name")


def locked_video(log: DataFrame) -> DataFrame:
    """Video a session has locked: the last key, if not unlocked or cleared since."""
    acts = log.filter(F.col("action").isin("MAKE_KEY", "UNLOCK_VIDEO", "CLEAR_TRAKE"))
    last = acts.groupBy("session").agg(F.max_by(F.struct("action", "value", "name"), "seq").alias("_l"))
    return last.filter("_l.action = 'MAKE_KEY'").select("session", F.col("_l.value").alias("video_id"), F.col("_l.name").alias("locked_by"))
