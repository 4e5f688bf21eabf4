"""Team state queries over an event log derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelweave.catalog import standins as st
from reelweave.catalog.registry import cte, query
from reelweave.operators import team as tm

# How the log is derived: session by user, action by event type, item from the payload.
QUEUE_ACTIONS = {"view": "ADD_FRAME", "click": "VOTE_FRAME", "purchase": "SUBMIT_DONE", "error": "REMOVE_FRAME"}


def team_log(spark, d, actions, clear, rest):
    """Log rows; sign-ups with payload 50 clear, the others are ``rest``."""
    t = st.timeline(spark, d)
    k = F.get_json_object("props", "$.k").cast("bigint")
    signup = F.col("event_type") == "signup"
    action = F.when(signup & (k == 50), clear).when(signup, rest or "none").otherwise("none")
    for kind, name in actions.items():
        action = F.when(F.col("event_type") == kind, name).otherwise(action)
    return t.select(
        F.concat(F.lit("S"), F.pmod("user_id", F.lit(10))).alias("session"),
        F.col("event_id").alias("seq"),
        action.alias("action"),
        F.concat(F.lit("u"), F.floor(F.col("user_id") / 30)).alias("name"),
        F.concat(F.lit("f"), F.pmod(k, F.lit(20))).alias("item_id"),
        (k > 40).alias("flag"),
        F.when(k < 30, "incorrect").when(k < 60, "caution").otherwise("other").alias("value"),
        F.when(k < 25, "").otherwise(F.concat(F.lit("s"), k)).alias("status"),
        F.when(k > 75, F.concat(F.lit("#"), k)).alias("colour"),
        "ts",
        "event_type",
        k.alias("k"),
    )


def queue_log(spark, d):
    return team_log(spark, d, QUEUE_ACTIONS, "CLEAR_QUEUE", "TOGGLE_PIN")


cte(
    "log0",
    """SELECT 'S' || (user_id % 10) AS session, event_id AS seq, event_type, k, 'u' || (user_id // 30) AS name, 'f' || (k % 20) AS item_id, k > 40 AS flag,
  CASE WHEN k < 30 THEN 'incorrect' WHEN k < 60 THEN 'caution' ELSE 'other' END AS value, CASE WHEN k < 25 THEN '' ELSE 's' || k END AS status, CASE WHEN k > 75 THEN '#' || k END AS colour, ts
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
cte(
    "queue_log",
    """SELECT *, CASE event_type WHEN 'view' THEN 'ADD_FRAME' WHEN 'click' THEN 'VOTE_FRAME' WHEN 'purchase' THEN 'SUBMIT_DONE' WHEN 'error' THEN 'REMOVE_FRAME' ELSE CASE WHEN k = 50 THEN 'CLEAR_QUEUE' ELSE 'TOGGLE_PIN' END END AS action FROM log0""",
    "log0",
)
cte(
    "queue_kept",
    """SELECT l.* FROM queue_log l LEFT JOIN (SELECT session, max(seq) AS c FROM queue_log WHERE action = 'CLEAR_QUEUE' GROUP BY 1) c USING (session)
LEFT JOIN (SELECT session, item_id, max(seq) AS g FROM queue_log WHERE action = 'REMOVE_FRAME' GROUP BY ALL) g ON g.session = l.session AND g.item_id = l.item_id
WHERE (c IS NULL OR seq > c) AND (g IS NULL OR seq > g) AND action <> 'CLEAR_QUEUE'""",
    "queue_log",
)
cte(
    "queue_state",
    """SELECT k.session, k.item_id, added, coalesce(arg_max(flag, seq) FILTER (action = 'TOGGLE_PIN'), false) AS pinned, count(*) FILTER (action = 'SUBMIT_DONE') > 0 AS done, arg_max(name, seq) FILTER (action = 'SUBMIT_DONE') AS submitted_by
FROM queue_kept k JOIN (SELECT session, item_id, min(seq) AS added FROM queue_kept WHERE action = 'ADD_FRAME' GROUP BY ALL) a USING (session, item_id) WHERE seq >= added GROUP BY ALL""",
    "queue_kept",
)


@query("team_queue", "SELECT * FROM queue_state", ("queue_state",))
def team_queue(spark, d):
    return tm.queue(queue_log(spark, d))


@query(
    "team_votes",
    """SELECT session, item_id, count(*) AS n_votes, min(name) AS first_voter FROM (
  SELECT q.session, q.item_id, l.name, count(*) AS n FROM queue_state q JOIN queue_log l ON l.session = q.session AND l.item_id = q.item_id AND l.action = 'VOTE_FRAME' AND l.seq > q.added GROUP BY ALL) WHERE n % 2 = 1 GROUP BY ALL""",
    ("queue_state", "queue_log"),
)
def team_votes(spark, d):
    return tm.votes(queue_log(spark, d))


@query(
    "team_presence",
    """SELECT b.session, b.name, coalesce(arg_max(status, seq) FILTER (status <> ''), '') AS status, coalesce(arg_max(colour, seq) FILTER (colour <> ''), '#8b6bff') AS colour,
  epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(arg_max(ts, seq)) <= 12000000 AS online, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(arg_max(ts, seq))) / 1000000) AS BIGINT) AS seconds_ago
FROM (SELECT * FROM log0 WHERE event_type IN ('view', 'click', 'purchase')) b LEFT JOIN (SELECT session, name, max(seq) AS g FROM log0 WHERE event_type = 'error' GROUP BY ALL) g USING (session, name) WHERE g IS NULL OR seq > g GROUP BY ALL""",
    ("log0",),
)
def team_presence(spark, d):
    log = team_log(spark, d, {"view": "heartbeat", "click": "heartbeat", "purchase": "heartbeat", "error": "leave"}, "none", None)
    return tm.presence(log, F.to_timestamp(F.lit("2024-01-31 00:00:00")))


@query(
    "team_picks",
    """SELECT session, name, item_id, seq, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS n FROM (
  SELECT session, name, item_id, max(seq) AS seq FROM log0 WHERE event_type = 'click' GROUP BY ALL)) WHERE n <= 16""",
    ("log0",),
)
def team_picks(spark, d):
    return tm.picks(team_log(spark, d, {"click": "pick"}, "none", None))


@query(
    "team_markings",
    """SELECT session, item_id, kind FROM (SELECT session, item_id, arg_max(value, seq) AS kind, arg_max(flag, seq) AS m FROM log0 l LEFT JOIN (SELECT session, max(seq) AS c FROM log0 WHERE event_type = 'signup' AND k = 50 GROUP BY 1) USING (session)
  WHERE event_type = 'view' AND (c IS NULL OR seq > c) GROUP BY ALL) WHERE m AND kind IN ('incorrect', 'caution')""",
    ("log0",),
)
def team_markings(spark, d):
    return tm.markings(team_log(spark, d, {"view": "TOGGLE_MARK"}, "CLEAR_MARKING", None))


@query(
    "team_history",
    """SELECT session, seq, name, item_id, CAST(n AS INTEGER) AS rank FROM (SELECT l.*, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS n FROM log0 l LEFT JOIN (SELECT session, max(seq) AS c FROM log0 WHERE event_type = 'signup' AND k = 50 GROUP BY 1) USING (session)
  WHERE event_type = 'view' AND (c IS NULL OR seq > c)) WHERE n <= 100""",
    ("log0",),
)
def team_history(spark, d):
    return tm.shared_history(team_log(spark, d, {"view": "ADD_HISTORY"}, "CLEAR_HISTORY", None))


@query(
    "personal_history",
    """SELECT name, item_id, value, seq, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS n FROM (SELECT name, item_id, value, max(seq) AS seq FROM log0 WHERE event_type = 'view' GROUP BY ALL)) WHERE n <= 60""",
    ("log0",),
)
def personal_history(spark, d):
    return tm.personal_history(team_log(spark, d, {"view": "ADD_HISTORY"}, "none", None))


def answers(spark, d):
    log = team_log(spark, d, {"purchase": "answer"}, "none", None).filter("action = 'answer'")
    return log.select(F.col("session").alias("evaluation"), F.concat("item_id", "value").alias("answer"), "name", "seq", "ts")


@query(
    "duplicate_answers",
    """SELECT session AS evaluation, item_id || value AS answer, name, seq, min(seq) OVER w AS first_seq, first_value(name) OVER (PARTITION BY session, item_id || value ORDER BY seq) AS first_by, seq > min(seq) OVER w AS duplicate
FROM log0 WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY session, item_id || value)""",
    ("log0",),
)
def duplicate_answers(spark, d):
    return tm.duplicate_answers(answers(spark, d)).drop("ts")


@query(
    "shared_answers",
    """SELECT evaluation, answer, seq, name, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY evaluation ORDER BY seq DESC) AS n FROM (
  SELECT session AS evaluation, item_id || value AS answer, min(seq) AS seq, arg_min(name, seq) AS name FROM log0 WHERE event_type = 'purchase' GROUP BY ALL)) WHERE n <= 100""",
    ("log0",),
)
def shared_answers(spark, d):
    return tm.shared_answers(answers(spark, d))


def stage_log(spark, d):
    """Stage messages: the payload picks among claims, votes, locks and removals."""
    log = team_log(spark, d, {"view": "PROPOSE_STAGE_FRAME", "click": "VOTE_STAGE_FRAME", "purchase": "CLAIM_STAGE"}, "CLEAR_TRAKE", "ADD_STAGE")
    k = F.pmod(F.col("seq"), F.lit(4))
    lock = F.when(k == 0, "LOCK_STAGE_FRAME").when(k == 1, "UNLOCK_STAGE_FRAME").when(k == 2, "REMOVE_STAGE_FRAME").otherwise("MAKE_KEY")
    return log.withColumn("action", F.when(F.col("action") == "none", lock).otherwise(F.col("action")))


cte(
    "stage_live",
    """SELECT l.* FROM (SELECT session, seq, name, item_id, value, CASE event_type WHEN 'view' THEN 'PROPOSE_STAGE_FRAME' WHEN 'click' THEN 'VOTE_STAGE_FRAME' WHEN 'purchase' THEN 'CLAIM_STAGE' WHEN 'signup' THEN CASE WHEN k = 50 THEN 'CLEAR_TRAKE' ELSE 'ADD_STAGE' END
  ELSE CASE seq % 4 WHEN 0 THEN 'LOCK_STAGE_FRAME' WHEN 1 THEN 'UNLOCK_STAGE_FRAME' WHEN 2 THEN 'REMOVE_STAGE_FRAME' ELSE 'MAKE_KEY' END END AS action FROM log0) l
LEFT JOIN (SELECT session, max(seq) AS c FROM log0 WHERE event_type = 'signup' AND k = 50 GROUP BY 1) USING (session) WHERE c IS NULL OR seq > c""",
    "log0",
)
cte(
    "stage_msgs",
    "SELECT m.* FROM stage_live m JOIN (SELECT session, item_id, max(seq) AS since FROM stage_live WHERE action = 'ADD_STAGE' GROUP BY ALL) s USING (session, item_id) WHERE seq >= since",
    "stage_live",
)
cte(
    "stage_cands",
    """SELECT session, item_id, value, p FROM (SELECT session, item_id, value, arg_max(action, seq) AS a, max(seq) FILTER (action = 'PROPOSE_STAGE_FRAME') AS p FROM stage_msgs
WHERE action IN ('PROPOSE_STAGE_FRAME', 'REMOVE_STAGE_FRAME') GROUP BY ALL) WHERE a = 'PROPOSE_STAGE_FRAME'""",
    "stage_msgs",
)


@query(
    "team_stage_board",
    """SELECT s.session, s.item_id, coalesce(n_assignees, 0) AS n_assignees, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_votes, 0)::BIGINT AS n_votes, locked_candidate FROM (SELECT DISTINCT session, item_id FROM stage_msgs) s
LEFT JOIN (SELECT session, item_id, count(*) AS n_assignees FROM (SELECT session, item_id, name FROM stage_msgs WHERE action = 'CLAIM_STAGE' GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY ALL) a USING (session, item_id)
LEFT JOIN (SELECT session, item_id, count(*) AS n_candidates FROM stage_cands GROUP BY ALL) c USING (session, item_id)
LEFT JOIN (SELECT session, item_id, count(*) AS n_votes FROM (SELECT m.session, m.item_id, m.value, name FROM stage_msgs m JOIN stage_cands c USING (session, item_id, value) WHERE action IN ('PROPOSE_STAGE_FRAME', 'VOTE_STAGE_FRAME') AND seq >= p
  GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY ALL) v USING (session, item_id)
LEFT JOIN (SELECT l.session, l.item_id, l.value AS locked_candidate FROM (SELECT session, item_id, arg_max(value, seq) AS value, arg_max(action, seq) AS a FROM stage_msgs WHERE action IN ('LOCK_STAGE_FRAME', 'UNLOCK_STAGE_FRAME') GROUP BY ALL) l
  JOIN stage_cands USING (session, item_id, value) WHERE a = 'LOCK_STAGE_FRAME') l USING (session, item_id)""",
    ("stage_msgs", "stage_cands"),
)
def team_stage_board(spark, d):
    return tm.stage_board(stage_log(spark, d))


@query(
    "team_locked_video",
    """SELECT session, video_id, locked_by FROM (SELECT session, arg_max(value, seq) AS video_id, arg_max(name, seq) AS locked_by, arg_max(a, seq) AS a FROM (
  SELECT *, CASE WHEN event_type = 'error' THEN 'MAKE_KEY' WHEN event_type = 'purchase' AND k < 3 THEN 'UNLOCK_VIDEO' WHEN event_type = 'signup' AND k = 50 THEN 'CLEAR_TRAKE' END AS a FROM log0) WHERE a IS NOT NULL GROUP BY session) WHERE a = 'MAKE_KEY'""",
    ("log0",),
)
def team_locked_video(spark, d):
    log = team_log(spark, d, {"error": "MAKE_KEY"}, "CLEAR_TRAKE", None)
    unlock = (F.col("event_type") == "purchase") & (F.col("k") < 3)
    return tm.locked_video(log.withColumn("action", F.when(unlock, "UNLOCK_VIDEO").otherwise(F.col("action"))))
