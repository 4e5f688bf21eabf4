"""Streaming forms: presence, queue, picks, histories, markings and stage boards as keyed state, duplicate-answer guard, continuous retrieval."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from reelweave.operators.team import DEFAULT_COLOUR, MARKS, MAX_HISTORY, MAX_PERSONAL, MAX_PICKS, NAMED_ACTIONS, ONLINE_SECONDS

QUEUE_OUTPUT = "session STRING, item_id STRING, added BIGINT, pinned BOOLEAN, done BOOLEAN, submitted_by STRING, voters ARRAY<STRING>, present BOOLEAN"


class QueueState(StatefulProcessor):
    """Queue of one session as map state; emits every item a batch has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._items = handle.getMapState(
            "items", "item_id STRING", "added BIGINT, pinned BOOLEAN, done BOOLEAN, submitted_by STRING, voters ARRAY<STRING>"
        )

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        session = key[0]
        batch = pd.concat(list(rows)).sort_values("seq")
        changed: dict[str, None] = {}
        for r in batch.itertuples(index=False):
            if r.action == "CLEAR_QUEUE":
                for (item,) in list(self._items.keys()):
                    changed[item] = None
                self._items.clear()
                continue
            k = (r.item_id,)
            if r.action == "ADD_FRAME":
                if not self._items.containsKey(k):
                    self._items.updateValue(k, (int(r.seq), False, False, None, []))
                    changed[r.item_id] = None
                continue
            if not self._items.containsKey(k):
                continue
            added, pinned, done, by, voters = self._items.getValue(k)
            changed[r.item_id] = None
            if r.action == "REMOVE_FRAME":
                self._items.removeKey(k)
                continue
            if r.action == "TOGGLE_PIN":
                pinned = bool(r.flag)
            elif r.action == "SUBMIT_DONE":
                done, by = True, r.name
            elif r.action == "VOTE_FRAME":
                if not (r.name or "").strip():
                    continue  # a vote without a name does not count
                names = set(voters)
                names ^= {r.name}
                voters = sorted(names)
            self._items.updateValue(k, (added, pinned, done, by, voters))
        out = []
        for item in changed:
            if self._items.containsKey((item,)):
                out.append((session, item, *self._items.getValue((item,)), True))
            else:
                out.append((session, item, None, None, None, None, None, False))
        columns = ["session", "item_id", "added", "pinned", "done", "submitted_by", "voters", "present"]
        yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass


def queue_stream(log: DataFrame) -> DataFrame:
    """Changed queue items per micro-batch; needs the RocksDB state store."""
    return log.groupBy("session").transformWithStateInPandas(
        statefulProcessor=QueueState(), outputStructType=QUEUE_OUTPUT, outputMode="Update", timeMode="None"
    )


PRESENCE_OUTPUT = "session STRING, name STRING, status STRING, colour STRING, online BOOLEAN, seen BIGINT"


class PresenceState(StatefulProcessor):
    """Presence of one member: the last heartbeat, and a timer that tells of silence.

    Emits the member after every batch with messages, and once more, offline, when no
    heartbeat has come for ``online_seconds``. A leave forgets the member. With event time the
    watermark is the clock and messages carry their time; else the clock is the cluster's.
    """

    def __init__(self, online_seconds: int, event_time: bool):
        self._window = online_seconds * 1000
        self._event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._member = handle.getValueState("member", "status STRING, colour STRING, seen BIGINT")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        session, name = key
        batch = pd.concat(list(rows)).sort_values("seq")
        known = self._member.get() if self._member.exists() else None
        was_known = known is not None
        for r in batch.itertuples(index=False):
            if r.action == "leave":
                known = None
                continue
            status, colour, _ = known or ("", DEFAULT_COLOUR, 0)
            at = int(pd.Timestamp(r.ts).value // 1_000_000) if self._event_time else timerValues.getCurrentProcessingTimeInMs()
            known = (r.status or status, r.colour or colour, at)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if known is None:
            self._member.clear()
            if was_known:
                yield self._row(session, name, None, None, None, None)
            return
        self._member.update(known)
        self._handle.registerTimer(known[2] + self._window + 1)
        yield self._row(session, name, known[0], known[1], True, known[2])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self._member.exists():
            status, colour, seen = self._member.get()
            yield self._row(*key, status, colour, False, seen)

    @staticmethod
    def _row(*values: Any) -> pd.DataFrame:
        return pd.DataFrame([values], columns=["session", "name", "status", "colour", "online", "seen"])

    def close(self) -> None:
        pass


def presence_stream(log: DataFrame, online_seconds: int = ONLINE_SECONDS, event_time: bool = False, delay: str = "0 seconds") -> DataFrame:
    """Changes of presence from ``log(session, name, seq, action, status, colour, ts)``.

    ``online`` is null for a member that has left. Needs the RocksDB state store.
    """
    msgs = log.filter(F.col("action").isin("heartbeat", "leave") & (F.trim("name") != ""))
    if event_time:
        msgs = msgs.withWatermark("ts", delay)
    return msgs.groupBy("session", "name").transformWithStateInPandas(
        statefulProcessor=PresenceState(online_seconds, event_time), outputStructType=PRESENCE_OUTPUT, outputMode="Update", timeMode="EventTime" if event_time else "ProcessingTime"
    )


RECENT_OUTPUT = "owner STRING, place INT, name STRING, item_id STRING, value STRING, seq BIGINT, present BOOLEAN"


class RecentList(StatefulProcessor):
    """The newest entries of one owner, an entry being what its columns say.

    What falls behind the limit is dropped: only a new message can bring it back. Emits every
    place of a list that a batch has changed, and places that are empty since as not present.
    """

    def __init__(self, limit: int, entry: tuple[str, ...], clear: str | None):
        self._limit = limit
        self._entry = entry
        self._clear = clear

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._rows = handle.getMapState("rows", "entry STRING", "name STRING, item_id STRING, value STRING, seq BIGINT")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq").astype(object)
        batch = batch.where(batch.notna(), None)
        entries = {k[0]: tuple(v) for k, v in self._rows.iterator()}
        places = len(entries)
        for r in batch.itertuples(index=False):
            if r.action == self._clear:
                entries = {}
                continue
            entry = json.dumps([str(getattr(r, c)) if getattr(r, c) is not None else None for c in self._entry])
            entries[entry] = (r.name, r.item_id, r.value, int(r.seq))
        kept = sorted(entries.items(), key=lambda e: -e[1][3])[: self._limit]
        self._rows.clear()
        for entry, row in kept:
            self._rows.updateValue((entry,), row)
        out = [(key[0], i, *row, True) for i, (_, row) in enumerate(kept, start=1)]
        out += [(key[0], i, None, None, None, None, False) for i in range(len(kept) + 1, places + 1)]
        frame = pd.DataFrame(out, columns=["owner", "place", "name", "item_id", "value", "seq", "present"])
        yield frame.astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def _recent(log: DataFrame, owner: str, add: str, limit: int, entry: tuple[str, ...], clear: str | None = None) -> DataFrame:
    actions = [add] if clear is None else [add, clear]
    return log.filter(F.col("action").isin(*actions)).groupBy(owner).transformWithStateInPandas(
        statefulProcessor=RecentList(limit, entry, clear), outputStructType=RECENT_OUTPUT, outputMode="Update", timeMode="None"
    )


def picks_stream(log: DataFrame, limit: int = MAX_PICKS) -> DataFrame:
    """Newest pick per (member, frame) of each session, by place; needs the RocksDB state store."""
    return _recent(log, "session", "pick", limit, ("name", "item_id"))


def history_stream(log: DataFrame, limit: int = MAX_HISTORY) -> DataFrame:
    """Shared history of each session since its last clear, by place."""
    return _recent(log, "session", "ADD_HISTORY", limit, ("seq",), "CLEAR_HISTORY")


def personal_history_stream(log: DataFrame, limit: int = MAX_PERSONAL) -> DataFrame:
    """Newest distinct (query, task) entries of each member, by place."""
    return _recent(log, "name", "ADD_HISTORY", limit, ("item_id", "value"))


MARKING_OUTPUT = "session STRING, item_id STRING, kind STRING, present BOOLEAN"


class Markings(StatefulProcessor):
    """Marked frames of one session as map state; emits every frame a batch has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kinds = handle.getMapState("kinds", "item_id STRING", "kind STRING")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq").astype(object)
        batch = batch.where(batch.notna(), None)
        changed: dict[str, str | None] = {}
        for r in batch.itertuples(index=False):
            if r.action == "CLEAR_MARKING":
                changed |= {k[0]: None for k in self._kinds.keys()} | dict.fromkeys(changed)
                self._kinds.clear()
                continue
            marked = bool(r.flag) and r.value in MARKS
            changed[r.item_id] = r.value if marked else None
            if marked:
                self._kinds.updateValue((r.item_id,), (r.value,))
            elif self._kinds.containsKey((r.item_id,)):
                self._kinds.removeKey((r.item_id,))
        out = [(key[0], item, kind, kind is not None) for item, kind in changed.items()]
        yield pd.DataFrame(out, columns=["session", "item_id", "kind", "present"])

    def close(self) -> None:
        pass


def markings_stream(log: DataFrame) -> DataFrame:
    """Changed markings per micro-batch; needs the RocksDB state store."""
    return log.filter(F.col("action").isin("TOGGLE_MARK", "CLEAR_MARKING")).groupBy("session").transformWithStateInPandas(
        statefulProcessor=Markings(), outputStructType=MARKING_OUTPUT, outputMode="Update", timeMode="None"
    )


STAGE_OUTPUT = "session STRING, item_id STRING, n_assignees BIGINT, n_candidates BIGINT, n_votes BIGINT, locked_candidate STRING, locked_video STRING, present BOOLEAN"


class StageBoard(StatefulProcessor):
    """Stage board of one session: stages, claims, candidates, votes, locks and the locked video.

    States are maps under composite keys, so a message touches only its own entries.
    Emits the stages a batch has changed, all of them after a change of the locked video. Starts from the rows of
    ``operators.team.stage_snapshot`` where those are given.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._stages = handle.getMapState("stages", "item_id STRING", "known BOOLEAN")
        self._claims = handle.getMapState("claims", "item_id STRING, name STRING", "known BOOLEAN")
        self._candidates = handle.getMapState("candidates", "item_id STRING, value STRING", "known BOOLEAN")
        self._votes = handle.getMapState("votes", "item_id STRING, value STRING, name STRING", "known BOOLEAN")
        self._locks = handle.getMapState("locks", "item_id STRING", "value STRING")
        self._video = handle.getValueState("video", "video_id STRING, locked_by STRING")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for r in initialState.itertuples(index=False):
            if r.kind == "stage":
                self._stages.updateValue((r.item_id,), (True,))
            elif r.kind == "claim":
                self._claims.updateValue((r.item_id, r.name), (True,))
            elif r.kind == "candidate":
                self._candidates.updateValue((r.item_id, r.value), (True,))
            elif r.kind == "vote":
                self._votes.updateValue((r.item_id, r.value, r.name), (True,))
            elif r.kind == "lock":
                self._locks.updateValue((r.item_id,), (r.value,))
            else:
                self._video.update((r.value, r.name))

    @staticmethod
    def _toggle(state: Any, key: tuple) -> None:
        if state.containsKey(key):
            state.removeKey(key)
        else:
            state.updateValue(key, (True,))

    @staticmethod
    def _forget(state: Any, prefix: tuple) -> None:
        for key in [k for k in state.keys() if tuple(k)[: len(prefix)] == prefix]:
            state.removeKey(key)

    def _apply(self, r: Any) -> bool:
        """Apply one message; whether it counts."""
        stage, cand, name = r.item_id, r.value, r.name
        if r.action == "ADD_STAGE" or r.action == "REMOVE_STAGE":
            for state in (self._claims, self._candidates, self._votes, self._locks):
                self._forget(state, (stage,))
            if r.action == "ADD_STAGE":
                self._stages.updateValue((stage,), (True,))
            elif self._stages.containsKey((stage,)):
                self._stages.removeKey((stage,))
            return True
        if not self._stages.containsKey((stage,)):
            return False
        if r.action in NAMED_ACTIONS and not (name or "").strip():
            return False
        if r.action == "CLAIM_STAGE":
            self._toggle(self._claims, (stage, name))
        elif r.action == "PROPOSE_STAGE_FRAME":
            self._forget(self._votes, (stage, cand))
            self._candidates.updateValue((stage, cand), (True,))
            self._votes.updateValue((stage, cand, name), (True,))
        elif r.action == "VOTE_STAGE_FRAME":
            if not self._candidates.containsKey((stage, cand)):
                return False
            self._toggle(self._votes, (stage, cand, name))
        elif r.action == "REMOVE_STAGE_FRAME":
            if self._candidates.containsKey((stage, cand)):
                self._candidates.removeKey((stage, cand))
            self._forget(self._votes, (stage, cand))
        elif r.action == "LOCK_STAGE_FRAME":
            self._locks.updateValue((stage,), (cand,))
        elif r.action == "UNLOCK_STAGE_FRAME":
            if self._locks.containsKey((stage,)):
                self._locks.removeKey((stage,))
        else:
            return False
        return True

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq").astype(object)
        batch = batch.where(batch.notna(), None)
        changed: dict[str, None] = {}
        for r in batch.itertuples(index=False):
            if r.action == "CLEAR_TRAKE":
                changed |= dict.fromkeys(k[0] for k in self._stages.keys())
                for state in (self._stages, self._claims, self._candidates, self._votes, self._locks, self._video):
                    state.clear()
            elif r.action in ("MAKE_KEY", "UNLOCK_VIDEO"):
                if r.action == "MAKE_KEY":
                    self._video.update((r.value, r.name))
                else:
                    self._video.clear()
                changed |= dict.fromkeys(k[0] for k in self._stages.keys())
            elif self._apply(r):
                changed[r.item_id] = None
        video = self._video.get()[0] if self._video.exists() else None
        claims, votes = Counter(k[0] for k in self._claims.keys()), Counter(k[0] for k in self._votes.keys())
        candidates = Counter(k[0] for k in self._candidates.keys())
        out = []
        for stage in changed:
            if not self._stages.containsKey((stage,)):
                out.append((key[0], stage, 0, 0, 0, None, video, False))
                continue
            locked = self._locks.getValue((stage,))[0] if self._locks.containsKey((stage,)) else None
            if locked is not None and not self._candidates.containsKey((stage, locked)):
                locked = None
            out.append((key[0], stage, claims[stage], candidates[stage], votes[stage], locked, video, True))
        yield pd.DataFrame(out, columns=["session", "item_id", "n_assignees", "n_candidates", "n_votes", "locked_candidate", "locked_video", "present"])

    def close(self) -> None:
        pass


def stage_stream(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Changed stages per micro-batch; needs the RocksDB state store.

    ``snapshot`` (``stage_snapshot`` of an older log) is where a new query starts from.
    """
    start = None if snapshot is None else snapshot.groupBy("session")
    return log.groupBy("session").transformWithStateInPandas(
        statefulProcessor=StageBoard(), outputStructType=STAGE_OUTPUT, outputMode="Update", timeMode="None", initialState=start
    )


def first_answers(answers: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Stream of answers with repeats of (evaluation, answer) inside the horizon removed."""
    return answers.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["evaluation", "answer"])


def continuous_search(queries: DataFrame, search: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Answer queries as they arrive: each micro-batch runs the batch operators over the
    corpus tables and writes its results into its own folder, so a replayed batch
    replaces its output."""

    def answer(batch: DataFrame, epoch: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
