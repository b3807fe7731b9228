"""Stream monitors: time-outs by built-in joins and sessions, job states and request limits by keyed state.

Time-outs need no custom state. The last two do, because each decision depends on the accepted ones before it. Rows of a
key wait for the watermark, so the delay bounds what a key holds, and event-time timers empty and remove its state.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from copytrail import constants as C
from copytrail.streaming.limits import admit

#: Slots that the keys of a stream share. A checkpoint keeps the number it was begun with.
SLOTS = 512
SLOT, KEY = "slot", "state_key"


def overdue(opened: DataFrame, closed: DataFrame, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Openings of (key, at) that no closing of (key, at) follows before the deadline.

    A time-bounded outer join: an opening leaves the state with its answer once the watermark has passed its
    deadline, and a closing as soon as no opening can still reach it.
    """
    span = F.expr(f"INTERVAL '{seconds}' SECOND")
    left = opened.withWatermark("at", delay).select("key", "at").alias("o")
    right = closed.withWatermark("at", delay).select("key", "at").alias("c")
    match = (F.col("o.key") == F.col("c.key")) & (F.col("c.at") >= F.col("o.at")) & (F.col("c.at") < F.col("o.at") + span)
    return left.join(right, match, "left_outer").filter(F.col("c.key").isNull()).select(
        F.col("o.key").alias("key"), (F.col("o.at") + span).alias("due_at"))


def deadline_monitor(created: DataFrame, results: DataFrame, seconds: int = C.JOB_TIMEOUT_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Jobs without a result by their deadline, with the failure they get."""
    return overdue(created, results, seconds, delay).select(
        F.col("key").alias("job_id"), "due_at", F.lit("failed").alias("new_status"), F.lit("DEMO_JOB_DEADLINE_EXCEEDED").alias("error_code"))


def orphan_uploads(created: DataFrame, deleted: DataFrame, hours: int = C.RETENTION_HOURS["orphan_upload"], delay: str = "10 minutes") -> DataFrame:
    """Uploads created and not deleted within the orphan window."""
    return overdue(created, deleted, hours * 3600, delay).select(F.col("key").alias("upload_id"), F.col("due_at").alias("eligible_at"))


def stale_monitor(events: DataFrame, minutes: int = C.STALE_MINUTES, delay: str = "10 minutes") -> DataFrame:
    """Silences longer than ``minutes`` per key of (key, at): the end of each activity session."""
    sessions = events.withWatermark("at", delay).groupBy("key", F.session_window("at", f"{minutes} minutes").alias("s"))
    return sessions.agg(F.max("at").alias("last_seen")).select("key", "last_seen", F.col("s.end").alias("stale_at"))


class InEventOrder(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them, and are then handled key by key in ``order``.

    So neither the cut into micro-batches nor the order inside them (up to the watermark's delay) changes a result. Keys share
    slots: a slot's rows and kept values are read and written as lists, a few calls for many keys instead of several for each.
    One event-time timer per slot stands at its earliest waiting row or useless value. ``handle`` gets a key's settled rows and
    its kept value and returns output rows, the value to keep and the time (microseconds) from which it is of no use; then it is removed.
    """

    waiting_type: str
    kept_type: str
    names: tuple[str, ...]

    def handle(self, key: str | None, rows: list[tuple], kept: tuple | None) -> tuple[list[tuple], tuple | None, int]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timers = handle
        self.waiting = handle.getListState("waiting", f"{self.waiting_type}, {KEY} string")
        self.kept = handle.getListState("kept", f"{KEY} string, {self.kept_type}, useless_at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        columns = [*(c.split()[0] for c in self.waiting_type.split(", ")), KEY]
        new = [row for part in rows for row in zip(*(part[c].tolist() for c in columns), strict=True)]
        self.waiting.appendList(new)
        self._wake(min(row[0] for row in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = defaultdict(list), []
        for row in self.waiting.get():
            if row[0] <= mark:
                ready[row[-1]].append(tuple(row[:-1]))
            else:
                rest.append(tuple(row))
        held = {row[0]: tuple(row[1:]) for row in self.kept.get()}
        kept, out = dict(held), []
        for one, own in ready.items():
            past = held.get(one)
            rows, value, useless_at = self.handle(one, sorted(own), past and past[:-1])
            out += rows
            if value is None:
                kept.pop(one, None)
            else:
                kept[one] = (*value, useless_at)
        expected = {row[-1] for row in rest}
        kept = {one: value for one, value in kept.items() if value[-1] > mark or one in expected}
        if ready:
            self._store(self.waiting, rest)
        if kept != held:
            self._store(self.kept, [(one, *value) for one, value in kept.items()])
        due = [row[0] for row in rest] + [value[-1] for value in kept.values() if value[-1] > mark]
        if due:
            self._wake(min(due))
        if out:
            yield pd.DataFrame(out, columns=list(self.names))

    def close(self) -> None:
        pass

    @staticmethod
    def _store(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _wake(self, micros: int) -> None:
        self.timers.registerTimer(micros // 1000 + 1)


class JobStates(InEventOrder):
    """Declared edges move the state, anything else is reported and leaves it alone."""

    waiting_type = "micros bigint, change_id bigint, target string, attempt int"
    kept_type = "status string"
    names = ("job_id", "change_id", "status", "target", "error_code")

    def __init__(self, idle_seconds: int):
        self.idle = idle_seconds * 1_000_000

    def handle(self, key: str | None, rows: list[tuple], kept: tuple | None) -> tuple[list[tuple], tuple | None, int]:
        status, out = kept[0] if kept else None, []
        job = None if key is None else int(key)
        for _, change_id, target, attempt in rows:
            code = self.error(status, target, attempt)
            out.append((job, change_id, status, target, code))
            status = target if code is None else status
        return out, None if status is None else (status,), rows[-1][0] + self.idle

    @staticmethod
    def error(status: str | None, target: str, attempt: int) -> str | None:
        if status is None:
            return None if target == "created" else "JOB_TRANSITION"
        if not 0 <= attempt <= C.MAX_ATTEMPT:
            return "JOB_ATTEMPT"
        if target not in C.JOB_EDGES[status]:
            return "JOB_TRANSITION"
        return "JOB_ATTEMPT" if (status, target) == ("retryable_failed", "queued") and attempt >= C.MAX_ATTEMPT else None


class RequestLimits(InEventOrder):
    """The kept value is the times of the allowed requests inside the window, at most ``limit`` of them."""

    waiting_type = "micros bigint, event_id bigint"
    kept_type = "recent array<bigint>"
    names = ("key", "event_id", "allowed")

    def __init__(self, limit: int, seconds: int):
        self.limit, self.window = limit, seconds * 1_000_000

    def handle(self, key: str | None, rows: list[tuple], kept: tuple | None) -> tuple[list[tuple], tuple | None, int]:
        allowed, recent = admit((r[0] for r in rows), kept[0] if kept else (), self.limit, self.window)
        out = [(key, r[1], a) for r, a in zip(rows, allowed, strict=True)]
        return out, (recent,) if recent else None, (recent[-1] if recent else rows[-1][0]) + self.window


def _real(rows: DataFrame, time: str, row_id: str) -> DataFrame:
    """Rows with an id. The condition names the time, or it would be moved before the watermark, which then missed the others."""
    return rows.filter(F.when(F.col(time).isNotNull(), F.col(row_id).isNotNull()))


def in_event_order(rows: DataFrame, key: str, processor: InEventOrder, output: str) -> DataFrame:
    """The processor over a watermarked stream of (key, micros, ...); keys are carried as text, for pandas has no null integers."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias(SLOT)
    named = rows.select(slot, *[c for c in rows.columns if c != key], F.col(key).cast("string").alias(KEY))
    return named.groupBy(SLOT).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime")


def job_states(changes: DataFrame, delay: str = "0 seconds", idle_seconds: int = 30 * 86400) -> DataFrame:
    """Accepted and rejected changes of (job_id, changed_at, change_id, target, attempt), in the order of their times.

    A change is answered once the watermark has passed it, whatever batch brought it. A job without a change for
    ``idle_seconds`` of event time is forgotten. Rows without a change_id only move the watermark.
    """
    marked = _real(changes.withWatermark("changed_at", delay), "changed_at", "change_id")
    rows = marked.select("job_id", F.unix_micros("changed_at").alias("micros"), "change_id", "target", F.col("attempt").cast("int").alias("attempt"))
    return in_event_order(rows, "job_id", JobStates(idle_seconds), "job_id bigint, change_id bigint, status string, target string, error_code string")


def rate_limit_stream(requests: DataFrame, limit: int, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Admit or deny each request of (key, ts, event_id); only allowed requests count against the limit.

    A request is answered once the watermark has passed it, whatever batch brought it; of equal times the lower event_id is
    first. A key is forgotten when its last allowed request has left the window. Rows without an event_id only move the
    watermark.
    """
    marked = _real(requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay), "ts", "event_id")
    rows = marked.select("key", F.unix_micros("ts").alias("micros"), "event_id")
    return in_event_order(rows, "key", RequestLimits(limit, seconds), "key string, event_id bigint, allowed boolean")
