"""Streams with state of their own: events in order, lost workers and key pools.

All three take a key's events in the order of (ts, event_id), whatever batches they come in: events wait in
the state until the watermark has passed them, then a timer takes them out, first ones first.  So a replay gives
the same rows as the batch forms, however it is cut.  Events behind the watermark are left out by Spark; repeats of
(ts, event_id) count once.  What a key holds is its state and the events of the watermark's delay.

Sessions need the RocksDB state store (``STORE``), which keeps state on disk and checkpoints its changes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

#: A session setting that these streams need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LATE = "10 minutes"


class InOrder(StatefulProcessor):
    """Hands a key's events to ``event`` in order, and calls ``due`` when a deadline that the state names has passed.

    ``own`` is the state's schema and ``new`` its first value; ``payload`` are the columns that are kept of an event.
    """

    own, new, payload, kinds = "n long", (0,), (), ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, event_id long", self.kinds)
        self.state = handle.getValueState("state", self.own)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.us, r.event_id), tuple(r[c] for c in self.payload))
            self.handle.registerTimer(_ms(r.us))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # whatever the watermark has passed is known and cannot change
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        state = list(self.state.get() if self.state.exists() else self.new)
        before = tuple(state)
        for at in sorted(k for k in self.waiting.keys() if k[0] <= until):
            value = self.waiting.getValue(at)
            self.waiting.removeKey(at)
            # a deadline between two events has passed before the second
            yield from self.due(key, state, at[0] - 1)
            yield from self.event(key, state, *at, *value)
        yield from self.due(key, state, until)
        if tuple(state) != before:
            self.state.update(tuple(state))
        deadline = self.deadline(state)
        if deadline is not None and deadline > until:
            self.handle.registerTimer(_ms(deadline))

    def deadline(self, state: list) -> int | None:
        return None

    def due(self, key, state: list, us: int) -> Iterator[Row]:
        return iter(())


def _ms(us: int) -> int:
    return -(-us // 1000)


def _in_order(events: DataFrame, keys: list[str], processor: InOrder, schema: str, late: str) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = e.select(*keys, "ts", F.unix_micros("ts").alias("us"), "event_id", *processor.payload)
    return rows.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime")


# ---- events of a job in order


class _Numbered(InOrder):
    payload, kinds = ("kind",), "kind string"

    def event(self, key, state, us, event_id, kind) -> Iterator[Row]:
        yield Row(job_id=key[0], event_id=event_id, us=us, kind=kind, seq=state[0])
        state[0] += 1


def ordered_events(events: DataFrame, late: str = LATE) -> DataFrame:
    """A stream's events of a job, each once, in order and numbered from 0: job_id, event_id, ts, kind, seq."""
    job = events.schema["job_id"].dataType.simpleString()
    out = _in_order(events, ["job_id"], _Numbered(), f"job_id {job}, event_id long, us long, kind string, seq long", late)
    return out.select("job_id", "event_id", F.timestamp_micros("us").alias("ts"), "kind", "seq")


# ---- workers that fall silent


class _Leases(InOrder):
    """attempts, whether in work, when the lease ends, and the last heartbeat (0: none)."""

    own, new = "attempts long, working boolean, ends long, beat long", (0, False, 0, 0)
    payload, kinds = ("kind",), "kind string"

    def __init__(self, attempts: int, silence: int, lease: int):
        self.attempts, self.silence, self.lease = attempts, silence * 1_000_000, lease * 1_000_000

    def deadline(self, state: list) -> int | None:
        # lost one microsecond after the lease has run out and the last heartbeat is too old
        return max(state[2], state[3] + self.silence if state[3] else 0) + 1 if state[1] else None

    def due(self, key, state: list, us: int) -> Iterator[Row]:
        at = self.deadline(state)
        if at is not None and at <= us:
            state[1] = False
            yield Row(job_id=key[0], attempts=state[0], us=at, status="failed" if state[0] >= self.attempts else "queued")

    def event(self, key, state: list, us: int, event_id: int, kind: str) -> Iterator[Row]:
        state[0] += kind == "started"
        state[1] = kind in ("started", "heartbeat")
        if state[1]:
            state[2] = us + self.lease
        if kind == "heartbeat":
            state[3] = us
        return iter(())


class _Watched(_Leases):
    """Leases by the clock on the wall: events count from when they come in, and a timer needs no other event."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.own)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        state = list(self.state.get() if self.state.exists() else self.new)
        lost = list(self.due(key, state, now))
        for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
            lost += self.event(key, state, now, r.event_id, r.kind)
        self.state.update(tuple(state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[1]:
            self.handle.registerTimer(_ms(self.deadline(state)))
        return iter(lost)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = list(self.state.get())
        yield from self.due(key, state, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self.state.update(tuple(state))


def lost_workers(events: DataFrame, max_attempts: int = 3, silence: int = 45, lease: int = 60, late: str = LATE, clock: str = "events") -> DataFrame:
    """Each time that a job in work is lost: job_id, attempts, at, status.

    A start and each heartbeat grant ``lease`` seconds.  By the events' clock, a timer at their end finds the job lost when
    the watermark reaches it; the batch form is ``telemetry.lost_spells``.  With ``clock`` wall, leases count from when an event
    comes in and end by the time of day, with no further event of any job; each new event of the job sets its timer anew.
    """
    job = events.schema["job_id"].dataType.simpleString()
    schema = f"job_id {job}, attempts long, us long, status string"
    if clock == "wall":
        rows = events.select("job_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "kind")
        out = rows.groupBy("job_id").transformWithState(_Watched(max_attempts, silence, lease), schema, "Append", "ProcessingTime")
    else:
        out = _in_order(events, ["job_id"], _Leases(max_attempts, silence, lease), schema, late)
    return out.select("job_id", "attempts", F.timestamp_micros("us").alias("at"), "status")


# ---- key pools


class _Pool(InOrder):
    """failures in a row and the end of a cooldown (0: none), in microseconds."""

    own, new = "failures long, until long", (0, 0)
    payload, kinds = ("outcome", "custom"), "outcome string, custom double"

    def __init__(self, failures: int, cooldown: float, limited: float):
        self.failures, self.cooldown, self.limited = failures, cooldown, limited

    def deadline(self, state: list) -> int | None:
        return state[1] or None

    def due(self, key, state: list, us: int) -> Iterator[Row]:
        if state[1] and state[1] <= us:
            at, state[0], state[1] = state[1], 0, 0
            yield Row(provider=key[0], key=key[1], us=at, failures=0, until=0)

    def event(self, key, state: list, us: int, event_id: int, outcome: str, custom: float | None) -> Iterator[Row]:
        yield from self.due(key, state, us)
        if outcome == "ok":
            state[:] = 0, 0
        else:
            state[0] += 1
            if outcome == "limited" or state[0] >= self.failures:
                state[1] = us + round((custom or (self.limited if outcome == "limited" else self.cooldown)) * 1_000_000)
        yield Row(provider=key[0], key=key[1], us=us, failures=state[0], until=state[1])


def key_states(calls: DataFrame, failures: int = 3, cooldown: float = 60.0, limited: float = 120.0, late: str = LATE) -> DataFrame:
    """A key's state after each call, and again when a cooldown lapses: provider, key, ts, failures, cooldown_until (or null).

    ``calls`` has provider, key, ts, event_id, outcome (ok, failed or limited) and custom, seconds of cooldown or null.
    """
    provider, key = (calls.schema[c].dataType.simpleString() for c in ("provider", "key"))
    out = _in_order(calls, ["provider", "key"], _Pool(failures, cooldown, limited), f"provider {provider}, key {key}, us long, failures long, until long", late)
    return out.select("provider", "key", F.timestamp_micros("us").alias("ts"), "failures", F.when(F.col("until") > 0, F.timestamp_micros("until")).alias("cooldown_until"))
