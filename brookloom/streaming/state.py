"""Keyed state with timers on streams: folds in order of time, a cache that forgets, a queue of retries, states of fragments.

A stream may bring events of a key in any order. Each operator here holds a key's rows until the watermark has passed them,
takes them in order of time then, and sets timers for what falls due without a new row. What comes out is thus that of the
batch operator over the same rows, however they were cut into micro-batches, and a restart from a checkpoint goes on as
if there had been none. Rows that come later than the watermark allows are dropped by Spark; rows that the watermark has
not passed when a stream ends wait in its state.

State of a key: the rows of one watermark delay, and what the operator says. ``timed`` names the state store this needs.

Defined results: rows without a time are dropped; events of equal time go by the order that each operator names; null keys
are one key; empty streams give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brookloom.operators.cache import DEFAULT_TTL_MS
from brookloom.operators.tracks import DONE, FAILED, PENDING, SENT
from brookloom.streaming.sessions import Step, throttle_step, tap_step

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(spark: SparkSession) -> SparkSession:
    """The session, with the state store that timers need for the streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class InOrder(StatefulProcessor):
    """Takes a key's rows in order once the watermark has passed them. ``columns``: those of the rows, ``ts_ms`` first among
    those that order them."""

    def __init__(self, schema: str, order: list[str]):
        self.schema, self.order = schema, order
        self.columns, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
        self.whole = [k == "long" for k in kinds]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Open further state."""

    def fold(self, key: tuple, rows: Iterator[dict]) -> list[tuple]:
        """What comes out of the rows, in order."""
        raise NotImplementedError

    def due(self, key: tuple, now: int) -> list[tuple]:
        """What falls due up to ``now`` without a row."""
        return []

    def made(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.out).astype(self.kinds)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[list(self.columns)]
        # Whole numbers stand as floating-point ones beside nulls.
        records = [tuple(None if x is None or x != x else int(x) if w else x for x, w in zip(r, self.whole, strict=True)) for r in new.itertuples(index=False)]
        self.waiting.appendList(records)
        self.handle.registerTimer(max(r[self.columns.index("ts_ms")] for r in records))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [dict(zip(self.columns, r, strict=True)) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in held if r["ts_ms"] <= now), key=lambda r: [(r[c] is not None, r[c]) for c in self.order])
        later = [tuple(r[c] for c in self.columns) for r in held if r["ts_ms"] > now]
        if ready:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        yield from self.made(key, self.fold(key, iter(ready)) + self.due(key, now))

    def close(self) -> None:
        pass


def _timed_rows(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull()).withWatermark(ts, delay).withColumn("ts_ms", F.unix_millis(ts))


class _Passing(InOrder):
    out, kinds = ["user_id", "event_id", "ts_ms"], {"user_id": "Int64", "event_id": "Int64", "ts_ms": "int64"}

    def __init__(self, step: Step):
        super().__init__("event_id long, ts_ms long", ["ts_ms", "event_id"])
        self.step = step

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "a long, b long")

    def fold(self, key: tuple, rows: Iterator[dict]) -> list[tuple]:
        state, out = None, []
        if self.last.exists():
            state = tuple(x for x in self.last.get() if x is not None)
        for r in rows:
            ok, state = self.step(state, r["ts_ms"])
            if ok:
                out.append((key[0], r["event_id"], r["ts_ms"]))
        if state is None:
            self.last.clear()
        else:
            self.last.update((*state, None)[:2])
        return out


def passing_stream(events: DataFrame, step: Step, delay: str) -> DataFrame:
    """user_id, event_id and ts_ms of a stream's events that pass ``step``, as ``sessions`` has it for batches; events of equal
    time go by event_id."""
    rows = _timed_rows(events.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "ts"), "ts", delay)
    return rows.groupBy("user_id").transformWithStateInPandas(_Passing(step), "user_id long, event_id long, ts_ms long", "append", "EventTime")


def throttled_stream(events: DataFrame, gap_ms: int = 1000, delay: str = "10 seconds") -> DataFrame:
    """``sessions.throttled`` on a stream."""
    return passing_stream(events, throttle_step(gap_ms), delay)


def triple_taps_stream(events: DataFrame, within_ms: int = 500, taps: int = 3, delay: str = "10 seconds") -> DataFrame:
    """``sessions.triple_taps`` on a stream."""
    return passing_stream(events, tap_step(within_ms, taps), delay).drop("ts_ms")


OPERATIONS = "key string, op_id long, ts_ms long, data string, ttl_ms long"


def answered(operations: DataFrame) -> DataFrame:
    """key, op_id, data and hit of every read of a table of operations (key, op_id, ts, data, ttl_ms): those with data write,
    those without read. A read finds the last write before it, by time and op_id, unless its time to live (0 or null: the
    default) has run out."""
    own = W.partitionBy("key").orderBy("ts_ms", "op_id").rowsBetween(W.unboundedPreceding, 0)
    rows = operations.where("ts is not null").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    ttl = F.when(F.coalesce("ttl_ms", F.lit(0)) == 0, DEFAULT_TTL_MS).otherwise(F.col("ttl_ms"))
    held = F.last(F.when(F.col("data").isNotNull(), F.struct("data", (F.col("ts_ms") + ttl).alias("until"))), ignorenulls=True).over(own)
    reads = rows.withColumn("held", held).where("data is null")
    live = F.when(F.col("held.until") >= F.col("ts_ms"), F.col("held.data"))
    return reads.select("key", "op_id", live.alias("data")).withColumn("hit", F.col("data").isNotNull())


class _Cache(InOrder):
    out, kinds = ["key", "op_id", "data", "hit"], {"op_id": "Int64", "hit": bool}

    def __init__(self):
        super().__init__(OPERATIONS.removeprefix("key string, "), ["ts_ms", "op_id"])

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "data string, until long")

    def fold(self, key: tuple, rows: Iterator[dict]) -> list[tuple]:
        data, until = self.entry.get() if self.entry.exists() else (None, -1)
        out, written = [], False
        for r in rows:
            if r["data"] is not None:
                data, until, written = r["data"], r["ts_ms"] + (r["ttl_ms"] or DEFAULT_TTL_MS), True
            else:
                found = data if until >= r["ts_ms"] else None
                out.append((key[0], r["op_id"], found, found is not None))
        if written:
            self.entry.update((data, until))
            self.handle.registerTimer(until + 1)
        return out

    def due(self, key: tuple, now: int) -> list[tuple]:
        if self.entry.exists() and self.entry.get()[1] < now:
            self.entry.clear()  # what its time ran out for takes no room
        return []


def answered_stream(operations: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """``answered`` on a stream: a key's entry is state that a timer clears when its time to live has run out."""
    rows = _timed_rows(operations, "ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(_Cache(), "key string, op_id long, data string, hit boolean", "append", "EventTime")


RETRIED, DROPPED = "done", "dropped"


def retried(queue: DataFrame, succeeds: Callable[[str, int], bool], wait_ms: int, most: int = 3) -> DataFrame:
    """owner, key, status, tries and at_ms of a table of entries (owner, key, ts): an entry is tried every ``wait_ms`` from its
    time on, until ``succeeds(key, try)``, counted from 0, or ``most`` tries have failed; then it is dropped at the next turn.
    Of repeated keys of an owner the first by time counts as long as it waits."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out, free = [], -1
        for ts in f["ts_ms"].sort_values().tolist():
            if ts > free:
                tries = next((k for k in range(most) if succeeds(key[1], k)), most)
                free = ts + (tries + 1) * wait_ms
                out.append((key[0], key[1], DROPPED if tries == most else RETRIED, min(tries + 1, most), free))
        return pd.DataFrame(out, columns=["owner", "key", "status", "tries", "at_ms"])

    rows = queue.where("ts is not null").select("owner", "key", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return rows.groupBy("owner", "key").applyInPandas(run, "owner string, key string, status string, tries int, at_ms long")


class _Retries(InOrder):
    out, kinds = ["owner", "key", "status", "tries", "at_ms"], {"tries": "int32", "at_ms": "int64"}

    def __init__(self, succeeds: Callable[[str, int], bool], wait_ms: int, most: int):
        super().__init__("key string, ts_ms long", ["ts_ms", "key"])
        self.succeeds, self.wait_ms, self.most = succeeds, wait_ms, most

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getMapState("queue", "key string", "due long, tries int, since long")

    def _worked(self, owner: object, now: int) -> list[tuple]:
        """Every turn up to ``now``, the earliest first and of equal ones the oldest entry."""
        held = {k[0]: tuple(v) for k, v in self.queue.iterator()}
        out = []
        while ready := [(v[0], v[2], k is not None, k or "", k) for k, v in held.items() if v[0] <= now]:
            at, since, _, _, key = min(ready)
            tries = held[key][1]
            if tries >= self.most:
                status = DROPPED
            else:
                tries += 1
                try:
                    status = RETRIED if self.succeeds(key, tries - 1) else None
                except Exception:  # a call that raises counts as failed
                    status = None
            if status:
                out.append((owner, key, status, tries, at))
                del held[key]
                self.queue.removeKey((key,))
            else:
                held[key] = (at + self.wait_ms, tries, since)
                self.queue.updateValue((key,), held[key])
        if held:
            self.handle.registerTimer(min(v[0] for v in held.values()))
        return out

    def fold(self, key: tuple, rows: Iterator[dict]) -> list[tuple]:
        out = []
        for r in rows:
            out += self._worked(key[0], r["ts_ms"] - 1)
            if not self.queue.containsKey((r["key"],)) or self.queue.getValue((r["key"],))[0] < r["ts_ms"]:
                self.queue.updateValue((r["key"],), (r["ts_ms"] + self.wait_ms, 0, r["ts_ms"]))
        return out

    def due(self, key: tuple, now: int) -> list[tuple]:
        return self._worked(key[0], now)


def retried_stream(queue: DataFrame, succeeds: Callable[[str, int], bool], wait_ms: int, most: int = 3, delay: str = "10 seconds") -> DataFrame:
    """``retried`` on a stream: an owner's queue is state, and timers call for its next turn."""
    rows = _timed_rows(queue, "ts", delay)
    return rows.groupBy("owner").transformWithStateInPandas(_Retries(succeeds, wait_ms, most), "owner string, key string, status string, tries int, at_ms long", "append", "EventTime")


class _Fragments(InOrder):
    out, kinds = ["video_id", "idx", "status", "translated", "at_ms"], {"idx": "Int64", "at_ms": "int64"}

    def __init__(self):
        super().__init__("idx long, kind string, text string, ts_ms long", ["ts_ms", "kind", "idx"])

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("states", "idx long", "status string")

    def fold(self, key: tuple, rows: Iterator[dict]) -> list[tuple]:
        held = {k[0]: v[0] for k, v in self.states.iterator()} if self.states.exists() else {}
        out, changed = [], {}
        for r in rows:
            idx, now = r["idx"], held.get(r["idx"], PENDING)
            if r["kind"] == "sent" and now in (PENDING, FAILED):
                new = [(idx, SENT, None)]
            elif r["kind"] == "result" and now == SENT:
                new = [(idx, DONE, r["text"]) if r["text"] else (idx, FAILED, None)]
            elif r["kind"] == "abort":
                new = [(i, PENDING, None) for i in sorted(i for i, s in held.items() if s == SENT)]
            else:
                new = []
            for i, status, text in new:
                held[i] = changed[i] = status
                out.append((key[0], i, status, text, r["ts_ms"]))
        for i, status in changed.items():
            self.states.updateValue((i,), (status,))
        return out


def fragment_states_stream(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """video_id, idx, status, translated and at_ms of every change of a stream of (video_id, idx, kind, text, ts). "sent" puts a
    fragment that waits or has failed under way, "result" makes it done, or failed without a text, and "abort" lets all
    of the video that are under way wait again. Events of equal time go by kind and idx; others change nothing."""
    rows = _timed_rows(events, "ts", delay)
    return rows.groupBy("video_id").transformWithStateInPandas(_Fragments(), "video_id string, idx long, status string, translated string, at_ms long", "append", "EventTime")
