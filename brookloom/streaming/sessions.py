"""Behaviour over time: debounce, throttle, navigation, taps and first sight, for batches and, where named, streams.

Events are rows of (user_id, event_id, ts, event_type). Folds over a user's events stream them in order through one task
that holds a few values of the user at hand, however many events there are. Defined results: events of equal time go by
event_id, repeated rows count each; null users are one user; events without a time come first and pass no fold; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def debounced(events: DataFrame, gap: str = "1500 milliseconds", watermark: str | None = None) -> DataFrame:
    """user_id, fires_at, n and first_id: events of a user that follow within the gap are one batch of n.

    With ``watermark`` the input may be a stream; late events beyond it are dropped by Spark.
    """
    if watermark:
        events = events.withWatermark("ts", watermark)
    return (
        events.groupBy("user_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
        .select("user_id", F.col("s.end").alias("fires_at"), "n", "first_id")
    )


#: Given a user's state and an event's time: whether the event passes, and the state after it.
Step = Callable[[tuple | None, int], tuple[bool, tuple | None]]


def _passing(events: DataFrame, step: Step) -> DataFrame:
    """user_id, event_id and ts_ms of the events for which ``step``, given the user's state and the time, says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user: object = run  # no user yet
        state: tuple | None = None
        for batch in batches:
            keep = []
            for u, t in zip(batch.column("user_id").to_pylist(), batch.column("ts_ms").to_pylist(), strict=True):
                if u != user:
                    user, state = u, None
                ok, state = step(state, t)
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = events.select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms")).where("ts_ms is not null")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts_ms", "event_id").mapInArrow(run, "user_id long, event_id long, ts_ms long")


def throttle_step(gap_ms: int) -> Step:
    def step(state: tuple | None, t: int) -> tuple[bool, tuple | None]:
        ok = state is None or t - state[0] >= gap_ms
        return ok, (t,) if ok else state

    return step


def throttled(events: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """user_id, event_id and ts_ms of the events that pass: at least ``gap_ms`` after the last one of the user that passed."""
    return _passing(events, throttle_step(gap_ms))


def navigation_sessions(events: DataFrame) -> DataFrame:
    """user_id, session, n and the event type: a session ends when the type of a user's events changes."""
    own = W.partitionBy("user_id").orderBy("ts", "event_id")
    changed = F.coalesce((F.lag("event_type").over(own) != F.col("event_type")).cast("int"), F.lit(1))
    rows = events.withColumn("changed", changed).withColumn("session", F.sum("changed").over(own.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def tap_step(within_ms: int, taps: int) -> Step:
    def step(state: tuple | None, t: int) -> tuple[bool, tuple | None]:
        first, n = state if state and t - state[0] <= within_ms else (t, 0)
        return n + 1 == taps, None if n + 1 == taps else (first, n + 1)

    return step


def triple_taps(events: DataFrame, within_ms: int = 500, taps: int = 3) -> DataFrame:
    """user_id and the event that completes a gesture: the third tap within the time from the first; then counting starts anew."""
    return _passing(events, tap_step(within_ms, taps)).drop("ts_ms")


def first_seen(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """One row for each (user_id, event_type): of a batch the earliest, of a stream the first that arrives."""
    if watermark:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return events.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def live_cache(writes: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """A stream of cache writes as counts per key and hour, late ones dropped."""
    return writes.withWatermark("ts", watermark).groupBy("key", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("hour"), "n")


def sse_stream(payloads: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """stream_id and complete line of a stream of payload pieces (stream_id, seq, payload): the cut tail is kept as
    state until its end arrives, the stream says ``[DONE]``, or, where given, ``idle_ms`` pass after the last piece (Spark then
    runs batches without data too). Pieces of a micro-batch go by ``seq``; a tail without an end never comes out."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        *lines, tail = (tail + "".join(rows["payload"].fillna(""))).split("\n")
        if any(x.rstrip("\r") == "data: [DONE]" for x in lines):
            if state.exists:
                state.remove()
        else:
            state.update((tail,))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"stream_id": [key[0]] * len(lines), "line": lines})

    return payloads.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, line string", "tail string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
