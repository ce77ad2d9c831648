"""Streams with state and timers against the batch operators over the same rows, cut anywhere and restarted."""

from __future__ import annotations

import datetime as dt
import random
import zlib

import pytest
from pyspark.sql import functions as F

from brookloom.operators import captions
from brookloom.streaming import sessions, state

START = dt.datetime(2024, 1, 1)
END = START + dt.timedelta(days=900)


def streamed(spark, tmp_path, schema, parts, build, restart_at=None):
    """Rows that a stream over one file for each of ``parts`` gives; with ``restart_at`` it is stopped there and goes on from its
    checkpoint."""
    state.timed(spark)
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def write(k):
        spark.createDataFrame(parts[k], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = build(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    for k in range(len(parts)):
        write(k)
        if k + 1 in (restart_at, len(parts)):
            run()
    return sorted((tuple(r) for r in spark.read.parquet(sink).collect()), key=repr)


def cut(rows, pieces, rnd, late_ms):
    """Rows in order of arrival: of time, moved by less than ``late_ms``, and a last row of a far time for the watermark."""
    rows = sorted(rows, key=lambda r: r["ts"] + dt.timedelta(milliseconds=rnd.randrange(late_ms)))
    n = len(rows) // pieces + 1
    return [rows[i : i + n] for i in range(0, len(rows), n)]


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


@pytest.mark.parametrize("what", ["throttled", "triple_taps"])
def test_folds(spark, tmp_path, what):
    rnd = random.Random(1)
    schema = "user_id long, event_id long, ts timestamp"
    rows = [{"user_id": rnd.choice([1, 2, None]), "event_id": i, "ts": at(rnd.randrange(60_000))} for i in range(300)]
    parts = [*cut(rows, 4, rnd, 3000), [{"user_id": 9, "event_id": -1, "ts": END}]]
    build = {"throttled": lambda s: state.throttled_stream(s, 1000, "5 seconds"), "triple_taps": lambda s: state.triple_taps_stream(s, 1500, 3, "5 seconds")}[what]
    batch = {"throttled": lambda d: sessions.throttled(d, 1000), "triple_taps": lambda d: sessions.triple_taps(d, 1500)}[what]
    got = streamed(spark, tmp_path, schema, parts, build, restart_at=2)
    want = sorted((tuple(r) for r in batch(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert [g for g in got if g[1] != -1] == want and len(want) > 20


def test_cache_forgets(spark, tmp_path):
    rnd = random.Random(2)
    schema = "key string, op_id long, ts timestamp, data string, ttl_ms long"
    rows = [
        {"key": rnd.choice(["a", "b", None]), "op_id": i, "ts": at(rnd.randrange(60_000)), "data": rnd.choice([None, None, f"d{i}"]), "ttl_ms": rnd.choice([0, None, 900, 5000])}
        for i in range(200)
    ]
    parts = [*cut(rows, 3, rnd, 3000), [{"key": "end", "op_id": -1, "ts": END, "data": "x", "ttl_ms": 1}]]
    got = streamed(spark, tmp_path, schema, parts, lambda s: state.answered_stream(s, "5 seconds"), restart_at=2)
    want = sorted((tuple(r) for r in state.answered(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == want and {r[3] for r in want} == {True, False}


def test_retries_come_due(spark, tmp_path):
    succeeds = lambda key, k: zlib.crc32(f"{key}{k}".encode()) % 3 == 0
    rnd = random.Random(3)
    schema = "owner string, key string, ts timestamp"
    rows = [{"owner": rnd.choice(["o", "p", None]), "key": f"k{rnd.randrange(25)}", "ts": at(rnd.randrange(90_000))} for _ in range(150)]
    parts = [*cut(rows, 3, rnd, 3000), [{"owner": "end", "key": "end", "ts": END}], [{"owner": "end", "key": "end2", "ts": END + dt.timedelta(days=1)}]]
    got = streamed(spark, tmp_path, schema, parts, lambda s: state.retried_stream(s, succeeds, 4000, delay="5 seconds"), restart_at=2)
    want = sorted((tuple(r) for r in state.retried(spark.createDataFrame(rows, schema), succeeds, 4000).collect()), key=repr)
    assert [g for g in got if g[0] != "end"] == want and {r[2] for r in want} == {"done", "dropped"}


def test_fragment_states(spark, tmp_path):
    rnd = random.Random(4)
    schema = "video_id string, idx long, kind string, text string, ts timestamp"
    rows = []
    for i in range(250):
        kind = rnd.choice(["sent", "sent", "result", "result", "abort", "other"])
        rows.append({"video_id": rnd.choice(["v", "w"]), "idx": None if kind == "abort" else rnd.randrange(6), "kind": kind, "text": rnd.choice([None, "", "t"]), "ts": at(i * 100)})
    parts = [*cut(rows, 3, rnd, 2000), [{"video_id": "end", "idx": 0, "kind": "other", "text": None, "ts": END}]]
    got = streamed(spark, tmp_path, schema, parts, lambda s: state.fragment_states_stream(s, "5 seconds"), restart_at=2)
    want, held = [], {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["kind"], r["idx"] or 0)):
        k, ms = (r["video_id"], r["idx"]), int((r["ts"] - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
        now = held.get(k, "pending")
        change = []
        if r["kind"] == "sent" and now in ("pending", "failed"):
            change = [(k, "translating", None)]
        if r["kind"] == "result" and now == "translating":
            change = [(k, "done" if r["text"] else "failed", r["text"] or None)]
        if r["kind"] == "abort":
            change = [(x, "pending", None) for x, s in held.items() if x[0] == k[0] and s == "translating"]
        for x, s, t in change:
            held[x] = s
            want.append((*x, s, t, ms))
    assert got == sorted(want, key=repr) and {w[2] for w in want} == {"pending", "translating", "done", "failed"}


def test_empty_streams(spark, tmp_path):
    assert streamed(spark, tmp_path, "user_id long, event_id long, ts timestamp", [[{"user_id": 1, "event_id": 1, "ts": None}]], lambda s: state.throttled_stream(s)) == []


def test_look_ahead_over_two_streams(spark, tmp_path):
    """Playback and fragments arrive in pieces out of order; the windows are those of the batch operator."""
    rnd = random.Random(5)
    play = [(rnd.choice(["v", "w", None]), at(rnd.randrange(0, 400_000, 1000))) for _ in range(60)]
    held = []
    for video in ("v", "w"):
        for i in range(150):
            begin = i * 2500 + rnd.randrange(2000)
            held.append((video, i, f"t{i}", at(begin), at(begin + rnd.choice([0, 800, 2500, 20_000]))))
    schemas = ("video_id string, at timestamp", "video_id string, idx long, text string, start timestamp, end timestamp")

    def arrivals(rows, t):
        rows = sorted(rows, key=lambda r: r[t] + dt.timedelta(milliseconds=rnd.randrange(5000)))
        return [rows[i : i + len(rows) // 4 + 1] for i in range(0, len(rows), len(rows) // 4 + 1)]

    parts = (arrivals(play, 1), arrivals(held, 3))
    ends = [[("end", END)], [("end", 0, "x", END, END)]]
    where = [[str(tmp_path / f"in{k}") for k in range(2)], str(tmp_path / "out"), str(tmp_path / "check")]

    def run(name, build, more):
        for k in range(2):
            for piece in more[k]:
                spark.createDataFrame(piece, schemas[k]).coalesce(1).write.mode("append").parquet(where[0][k])
        streams = [spark.readStream.schema(schemas[k]).option("maxFilesPerTrigger", 1).parquet(where[0][k]) for k in range(2)]
        build(*streams).writeStream.format("parquet").option("path", where[1] + name).option("checkpointLocation", where[2] + name).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    build = lambda p, f: captions.look_ahead_stream(p, f, "8 seconds", batch=10)
    run("a", build, [x[:2] for x in parts])
    run("a", build, [x[2:] + [e] for x, e in zip(parts, ends, strict=True)])
    run("b", lambda p, f: captions.captions_at_stream(p, f, "8 seconds"), [[], []])
    ms = F.unix_millis
    p = spark.createDataFrame(play, schemas[0]).distinct().select("video_id", ms("at").alias("at_ms"))
    f = spark.createDataFrame(held, schemas[1]).select("video_id", "idx", "text", ms("start").alias("start_ms"), ms("end").alias("end_ms"))
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    got = spark.read.parquet(where[1] + "a").where("video_id != 'end'")
    assert plain(got.select("video_id", ms("at"), "idx", "batch")) == plain(captions.look_ahead(p, f, batch=10)) != []
    got = spark.read.parquet(where[1] + "b").where("video_id != 'end'")
    assert plain(got.select("video_id", ms("at"), "idx", "text")) == plain(captions.captions_at(p, f)) != []
