"""Timed captions: noise, formats, the five parsers, and look-ups by playback time.

Events are rows of (video_id, pos, start_ms, duration_ms, append, win_id, pos_id, segs, lang), ``segs`` an array of
(utf8, offset_ms). Everything is grouped by video, whose events one player holds.

Defined results: rows with null segs hold no text; repeated rows count each, in order of ``pos``; null video ids match
nothing in the joins by format and time; videos without events have no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from brookloom.functions.text import clean_caption, unit_limit, without_noise

#: Fixed values of the formats and parsers.
KARAOKE_TRACK, WORD_MS, FAMILY_GAP_MS, MIN_PREFIX = 3, 200, 1200, 10
SENTENCE_END = re.compile(r"[,.。?？！!；;…؟۔\n]$")
FRAGMENT = "video_id string, idx long, start_ms long, end_ms long, text string"


def _in_order() -> WindowSpec:
    return W.partitionBy("video_id").orderBy("pos")


#: The names of a payload's fields, by those of events.
PAYLOAD_FIELDS = {"start_ms": "tStartMs", "duration_ms": "dDurationMs", "append": "aAppend", "win_id": "wWinId", "pos_id": "wpWinPosId"}
EVENT_SEGS = "array<struct<utf8:string,offset_ms:bigint>>"


def payload_events(payloads: DataFrame) -> DataFrame:
    """Events of raw payloads (video_id, payload, lang): ``pos`` is an event's place in its payload's list ``events``.

    What a payload holds is looked at as it comes: numbers may stand as texts, fields may lack, be null or of another kind,
    which makes them null, and others are passed over. Events that are no object or have no start are left out, as are
    segments that are no object; an event whose ``segs`` are no list has null ones; payloads that are no JSON, or have no
    list of events, give no rows."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    listed = get(F.try_parse_json("payload"), "$.events", "array<variant>")
    events = payloads.select("video_id", "lang", F.posexplode(listed).alias("pos", "e"))
    kind = lambda v: F.schema_of_variant(v)
    objects = F.filter(get(F.col("e"), "$.segs", "array<variant>"), lambda s: kind(s).startswith("OBJECT"))
    segs = F.transform(objects, lambda s: F.struct(F.coalesce(get(s, "$.utf8", "string"), F.lit("")).alias("utf8"), get(s, "$.tOffsetMs", "bigint").alias("offset_ms")))
    number = {name: get(F.col("e"), f"$.{field}", "bigint") for name, field in PAYLOAD_FIELDS.items()}
    read = events.where(kind(F.col("e")).startswith("OBJECT")).select(
        "video_id", F.col("pos").cast("long").alias("pos"), *[c.alias(name) for name, c in number.items()], segs.cast(EVENT_SEGS).alias("segs"), "lang"
    )
    return read.where("start_ms is not null")


def filtered_events(events: DataFrame) -> DataFrame:
    """Events whose segs have no noise, blank ones dropped."""
    clean = F.transform("segs", lambda s: F.struct(without_noise(s["utf8"]).alias("utf8"), s["offset_ms"].alias("offset_ms")))
    return events.withColumn("segs", F.filter(clean, lambda s: F.trim(F.regexp_replace(s["utf8"], r"\s+", " ")) != ""))


def event_text() -> Column:
    return F.array_join(F.transform(F.coalesce(F.col("segs"), F.array().cast("array<struct<utf8:string,offset_ms:bigint>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), "")


def caption_formats(events: DataFrame) -> DataFrame:
    """video_id and format: the first of animated, karaoke-stylized, karaoke, scrolling-asr and standard that holds."""
    raw = events.withColumn("raw", event_text()).withColumn("cleaned", clean_caption(F.col("raw")))
    norm = F.lower(F.trim(F.regexp_replace(F.replace("cleaned", F.lit("/"), F.lit("")), r"\s+", " ")))
    track = W.partitionBy("video_id", "pos_id").orderBy("pos")
    marked = raw.where("pos_id is not null").withColumn("norm", norm).withColumn("n_track", F.count("*").over(W.partitionBy("video_id", "pos_id"))).where("cleaned != '' and norm != ''")
    marked = marked.withColumns({"last": F.lag("norm").over(track), "last_ms": F.lag("start_ms").over(track)})
    same = (F.col("start_ms") - F.col("last_ms") <= 400) & (F.col("norm").startswith(F.col("last")) | F.col("last").startswith(F.col("norm"))) & (F.col("raw").contains("/") | F.col("raw").contains("​"))
    stylized = marked.where("n_track >= 4").groupBy("video_id", "pos_id").agg(F.count_if(same).alias("n")).groupBy("video_id").agg((F.max("n") >= 3).alias("stylized"))
    karaoke = events.where("pos_id is not null").groupBy("video_id", "start_ms").agg(F.count_distinct("pos_id").alias("n")).groupBy("video_id").agg((F.max("n") > 1).alias("karaoke"))
    counts = events.groupBy("video_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("pos_id").isNotNull() & (F.coalesce("duration_ms", F.lit(0)) <= 100)).alias("short"),
        F.coalesce(F.bool_or(F.col("win_id").isNotNull() & (F.col("append") == 1)), F.lit(False)).alias("scrolling"),
    )
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return counts.join(stylized, "video_id", "left").join(karaoke, "video_id", "left").select(
        "video_id",
        F.when((F.col("n") >= 50) & (F.col("short") / F.col("n") >= 0.5), "animated").when(no("stylized") & (F.col("n") >= 4), "karaoke-stylized").when(no("karaoke"), "karaoke").when(F.col("scrolling"), "scrolling-asr").otherwise("standard").alias("format"),
    )


def _numbered(fragments: DataFrame, *order: str) -> DataFrame:
    own = W.partitionBy("video_id").orderBy(*order)
    return fragments.select("video_id", (F.row_number().over(own) - 1).cast("long").alias("idx"), "start_ms", "end_ms", "text")


def standard_captions(events: DataFrame) -> DataFrame:
    """One fragment a seg: the next seg's start ends it, unless its event ends before."""
    segs = events.select("video_id", "pos", "start_ms", "duration_ms", F.size("segs").alias("n"), F.posexplode("segs").alias("seg", "s"))
    start = F.col("start_ms") + F.coalesce(F.col("s")["offset_ms"], F.lit(0))
    own = W.partitionBy("video_id").orderBy("pos", "seg")
    rows = segs.select("video_id", "pos", "seg", F.trim(F.regexp_replace(F.col("s")["utf8"], r"\s+", " ")).alias("text"), start.alias("begin"), F.when(F.col("seg") == F.col("n") - 1, F.col("start_ms") + F.coalesce("duration_ms", F.lit(0))).otherwise(0).alias("stop"))
    rows = rows.withColumn("next", F.lead("begin").over(own))
    end = F.when(F.col("next").isNotNull() & ((F.col("stop") == 0) | (F.col("stop") > F.col("next"))), F.col("next")).otherwise(F.col("stop"))
    return _numbered(rows.select("video_id", "pos", "seg", F.col("begin").alias("start_ms"), end.cast("long").alias("end_ms"), "text"), "pos", "seg")


def _merged_runs(rows: DataFrame) -> DataFrame:
    """Rows (video_id, pos, start_ms, stop, text): equal neighbours are one fragment, and the next's start ends each."""
    rows = rows.withColumn("fresh", F.coalesce((F.lag("text").over(_in_order()) != F.col("text")).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("fresh").over(_in_order().rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("video_id", "run").agg(F.min("pos").alias("pos"), F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("stop", "pos").alias("stop"), F.first("text").alias("text"))
    following = F.lead("start_ms").over(_in_order())
    return _numbered(runs.withColumn("end_ms", F.coalesce(F.least("stop", following), F.col("stop"))), "pos")


def animated_captions(events: DataFrame) -> DataFrame:
    rows = events.select("video_id", "pos", "start_ms", (F.col("start_ms") + F.coalesce("duration_ms", F.lit(0))).alias("stop"), clean_caption(event_text()).alias("text"))
    return _merged_runs(rows.where("text != ''"))


def karaoke_captions(events: DataFrame) -> DataFrame:
    """Of the main track (number 3, else the highest): each event is cut at the next one's start, then equal neighbours merge."""
    main = events.where("pos_id is not null").groupBy("video_id").agg(F.when(F.bool_or(F.col("pos_id") == KARAOKE_TRACK), KARAOKE_TRACK).otherwise(F.max("pos_id")).alias("pos_id"))
    rows = events.join(main, ["video_id", "pos_id"]).select("video_id", "pos", "start_ms", (F.col("start_ms") + F.coalesce("duration_ms", F.lit(0))).alias("stop"), clean_caption(event_text()).alias("text")).where("text != ''")
    rows = rows.withColumn("stop", F.coalesce(F.least("stop", F.lead("start_ms").over(_in_order())), F.col("stop")))
    rows = rows.withColumn("fresh", F.coalesce((F.lag("text").over(_in_order()) != F.col("text")).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("fresh").over(_in_order().rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("video_id", "run").agg(F.min("pos").alias("pos"), F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("stop", "pos").alias("end_ms"), F.first("text").alias("text"))
    return _numbered(runs, "pos")


def main_track(events: DataFrame) -> DataFrame:
    """video_id and the track with most events, then marked events, then text, then the highest number."""
    raw = events.where("pos_id is not null").withColumn("raw", event_text()).withColumn("cleaned", clean_caption(F.col("raw"))).where("cleaned != ''")
    stats = raw.groupBy("video_id", "pos_id").agg(F.count("*").alias("n"), F.count_if(F.col("raw").contains("/") | F.col("raw").contains("​")).alias("marked"), F.sum(F.length("cleaned")).alias("size"))
    return stats.groupBy("video_id").agg(F.max_by("pos_id", F.struct("n", "marked", "size", "pos_id")).alias("main"))


def families(rows: list[tuple[int, int, str]]) -> list[list]:
    """[start, end, text] of runs of (start, end, text) that repeat or extend the longest text so far."""
    out: list[list] = []
    last = 0
    for start, end, text in rows:
        if out and start - last <= FAMILY_GAP_MS:
            short, long = sorted((out[-1][2].lower(), text.lower()), key=len)
            if short == long or (len(short) >= MIN_PREFIX and long.startswith(short)):
                out[-1][1], last = end, start
                if len(text) > len(out[-1][2]):
                    out[-1][2] = text
                continue
        if out:
            out[-1][1] = min(out[-1][1], start)
        out.append([start, end, text])
        last = start
    return out


def stylized_captions(events: DataFrame) -> DataFrame:
    """Families of the main track, and of other events that overlap none of them, in order of start."""
    raw = events.join(main_track(events), "video_id").select("video_id", "pos", "start_ms", (F.col("start_ms") + F.coalesce("duration_ms", F.lit(0))).alias("stop"), clean_caption(event_text()).alias("text"), (F.coalesce("pos_id", F.lit(-1)) == F.col("main")).alias("is_main")).where("text != ''")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        take = lambda f: list(f[["start_ms", "stop", "text"]].itertuples(index=False, name=None))
        main = families(take(pdf[pdf["is_main"]]))
        free = [r for r in take(pdf[~pdf["is_main"]]) if not any(r[0] < e and r[1] > s for s, e, _ in main)]
        merged = sorted([*main, *families(free)], key=lambda f: f[0])
        for a, b in zip(merged, merged[1:], strict=False):
            a[1] = min(a[1], b[0])
        out = pd.DataFrame(merged, columns=["start_ms", "end_ms", "text"])
        return out.assign(video_id=pdf["video_id"].iloc[0], idx=range(len(out)))[["video_id", "idx", "start_ms", "end_ms", "text"]]

    return raw.groupBy("video_id").applyInPandas(fold, FRAGMENT)


def scrolling(rows: list[tuple], by_character: bool, most: int) -> list[list]:
    """[start, end, text] from (start, duration, append, [(utf8, offset)]): segs gather until a sentence ends or they are
    too many; what is gathered goes out with the next seg, event or append mark, which may still move its end."""
    out: list[list] = []
    text, start, end, waiting = "", None, 0, False

    def flush() -> None:
        nonlocal text, start, waiting
        t = re.sub(r"\s+", " ", text).strip()
        if t and start is not None and not re.fullmatch(r"\[.*\]", t):
            if out:
                out[-1][1] = min(out[-1][1], start)
            out.append([start, end, t])
        text, start, waiting = "", None, False

    for begin, duration, append, segs in rows:
        if append == 1:
            if text:
                end = begin + (duration or 0)
            if waiting:
                flush()
            continue
        for utf8, offset in segs or []:
            if waiting:
                flush()
            piece = utf8 or ""
            if not piece.strip():
                continue
            at = begin + (offset or 0)
            start = at if start is None else start
            text += piece if by_character or not text or text[-1].isspace() or piece[0].isspace() else " " + piece
            end = at + WORD_MS
            size = len(text) if by_character else len(text.split())
            waiting = bool(SENTENCE_END.search(text.rstrip(" "))) or size >= most
    flush()
    return out


def scrolling_captions(events: DataFrame) -> DataFrame:
    """Sentences of automatic captions, whose words arrive one by one."""
    raw = events.withColumn("most", unit_limit(F.col("lang")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        none = lambda x: None if x is None or x != x else int(x)
        rows = [(int(s), none(d), none(a), [(g["utf8"], none(g["offset_ms"])) for g in (segs if segs is not None else [])]) for s, d, a, segs in zip(pdf["start_ms"], pdf["duration_ms"], pdf["append"], pdf["segs"], strict=True)]
        most = int(pdf["most"].iloc[0])
        out = pd.DataFrame(scrolling(rows, most == 30, most), columns=["start_ms", "end_ms", "text"])
        return out.assign(video_id=pdf["video_id"].iloc[0], idx=range(len(out)))[["video_id", "idx", "start_ms", "end_ms", "text"]]

    return raw.select("video_id", "pos", "start_ms", "duration_ms", "append", "segs", "most").groupBy("video_id").applyInPandas(fold, FRAGMENT)


PARSERS = {"standard": standard_captions, "animated": animated_captions, "karaoke": karaoke_captions, "karaoke-stylized": stylized_captions, "scrolling-asr": scrolling_captions}


def captions(events: DataFrame) -> DataFrame:
    """Fragments of every video by its own format."""
    clean = filtered_events(events)
    formats = caption_formats(clean)
    out = None
    for name, parser in PARSERS.items():
        part = parser(clean.join(formats.where(F.col("format") == name).select("video_id"), "video_id", "left_semi")).withColumn("format", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def captions_at(playback: DataFrame, fragments: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """video_id, at_ms and the first fragment that holds it. Fragments stand in every bucket of time that they touch, so
    the join is on equal (video, bucket), and a hot video is split by time."""
    spread = fragments.where("end_ms > start_ms").withColumn("bucket", F.explode(F.sequence(F.expr(f"start_ms div {bucket_ms}"), F.expr(f"(end_ms - 1) div {bucket_ms}"))))
    asked = playback.withColumn("bucket", F.expr(f"at_ms div {bucket_ms}"))
    hits = asked.join(spread, ["video_id", "bucket"]).where("start_ms <= at_ms and at_ms < end_ms")
    return hits.groupBy("video_id", "at_ms").agg(F.min_by(F.struct("idx", "text"), "idx").alias("hit")).select("video_id", "at_ms", "hit.idx", "hit.text")


def look_ahead(playback: DataFrame, fragments: DataFrame, back_ms: int = 5_000, ahead_ms: int = 90_000, batch: int = 50, bucket_ms: int = 10_000) -> DataFrame:
    """video_id, at_ms, idx and batch number of the fragments that end from 5 s before and start up to 90 s after each playback
    time. Both sides stand in every bucket of time that they touch; a pair counts in the first bucket that they share. A bucket's
    fragments are one row, and so are those of a playback time, so that pairs are no rows until the last step."""
    bucket = lambda x: F.floor(x / bucket_ms)
    asked = playback.select("video_id", "at_ms", bucket(F.col("at_ms") - back_ms).alias("first"), bucket(F.col("at_ms") + ahead_ms).alias("last"))
    asked = asked.withColumn("bucket", F.explode(F.sequence("first", "last"))).drop("last")
    end = F.greatest("start_ms", "end_ms")
    held = fragments.where("start_ms is not null").select("video_id", "idx", "start_ms", "end_ms", bucket(F.col("start_ms")).alias("own"), F.explode(F.sequence(bucket(F.col("start_ms")), bucket(end))).alias("bucket"))
    packed = held.groupBy("video_id", "bucket").agg(F.collect_list(F.struct("idx", "start_ms", "end_ms", "own")).alias("held"))
    meets = lambda f: (F.col("bucket") == F.greatest("first", f["own"])) & (f["end_ms"] >= F.col("at_ms") - back_ms) & (f["start_ms"] <= F.col("at_ms") + ahead_ms)
    rows = asked.join(packed, ["video_id", "bucket"]).select("video_id", "at_ms", F.transform(F.filter("held", meets), lambda f: f["idx"]).alias("idxs")).where("size(idxs) > 0")
    whole = rows.groupBy("video_id", "at_ms").agg(F.array_sort(F.flatten(F.collect_list("idxs"))).alias("idxs"))
    return whole.select("video_id", "at_ms", F.posexplode("idxs").alias("place", "idx")).select("video_id", "at_ms", "idx", F.floor(F.col("place") / batch).alias("batch"))


def _met(playback: DataFrame, fragments: DataFrame, delay: str, back_ms: int, ahead_ms: int, longest_ms: int) -> DataFrame:
    """Playback times with the fragments that touch their window, of two streams. A fragment's start lies at most ``longest_ms``
    before its end, so either side's state ends once the other's watermark has passed the window."""
    span = lambda ms: F.expr(f"interval {ms} milliseconds")
    asked = playback.select(F.col("video_id").alias("asked_id"), "at").withWatermark("at", delay)
    held = fragments.select("video_id", "idx", "text", "start", "end").withWatermark("start", delay)
    near = (F.col("start") <= F.col("at") + span(ahead_ms)) & (F.col("start") >= F.col("at") - span(back_ms + longest_ms))
    return asked.join(held, (F.col("asked_id") == F.col("video_id")) & near & (F.col("end") >= F.col("at") - span(back_ms))).drop("asked_id")


def look_ahead_stream(playback: DataFrame, fragments: DataFrame, delay: str = "10 seconds", back_ms: int = 5_000, ahead_ms: int = 90_000, batch: int = 50, longest_ms: int = 60_000) -> DataFrame:
    """``look_ahead`` on streams of playback times (video_id, at) and fragments (video_id, idx, text, start, end), whose times
    are timestamps. Fragments longer than ``longest_ms`` may be missed after that time. Equal playback times count once, and
    equal (video_id, idx) once for each."""
    rows = _met(playback, fragments, delay, back_ms, ahead_ms, longest_ms).groupBy("video_id", "at").agg(F.array_sort(F.collect_set("idx")).alias("idxs"))
    return rows.select("video_id", "at", F.posexplode("idxs").alias("place", "idx")).select("video_id", "at", "idx", F.floor(F.col("place") / batch).alias("batch"))


def captions_at_stream(playback: DataFrame, fragments: DataFrame, delay: str = "10 seconds", longest_ms: int = 60_000) -> DataFrame:
    """``captions_at`` on the streams of ``look_ahead_stream``: video_id, at and the first fragment that holds it."""
    rows = _met(playback, fragments, delay, 0, 0, longest_ms).where("at < end")
    return rows.groupBy("video_id", "at").agg(F.min_by(F.struct("idx", "text"), "idx").alias("hit")).select("video_id", "at", "hit.idx", "hit.text")
