"""Caption tracks and their life: which track to fetch, its token and address, the state of fragments.

Tables are keyed by video_id; a video's tracks are a handful. Defined results: null ids match nothing; of equal
priority the first track (``ord``) counts; addresses without what is asked for give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookloom.functions.text import url_host, url_parameter

#: Parameters of caption requests, and those taken from the device.
FIXED_PARAMETERS = {"fmt": "json3", "xorb": "2", "xobt": "3", "xovt": "3", "c": "WEB", "cplayer": "UNIPLAYER"}
DEVICE_PARAMETERS = ("cbrand", "cbr", "cbrver", "cos", "cosver", "cplatform")


def is_watch_page(url: Column) -> Column:
    """Whether an address shows one video."""
    return url_host(url).rlike(r"^(www\.|m\.)?youtube\.com$") & url.rlike(r"^[a-zA-Z]+://[^/]+/watch([?#]|$)") & url_parameter(url, "v").isNotNull()


def newest_addresses(requests: DataFrame) -> DataFrame:
    """video_id and the last address (url, ts) that asked for its captions with a token."""
    video, token = url_parameter(F.col("url"), "v"), url_parameter(F.col("url"), "pot")
    held = requests.where(F.col("url").contains("/api/timedtext")).select(video.alias("video_id"), token.alias("pot"), "url", "ts")
    return held.where("video_id is not null and pot is not null").groupBy("video_id").agg(F.max_by("url", F.struct("ts", "url")).alias("url"))


def whole_address(url: Column, origin: Column) -> Column:
    """An address with its origin before it, if it has none."""
    return F.when(url.contains("://"), url).otherwise(F.concat(origin, url))


def audio_language(url: Column) -> Column:
    return url_parameter(url, "lang")


def selected_tracks(tracks: DataFrame, players: DataFrame) -> DataFrame:
    """Of tracks (video_id, ord, vss_id, language, kind, name, url) the one for each player (video_id, selected_vss_id,
    selected_language): the selected one, else of the selected language, else by people without a name, by people, made
    by machine, any."""
    human, no = F.coalesce(F.col("kind") != "asr", F.lit(True)), F.lit(False)
    order = (
        F.when(F.coalesce(F.col("vss_id") == F.nullif("selected_vss_id", F.lit("")), no), 0)
        .when(F.coalesce(F.col("language") == F.nullif("selected_language", F.lit("")), no), 1)
        .when(human & (F.coalesce("name", F.lit("")) == ""), 2).when(human, 3).when(F.col("kind") == "asr", 4).otherwise(5)
    )
    row = F.struct("vss_id", "language", "kind", "name", "url")
    joined = tracks.join(players.select("video_id", "selected_vss_id", "selected_language"), "video_id")
    return joined.groupBy("video_id").agg(F.min_by(row, F.struct(order.alias("order"), "ord")).alias("t")).select("video_id", "t.*")


def track_tokens(selected: DataFrame, audio: DataFrame, newest: DataFrame) -> DataFrame:
    """video_id, pot and potc of each selected track, from the nearest of its audio tracks (video_id, ord, vss_id, language,
    kind, url), else from the newest address that had one."""
    a = audio.select("video_id", "ord", F.col("vss_id").alias("a_vss"), F.col("language").alias("a_language"), F.col("kind").alias("a_kind"), F.col("url").alias("a_url"))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    order = F.when(same("a_vss", "vss_id"), 0).when(same("a_language", "language") & same("a_kind", "kind"), 1).when(same("a_language", "language"), 2).otherwise(3)
    nearest = selected.join(a, "video_id").groupBy("video_id").agg(F.min_by("a_url", F.struct(order.alias("order"), "ord")).alias("near"))
    df = selected.select("video_id").join(nearest, "video_id", "left").join(newest.select("video_id", F.col("url").alias("newest")), "video_id", "left")
    source = F.when(url_parameter(F.col("near"), "pot").isNotNull(), F.col("near")).otherwise(F.col("newest"))
    return df.select("video_id", url_parameter(source, "pot").alias("pot"), url_parameter(source, "potc").alias("potc"))


def caption_address(base: Column, device: Column, version: Column, pot: Column, potc: Column) -> Column:
    """``base`` with the fixed parameters, those of the device (a map), version and tokens; null ones are left out. What the
    address had under these names goes; the new ones stand last, in this order."""
    device = F.coalesce(device, F.create_map().cast("map<string,string>"))
    pairs = [(k, F.lit(v)) for k, v in FIXED_PARAMETERS.items()] + [(k, F.nullif(device[k], F.lit(""))) for k in DEVICE_PARAMETERS]
    pairs += [("cver", F.nullif(version, F.lit(""))), ("pot", F.nullif(pot, F.lit(""))), ("potc", F.nullif(potc, F.lit("")))]
    names = "|".join(k for k, _ in pairs)
    path, query = F.substring_index(base, "?", 1), F.when(base.contains("?"), F.regexp_extract(base, r"\?([^#]*)", 1)).otherwise("")
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^({names})(=|$)"))
    added = F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in pairs]))
    return F.concat(path, F.lit("?"), F.array_join(F.concat(kept, added), "&"))


PENDING, SENT, DONE, FAILED = "pending", "translating", "done", "failed"


def claimed(window: DataFrame, states: DataFrame) -> DataFrame:
    """Fragments of a look-ahead window (video_id, idx, ...) that are neither done nor under way."""
    return window.join(states.where(F.col("status").isin(SENT, DONE)).select("video_id", "idx"), ["video_id", "idx"], "left_anti")


def with_results(states: DataFrame, results: DataFrame) -> DataFrame:
    """States (video_id, idx, text, translated, status) after results (video_id, id, text): those under way become done, or
    failed where the service left them out or gave nothing."""
    got = results.select("video_id", F.col("id").try_cast("long").alias("idx"), F.nullif("text", F.lit("")).alias("got"))
    got = got.groupBy("video_id", "idx").agg(F.max("got").alias("got"))
    sent = F.col("status") == SENT
    df = states.join(got, ["video_id", "idx"], "left")
    return df.select(
        "video_id", "idx", "text", F.when(sent, F.col("got")).otherwise(F.col("translated")).alias("translated"),
        F.when(sent & F.col("got").isNotNull(), DONE).when(sent, FAILED).otherwise(F.col("status")).alias("status"),
    )


def sent(states: DataFrame, batch: DataFrame) -> DataFrame:
    """States with those of the batch (video_id, idx) under way."""
    marked = batch.select("video_id", "idx").distinct().withColumn("chosen", F.lit(True))
    return states.join(marked, ["video_id", "idx"], "left").withColumn("status", F.when(F.col("chosen"), SENT).otherwise(F.col("status"))).drop("chosen")


def aborted(states: DataFrame) -> DataFrame:
    """States after a stop: what was under way waits again."""
    return states.withColumn("status", F.when(F.col("status") == SENT, PENDING).otherwise(F.col("status")))


def progress(states: DataFrame) -> DataFrame:
    """video_id, how many fragments there are, and how many are done or failed."""
    return states.groupBy("video_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == DONE).alias("done"), F.count_if(F.col("status") == FAILED).alias("failed"))


def kept_states(saved: DataFrame, states: DataFrame) -> DataFrame:
    """The states of every video as last saved: those of ``states`` take the place of all that were saved of their videos."""
    return saved.join(states.select("video_id").distinct(), "video_id", "left_anti").unionByName(states)


def centroid(touches: DataFrame) -> DataFrame:
    """gesture_id and the centre of its touches (x, y)."""
    return touches.groupBy("gesture_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
