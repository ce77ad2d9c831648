"""A keyed cache with expiry, and a queue of retries, as tables. Every operator is one equi-join or aggregate.

The cache holds (key, data, ts_ms, ttl_ms), the queue (owner, key, ts_ms, tries, ...). Writes return the new table; a
bucketed store on disk replaces the files of the buckets that a write touches, and no others. Defined results: of
equal times the greater data counts; null keys match nothing; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
DEFAULT_TTL_MS, RESULT_TTL_MS = DAY_MS, 7 * DAY_MS


def is_expired(now_ms: Column | int) -> Column:
    """Age beyond the time to live; 0 or null means the default."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    ttl = F.when(F.coalesce("ttl_ms", F.lit(0)) == 0, DEFAULT_TTL_MS).otherwise(F.col("ttl_ms"))
    return now - F.col("ts_ms") > ttl


def latest(entries: DataFrame) -> DataFrame:
    """The last write of each key."""
    row = F.struct(*[c for c in entries.columns if c != "key"])
    return entries.groupBy("key").agg(F.max_by(row, F.struct("ts_ms", "data")).alias("row")).select("key", "row.*")


def lookup(asked: DataFrame, entries: DataFrame, now_ms: int) -> DataFrame:
    """``asked`` (key, ...) with data of live entries, and whether each was a hit."""
    live = latest(entries).where(~is_expired(now_ms)).select("key", "data")
    return asked.join(live, "key", "left").withColumn("hit", F.col("data").isNotNull())


def purged(entries: DataFrame, now_ms: int) -> DataFrame:
    return latest(entries).where(~is_expired(now_ms))


def removed(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("key"), "key", "left_anti")


def stats(entries: DataFrame, now_ms: int) -> DataFrame:
    """How many keys are stored, and how many live."""
    return latest(entries).agg(F.count("*").alias("stored"), F.count_if(~is_expired(now_ms)).alias("live"))


def in_flight_once(asked: DataFrame) -> DataFrame:
    """Each key once: the first request of a key makes the call, the others wait for it."""
    return asked.groupBy("key").agg(F.min_by("request_id", "request_id").alias("caller"), (F.count("*") - 1).alias("waiting"))


def with_bucket(entries: DataFrame, buckets: int = 64) -> DataFrame:
    """A bucket of each key, for ``partitionBy("bucket")``: a write then touches its own bucket's files."""
    return entries.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def pending(queue: DataFrame, most: int = 3) -> DataFrame:
    """Entries to retry, oldest first by ``place``; those tried ``most`` times are dropped."""
    from pyspark.sql import Window as W

    return queue.where(F.col("tries") < most).withColumn("place", F.row_number().over(W.partitionBy("owner").orderBy("ts_ms", "key")))


def written(entries: DataFrame, new: DataFrame, now_ms: int, ttl_ms: int = 0) -> DataFrame:
    """The cache after ``new`` (key, data) is written: of each key the new entry, else the old."""
    fresh = new.groupBy("key").agg(F.max("data").alias("data")).select("key", "data", F.lit(now_ms).cast("long").alias("ts_ms"), F.lit(ttl_ms).cast("long").alias("ttl_ms"))
    return removed(latest(entries), fresh).select(*fresh.columns).unionByName(fresh)


def cleared(entries: DataFrame) -> DataFrame:
    return entries.limit(0)


def bucket_index(entries: DataFrame, buckets: int = 64) -> DataFrame:
    """bucket, n and keys of the store: how many entries each bucket has."""
    return with_bucket(latest(entries), buckets).groupBy("bucket").agg(F.count("*").alias("n"))


def save_bucketed(entries: DataFrame, path: str, buckets: int = 64) -> None:
    """Write whole buckets: those that ``entries`` has rows for take the place of what was there."""
    with_bucket(latest(entries), buckets).repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)


def load_bucketed(spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """The store, or what it has of a few keys: only their buckets' files are read."""
    held = spark.read.parquet(path)
    if keys is not None:
        own = spark.createDataFrame([(k,) for k in keys], "key string")
        wanted = sorted({r.bucket for r in with_bucket(own, buckets).select("bucket").distinct().collect()})  # as many as there are buckets at most
        held = held.where(F.col("bucket").isin(wanted)).join(own, "key", "left_semi")
    return held.drop("bucket")


def enqueued(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with rows whose key it didn't have, untried; rows without a key stay out."""
    first = new.where("key is not null").dropDuplicates(["key"]).join(queue.select("key"), "key", "left_anti").withColumn("tries", F.lit(0).cast(queue.schema["tries"].dataType))
    return queue.unionByName(first.select(*queue.columns))


def dequeued(queue: DataFrame, keys: DataFrame) -> DataFrame:
    return queue.join(keys.select("key").distinct(), "key", "left_anti")


def tried_again(queue: DataFrame, keys: DataFrame) -> DataFrame:
    """The queue with one more try for each of ``keys``."""
    marked = keys.select("key").distinct().withColumn("again", F.lit(1))
    tries = (F.col("tries") + F.coalesce("again", F.lit(0))).cast(queue.schema["tries"].dataType)
    return queue.join(marked, "key", "left").withColumn("tries", tries).select(*queue.columns)


def worked_off(queue: DataFrame, retry: Callable[[dict], bool], most: int = 3) -> DataFrame:
    """The queue after ``retry`` was called with every entry below ``most`` tries: what succeeded and what had its tries is
    gone, what failed or raised has one more. Entries of one owner go oldest first, in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            left = []
            for row in f.to_dict("records"):
                try:
                    done = retry(row)
                except Exception:  # a call that raises counts as failed
                    done = False
                left.append(not done)
            f["tries"] += 1
            yield f[pd.Series(left, index=f.index, dtype=bool)]

    waiting = queue.where(F.col("tries") < most).repartition("owner").sortWithinPartitions("owner", "ts_ms", "key")
    return waiting.mapInPandas(run, queue.schema)


def queue_size(queue: DataFrame) -> DataFrame:
    return queue.groupBy("owner").agg(F.count("*").alias("n"))
