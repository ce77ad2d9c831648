"""Helpers shared by the training-data operators.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r, which is what ``bytes.split()``
returns, so texts travel through Arrow as UTF-8 and are never decoded unless an operator needs code points.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd 64-bit multipliers, one for each place in a five-word window.
WINDOW_KEYS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, under spark.checkpoint.dir.

    Where the session names none, a temporary folder takes its place on one machine, until the process ends; a cluster, whose
    machines don't share such a folder, is an error. Files stay until the folder's owner clears it: rows read from them
    outlive this call.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            base = tempfile.mkdtemp(prefix="brookloom-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null counts as an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text each, and one row at least: what a task holds is bounded by
    that and its longest text, whatever the rows of a batch."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo or not batch.num_rows:
            yield batch.slice(lo, hi - lo)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on the Arrow batches of ``df``, long ones in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield work(part)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on the rows of each group of equal ``keys``, whole numbers without nulls: groups are dealt by hash, sorted,
    and streamed through a task one at a time. For many small groups, as it makes no data frame of each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            changes = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                changes |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(c[lo] for c in columns)
                if held and key != last:
                    yield work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = key
        if held:
            yield work(pa.Table.from_batches(held))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in run(batches):
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= 10_000 or len(waiting) >= 5_000:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, rows = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
        pa.default_memory_pool().release_unused()

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows (n up to five) from the words' hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1] * WINDOW_KEYS[0]
    for j in range(1, n):
        out = out + h[j : len(h) - n + 1 + j] * WINDOW_KEYS[j]
    return mix(out)


def crc_mod(column: str, modulus: int) -> F.Column:
    """crc32 of the column's text form, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
