"""Whole-number vectors, and the grid in which a stated set of query vectors meets all rows in bounded cells.

A component x becomes floor(SCALE * x). Rows whose id or vector is null, or whose vector holds a null or a number that isn't
finite, take no part. Of rows with one id the one with the smallest vector (number by number) counts. A vector that is
shorter than another counts as followed by zeros. Scores are exact; beyond 64 bits they are held at the ends of a long.

Rows are dealt by the hash of their id over shards, queries likewise over blocks; a cell is one shard with one block. Both
sizes bound what a task holds, and rows are shipped once a block, queries once a shard.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookloom.llm.common import map_groups

SCALE = 256
#: Most rows of a shard, and queries of a block, on average; a small table is cut into SHARDS all the same.
SHARD_ROWS, BLOCK_QUERIES, SHARDS = 65_536, 16_384, 16
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole_vectors(df: DataFrame, id_column: str, vector: str, *more: F.Column) -> DataFrame:
    """id, v (whole numbers) and ``more`` of the rows that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    return df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & sound).select(F.col(id_column).cast("long").alias("id"), v.alias("v"), *more)


def grid(rows: int, queries: int, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> tuple[int, int]:
    """Shards and blocks for so many rows and queries."""
    return max(-(-rows // shard_rows), min(SHARDS, rows // 256), 1), max(-(-queries // block_queries), 1)


def part(column: str, parts: int) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def meet(rows: DataFrame, queries: DataFrame, shape: tuple[int, int], work: Callable[[pa.Table, pa.Table], pa.RecordBatch], schema: str, shards: F.Column | None = None) -> DataFrame:
    """``work`` on the rows and the queries of every cell. ``shards`` names those that a query meets, all if not given. Both
    frames have id, v and other columns, null in the other's rows."""
    n, blocks = shape
    every = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    left = rows.withColumns({"shard": part("id", n), "is_query": F.lit(False)}).withColumn("block", F.explode(every(blocks)))
    right = queries.withColumns({"block": part("id", blocks), "is_query": F.lit(True)}).withColumn("shard", F.explode(every(n) if shards is None else shards))

    def cell(table: pa.Table) -> pa.RecordBatch:
        is_query = table.column("is_query").combine_chunks()
        return work(table.filter(pa.compute.invert(is_query)), table.filter(is_query))

    return map_groups(left.unionByName(right, allowMissingColumns=True), ["shard", "block"], cell, schema)


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    """A list column as a matrix, short lists followed by zeros."""
    lists = table.column(column).combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(lists.offsets.to_numpy())
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), flat.dtype)
    out[np.arange(width) < size[:, None]] = flat
    return out


def widened(*parts: np.ndarray) -> list[np.ndarray]:
    width = max(x.shape[1] for x in parts)
    return [np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts]


def one_each(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows in order of their ids, one of each; ids and vectors."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        keys = list(zip(ids.tolist(), table.column("v").to_pylist(), strict=True))
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        order = order[np.append(True, np.diff(ids[order]) != 0)]
    table = table.take(pa.array(order))
    return table, ids[order], matrix(table)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b. Floating-point numbers hold them exactly below 2^53; Python's whole
    numbers do beyond."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    top = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if top(a) * top(b) * max(a.shape[1], 1) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first k of each group, highest score and then smallest id first; and their ranks from 0."""
    order = np.lexsort((ids, np.invert(score), group))
    g = group[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < k], rank[rank < k]


def ranked(found: DataFrame, keys: list[str], candidate: str, score: str, k: int) -> DataFrame:
    """The first k candidates of each key of what the cells found, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), candidate))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
