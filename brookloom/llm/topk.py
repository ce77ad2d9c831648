"""Exact top-k search by inner product: ball trees of shards, branch and bound, and kth scores that shards share.

Each shard's rows form a ball tree: a node has a centre and a radius, so no row below it scores over q.centre + |q| * radius.
The queries of a block go down the tree together, the node of the highest bound first; a node drops the queries whose kth
score so far is above its bound, and a leaf scores those that are left.

1. Each query meets the shard that its id falls into, and gets a first kth score there.
2. With it the query meets all other shards, which prune by the better of the shared and their own kth score.
3. The first k of what all shards found are the result.

Ties go to the smaller id, so a bound equal to the kth score doesn't prune. Defined results beyond those of ``vectors``: a
query takes part in no result of its own; with fewer than k other rows all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.llm.common import stored
from brookloom.llm.vectors import LEAST, MOST, first_of, grid, meet, one_each, part, products, ranked, whole_vectors, widened

LEAF_ROWS = 256
FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes over rows ordered so that each node's are one run. Halves are cut at the median along the line between two far
    rows, so equal rows fill leaves like any others."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []  # first, end, centre, radius, children or -1
        points = x.astype(np.float64)

        def grown(lo: int, hi: int) -> int:
            at, own = len(self.nodes), points[self.order[lo:hi]]
            centre = own.mean(0)
            away = np.sqrt(((own - centre) ** 2).sum(1))
            self.nodes.append((lo, hi, centre, float(away.max()), -1, -1))
            if hi - lo > leaf_rows:
                one = own[away.argmax()]
                two = own[((own - one) ** 2).sum(1).argmax()]
                half = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own @ (two - one), half)]
                del own
                self.nodes[at] = (*self.nodes[at][:4], grown(lo, lo + half), grown(lo + half, hi))
            return at

        if len(x):
            grown(0, len(x))


def search(tree: BallTree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, shared: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row id, score) of the first k rows of each query among those that score ``shared`` or more."""
    x, ids = x[tree.order], ids[tree.order]
    points, length = q.astype(np.float64), np.sqrt((q.astype(np.float64) ** 2).sum(1))
    score, row = np.full((len(q), k), LEAST), np.full((len(q), k), MOST)
    kth = shared.copy()

    def bound(node: int, active: np.ndarray) -> np.ndarray:
        _, _, centre, radius, _, _ = tree.nodes[node]
        reach = length[active] * (np.sqrt((centre**2).sum()) + radius)
        return points[active] @ centre + length[active] * radius + 1 + reach * 1e-9  # above what rounding may take

    order = itertools.count()
    heap: list[tuple[float, int, int, np.ndarray, np.ndarray]] = []

    def push(node: int, active: np.ndarray) -> None:
        top = bound(node, active)
        if (open_ := top >= kth[active]).any():
            heapq.heappush(heap, (-top.max(), next(order), node, active[open_], top[open_]))

    if tree.nodes and len(q):
        push(0, np.arange(len(q)))
    while heap:
        _, _, node, active, top = heapq.heappop(heap)
        active = active[top >= kth[active]]
        if not len(active):
            continue
        lo, hi, _, _, left, right = tree.nodes[node]
        if left >= 0:
            push(left, active)
            push(right, active)
            continue
        s = products(q[active], x[lo:hi])
        last = np.where(kth[active] == score[active, -1], row[active, -1], MOST)  # a tie with the kth must have a smaller id
        hit = ((s > kth[active, None]) | (s == kth[active, None]) & (ids[None, lo:hi] < last[:, None])) & (ids[None, lo:hi] != own[active, None])
        a, r = np.nonzero(hit)
        if not len(a):
            continue
        better = np.unique(active[a])
        group = np.concatenate([np.repeat(better, k), active[a]])
        scores = np.concatenate([score[better].ravel(), s[a, r]])
        rows = np.concatenate([row[better].ravel(), ids[lo:hi][r]])
        keep, rank = first_of(group, scores, rows, k)
        score[group[keep], rank], row[group[keep], rank] = scores[keep], rows[keep]
        kth[better] = np.maximum(kth[better], score[better, -1])
    a, r = np.nonzero(row != MOST)
    return a, row[a, r], score[a, r]


def top_k(rows: DataFrame, queries: DataFrame, k: int, **sizes: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's first k other rows. Both frames hold id and v (``whole_vectors``)."""
    shape = grid(rows.count(), queries.count(), **sizes)

    def work(table: pa.Table, asked: pa.Table) -> pa.RecordBatch:
        _, ids, x = one_each(table)
        asked, own, q = one_each(asked)
        x, q = widened(x, q)
        shared = asked.column("kth").to_numpy()
        a, found, score = search(BallTree(x), x, ids, q, own, shared, k)
        return pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    home = part("id", shape[0])
    first = stored(meet(rows, queries.withColumn("kth", F.lit(int(LEAST))), shape, work, FOUND, F.array(home)), "first")
    kth = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    known = queries.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(int(LEAST))))
    others = F.array_except(F.sequence(F.lit(0), F.lit(shape[0] - 1)), F.array(home))
    rest = meet(rows, known, shape, work, FOUND, others)
    return ranked(first.union(rest), ["query_id"], "vec_id", "score", k).select("query_id", "rank", "vec_id", "score")


def vector_top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``top_k`` of the rows of ``embeddings`` whose vec_id is divisible by ``every``."""
    rows = whole_vectors(embeddings, "vec_id", "embedding")
    return top_k(rows, rows.where(F.col("id") % every == 0), k)


#: The query's rows, every query against every row.
ORACLE_SQL = r"""
WITH e AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id != c.vec_id),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""
