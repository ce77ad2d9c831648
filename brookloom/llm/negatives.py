"""Hard negatives: rows of another label that score nearly as high against an anchor as its positives do.

An anchor's positives are its first rows of the same label by inner product; the negatives of a positive are the first rows
of other labels that score at most as high as it, and at least ``percent`` percent of that. They are found with a table of
pivots. Every row x gets one more number, sqrt(M^2 - |x|^2) with M the longest length, and an anchor gets 0, which makes the
inner product a distance: d(q, x)^2 = |q|^2 + M^2 - 2 q.x. The table holds each row's distance to every pivot, and by the
triangle inequality the distances of anchor and row to a pivot bracket the one between them, and so the score. Rows whose
bracket lies outside what is asked for are passed over; the others' scores are computed.

1. ``PIVOTS`` rows far from each other are chosen from a sample of ``SAMPLE`` rows, those of the smallest hashes of their ids;
   it bears on speed alone. Every row's distances are stored.
2. Anchors meet the rows of their label in all shards; the first of each anchor are its positives.
3. Anchors with their positives' scores meet the rows of other labels.

Ties go to the smaller id. Defined results beyond those of ``vectors``: rows with a null label take no part; of rows with
one id that differ in label too, the one with the smallest (vector, label) counts; a positive that scores below 0 has no
negatives, as no score is both over 0.8 of it and under it; an anchor that is alone with its label has no positives, and
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.llm.common import slices, stored
from brookloom.llm.vectors import first_of, grid, matrix, meet, one_each, products, ranked, whole_vectors, widened

PIVOTS, SAMPLE = 8, 1024
#: Anchors that are bracketed at a time, and rows that are scored first.
CHUNK, PROBES = 64, 32


class PivotTable:
    """Pivots of bounded number, the longest length, and distances to the pivots of rows and of anchors."""

    def __init__(self, sample: list[list[int]], longest: float, pivots: int):
        width = max(map(len, sample), default=0)
        points = np.array([x + [0] * (width - len(x)) for x in sample], np.float64).reshape(len(sample), width)
        self.longest = longest
        points = self.lifted(points)
        chosen, away = [], np.full(len(points), np.inf)
        while len(chosen) < min(pivots, len(points)) and (not chosen or away.max() > 0):
            chosen.append(int(away.argmax()) if chosen else 0)
            away = np.minimum(away, np.sqrt(((points - points[chosen[-1]]) ** 2).sum(1)))
        self.points = points[chosen]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0)), x])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        x, p = widened(lifted, self.points)
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * x @ p.T, 0))

    def brackets(self, near: np.ndarray, far: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor (distances ``near``, squared length) with each row (distances ``far``)."""
        low, high = np.zeros((len(near), len(far))), np.full((len(near), len(far)), np.inf)
        for j in range(near.shape[1]):
            np.maximum(low, np.abs(near[:, j, None] - far[None, :, j]), out=low)
            np.minimum(high, near[:, j, None] + far[None, :, j], out=high)
        whole = square[:, None] + self.longest**2
        # A squared distance of two nearby points is known to about 1e-16 of the squares that it is the difference of; its
        # root to 1e-8 of their root, so brackets are widened by more than that.
        slack = 1 + 1e-6 * whole
        return (whole - high**2) / 2 - slack, (whole - low**2) / 2 + slack


def with_distances(rows: DataFrame, table: PivotTable) -> DataFrame:
    """The rows with ``far``, their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                far = table.distances(table.lifted(matrix(pa.Table.from_batches([piece])).astype(np.float64)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([*piece.columns, lists], names=[*piece.schema.names, "far"])

    return rows.mapInArrow(run, "id long, v array<long>, label long, far array<double>")


def _sides(table: pa.Table, asked: pa.Table, pivots: PivotTable) -> tuple:
    table, ids, x = one_each(table)
    asked, own, q = one_each(asked)
    x, q = widened(x, q)
    points = q.astype(np.float64)
    near = pivots.distances(np.column_stack([np.zeros(len(q)), points]))
    labels = [t.column("label").to_numpy() for t in (table, asked)]
    return ids, x, matrix(table, "far"), labels[0], asked, own, q, near, labels[1], (points**2).sum(1)


def positives(table: pa.Table, asked: pa.Table, pivots: PivotTable, k: int) -> pa.RecordBatch:
    """The first k rows of each anchor's label in a cell."""
    ids, x, far, label, asked, own, q, near, wanted, square = _sides(table, asked, pivots)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for of in np.unique(wanted):
        mine, theirs = np.flatnonzero(wanted == of), np.flatnonzero(label == of)
        for lo in range(0, len(mine), CHUNK):
            a = mine[lo : lo + CHUNK]
            _, high = pivots.brackets(near[a], far[theirs], square[a])
            other = ids[None, theirs] != own[a, None]
            high[~other] = -np.inf
            kth = np.full(len(a), -np.inf)
            if len(theirs) > PROBES > k:  # k scores at least, each of another row, since only one is the anchor's own
                probe = np.argpartition(-high, PROBES, 1)[:, :PROBES]
                for i, p in enumerate(probe):
                    p = p[other[i, p]]
                    kth[i] = np.sort(products(q[a[i : i + 1]], x[theirs[p]])[0])[-k]
            open_ = (high >= kth[:, None]) & other
            rows = np.flatnonzero(open_.any(0))
            score = products(q[a], x[theirs[rows]])
            i, r = np.nonzero(open_[:, rows])
            keep, _ = first_of(i, score[i, r], ids[theirs[rows[r]]], k)
            out.append((own[a[i[keep]]], ids[theirs[rows[r[keep]]]], score[i[keep], r[keep]]))
    found = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 3)]
    return pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["anchor_id", "positive_id", "positive_score"])


def negatives(table: pa.Table, asked: pa.Table, pivots: PivotTable, k: int, percent: int) -> pa.RecordBatch:
    """For each anchor and positive score the first k rows of another label in a cell."""
    ids, x, far, label, asked, own, q, near, wanted, square = _sides(table, asked, pivots)
    lists = asked.column("scores").to_pylist()
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(q), CHUNK):
        a = np.arange(lo, min(lo + CHUNK, len(q)))
        low, high = pivots.brackets(near[a], far, square[a])
        # From percent of the least positive score to the greatest; scores are whole numbers.
        least = np.array([-(-min(lists[i]) * percent // 100) for i in a], np.float64)
        most = np.array([max(lists[i]) for i in a], np.float64)
        open_ = (high >= least[:, None]) & (low <= most[:, None]) & (label[None] != wanted[a, None])
        rows = np.flatnonzero(open_.any(0))
        score = products(q[a], x[rows])
        for i, one in enumerate(a):
            r = rows[open_[i, rows]]
            s = score[i, open_[i, rows]]
            for positive in lists[one]:
                fits = np.flatnonzero((s <= positive) & (s >= -(-positive * percent // 100)))
                keep, _ = first_of(np.zeros(len(fits), np.int64), s[fits], ids[r[fits]], k)
                n = len(keep)
                out.append((np.repeat(own[one], n), np.full(n, positive), ids[r[fits[keep]]], s[fits[keep]]))
    found = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
    return pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["anchor_id", "positive_score", "negative_id", "negative_score"])


def hard_negatives(rows: DataFrame, every: int = 100, positive: int = 5, negative: int = 5, percent: int = 80, pivots: int = PIVOTS, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. ``rows`` hold id, v and label; anchors
    are those whose id is divisible by ``every``."""
    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    n, longest = rows.agg(F.count("*"), F.max(F.sqrt(length))).first()
    sample = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id", "v").limit(SAMPLE).collect()
    table = PivotTable([r["v"] for r in sample], (longest or 0.0) * (1 + 1e-12), pivots)
    known = stored(with_distances(rows.select("id", "v", F.col("label").cast("long").alias("label")), table), "pivot-table")
    anchors = known.where(F.col("id") % every == 0).select("id", "v", "label")
    shape = grid(n, anchors.count(), **sizes)

    found = meet(known, anchors, shape, lambda t, q: positives(t, q, table, positive), "anchor_id long, positive_id long, positive_score long")
    chosen = stored(ranked(found, ["anchor_id"], "positive_id", "positive_score", positive).drop("rank"), "positives")
    scores = chosen.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores"))
    asking = anchors.join(scores, "id")
    near = meet(known, asking, shape, lambda t, q: negatives(t, q, table, negative, percent), "anchor_id long, positive_score long, negative_id long, negative_score long")
    best = ranked(near, ["anchor_id", "positive_score"], "negative_id", "negative_score", negative)
    return chosen.join(best, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined_negatives(embeddings: DataFrame) -> DataFrame:
    """``hard_negatives`` of ``embeddings``; the label of an id divisible by 7 moves up by 1, modulo 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return hard_negatives(whole_vectors(embeddings.where("label is not null"), "vec_id", "embedding", label))


#: The query's rows, every anchor against every row.
ORACLE_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id != r.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM scored WHERE same) WHERE k <= 5),
ranked AS (
  SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM ranked WHERE rank <= 5
"""
