"""Top-k search and hard negatives against every query with every row, and rows that take no part."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from brookloom.llm.negatives import PivotTable, hard_negatives, mined_negatives
from brookloom.llm.topk import BallTree, search, vector_top_k
from brookloom.llm.vectors import LEAST, MOST, first_of, products, whole_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, kth int, shard string"


def sound(rows):
    """vec_id: (whole vector, label) of the rows that take part, the smallest of each id."""
    out = {}
    for i, x, label, *_ in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            one = ([max(LEAST, min(MOST, math.floor(256 * c))) for c in x], label)
            out[i] = min(out.get(i, one), one, key=lambda y: (y[0], y[1] is not None, y[1] or 0))
    return out


def score(a, b):
    return max(int(LEAST), min(int(MOST), sum(x * y for x, y in zip(a, b, strict=False))))


def first(pairs, k):
    return sorted(pairs, key=lambda p: (-p[1], p[0]))[:k]


def brute_top(rows, every, k=5):
    known = sound(rows)
    return sorted(
        (q, rank + 1, i, s)
        for q, (v, _) in known.items() if q % every == 0
        for rank, (i, s) in enumerate(first([(i, score(v, w)) for i, (w, _) in known.items() if i != q], k))
    )


def brute_negatives(rows, every):
    known = sound([r for r in rows if r[2] is not None])
    out = []
    for a, (v, label) in known.items():
        if a % every == 0:
            scored = [(i, score(v, w), other) for i, (w, other) in known.items() if i != a]
            for p, high in [(i, s) for i, s in first([x[:2] for x in scored if x[2] == label], 5)]:
                fits = [x[:2] for x in scored if x[2] != label and 80 * high <= 100 * x[1] <= 100 * high]
                out += [(a, p, rank + 1, i, high, s) for rank, (i, s) in enumerate(first(fits, 5))]
    return sorted(out)


def made(n, seed=1, width=6):
    """Vectors near few directions, a third of them one vector, with ties, odd lengths, nulls and repeated ids."""
    rnd = random.Random(seed)
    ways = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        way = rnd.choice(ways)
        x = ways[0] if i % 3 == 0 else [round(a + rnd.gauss(0, 0.2), 1) for a in way]
        rows.append((i, list(x), rnd.choice([0, 0, 0, 1, 2, None]), "x", 1, 2, "y"))
    odd = [None, [], [1.0], [1.0, None], [float("nan")] * width, [float("inf"), 1.0], [2.0] * (width + 3)]
    rows += [(n + j, x, 1, None, None, None, None) for j, x in enumerate(odd)]
    rows += [(None, [1.0] * width, 1, "x", 1, 1, "z"), rows[5], rows[0], (100, [9.0] * width, 0, "x", 1, 1, "z"), (100, [-9.0] * width, 2, "x", 1, 1, "z")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [0, 3, 700])
def test_top_k_is_brute_force(spark, n):
    rows = made(n)
    got = sorted(tuple(r) for r in vector_top_k(spark.createDataFrame(rows, SCHEMA), every=20).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 20)


def test_top_k_over_many_cells(spark):
    from brookloom.llm.topk import top_k

    rows = made(900, seed=3)
    whole = whole_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    got = top_k(whole, whole.where("id % 4 = 0"), 5, shard_rows=100, block_queries=60)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 4)


@pytest.mark.parametrize("n", [0, 700])
def test_negatives_are_brute_force(spark, n):
    rows = made(n, seed=2)
    whole = whole_vectors(spark.createDataFrame(rows, SCHEMA).where("label is not null"), "vec_id", "embedding", "label")
    got = hard_negatives(whole, every=20, shard_rows=150, block_queries=20)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 20)
    assert n == 0 or got.count() > 50


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_top_k(none).count() == 0 and mined_negatives(none).count() == 0


def test_scores_beyond_floating_point(spark):
    rows = [(i, [float(2**k), 1.0 + i, -(2.0**k)], 0) for i, k in enumerate([0, 20, 40, 44, 52, 60, 100, 3])]
    got = vector_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), every=1)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 1)
    assert products(np.array([[2**40, 1]]), np.array([[2**20, 1]]))[0, 0] == 2**60 + 1


def test_tree_prunes_and_agrees():
    rnd = np.random.default_rng(5)
    centres = rnd.normal(0, 4000, (40, 8))
    x = np.floor(centres[rnd.integers(0, 40, 8000)] + rnd.normal(0, 60, (8000, 8))).astype(np.int64)
    ids, tree = rnd.permutation(8000), BallTree(x)
    q = x[:50]
    scored = []
    import brookloom.llm.topk as module

    real = module.products
    module.products = lambda a, b: scored.append(len(a) * len(b)) or real(a, b)
    try:
        a, row, s = search(tree, x, ids, q, ids[:50], np.full(50, LEAST), 5)
    finally:
        module.products = real
    full = q @ x.T
    for i in range(50):
        want = first([(int(ids[j]), int(full[i, j])) for j in range(8000) if j != i], 5)
        assert sorted(zip(row[a == i].tolist(), s[a == i].tolist(), strict=True)) == sorted(want)
    assert sum(scored) < 0.5 * 50 * 8000
    assert all(hi - lo <= 256 for lo, hi, _, _, left, _ in tree.nodes if left < 0)


def test_pivots_bracket_every_score():
    rnd = np.random.default_rng(6)
    x = rnd.integers(-90, 90, (400, 12))
    x[100:200] = x[0]
    longest = float(np.sqrt((x.astype(float) ** 2).sum(1)).max())
    table = PivotTable(x[:50].tolist(), longest, 6)
    far = table.distances(table.lifted(x.astype(float)))
    near = table.distances(np.column_stack([np.zeros(30), x[:30].astype(float)]))
    low, high = table.brackets(near, far, (x[:30].astype(float) ** 2).sum(1))
    exact = x[:30] @ x.T
    assert (low <= exact).all() and (exact <= high).all()


def test_first_of_takes_small_ids_of_ties():
    keep, rank = first_of(np.array([1, 0, 1, 1]), np.array([5, 1, 5, 9]), np.array([7, 1, 3, 8]), 2)
    assert keep.tolist() == [1, 3, 2] and rank.tolist() == [0, 0, 1]
