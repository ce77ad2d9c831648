from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from brookloom.llm.decontaminate import GAP, MATCH, MISMATCH, align, contamination, fold_words, without_leaks

SCHEMA = "doc_id long, text string, item_id string"


def smith_waterman(a, b) -> int:
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (MATCH if x == y else MISMATCH), h[i - 1, j] + GAP, h[i, j - 1] + GAP)
    return int(h.max())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=9))
def test_alignment_scores(a, b):
    score, lo, hi = align(np.array(a, np.uint64), np.array(b, np.uint64))
    assert score == smith_waterman(a, b) and 0 <= lo <= hi <= len(a)
    assert smith_waterman(a[lo:hi], b) == score


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefg") for _ in range(r.randrange(3, 7))) for _ in range(n)]


def test_copies_and_edited_copies_are_found(spark):
    r = random.Random(1)
    items = [(k, words(r, n)) for k, n in enumerate([40, 25, 60, 16, 3])]
    rows, want = [], {}
    for d in range(60):
        w = words(r, 200)
        if d % 3 == 0:
            k, item = items[d // 3 % 4]
            copy = list(item)
            for _ in range(len(item) // 10 if d % 2 else 0):  # a tenth of the words edited
                copy[r.randrange(len(copy))] = "edited"
            at = r.randrange(200)
            w[at:at] = [x.upper() if i % 4 == 0 else x + "," for i, x in enumerate(copy)]
            want[d] = k
        rows.append((d, " ".join(w), "clash"))
    rows += [(100, None, ""), (101, "", ""), (102, "so " + "; ".join(items[4][1]) + " it goes", ""), (None, " ".join(items[0][1]), "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w), 0) for k, w in items] + [(9, None, 0), (10, "", 0)], "item_id long, text string, score int")
    got = {(x.doc_id, x.item_id): x.score for x in contamination(docs, bench).collect()}
    assert set(got) == {*want.items(), (102, 4), (None, 0)}
    assert all(got[d, k] == 1.0 for d, k in want.items() if d % 2 == 0) and min(got.values()) > 0.6
    left = without_leaks(docs, bench)
    assert left.schema == docs.schema and {x.doc_id for x in left.collect()} == {d for d in range(60) if d not in want} | {100, 101}
    blocks = {(x.doc_id, x.item_id): x.score for x in contamination(docs, bench, block_items=2).collect()}
    assert blocks == got


def test_recall_against_full_alignment(spark):
    """Every document aligned with every item, without seeds: of the pairs that score half or more, in whole, in part or
    with up to a quarter of the words edited, the seeds find at least nine in ten, and nothing else; scores agree."""
    r = random.Random(9)
    common = words(r, 40)
    items = [(k, [r.choice(common) if r.random() < 0.3 else x for x in words(r, r.choice([12, 30, 80]))]) for k in range(25)]
    rows = []
    for d in range(150):
        w = [r.choice(common) if r.random() < 0.5 else x for x in words(r, 150)]
        if d % 2:
            copy = list(items[r.randrange(25)][1])
            if d % 3 == 0:  # a part of it
                lo = r.randrange(len(copy) // 3 + 1)
                copy = copy[lo : lo + 2 * len(copy) // 3 + 1]
            for _ in range(int(len(copy) * r.choice([0, 0.1, 0.15, 0.25]))):
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice([[], ["other"], [copy[at], "more"]]) or ["gone"]
            at = r.randrange(150)
            w[at:at] = copy
        rows.append((d, " ".join(w)))
    hashed = lambda texts: fold_words(pa.array(texts, pa.string()))
    docs, queries = hashed([t for _, t in rows]), hashed([" ".join(w) for _, w in items])
    full = {(d, k): align(a, b)[0] / (MATCH * len(b)) for (d, _), a in zip(rows, docs, strict=True) for (k, _), b in zip(items, queries, strict=True)}
    want = {p: s for p, s in full.items() if s >= 0.5}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in contamination(frame, bench).collect()}
    assert set(got) <= set(want) and len(want) > 50
    assert len(got) >= 0.9 * len(want), (len(got), len(want))
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e", "")], SCHEMA), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert contamination(docs.limit(0), bench).collect() == [] and contamination(docs, bench.limit(0)).collect() == []
    assert without_leaks(docs, bench.limit(0)).count() == 1 and without_leaks(docs.limit(0), bench).count() == 0
