from __future__ import annotations

import random
import re

import numpy as np

from brookloom.llm import near_dup
from brookloom.llm.near_dup import components, minhashes, near_duplicates, odd_sketches, shingles, sketch_similarity, without_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def full_set(text: str | None) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows: list[tuple], num: int) -> dict:
    sets, up = [(i, full_set(t)) for i, t in rows if i is not None], {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 1000 * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def corpus(seed: int) -> list[tuple]:
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(12):  # loosely tied groups: each edit differs from the others too
        base = [r.choice(vocab) for _ in range(r.choice([6, 40, 120, 300]))]
        for _ in range(r.choice([1, 3, 20])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, r.choice([" ", "\n"]).join(w)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t"), (i + 3, "Two WORDS"), (i + 4, "two words"), (i + 5, "two words more")]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "e", 5) for x in rows], "doc_id long, text string, component_id string, label int")


def test_components_match_brute_force(spark, monkeypatch):
    for seed, cell in ((1, 512), (2, 3)):
        monkeypatch.setattr(near_dup, "CELL_DOCS", cell)
        rows = corpus(seed)
        got = {r.doc_id: r for r in near_duplicates(frame(spark, rows), 0.85).collect()}
        assert {i: r.component_id for i, r in got.items()} == brute(rows, 850)
        assert all(got[i].n_shingles == len(full_set(t)) and got[i].kept == (got[i].component_id == i) for i, t in rows)


def test_recall_at_the_pipelines_threshold(spark):
    """At 0.8 no component is lost on these texts, where one pair in 2,400 shares no band but has other links."""
    rows = corpus(7)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), 0.8).collect()}
    assert got == brute(rows, 800)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """Half of all rows vary one text, dealt over many cells; a chain of edits reaches from one end to the other."""
    monkeypatch.setattr(near_dup, "CELL_DOCS", 16)
    r = random.Random(11)
    base = [f"t{k}" for k in range(150)]
    rows, chain = [], list(base)
    for i in range(150):
        w = list(base)
        w[r.randrange(150)] = f"e{i}"
        rows.append((i, " ".join(w)))
    for i in range(20):
        chain[i * 7] = f"c{i}"
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000 + i, " ".join(r.choices([f"o{k}" for k in range(500)], k=80))) for i in range(100)] + [(3000 + i, " " * i) for i in range(30)]
    got = {x.doc_id: x.component_id for x in near_duplicates(frame(spark, rows), 0.85).collect()}
    assert got == brute(rows, 850) and got[1019] == got[0] == 0


def test_equal_sets_of_other_order(spark):
    """Two orders of the same shingles are two classes with one link."""
    a = "a b c d e f g h i j"
    rows = [(1, f"{a} x {a} y {a}"), (2, f"{a} y {a} x {a}"), (3, f"{a} X {a}  y {a}")]
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), 0.85).collect()}
    assert got == brute(rows, 850) and got[3] == 1


def test_repeated_and_null_ids(spark):
    t = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(5, t[0]), (5, t[1]), (7, t[1]), (9, t[0]), (None, t[0]), (3, t[2]), (3, t[2])]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 5, True)] * 2 + [(7, 5, False), (9, 5, False), (None, None, True), (3, 3, True), (3, 3, True)], key=str)
    left = without_near_duplicates(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "component_id", "label"]
    assert sorted((r.doc_id for r in left.collect()), key=str) == [3, 5, None]


def test_empty(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
    assert [(r.component_id, r.kept) for r in near_duplicates(frame(spark, [(4, None)])).collect()] == [(4, True)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.doc_id: r.label for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(31)}, 90: 90, 95: 90, 100: 90}


def test_sketches_estimate_high_similarities():
    r, found = random.Random(3), []
    for _ in range(60):
        w = [f"x{r.random()}" for _ in range(200)]
        v = list(w)
        v[r.randrange(200)] = "y"
        a, b = shingles(" ".join(w).encode()), shingles(" ".join(v).encode())
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = odd_sketches(np.array([minhashes(a), minhashes(b)]))
        found.append(float(sketch_similarity(np.bitwise_count(s[0] ^ s[1]).sum())) - true)
    assert abs(np.mean(found)) < 0.02 and np.max(np.abs(found)) < near_dup.LIKELY_MARGIN


def test_columns_of_the_operator_may_be_the_callers(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 9, "a", 0), (2, text, 8, "b", 1), (None, text, 7, "c", 2), (3, "other words " * 6, 6, "d", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id long, row string, label int")
    got = sorted(without_near_duplicates(docs).collect(), key=lambda r: r.kept_id)
    assert [tuple(r) for r in got] == [rows[3], rows[2], rows[0]] and got[0].__fields__ == docs.columns
