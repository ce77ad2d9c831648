from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from brookloom.llm.quality import fit_rules, learn, quality, repeated_words, text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, extra string, n_words string"


def brute(text: str | None) -> tuple:
    t = text or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    w5 = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(w5):
        if w5.count(w) > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


TEXTS = [None, "", " \n\t", "one", "a b c d e a b c d e a", "x y z w\n\nx y z w\n \n", "é# ü|% \x0b\x0c q\r\n é# ü|% \x0b\x0c q\r", "word " * 3000, "same line\nsame line\nsame line"]


def test_stats_match_brute_force(spark):
    rows = [(i, t, "e", "clash") for i, t in enumerate(TEXTS)]
    got = {r.doc_id: tuple(r[1:6]) for r in text_stats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_repeated_words(words):
    assert repeated_words(words) == brute(b" ".join(words).decode())[4]


def test_rules_are_learned_and_ordered():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600)}
    junk = (x["a"] > 0.7) | (x["b"] < 0.1)
    rules = learn(x, junk, np.arange(600) % 3 == 0)
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= r.mask(x)
    assert rules and (hit == junk).mean() > 0.98
    assert learn(x, np.zeros(600, bool), np.arange(600) % 3 == 0) == []


def test_quality_verdicts(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(30)), None, "") for i in range(60)]
    junk = [(100 + i, " ".join(f"w{i}y{j}###" for j in range(30)), None, "") for i in range(60)]
    docs = spark.createDataFrame(good + junk + [(1000, None, None, ""), (1001, "a b", None, "")], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert all(rows[i].kept for i in range(60)) and not any(rows[100 + i].kept for i in range(60))
    assert rows[1000].base_failed and rows[1001].base_failed and not rows[1000].kept
    assert rows[100].rule >= 1 and not rows[100].base_failed


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_rules(docs, labels) == []
    assert quality(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a b c d e f g h i j k", None, ""), (1, None, None, "")], SCHEMA)
    assert sorted(r.kept for r in quality(one, labels).collect()) == [False, True]
