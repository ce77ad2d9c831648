from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brookloom.llm.lm_score import lm_scores, planes, unplanes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts: list[str | None]) -> list[tuple[int, float]]:
    docs = [WORD.findall(t or "") for t in texts]
    count = lambda some: Counter(tuple(d[i : i + n]) for d in some for n in (1, 2, 3) for i in range(len(d) - n + 1))
    every, total, out = count(docs), sum(map(len, docs)), []
    for d in docs:
        own = count([d])
        held = lambda *g: every[g] - own[g]
        x = 0.0
        for i, w in enumerate(d):
            if i >= 2 and held(*d[i - 2 : i + 1]):
                x += math.log(held(*d[i - 2 : i + 1]) / held(*d[i - 2 : i]))
            elif i >= 1 and held(*d[i - 1 : i + 1]):
                x += math.log(held(*d[i - 1 : i + 1]) / held(d[i - 1])) + (i >= 2) * math.log(0.4)
            else:
                x += math.log(max(1, held(w)) / max(1, total - len(d))) + min(i, 2) * math.log(0.4)
        out.append((len(d), x))
    return out


TEXTS = ["a b c a b c a b d", "a b c", None, "", " \n", "zz", "a b c d e a b c d e", "the a b c " * 50, "a b c", "q r s t u v w x y z a b"]


@pytest.mark.parametrize(("size", "grams"), [(1 << 20, 10**6), (40, 7)])
def test_scores_match_brute_force(spark, size, grams):
    docs = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, n int").repartition(3)
    got = {r.doc_id or 0: r for r in lm_scores(docs, size, grams).collect()}
    for i, (n, x) in enumerate(brute(TEXTS)):
        assert got[i].n_words == n and got[i].log_score == pytest.approx(x, abs=1e-9) and got[i].mean_log_score == pytest.approx(x / max(1, n))


def test_repeated_slices_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 4, "doc_id long, text string").repartition(4)
    got = lm_scores(docs).collect()
    want = brute(["a b c"] * 4)[0]
    assert len(got) == 4 and all((r.n_words, r.log_score) == (want[0], pytest.approx(want[1])) for r in got)
    assert lm_scores(docs.limit(0)).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_planes(values):
    import numpy as np

    x = np.array(values, np.uint64)
    assert (unplanes(planes(x), np.uint64) == x).all()


def test_rare_words_keep_their_own_counts(spark):
    """Among over a million words, one that occurs twice counts once for each other document, and so do its n-grams."""
    texts = ["common " * 1_100_000, "once upon", "rare pair here", "rare pair there"]
    got = {r.doc_id: r.log_score for r in lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (_, x) in enumerate(brute(texts)):
        assert got[i] == pytest.approx(x, rel=1e-9)


def test_copies_score_above_single_texts(spark):
    """Of texts of the same words, those that another document repeats score best."""
    from random import Random

    draw = Random(5)
    texts = [" ".join(draw.choices([f"w{i}" for i in range(50)], k=30)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:10])), "doc_id long, text string")
    got = {r.doc_id: r.mean_log_score for r in lm_scores(docs).collect()}
    assert min(got[i] for i in (*range(10), *range(60, 70))) > max(got[i] for i in range(10, 60))


def test_rows_grow_with_the_words():
    from brookloom.llm.lm_score import MOST_PARTITION_GRAMS, MOST_SLICE_BYTES, PARTITION_GRAMS, SLICE_BYTES, sizes

    assert sizes(0) == sizes(150_000_000) == (SLICE_BYTES, PARTITION_GRAMS)
    rows = lambda words: (6.3 * words / sizes(words)[0]) * (2 * words / sizes(words)[1])
    assert rows(5_000_000_000) < 1.1 * 25 * rows(200_000_000)
    words = int(100e12 / 6.3)
    assert sizes(words) == (MOST_SLICE_BYTES, MOST_PARTITION_GRAMS) and 3 * words / rows(words) > 15
