"""Source divergence against a count of every term of every pair in Python's whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from brookloom.llm import divergence
from brookloom.llm.divergence import source_divergence, terms_of

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, idx int"


def brute(rows, min_docs, top=50):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, *_ in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        v = len(kept)

        def p(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept}

        sources = [s for g, s in counts if g == lang]
        of, whole = {s: p(counts[lang, s]) for s in sources}, p(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(of[s][t] - of[o][t]) for t in kept)) for o in sources if o != s]
            own = [(t, of[s][t] - whole[t]) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for name, found in (("pair", pairs), ("term", own)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, name, item, value, k + 1) for k, (item, value) in enumerate(found) if name == "pair" or k < top]
    return sorted(out)


def made(n, seed=1):
    rnd = random.Random(seed)
    words = ["Alpha", "alpha", "béta", "ÉTÉ", "été", "日本", "x", "don't", "a1b", "_", "12", "Zeta"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{rnd.randrange(8)}"
        text = rnd.choice([" ", "\x00", "-", "\n"]).join(rnd.choices(words, [40 - j for j in range(len(words))], k=rnd.randrange(30)))
        rows.append((i, text, rnd.choice(["en", "en", "de", None]), rnd.choice([source, source, None]), "t", 1, 2))
    rows += [(None, None, None, None, None, None, None), (1, "", "xx", "only", None, None, None), (2, "9 !", "yy", "a", "t", 0, 0), (2, None, "yy", "b", "t", 0, 0), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("min_docs", "block_rows", "tile"), [(30, 500_000, 128), (3, 20, 2), (1, 7, 3), (10_000, 5, 128)])
def test_divergence_is_brute_force(spark, min_docs, block_rows, tile):
    rows = made(400)
    got = source_divergence(spark.createDataFrame(rows, SCHEMA), min_docs=min_docs, block_rows=block_rows, tile=tile)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows, min_docs)


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_are_split_at_blanks(monkeypatch):
    text = ("Éa bb-ccc " * 50).encode()
    whole = terms_of(text)
    for stretch in (1, 3, 10, 64):
        monkeypatch.setattr(divergence, "STRETCH", stretch)
        assert terms_of(text) == whole
    assert whole[b"bb"] == 50 and whole["Éa".encode()] == 50


def test_counts_past_64_bits():
    import numpy as np

    got = divergence._probabilities(np.array([0, 10**15]), 2 * 10**15, 3)
    assert got.tolist() == [1 + 10**9 * 5 // (2 * 10**15 + 15), 1 + 10**9 * (10**15 + 5) // (2 * 10**15 + 15)]
