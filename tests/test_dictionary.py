"""Dictionaries against a scan by regular expression and, for large ones, against every span of a text."""

from __future__ import annotations

import random
import re

import pytest

from brookloom.operators import terms
from brookloom.operators.dictionary import Matcher, dictionary_hits, folded, settled


def scan(text, names):
    """What one regular expression of all names, longest first, finds."""
    written = {}
    for n in sorted(names):
        written.setdefault(n.lower(), n)
    either = "|".join(re.escape(n) for n in sorted(written, key=lambda x: (-len(x), x)))
    found = re.finditer(rf"(?<![A-Za-z0-9_])(?:{either})(?![A-Za-z0-9_])", text.lower())
    return [(m.start(), m.end(), written[m.group()]) for m in found]


def made(r):
    parts = ["node", "Node.js", "C++", ".NET", "a", "apache", "Spark", "été", "日本", "x_y", "42"]
    return " ".join(r.choices(parts, k=r.randrange(1, 4))) if r.random() < 0.7 else r.choice(parts)


@pytest.mark.parametrize("part_bytes", [8 << 20, 60])
def test_hits_are_those_of_a_scan(spark, part_bytes):
    r = random.Random(1)
    names = [made(r) for _ in range(40)]
    rows = [(i % 50, r.choice(["", " ", ", ", "x"]).join(made(r) for _ in range(12))) for i in range(60)] + [(3, None), (None, "Node.js of apache spark")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    entries = spark.createDataFrame([(n,) for n in [*names, names[0], None, ""]], "name string")
    got = dictionary_hits(docs, entries, part_bytes=part_bytes).collect()
    want = [(i, *h) for i, t in rows if t is not None for h in scan(t, names)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 100


def test_a_hundred_thousand_entries():
    r = random.Random(2)
    words = [f"w{i:x}" for i in range(4000)]
    names = {" ".join(r.choices(words, k=r.randrange(1, 5))) for _ in range(100_000)}
    own = Matcher(names)
    for _ in range(20):
        w = " ".join(r.choice(sorted(names)[:5000]) if r.random() < 0.3 else r.choice(words) for _ in range(200)).split(" ")
        starts = [0]
        for x in w:
            starts.append(starts[-1] + len(x) + 1)
        text = " ".join(w)
        spans = [(starts[i], starts[j] - 1, text[starts[i] : starts[j] - 1]) for i in range(len(w)) for j in range(i + 1, min(i + 5, len(w)) + 1)]
        assert own.found(text) == settled(s for s in spans if s[2] in names)


def test_folding_keeps_places():
    assert folded("İstanbul ÉTÉ") == "İstanbul été" and Matcher(["istanbul", "été"]).found("İstanbul ÉTÉ") == [(9, 12, "été")]
    assert Matcher(["Nature"], fold=False, whole=False).found("naturally Natures") == [(10, 16, "Nature")]
    assert Matcher([]).found("x") == [] and Matcher(["", "a"]).found("a b") == [(0, 1, "a")]


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "name string")
    assert dictionary_hits(docs, none).count() == 0 and dictionary_hits(docs.limit(0), none).count() == 0


def test_glossary_takes_tables_of_names(spark):
    text = "We moved all of it to quietdb last week, and read of it in the Daily Planet; QuietDB Pro came later than that."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    names = spark.createDataFrame([("QuietDB",), ("QuietDB Pro",)], "name string")
    got = {r.term for r in terms.glossary(docs, names=names, publication_names=spark.createDataFrame([("Daily Planet",)], "name string")).collect()}
    assert {"QuietDB", "QuietDB Pro", "Daily Planet"} <= got
    assert {r.name for r in terms.listed_names(docs, names).collect()} == {"QuietDB", "QuietDB Pro"}
