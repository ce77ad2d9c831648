"""The tagger against all paths, the chunker by examples, and what it finds in sentences tagged by hand."""

from __future__ import annotations

import itertools
import random

from brookloom.operators import phrases, terms
from brookloom.operators.phrases import ADJ, CLASSES, NOUN, TRANSITION, chunks, frequent, people_in, scores, split, tagged

#: Sentences with their noun phrases, in order, written by hand for this test.
BY_HAND = (
    ("The new compiler builds a small index of the table", ["new compiler", "small index", "table"]),
    ("A distributed cache keeps recent results in memory", ["distributed cache", "recent results", "memory"]),
    ("She quickly reads the long report", ["long report"]),
    ("They will train a language model on public data", ["language model", "public data"]),
    ("Every query returns the nearest vector", ["query", "nearest vector"]),
    ("The operational cost of the cluster is high", ["operational cost", "cluster"]),
    ("Our team has written a careful explanation", ["team", "careful explanation"]),
    ("It depends on the network and the server", ["network", "server"]),
    ("You can add a local index to each partition", ["local index", "partition"]),
    ("The available memory limits the batch size", ["available memory", "batch size"]),
    ("A good teacher explains the difficult question", ["good teacher", "difficult question"]),
    ("We measured the latency of the token service", ["latency", "token service"]),
)


def test_best_path_is_the_best_of_all():
    r = random.Random(1)
    words = ["the", "model", "quickly", "runs", "nice", "and", "it", "will", "of", "building", "useful", "London", "tables", "help"]
    sentences = [r.choices(words, k=r.randrange(0, 6)) for _ in range(25)]
    for s, got in zip(sentences, tagged(sentences), strict=True):
        def total(path, s=s):
            return sum(scores(w)[c] for w, c in zip(s, path, strict=True)) + sum(TRANSITION[a, b] for a, b in itertools.pairwise(path))

        assert len(got) == len(s)
        if s:
            assert abs(total(got.tolist()) - max(map(total, itertools.product(range(CLASSES), repeat=len(s))))) < 1e-9


def test_noun_phrases_of_tagged_sentences():
    found = right = wanted = 0
    for text, want in BY_HAND:
        (words,) = split(text)
        got = [" ".join(p) for p in chunks(words, tagged([words])[0])]
        found, wanted, right = found + len(got), wanted + len(want), right + len(set(got) & set(want))
    assert right >= 0.85 * found and right >= 0.85 * wanted, (right, found, wanted)


def test_chunks_end_with_a_noun():
    words, classes = "big red house and old tall thing uses green".split(), [ADJ, ADJ, NOUN, phrases.CONJ, ADJ, ADJ, NOUN, NOUN, ADJ]
    import numpy as np

    assert chunks(words, np.array(classes)) == [["big", "red", "house"], ["old", "tall", "thing"]]
    assert chunks(words[:3], np.array(classes[:3]), longest=2) == [["red", "house"]]


def test_frequent_phrases():
    three = [["shard", "index"]] * 2 + [["Latency"]] * 3 + [["people"]] * 5 + [["token", "bucket"]] + [["the"]] * 4 + [["wide", "shard", "index"]]
    assert frequent(three) == [("index", 3), ("latency", 3), ("shard index", 3), ("token bucket", 1), ("wide shard index", 1)]


def test_people():
    text = "Dr. Ada Lovelace met Mr Smith. Alan Turing said so, and Grace B. Hopper wrote it. The Big House said no."
    assert people_in(text)[:4] == ["Ada Lovelace", "Smith", "Alan Turing", "Grace B. Hopper"]


def test_over_tables(spark):
    docs = spark.createDataFrame([(1, "The shard index is small. A shard index was built. Mrs Jones said that the shard index of it is good."), (1, None), (None, "")], "doc_id long, text string")
    assert ("shard index", 3) in {(r.term, r.n) for r in phrases.noun_phrases(docs).collect()}
    assert [(r.doc_id, r.name) for r in phrases.people(docs).collect()] == [(1, "Jones")]
    assert phrases.noun_phrases(docs.limit(0)).count() == 0


def test_glossary_with_tagged_phrases(spark):
    text = "The careful planner reads the shard index. Mrs Jones wrote the shard index. A careful planner of it was not built, and the shard index is good."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.term for r in terms.glossary(docs, tagged=True).collect()}
    assert {"shard index", "careful planner", "Jones"} <= got and "planner reads" not in got


def test_noise_and_breakers_are_arguments(spark):
    text = "The redis cluster and the kudus cluster. A redis cluster ships a token. The kudus cluster ships a token, and Fancy Thing ships it too: the Fancy one."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.term for r in terms.glossary(docs, noise=("fancy",), breakers=("ships",), names=("redis",)).collect()}
    assert "redis" in got and "Fancy" not in got and not any("ships" in t for t in got)


def test_slices_of_a_batch(monkeypatch):
    """What is held as words at a time is bounded by characters, not by a batch's rows, and the phrases are the same."""
    import pyarrow as pa

    from brookloom.operators import phrases

    texts = [f"The token cache of host {i} holds a large token cache. " * 20 for i in range(50)] + [""]
    want, held = phrases.phrases_of(texts), []
    monkeypatch.setattr(phrases, "SLICE_CHARS", 3000)
    monkeypatch.setattr(phrases, "tagged", lambda s: held.append(sum(len(" ".join(x)) for x in s)) or tagged(s))
    assert phrases.phrases_of(texts) == want and max(held) <= 3000 and len(held) > 10
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": ["a" * 10, None, "é" * 10, "b" * 90, "", "c"]})
    assert [b.column("doc_id").to_pylist() for b in phrases.sliced(batch, 30)] == [[0, 1, 2], [3], [4, 5]]
