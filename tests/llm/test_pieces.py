from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from brookloom.llm.pieces import Pieces, Sampler, decoded, sampled_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = Pieces(PATH)
MODEL = SentencePieceProcessor(model_file=PATH)
SAMPLER = Sampler(PIECES)


def encode(texts: list[str], seed: int = 0, sampler: Sampler = SAMPLER) -> list[np.ndarray]:
    return sampler.encode([t.encode() for t in texts], np.arange(len(texts), dtype=np.uint64), seed)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("  ab\n▁\t☃thein")), max_size=40), max_size=4))
def test_round_trip(texts):
    for t, ids in zip(texts, encode(texts), strict=True):
        assert PIECES.decode(ids).tobytes() == (b" " + t.encode() if t else b"")
        if "\x00" not in t and "▁" not in t:
            assert MODEL.decode(ids.tolist()) == t


def paths(raw: bytes) -> dict[tuple, float]:
    """Every segmentation and its weight."""
    by = {x: i for i, x in enumerate(PIECES.text) if x and not MODEL.is_byte(i)}
    if not raw:
        return {(): 1.0}
    out: dict[tuple, float] = {}
    n = 1 if raw[0] < 0x80 else 2 if raw[0] < 0xE0 else 3 if raw[0] < 0xF0 else 4
    steps = [((by[raw[:k]],), k) for k in range(1, len(raw) + 1) if raw[:k] in by]
    if raw[:n] not in by:
        steps.append((tuple(int(PIECES.byte_id[b]) for b in raw[:n]), n))
    for own, k in steps:
        for rest, w in paths(raw[k:]).items():
            out[own + rest] = out.get(own + rest, 0.0) + w * float(np.exp(PIECES.weight[list(own)].sum()))
    return out


def test_draws_follow_the_lattice():
    for word in ("then", "é☃a", "a  b"):
        want = paths((" " + word).encode())
        total = sum(want.values())
        n = 40_000
        got = Counter(tuple(x.tolist()) for x in SAMPLER.encode([word.encode()] * n, np.arange(n, dtype=np.uint64), 5))
        assert set(got) <= set(want)
        for path, w in want.items():
            p = w / total
            assert abs(got[path] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 2e-4


def test_same_key_same_pieces_whatever_came_before():
    texts = ["the rain in spain", "x" * 5000, "stays\nmainly  on", ""]
    small = Sampler(PIECES, most=3)
    encode(["other words first"], 1, small)
    assert [x.tolist() for x in encode(texts, 1)] == [x.tolist() for x in encode(texts, 1, small)]
    assert any(a.tolist() != b.tolist() for a, b in zip(encode(texts, 1), encode(texts, 2), strict=True))


def test_frames(spark):
    rows = [(1, "Hello  world\n\nüber ☃", "x"), (2, None, ""), (3, "", ""), (None, "a b", ""), (1, "Hello  world\n\nüber ☃", "y"), (4, "word " * 30_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    found = sampled_pieces(docs, seed=9)
    got = found.collect()
    assert len(got) == 6 and all(r.lossless for r in got)
    same = [r.ids for r in got if r.doc_id == 1]
    assert same[0] == same[1] and len(same[0]) == [r.n_pieces for r in got if r.doc_id == 1][0]
    back = {(r.doc_id, r.text) for r in decoded(found).collect()}
    assert back == {(i, t) for i, t, _ in rows}
    assert sampled_pieces(docs.limit(0)).collect() == []


def test_long_units_are_drawn_in_stretches(monkeypatch):
    """Short stretches draw each segmentation as often as whole units do, and text without spaces stays lossless."""
    from brookloom.llm import pieces

    word = "☃a☃then☃é"
    want = paths((" " + word).encode())
    total = sum(want.values())
    monkeypatch.setattr(pieces, "STRETCH", 2)
    short, n = Sampler(PIECES), 20_000
    got = Counter(tuple(x.tolist()) for x in short.encode([word.encode()] * n, np.arange(n, dtype=np.uint64), 5))
    assert set(got) <= set(want) and len(short.first) > 3
    for path, w in want.items():
        p = w / total
        assert abs(got[path] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 3e-4
    texts = ["漢字かな" * 500 + "x", "a" * 300 + "é" * 50, " " * 40, ""]
    for t, ids in zip(texts, encode(texts, sampler=short), strict=True):
        assert PIECES.decode(ids).tobytes() == (b" " + t.encode() if t else b"")


def test_draws_do_not_depend_on_what_a_worker_holds():
    """Equal ids from a fresh sampler, from one with millions of states before them, and from one that forgets at each step."""
    texts = ["the lattice of pieces " * 5, "日本語の文章" * 40, "a" * 300, "x  y\n z", "Größenwahn énorme"]
    alone = [encode(texts, 7, Sampler(PIECES))]
    full = Sampler(PIECES)
    rnd = np.random.default_rng(1)
    full.encode([" ".join("".join(map(chr, rnd.integers(97, 123, 9))) for _ in range(60_000)).encode()], np.zeros(1, np.uint64), 0)
    assert full.states > 500_000
    for held in (full, Sampler(PIECES, most=0)):
        got = encode(texts, 7, held)
        encode(["other words in between"], 7, held)
        alone += [got, encode(texts, 7, held)]
    for other in alone[1:]:
        assert all((a == b).all() for a, b in zip(alone[0], other, strict=True))


def test_lattices_are_bounded_by_bytes():
    own = Sampler(PIECES, most=2 << 20)
    most = 0
    for k in range(30):
        text = "".join(chr(0x4E00 + (i * 7 + k * 1013) % 20_000) for i in range(20_000))
        (ids,) = encode([text], 1, own)
        assert PIECES.decode(ids).tobytes() == b" " + text.encode()
        most = max(most, own.held())
    assert most < (2 << 20) + 60 * 60_000


def test_shares_are_whole_within_a_state():
    own = Sampler(PIECES)
    encode(["then the thing there", "日本語" * 9], 1, own)
    for low, high in zip(own.low.tolist(), own.high.tolist(), strict=True):
        share = own.share[low : high + 1]
        assert not len(share) or (share[-1] == 1.0 and (np.diff(share) > -1e-12).all())
