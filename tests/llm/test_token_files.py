from __future__ import annotations

import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brookloom.llm.token_files import BLOCK, WordEncoder, block_ids, decode_blocks, encode_blocks, read_tokens, token_files, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    payload = encode_blocks(ids)
    assert (decode_blocks(payload) == ids).all()
    for at in range(-(-len(ids) // BLOCK)):
        assert (block_ids(payload, at) == ids[at * BLOCK : (at + 1) * BLOCK]).all()


def test_small_values_take_few_bits():
    ids = np.random.default_rng(0).integers(1000, 1016, 25600).astype(np.uint32)
    ids[::100] = 4_000_000_000
    assert len(encode_blocks(ids)) < 25600 * 1.0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab'sé  ́ \x1c\n\tΣ<|>")), max_size=60))
def test_words_encode_as_the_whole_text(text):
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    ids, size = ENCODER.encode(pa.array([text, None, text]))
    assert ids.tolist() == [*want, 2, 2, *want, 2] and size.tolist() == [len(want) + 1, 1, len(want) + 1]


ENCODER = WordEncoder(PATH)


def test_special_strings_and_full_store():
    small = WordEncoder(PATH, most=3)
    tok = Tokenizer.from_file(PATH)
    for t in ["a<|endoftext|>b <|startoftext|> c", " one two three four five six one two", "six seven one", "Straße ÉTÉ été. Œuvre İstanbul ŉa Ἀθήνα ДОМ дом!? K Å ǆ ſ"]:
        assert small.encode(pa.array([t]))[0].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2]


def test_every_letter_of_the_plain_blocks():
    """Words of two letters, in either case, before and after marks."""
    tok = Tokenizer.from_file(PATH)
    letters = [chr(c) for lo, hi in ((0x41, 0x5B), (0xC0, 0x180), (0x400, 0x460)) for c in range(lo, hi)]
    text = " ".join(x + y + z for x in letters for y, z in (("e", ""), ("E", ".,"), ("", "|;|")))
    assert ENCODER.encode(pa.array([text]))[0].tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2]


def test_files_of_another_form_encode_whole_texts(tmp_path):
    other = public_tokenizers.path("word_bpe_49k.json")
    form = json.loads(open(other, encoding="utf-8").read())
    form["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(form), encoding="utf-8")
    tok, own = Tokenizer.from_file(str(path)), WordEncoder(str(path))
    assert not own.by_word
    texts = ["Hello  wide world.", "", "a b"]
    ids, size = own.encode(pa.array([*texts, None]))
    want = [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in [*texts, ""]]
    assert ids.tolist() == sum(want, []) and size.tolist() == [len(x) for x in want]


def test_files_hold_every_document(spark, tmp_path):
    texts = ["Hello world", None, "", "a b c " * 30_000, "don't STOP <|endoftext|>", "x", "x"]
    ids = [5, 3, 9, 1, -2, 7, 7]
    rows = [(i, t, 0) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    write_tokens(docs, str(tmp_path / "f"))
    got = read_tokens(spark, str(tmp_path / "f"), ids=True).orderBy("start").collect()
    tok, at = Tokenizer.from_file(PATH), 0
    for (i, t), r in zip(sorted(zip(ids, texts, strict=True), key=lambda x: x[0]), got, strict=True):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    assert token_files(spark.createDataFrame([], "doc_id long, text string")).collect() == []
