from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brookloom.llm.language import _codes, fit, identify, language, scores
from brookloom.llm.queries import op3_language_id

SF = "/root/testdata/sf0.01"
SYLLABLES = {"aa": "ka to mi re su na".split(), "bb": "ber ung sch lich ent zu".split(), "cc": "tion eau ou ère des qu".split()}


def held(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


def corpus(n=300):
    r = random.Random(7)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 60))), lang))
    return rows


def test_codes_match_a_plain_scan():
    texts = ["ab cde", "", None, "É1x yz", "a", "longer Words, here"]
    code, row = _codes(pa.array(texts, pa.string()))
    want = []
    for i, t in enumerate(texts):
        b = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in b"  " + (t or "").lower().encode() + b"  ")
        want += [(i, b[j : j + 4]) for j in range(len(b) - 3) if b[j + 1] != 32 and b[j + 2] != 32]
    got = sorted((int(r), int(c).to_bytes(4, "little")) for c, r in zip(code, row, strict=True))
    assert got == sorted(want)


def test_held_out_languages(spark):
    rows = corpus()
    more = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 - 34 !", "cc"), (None, rows[0][1], None), (1003, rows[1][1], None), (1003, rows[1][1], "zz"), (1004, "ka " * 60_000, None)]
    docs = spark.createDataFrame([(*x, "s", 1.0) for x in rows + more], "doc_id long, text string, lang string, source string, score double")
    got = language(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 7 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    tested = [by[i].lang_pred == lang for i, _, lang in rows if held(i)]
    assert np.mean(tested) >= 0.98
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002)) and by[1004].lang_pred == "aa" and by[None].lang_pred == rows[0][2]


def test_false_positives_are_corrected(spark):
    rows = corpus(200)
    found = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    noise = pa.array(["".join(random.Random(k).choice("xyzqwjv") for _ in range(3000)) for k in range(20)])
    assert scores(found, noise).mean() < 0.01 and (found.false_rate > 0).all()


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "hello", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language(docs).collect()} == {"und"}
    assert language(docs.limit(0)).collect() == []
    assert identify(docs.limit(0), fit(docs.limit(0))).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_accuracy_on_the_tables(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").where("lang is not null")
    rows = op3_language_id(spark, SF).where("held_out").join(lang, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_rare_ngrams_add_nothing(spark):
    """The rate that bounds the filter names at least as many held-out documents right as a filter of all n-grams."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = docs.where("lang is not null")
    right = {}
    for rate in (0.0, 1e-5):
        found = fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1"), rate)
        rows = identify(asked.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), found).join(asked.select("doc_id", "lang"), "doc_id").collect()
        right[rate] = np.mean([r.lang == r.lang_pred for r in rows])
    assert right[1e-5] >= right[0.0] >= 0.97, right
