from __future__ import annotations

import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from brookloom.llm.queries import op1_toxicity
from brookloom.llm.toxicity import fit, folded, text_windows, toxicity

SF = "/root/testdata/sf0.1"


def held(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def corpus(n=600):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(800)]
    slurs = ["wretchedfool", "disgustingly", "vilecreature", "pathetic scum"]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randrange(30, 200))]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(r.randrange(3, 7)):
                words.insert(r.randrange(len(words)), r.choice(slurs))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_windows_cover_the_text():
    for t in (b"", b"a", b"one two three", b"x" * 500, b"Some, WORDS; here " * 40):
        f = folded(t)
        w = text_windows(f, 32)
        assert b"".join([w[0], *(x[1:] for x in w[1:])]) == f if w else not f.strip()


def test_held_out_documents_are_told_apart(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(900, None, "x", 0.1), (901, "", "x", 0.1), (902, rows[1][1], "y", 0.2), (None, rows[1][1], "", 0.0)], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == len(rows) + 4 and all(r.held_out == held(i) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    tested = [(y, got[i].predicted) for i, _, y in rows if held(i)]
    assert sum(y == p for y, p in tested) >= 0.95 * len(tested)
    assert got[902].score == got[1].score == got[None].score and got[900].score == got[901].score < 0.5


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    plain = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, toxic int")
    assert sorted(toxicity(docs, plain).collect()) == sorted(toxicity(docs, turned).collect())


def test_one_kind_of_label_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity(docs, labels).collect()} == {1}
    assert {r.predicted for r in toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity(docs.limit(0), labels).collect() == []


def test_rare_telling_words_are_learned(spark):
    """A slur of one document in fifty, beside a common one, is in the dictionary; a copy with another label isn't dropped."""
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows = [(i, words(80) + " commonslur " * (i % 2), i % 2) for i in range(1500)]
    rows = [(i, t + " rareinsult " * (i % 50 == 1), y) for i, t, y in rows]
    rows += [(5000 + i, rows[i][1], 1 - rows[i][2]) for i in range(0, 40, 3)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = fit(docs, labels)
    assert b"rareinsult" in model.toxic and b"commonslur" in model.toxic and b"rareinsult" not in model.ordinary


def test_what_tells_at_a_words_start_is_found(spark):
    """Toxic words begin with two syllables that ordinary words hold in that order too, but further on."""
    r = random.Random(11)
    parts = "ach lich keit ung ver ein der schie heit be ge tz pf über öff isch".split()
    word = lambda: "".join(r.choice(parts) for _ in range(r.randrange(2, 5)))
    rows = []
    for i in range(700):
        words = [w for w in (word() for _ in range(r.randrange(60, 240))) if not w.startswith("achlich")]
        if i % 5 == 1:
            for _ in range(max(3, len(words) // 45)):
                words.insert(r.randrange(len(words)), "achlich" + r.choice(parts))
        rows.append((i, " ".join(words), int(i % 5 == 1)))
    assert sum("achlich" in t for _, t, y in rows if not y) > 150
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity(docs, labels).collect()}
    found = [got[i] for i, _, y in rows if y and held(i)]
    wrong = [got[i] for i, _, y in rows if not y and held(i)]
    assert sum(found) >= 0.9 * len(found) and sum(wrong) <= 0.05 * len(wrong)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_figures_on_the_tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    got = op1_toxicity(spark, SF).where("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["n"] for r in got.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    found, missed, wrong, right = (n.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
    assert found >= 0.65 * (found + missed) and wrong <= 0.015 * (wrong + right), n
