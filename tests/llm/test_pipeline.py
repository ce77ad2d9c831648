from __future__ import annotations

import random

import corpus_pipeline
from brookloom.llm.decontaminate import contamination
from brookloom.llm.pii import entities, session_key, surrogate
from brookloom.llm.quality import quality


def tables(spark, folder):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(30)) for k in range(5)]
    rows = [(i, text(120), "en", "s") for i in range(60)]
    rows += [(100 + i, " ".join(f"{word()}###" for _ in range(60)), "en", "s") for i in range(60)]
    rows += [(200, rows[3][1] + " more", "en", "s"), (201, rows[3][1], None, None), (300, text(60) + " " + items[2][1] + " " + text(60), "en", "s")]
    rows += [(400, text(50) + " ann.b7@mail3.example.com " + text(50), "en", "s"), (500, None, None, None), (501, "too few words", "en", "s"), (502, text(20) + " same here now then again" * 30, "en", "s")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return docs, labels, spark.createDataFrame(items, "item_id long, text string")


def test_stages_in_order(spark, tmp_path):
    docs, labels, items = tables(spark, tmp_path)
    left, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        left = stage(spark, left, str(tmp_path))
        left.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert left.columns == docs.columns
        seen[name] = {r.doc_id for r in left.select("doc_id").collect()}
    assert seen["quality_rules"] == {r.doc_id for r in quality(docs, labels).where("kept").collect()} == {*range(60), 200, 201, 300, 400}
    assert seen["near_duplicates"] == {*range(60), 300, 400}
    assert [r.doc_id for r in contamination(docs, items).collect()] == [300]
    assert seen["decontamination"] == seen["pii_surrogates"] == seen["sentencepiece"] == {*range(60), 400}
    kept = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "pii_surrogates")).collect()}
    assert surrogate("email", "ann.b7@mail3.example.com", session_key(spark)) in kept[400].text and len(entities(kept[400].text)) == 1
    assert left.where("not lossless").isEmpty()
    assert left.exceptAll(corpus_pipeline.run(spark, str(tmp_path))).isEmpty()


def test_empty_documents(spark, tmp_path):
    docs, _, _ = tables(spark, tmp_path)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
