"""Requests, results, tracks, stores and queues that no SQL states, on small examples; word counts against plain scans."""

from __future__ import annotations

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookloom.functions.text import pixels
from brookloom.operators import cache, layout, requests, terms, tracks
from brookloom.sources.html import html_nodes, keyed


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_bodies_are_json(spark):
    texts = [["a", 'q"uo\\te\n'], ["b", None], ["c", "漢字 é"]]
    df = spark.createDataFrame([([{"id": i, "text": t or ""} for i, t in texts],), ([],)], "blocks array<struct<id:string,text:string>>")
    got = [json.loads(r.x) for r in df.select(requests.request_body(F.col("blocks"), F.lit("s"), "m", 0.3).alias("x")).collect()]
    said = json.dumps([{"id": i, "text": t or ""} for i, t in texts], indent=2, ensure_ascii=False)
    assert got[0]["messages"] == [{"role": "system", "content": "s"}, {"role": "user", "content": f"JSON:\n\n{said}"}] and got[0]["temperature"] == 0.3
    assert got[1]["messages"][1]["content"] == "JSON:\n\n[]" and got[0]["max_tokens"] == max(1024, -(-len(said) // 2) * 16)


def test_styles_and_missing_parts(spark):
    df = spark.createDataFrame([("en", None, "loud"), (None, "fr", None)], "source string, target string, style string")
    got = df.select(requests.system_prompt(F.col("source"), F.col("target"), F.array(F.lit(None).cast("string")), F.lit(None).cast("string"), F.col("style"), {"loud": "SHOUT {source} in {target}"}).alias("x")).collect()
    assert got[0].x == "SHOUT English in Simplified Chinese" and got[1].x.startswith("Translate English to fr.") and "mentions" not in got[1].x


def test_lenient_results_skip_what_is_none(spark):
    raw = [(1, '[{"id":1,"translated_text":"","text":"t"},{"id":null,"text":"x"},{"id":"2"},{"id":"3","text":""},{"id":1,"text":"later"}]'), (2, "no json"), (3, '{"results":[]}'), (4, None)]
    assert rows(requests.lenient_results(spark.createDataFrame(raw, "doc_id long, raw string")), "doc_id", "id", "text") == [(1, "1", "later"), (1, "3", "")]


def test_bilingual_pages(spark):
    page = '<base href=x><div data-block-id=b1><i class="x">A</i><b class="y translation"> A2 </b><b class=translation>no</b></div><p data-block-id=b2><b class=translation>same</b></p><p data-block-id=b3></p>'
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    blocks = spark.createDataFrame([(1, "b1", "A"), (1, "b2", "same"), (1, "b3", "C"), (2, "b1", "A")], "page_id long, id string, text string")
    assert rows(requests.server_results(pages, blocks), "page_id", "id", "translated") == [(1, "b1", "A2")]


def test_blocks_are_located_by_id_then_path(spark):
    pages = keyed(spark.createDataFrame([(1, "u", "<body><p>one</p><p data-block-id=b1>two</p></body>")], "page_id long, url string, html string"))
    nodes = html_nodes(pages)
    key = nodes.first().page_key
    blocks = spark.createDataFrame([(key, "b1", "/body[1]/p[1]"), (key, "b2", "/body[1]/p[1]"), (key, "b3", "/none")], "page_key string, id string, xpath string")
    assert rows(requests.located(blocks, nodes), "id", "pos") == [("b1", 2), ("b2", 1), ("b3", None)]


def test_results_are_applied_once_and_undone(spark):
    held = spark.createDataFrame([(1, "c", "a", "x", "old"), (1, "c", "b", "y", None)], "doc_id long, chunk_id string, id string, text string, translated string")
    fresh = spark.createDataFrame([(1, "c", "a", "new"), (1, "c", "b", "new")], "doc_id long, chunk_id string, id string, translated string")
    once = requests.applied_once(held, fresh)
    assert rows(once, "id", "translated") == [("a", "old"), ("b", "new")] == rows(requests.applied_once(once, fresh), "id", "translated")
    assert requests.restored(once).columns == ["doc_id", "chunk_id", "id", "text"]


def test_observed_metrics(spark):
    df = requests.observed(spark.range(10).toDF("id"), "chunks", late=F.count_if(F.col("id") > 7))
    assert df.count() == 10


def test_tokens_and_addresses(spark):
    selected = spark.createDataFrame([(v, "s", "en", None) for v in ("a", "b", "c", "d")], "video_id string, vss_id string, language string, kind string")
    audio = spark.createDataFrame(
        [("a", 0, "other", "en", None, "https://x/?pot=lang"), ("a", 1, "s", "fr", "asr", "https://x/?pot=own&potc=1"), ("b", 0, "t", "de", None, "https://x/?pot=any"), ("c", 0, "s", "en", None, "https://x/none")],
        "video_id string, ord int, vss_id string, language string, kind string, url string",
    )
    newest = spark.createDataFrame([("c", "https://y/api/timedtext?v=c&pot=cached"), ("a", "https://y/?pot=no")], "video_id string, url string")
    assert rows(tracks.track_tokens(selected, audio, newest), "video_id", "pot", "potc") == [("a", "own", "1"), ("b", "any", None), ("c", "cached", None), ("d", None, None)]
    df = spark.createDataFrame([("https://x/t?v=1&fmt=srv1&pot=old", {"cbr": "Fire fox", "other": "x"}, "2.0", "p=t", None), ("/t", None, None, None, None)], "base string, device map<string,string>, cver string, pot string, potc string")
    got = df.select(tracks.caption_address(*[F.col(c) for c in df.columns]).alias("u")).collect()
    fixed = "fmt=json3&xorb=2&xobt=3&xovt=3&c=WEB&cplayer=UNIPLAYER"
    assert [r.u for r in got] == [f"https://x/t?v=1&{fixed}&cbr=Fire+fox&cver=2.0&pot=p%3Dt", f"/t?{fixed}"]
    assert df.select(tracks.whole_address(F.col("base"), F.lit("https://o")).alias("u")).collect()[1].u == "https://o/t"
    assert spark.range(1).select(tracks.audio_language(F.lit("https://x/?a=1&lang=de")).alias("x")).first().x == "de"


def test_states_of_fragments(spark):
    states = spark.createDataFrame([("v", i, "t", None, s) for i, s in enumerate(("pending", "translating", "done", "failed"))], "video_id string, idx long, text string, translated string, status string")
    window = states.select("video_id", "idx")
    assert rows(tracks.claimed(window, states), "idx") == [(0,), (3,)]
    assert rows(tracks.sent(states, window.where("idx = 0")), "idx", "status")[0] == (0, "translating")
    assert rows(tracks.aborted(states), "idx", "status")[1] == (1, "pending")
    other = states.withColumn("video_id", F.lit("w"))
    assert rows(tracks.kept_states(states.unionByName(other), states.where("idx = 2")), "video_id", "idx") == [("v", 2), ("w", 0), ("w", 1), ("w", 2), ("w", 3)]


def test_bucketed_store(spark, tmp_path):
    path = str(tmp_path / "store")
    entries = spark.createDataFrame([(f"k{i}", f"d{i}", i, 0) for i in range(50)] + [("k1", "newer", 99, 0)], "key string, data string, ts_ms long, ttl_ms long")
    cache.save_bucketed(entries, path, 8)
    assert rows(cache.load_bucketed(spark, path, ["k1", "k7", "zz"], 8), "key", "data") == [("k1", "newer"), ("k7", "d7")]
    assert sum(r.n for r in cache.bucket_index(entries, 8).collect()) == 50
    own = cache.with_bucket(spark.createDataFrame([("k1",)], "key string"), 8).first().bucket
    bucket = spark.read.parquet(path).where(F.col("bucket") == own).select("key", "data", "ts_ms", "ttl_ms").collect()
    cache.save_bucketed(spark.createDataFrame([(r.key, "again", 100, 0) for r in bucket], entries.schema), path, 8)
    held = cache.load_bucketed(spark, path)
    assert held.count() == 50 and held.where("data = 'again'").count() == len(bucket) and cache.cleared(entries).count() == 0


def test_queue_is_worked_off(spark):
    queue = spark.createDataFrame([("o", k, t, n) for k, t, n in (("ok", 2, 0), ("no", 1, 1), ("raises", 3, 2), ("spent", 0, 3))], "owner string, key string, ts_ms long, tries int")

    def retry(row):
        if row["key"] == "raises":
            raise OSError("down")
        return row["key"] == "ok"

    assert rows(cache.worked_off(queue, retry), "key", "tries") == [("no", 2), ("raises", 3)]
    assert rows(cache.queue_size(queue), "owner", "n") == [("o", 4)]


def test_boxes_of_spans(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0, 5.0, 6.0, "12.5px"), (1.0, 1.0, 2.0, 2.0, 1.0, 1.0, None)], "left double, top double, right double, bottom double, layer_left double, layer_top double, font_size string")
    assert rows(layout.relative_boxes(df), *layout.BOX, "font_size") == [(0.0, 0.0, 1.0, 1.0, 14.0), (5.0, 14.0, 25.0, 34.0, 12.5)]
    values = spark.createDataFrame([(x,) for x in ("3px", "-1.5e1px", ".5", "px", None)], "v string").select(pixels(F.col("v")).alias("x")).collect()
    assert [r.x for r in values] == [3.0, -15.0, 0.5, 0.0, 0.0]


WORDS = st.lists(st.sampled_from(["model", "models", "shard", "index", "the", "uses", "thing", "day", "Anna", "anna's", "a", "x1", ".", ",", "café", "\n", "shard index"]), max_size=60)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.sampled_from([" ", "  ", " . "]))
def test_phrases_match_a_plain_scan(words, space):
    text = " ".join(words).replace("index", "index", 1) + space + " ".join(words[:7])
    anchors, stop = frozenset(terms.ANCHORS), frozenset((*terms.STOP_WORDS, *terms.BREAKERS))
    got = {t: (n, hits) for t, n, hits in terms.count_phrases(text, text, anchors, stop)}
    cut = re.sub(r"[^\w'’ -]+", " . ", text.lower()).split(" ")
    good = lambda w: bool(re.fullmatch("[a-z]{3,}", w)) and w not in stop
    want = {}
    for k in (1, 2, 3):
        for i in range(len(cut) - k + 1):
            if all(map(good, cut[i : i + k])):
                want[" ".join(cut[i : i + k])] = want.get(" ".join(cut[i : i + k]), 0) + 1
    for t, n in want.items():
        parts = t.split(" ")
        anchored = len(parts) > 1 and any(w in anchors or w.removesuffix("s") in anchors for w in parts)
        enough = n >= (1 if anchored else 2 if len(parts) > 1 else 3)
        plain = len(parts) == 1 and (len(t) < 5 or t in terms.COMMON_NOUNS) or all(w in terms.COMMON_NOUNS for w in parts)
        hits = len(re.findall(rf"(?<![a-z0-9_]){re.escape(t)}(?![a-z0-9_])", text.lower()))
        assert got.get(t) == ((n, hits) if enough and not plain else None), t
    assert set(got) <= set(want)


def test_streams_of_words():
    text = "Redis is fast. Anna came. Then Anna sat, and Anna's hat fell.\nBob's car. Bob's house. Pipeline starts. Zed"
    held = {w: (n, s, o) for w, n, s, o in terms.count_words(text)}
    assert held["Anna"] == (3, 1, 1) and held["Bob"] == (2, 2, 2) and held["Redis"] == (1, 1, 0) and held["Zed"] == (1, 1, 0)


def test_glossary_streams(spark):
    text = "Anna's plan. Anna's plan. We met Bertha, said Bertha. postgresql and Node.js run. Zebra once. It was in The Guardian today. The token bucket is here. Clara came. Clara went. Clara sat."
    docs = spark.createDataFrame([(1, text), (1, "other text that is long enough to be read here, with Kubernetes in it"), (None, text), (None, text), (2, None), (3, "short")], "doc_id long, text string")
    got = terms.glossary(docs, emphasised=spark.createDataFrame([(1, "special words"), (1, "x"), (9, "none")], "doc_id long, term string")).collect()
    of = lambda i: {r.term for r in got if r.doc_id == i}
    assert {"PostgreSQL", "Node.js", "Bertha", "The Guardian", "token bucket", "Clara"} <= of(None) and not {"Anna", "Zebra", "Guardian"} & of(None)
    assert {"Kubernetes", "special words"} <= of(1) and of(2) == of(3) == set()
    ranks = sorted(r.rank for r in got if r.doc_id is None)
    assert ranks == list(range(1, len(ranks) + 1))  # equal rows are one document
    assert terms.glossary(docs.limit(0)).count() == 0


def test_glossary_terms_stay_in_their_row(spark):
    """No candidate is shuffled, just each document's best terms; they are those of the operators over tables of terms."""
    import random

    r = random.Random(4)
    v = "Agent agents agent RAG token Tokens tokens Straße cache caches Cache gRPC index indexes Élan élan apps App".split()
    rows = [(i, " ".join(r.choice(v) + r.choice(["", "", ".", ","]) for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame([*rows, rows[0], (0, rows[1][1]), (None, rows[2][1])], "doc_id long, text string").repartition(3)
    best = terms.glossary(docs, most=5)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("RoundRobin") <= 1 and "Join" not in plan and "Window" not in plan
    got = best.collect()
    assert len(got) == 5 * 42
    for _ in range(20):
        found = [{"stream": r.randrange(4), "term": t, "key": t.lower(), "n": r.randrange(4)} for t in r.choices(v, k=12)]
        table = spark.createDataFrame([(1, x["term"], x["stream"], x["n"]) for x in found], "doc_id int, term string, stream int, n int")
        one = table.groupBy("doc_id", "term").agg(F.min("stream").alias("stream"), F.max("n").alias("n"))
        placed = one.withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("stream", "term")))
        merged = terms.plural_merged(terms.one_form(placed)).where(~terms.is_noise(F.col("term"), ("élan",), ["Apps"])).join(one.select("term", "n"), "term")
        want = merged.select("term", terms.term_score(F.col("term"), F.col("n")).cast("double").alias("score"), "pos").orderBy(F.desc("score"), "pos").limit(5).collect()
        assert terms.best_terms(found, 5, frozenset((*terms.STOP_WORDS, "élan")), frozenset(["apps"])) == [(k, x.term, x.score) for k, x in enumerate(want, 1)]


def test_settings_are_written_and_reset(spark):
    kind = "owner string, settings map<string,string>"
    stored = spark.createDataFrame([("a", {"x": "1", "y": "1"}), ("b", {"x": "7"}), (None, {})], kind)
    changes = spark.createDataFrame([("a", {"x": "2"}, 1), ("a", {"x": "3", "z": None}, 2), (None, {"y": "5"}, 1), ("c", {"z": "9"}, None)], kind + ", ts int")
    got = {r.owner: r.settings for r in requests.written_settings(stored, changes, {"x": "0", "w": "0"}).collect()}
    assert got == {"a": {"x": "3", "y": "1", "w": "0"}, "b": {"x": "7"}, None: {"x": "0", "w": "0", "y": "5"}, "c": {"x": "0", "w": "0", "z": "9"}}
    again = {r.owner: r.settings for r in requests.reset_settings(stored, spark.createDataFrame([("a",), (None,)], "owner string"), {"x": "0"}).collect()}
    assert again == {"a": {"x": "0"}, "b": {"x": "7"}, None: {"x": "0"}}


def test_the_first_chunks_go_alone(spark):
    got = spark.range(1, 5).select(requests.warm_up(F.col("id")).alias("two"), requests.warm_up(F.col("id"), 0).alias("none")).collect()
    assert [r.two for r in got] == [True, True, False, False] and not any(r.none for r in got)
