"""Worked examples and second forms of what SQL doesn't state."""

from __future__ import annotations

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brookloom.functions import text as T
from brookloom.operators import blocks, cache, captions, extract, layout, retry, terms
from brookloom.sources import html
from brookloom.streaming import sessions


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_texts(spark):
    rows = [("x" * 2, False), ("abc", True), ("AB 12", False), ("12 34", True), ("A" * 30, True), ("q" * 3072, False), ("q" * 199, True), ("q" * 200, False), ("['a', 1] " * 8, False), ("['a', 1] " * 7, True), (None, False), ("日本語", True)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.where(T.is_valid_text(F.col("t")) != F.col("want")).collect() == []
    assert one(spark, "😀x", T.utf16_length) == 3 and one(spark, "hello", T.rolling_hash) == 99162322 and one(spark, "😀x", T.rolling_hash) == 54959989
    assert one(spark, "S t a r t", T.collapse_spaced) == "Start" and one(spark, "I am a coder", T.collapse_spaced) == "I am a coder" and one(spark, "开 始 使 用", T.collapse_spaced) == "开 始 使 用"
    assert one(spark, "", lambda c: T.cache_key(c, F.lit("en"), F.lit("zh"))) == "translation_en_zh_0_0"
    assert one(spark, " 　a  ", T.trimmed) == "a"
    assert one(spark, '{"a":["b{', T.repaired_json) == '{"a":["b{"]}' and one(spark, '"a\\"', T.repaired_json) == '"a\\""'
    assert one(spark, "x [Music] y (z) ♪ la ♪", T.without_noise).split() == ["x", "y"]
    assert [one(spark, t, T.clean_term) for t in ("“Spark's”", "U.S.A", "  (gRPC). ")] == ["Spark", "U", "gRPC"]


def packed(tokens, headings):
    """The same packing over an explicit work list."""
    todo, out, closed = list(enumerate(tokens)), {}, 0
    current, size = [], 0

    def flush():
        nonlocal current, size, closed
        if current:
            closed += 1
            out.update(dict.fromkeys(current, closed))
        current, size = [], 0

    while todo:
        i, t = todo.pop(0)
        target = 400 if closed < 2 else 800
        if current and size + t + 20 > target and size + t + 20 <= 500_000 and not headings[i]:
            near = [k for k, _ in todo if headings[k]][:1]
            if near and near[0] - i < 5:
                current += range(i, near[0] + 1)
                todo = todo[near[0] - i :]
                flush()
                continue
        if current and size + t + 20 > target:
            flush()
        current.append(i)
        size += t + 20
    flush()
    return [out[i] for i in range(len(tokens))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 700), st.booleans()), max_size=30))
def test_chunk_packing(rows):
    tokens, headings = [t for t, _ in rows], [h for _, h in rows]
    assert blocks.pack(tokens, headings) == packed(tokens, headings)


def test_chunks_cover_all_blocks(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"Line number {i} says something. " * 5 for i in range(40))), (2, None), (3, ""), (4, "same line\nsame line")], "doc_id long, text string")
    got = blocks.chunks(docs).orderBy("doc_id", "chunk").collect()
    assert [b for r in got if r.doc_id == 1 for b in r.block_ids] == [f"b{i + 1}" for i in range(40)]
    assert [(r.doc_id, r.block_ids) for r in got if r.doc_id != 1] == [(4, ["b1"])]


PAGE = """<html><head><title>T</title></head><body><header><h1>Main heading here</h1></header><header>no heading in this one</header>
<nav><p>Navigation text</p></nav><div class="sidebar"><p>Side text here</p></div><article><h2>Second heading</h2><p>First paragraph of text.<p>First paragraph of text.
<p>Another <b>bold</b> one</p><span>Loose inline text</span><ul><li>Item one here</li><li>Item two<p>Inner para</p></li></ul><pre>code()</pre>
<div hidden><p>Hidden text</p></div><svg><text>drawn text</text></svg><p class="comment-x">demoted by hint</p><div>Bare holder text</div></article>
<div class="cookie-banner"><p>We use cookies</p></div><div>manage cookies<p>by text</p></div><section class="post-meta post"><p>Exempt words</p></section></body></html>"""


def test_page_blocks(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p>un<b>closed text")], "page_id long, url string, html string")
    nodes = html.html_nodes(pages)
    assert {"Exempt words"} == {r.text for r in extract.extract_blocks(nodes).collect()} - {r.text for r in extract.extract_blocks(nodes, noise=[*extract.NOISE_CLASSES, "post-meta"]).collect()}
    got = extract.extract_blocks(nodes, noise=[*extract.NOISE_CLASSES, "post-meta"]).orderBy("page_id", "position").collect()
    assert [(r.tag, r.text) for r in got if r.page_id == 1] == [
        ("h1", "Main heading here"), ("h2", "Second heading"), ("p", "First paragraph of text."), ("p", "Another bold one"), ("span", "Loose inline text"),
        ("li", "Item one here"), ("p", "Inner para"), ("div", "Bare holder text"),
    ]
    by = {r.text: r for r in got}
    assert by["Item one here"].heading_path == ["Main heading here", "Second heading"] and by["Another bold one"].xpath == "/html[1]/body[1]/article[1]/p[3]"
    assert by["unclosed text"].id == "b1" and {r.page_id for r in got} == {1, 4}


def test_subtree_windows_match_ancestor_walks(spark):
    r = random.Random(2)

    def grow(depth):
        tag = r.choice(["div", "p", "section", "article", "span", "li", "h2", "nav"])
        kids = "".join(grow(depth - 1) for _ in range(r.randrange(3))) if depth else ""
        return f"<{tag}>{r.choice(['', 'some words here '])}{kids}</{tag}>"

    pages = spark.createDataFrame([(i, "u", f"<body>{''.join(grow(4) for _ in range(4))}</body>") for i in range(20)], "page_id long, url string, html string")
    rows = extract.decided(html.html_nodes(pages)).collect()
    for page in range(20):
        nodes = {n.pos: n for n in rows if n.page_id == page}
        for n in nodes.values():
            above, up = [], n.parent
            while up is not None:
                above.append(nodes[up])
                up = nodes[up].parent
            below = [m for m in nodes.values() if n.pos < m.pos <= n.sub_end]
            assert n.rejected_above == any(m.decision == "reject" for m in above)
            assert n.block_above == any(m.tag in extract.BLOCK_TAGS for m in above)
            assert n.block_below == any(m.tag in extract.BLOCK_TAGS for m in below)
            assert n.in_article == any(m.tag == "article" for m in [n, *above])


def test_islands(spark):
    page = '<script type="application/json">{"a": {"description": "short prose", "slug": "no", "x": "%s"}, "text": ["one", "one"], "n": 3}</script><script id="__NEXT_DATA__">not json</script>' % ("y" * 60)
    got = html.data_islands(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [(r.position, r.text) for r in got] == [(1, "short prose"), (2, "y" * 60), (3, "one")]


def test_glossary(spark):
    text = "The RAG pipeline uses gRPC calls. Every RAG pipeline in the Kubernetes cluster feeds a model, and Kubernetes scales. KUBERNETES is loud. We tried Claude Opus 4.5 with gRPC. The shard index keeps each shard index small."
    got = terms.glossary(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")).orderBy("rank").collect()
    words = [r.term for r in got]
    assert words[0] == "RAG" and {"gRPC", "Kubernetes", "Claude Opus 4.5", "shard index"} <= set(words) and "KUBERNETES" not in words
    assert [r.rank for r in got] == list(range(1, len(got) + 1)) and all(r.doc_id == 1 for r in got)
    merged = terms.plural_merged(spark.createDataFrame([(1, "agent", "agent", 0), (1, "agents", "agents", 1), (1, "token", "Token", 2), (1, "tokens", "tokens", 3)], "doc_id long, key string, term string, pos int"))
    assert {(r.term, r.pos) for r in merged.collect()} == {("agents", 0), ("Token", 2)}


EVENT = "video_id string, pos long, start_ms long, duration_ms long, append int, win_id int, pos_id int, segs array<struct<utf8:string,offset_ms:long>>, lang string"


def events(spark, video, rows, lang="en"):
    return spark.createDataFrame([(video, i, *x[:2], *x[2:5], [(t, o) for t, o in x[5]], lang) for i, x in enumerate(rows)], EVENT)


def test_caption_formats_and_folds(spark):
    asr = events(spark, "asr", [(0, 4000, None, 1, None, [("hello", 0), (" world.", 300)]), (1000, 500, 1, 1, None, [("\n", None)]), (2000, 900, None, 1, None, [("again", 0), ("[x]", 100), (" here", 200)])])
    karaoke = events(spark, "k", [(0, 1000, None, None, 3, [("la", 0)]), (0, 1000, None, None, 1, [("ra", 0)]), (500, 1000, None, None, 3, [("la", 0)]), (2000, 100, None, None, 3, [("lo", 0)])])
    styled = events(spark, "s", [(100 * i, 150, None, None, 2, [("/" + "growing sentence"[: 10 + i], 0)]) for i in range(6)] + [(9000, 500, None, None, 7, [("off track", 0)]), (200, 100, None, None, 7, [("overlaps", 0)])])
    plain = events(spark, "p", [(0, 1000, None, None, None, [("a", 0), ("b", 400)]), (900, 300, None, None, None, [("c [Music]", 0)])])
    moving = events(spark, "m", [(50 * i, 60, None, None, 1, [("one" if i < 30 else "two", 0)]) for i in range(60)])
    got = captions.captions(asr.union(karaoke).union(styled).union(plain).union(moving)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.video_id, r.idx)):
        by.setdefault((r.video_id, r.format), []).append((r.start_ms, r.end_ms, r.text))
    assert by["asr", "scrolling-asr"] == [(0, 1500, "hello world."), (2000, 2400, "again here")]
    assert by["k", "karaoke"] == [(0, 1500, "la"), (2000, 2100, "lo")]
    assert by["s", "karaoke-stylized"] == [(0, 650, "/growing sentenc"), (9000, 9500, "off track")]
    assert by["p", "standard"] == [(0, 400, "a"), (400, 900, "b"), (900, 1200, "c")]
    assert by["m", "animated"] == [(0, 1500, "one"), (1500, 3010, "two")]


def test_layout(spark):
    spans = [(1, 1, 0, 10.0, 0.0, 40.0, 10.0, "Hello"), (1, 1, 0, 50.0, 2.0, 90.0, 12.0, "world"), (1, 1, 0, 10.0, 4.0, 20.0, 14.0, "next"), (1, 1, 0, 10.0, 16.0, 60.0, 26.0, "goes on."), (1, 1, 0, 10.0, 28.0, 60.0, 38.0, "New one"), (1, 1, 0, 60.0, 40.0, 99.0, 50.0, "indented"), (1, 2, 0, 1.0, 1.0, 9.0, 9.0, "page two"), (1, 2, 0, 1.0, 1.0, 1.0, 9.0, "no width"), (1, 2, 0, 1.0, 30.0, 9.0, 39.0, "x")]
    df = spark.createDataFrame(spans, "doc_id long, page int, layer int, left double, top double, right double, bottom double, text string")
    found = layout.lines(df)
    assert [r.text for r in found.orderBy("page", "no").collect()] == ["Hello world", "next", "goes on.", "New one", "indented", "page two"]
    pars = layout.paragraphs(found).orderBy("page", "no").collect()
    assert [(r.text, r.n) for r in pars] == [("Hello world next goes on.", 3), ("New one", 1), ("indented", 1), ("page two", 1)]
    assert layout.overlay_boxes(layout.paragraphs(found), 150.0).where("page = 1 and no = 2").first().max_width == 140.0


def test_service_is_asked_once_for_each_text(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "kept")], "id long, text string")
    known = spark.createDataFrame([("kept", "K")], "text string, translated string")
    got = retry.with_service(rows, lambda items: {x["id"]: x["text"] * 2 for x in items if x["text"] != "b"}, known)
    assert {r.id: r.translated for r in got.collect()} == {1: "aa", 2: "aa", 3: None, 4: None, 5: "K"}


def test_sse_tail_without_end_is_dropped(spark):
    d = 'data: {"choices":[{"delta":{"content":"%s"}}]}'
    rows = [(1, 0, (d % "Hel")[:20]), (1, 1, (d % "Hel")[20:] + "\n\n" + d % "lo" + "\r\n"), (1, 2, "data: {bad\n" + d % "lost"), (2, 0, "data: [DONE]\n" + d % "after" + "\n"), (3, 0, None)]
    got = retry.sse_deltas(spark.createDataFrame(rows, "stream_id long, seq int, payload string")).orderBy("stream_id", "seq").collect()
    assert [(r.stream_id, r.delta) for r in got] == [(1, "Hel"), (1, "lo")]


def test_cache_bounds(spark):
    entries = spark.createDataFrame([("a", "1", 0, 100), ("a", "2", 50, 100), ("b", "3", 0, 100), ("c", "4", 0, 0)], "key string, data string, ts_ms long, ttl_ms long")
    assert {r.key: r.data for r in cache.purged(entries, 101).collect()} == {"a": "2", "c": "4"}
    assert {r.key for r in cache.purged(entries, 100).collect()} == {"a", "b", "c"}
    assert cache.removed(entries, spark.createDataFrame([("a",)], "key string")).count() == 2


def taps(times, within, n=3):
    hits, start, count = [], None, 0
    for i, t in enumerate(times):
        if start is None or t - start > within:
            start, count = t, 0
        count += 1
        if count == n:
            hits.append(i)
            start = None
    return hits


def test_taps(spark):
    times = [0, 100, 200, 300, 900, 1300, 1401, 1402]
    rows = spark.createDataFrame([(1, i, t / 1000) for i, t in enumerate(times)], "user_id long, event_id long, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.event_id for r in sessions.triple_taps(rows).collect()) == taps(times, 500)


def test_folds_keep_users_apart(spark):
    """Random times of several users and of none, against folds of each user by itself; rows without a time don't count."""
    r = random.Random(3)
    raw = [(u, i, r.randrange(4000)) for i, u in enumerate(r.choices([1, 2, None], k=300))] + [(1, 900, None)]
    rows = spark.createDataFrame(raw, "user_id long, event_id long, ms long").withColumn("ts", F.timestamp_millis("ms")).repartition(5)
    passed, gestures = set(), set()
    for u in (1, 2, None):
        own = sorted((t, e) for x, e, t in raw if x == u and t is not None)
        last = None
        for t, e in own:
            if last is None or t - last >= 100:
                last = t
                passed.add(e)
        gestures |= {own[i][1] for i in taps([t for t, _ in own], 50)}
    assert {x.event_id for x in sessions.throttled(rows, 100).collect()} == passed
    assert {x.event_id for x in sessions.triple_taps(rows, 50).collect()} == gestures
    assert sessions.throttled(rows.limit(0)).count() == 0


def test_streams_match_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, "click" if i % 2 else "view", 1_700_000_000 + 60 * i) for i in range(60)] + [(99, 0, "end", 1_700_900_000)], "event_id long, user_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(tuple(r) for r in spark.table(name).collect())

    want = sorted(tuple(r) for r in sessions.debounced(rows.where("event_id != 99"), "5 minutes").collect())
    assert run(sessions.debounced(stream, "5 minutes", "1 minute"), "debounced") == want
    assert len(run(sessions.first_seen(stream, "1 day"), "firsts")) == sessions.first_seen(rows).count()
    pieces = spark.createDataFrame([(1, 0, "ab"), (1, 1, "c\nde"), (2, 0, "x\n"), (1, 2, "f\ntail")], "stream_id long, seq long, payload string")
    pieces.write.parquet(str(tmp_path / "sse"))
    lines = run(sessions.sse_stream(spark.readStream.schema(pieces.schema).parquet(str(tmp_path / "sse"))), "lines")
    assert lines == [(1, "abc"), (1, "def"), (2, "x")]


def test_payload_events(spark):
    event = {"tStartMs": 5, "dDurationMs": "7", "aAppend": 1, "wWinId": None, "wpWinPosId": {"a": 1}, "segs": [{"utf8": "a"}, 3, {"utf8": None, "tOffsetMs": "9"}, {}]}
    rows = [
        ("v", json.dumps({"events": [event, 4, None, "x", [], {"segs": []}, {"tStartMs": 1}, {"tStartMs": 2, "segs": "no list"}, {"tStartMs": "no number"}]})),
        ("w", '{"events": [{"tStartMs": 1'), ("x", None), ("y", '{"events": {"tStartMs": 1}}'), ("z", "[]"), (None, '{"events": [{"tStartMs": 3}]}'),
    ]
    got = captions.payload_events(spark.createDataFrame([(*r, "en") for r in rows], "video_id string, payload string, lang string")).collect()
    assert [(r.video_id, r.pos, r.start_ms) for r in got] == [("v", 0, 5), ("v", 6, 1), ("v", 7, 2), (None, 0, 3)]
    assert (got[0].duration_ms, got[0].append, got[0].win_id, got[0].pos_id) == (7, 1, None, None)
    assert [tuple(s) for s in got[0].segs] == [("a", None), ("", 9), ("", None)] and got[1].segs is None and got[2].segs is None
    assert captions.captions(captions.payload_events(spark.createDataFrame([(*r, "en") for r in rows], "video_id string, payload string, lang string"))).count() == 1


def test_json_is_repaired_as_a_fold_over_characters_would(spark):
    r = random.Random(3)
    texts = ["".join(r.choices(['{', '}', '[', ']', '"', "\\", "a", ",", "é", "\n", '\\"'], k=r.randrange(25))) for _ in range(400)] + ["", None]

    def fold(t):
        t = t.strip(" \t\n\r\x0b\x0c")
        braces = brackets = 0
        inside = escaped = False
        for x in t:
            if not escaped and not inside:
                braces += (x == "{") - (x == "}")
                brackets += (x == "[") - (x == "]")
            inside ^= not escaped and x == '"'
            escaped = not escaped and x == "\\"
        return t + '"' * inside + "]" * brackets + "}" * braces

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.repaired_json(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: None if t is None else fold(t) for i, t in enumerate(texts)}
