"""The parser's sizes, and signatures found in pieces of text, against plain walks over all pieces."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from brookloom.operators import containment
from brookloom.operators.roots import article_roots, held
from brookloom.sources.html import LONGEST_TEXT, MAX_DEPTH, data_islands, html_nodes, parse, text_nodes
from brookloom.sources.sql import register


def nodes_of(spark, *pages):
    return html_nodes(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string"))


def test_unclosed_tags_stay_in_proportion(spark):
    page = "<body>" + "".join(f"<font>some text {i % 10} " for i in range(6000))
    rows = nodes_of(spark, page).select(F.length("text").alias("t"), F.length("xpath").alias("x"), "depth").collect()
    assert len(rows) == 6001 and max(r.depth for r in rows) == MAX_DEPTH - 1
    assert sum(r.t or 0 for r in rows) < 4 * len(page) * 10 and sum(r.x for r in rows) <= 6001 * 9 * MAX_DEPTH
    assert len(parse(page)[0]["parts"]) == 6000


def test_lengths_are_those_of_the_text(spark):
    r = random.Random(3)
    bits = ["", " ", " \n", "word ", " é\U0001f600x ", "　end", "<b>", "</b>", "<p>", "<br>", "<h1>", "<a>", "</a>", "long text " * 500]
    pages = ["<body>" + "".join(r.choices(bits, k=25)) for _ in range(40)]
    for row in nodes_of(spark, *pages).collect():
        n = parse(pages[row.page_id])[row.pos]
        text = "".join(n["parts"])
        units = lambda t: len(t.encode("utf-16-le")) // 2
        trimmed = units(text.strip(" \t\n\r\x0b\x0c 　"))
        assert (row.whole, row.length, row.own_text) == (units(text), trimmed, " ".join(n["own"]))
        assert row.text == (text if trimmed <= LONGEST_TEXT or row.tag == "h1" else None) or (row.text is None and row.tag == "h1")


def test_text_nodes_are_in_document_order(spark):
    got = text_nodes(nodes_of(spark, "<body>a<p>b<i>c</i>d</p>e")).orderBy("nth").collect()
    assert [(r.nth, r.pos, r.text) for r in got] == [(0, 0, "a"), (1, 1, "b"), (2, 2, "c"), (3, 1, "d"), (4, 0, "e")]


def brute(article, pieces):
    """(words, nth) by trying every candidate on every piece."""
    if article is None or len(article.strip()) < 200:
        return None
    lines = [x.strip() for x in article.split("\n") if x.strip()]
    signature = next((x for x in lines if len(x) >= 40), lines[0])
    w = signature.split()
    for words in [0, *range(min(len(w) - 1, 6), 1, -1)]:
        candidate = " ".join(w[:words]) if words else signature
        if words == 0 or len(candidate) >= 12:
            for nth, text in pieces:
                if text is not None and candidate in text:
                    return words, nth
    return None


def test_containment_is_brute_force(spark):
    r = random.Random(8)
    vocabulary = ["alpha", "be", "c", "delta-x", "été", "日本語", "the", "Ωmega", "longerword", "x,y", "12"]
    articles, texts, want = [], [], {}
    for i in range(120):
        pieces = [(n, r.choice([None, "", " ".join(r.choices(vocabulary, k=r.randrange(1, 30))), "".join(r.choices("日本語文字abc", k=40))])) for n in range(12)]
        source = r.choice([t for _, t in pieces if t] or ["nothing"])
        at = r.randrange(len(source))
        line = source[at : at + r.randrange(5, 120)]
        if r.random() < 0.5:
            w = line.split()
            w.insert(min(len(w), r.randrange(1, 7)), "strange")
            line = " ".join(w)
        article = r.choice([line + "\n" + "filler of the text " * 15, "   \n" + line + "\n\n" + "f " * 130, line, None])
        articles.append((f"p{i}", article))
        texts += [(f"p{i}", n, t) for n, t in pieces]
        want[f"p{i}"] = brute(article, pieces)
    asked = containment.signatures(spark.createDataFrame([*articles, articles[0]], "page_key string, text string"))
    got = containment.first_containing(asked, spark.createDataFrame(texts, "page_key string, nth int, text string")).collect()
    assert {r.page_key: (r.words, r.nth) for r in got} == {k: v for k, v in want.items() if v}
    assert len({v[0] for v in want.values() if v}) >= 5  # the signature itself and prefixes of several lengths


def test_signature_roots(spark):
    long = "Many words of a longer paragraph that a reader would keep as it stands here. "
    article = long * 4 + "\n" + "more of it " * 10
    pages = (
        f"<body><nav>links</nav><div><section><p>{long * 4}</p><p>{'more of it ' * 10}</p></section></div></body>",  # the section covers it
        f"<body><section><p>{long * 4}</p></section><section>{'more of it ' * 10}</section></body>",
        f"<body><p>nothing like it</p></body><p>{long * 4}</p>",
        f'<body><div class="cookie-banner"><div>{article}</div></div></body>',
        f"<body><span>{long[:30]}<b>{long[30:]}</b></span></body>",
    )
    nodes = held(nodes_of(spark, *pages))
    articles = nodes.select("page_key").distinct().withColumn("text", F.lit(article))
    found = containment.signature_roots(nodes, articles).join(nodes.withColumnRenamed("pos", "root_pos").select("page_key", "root_pos", "page_id", "tag"), ["page_key", "root_pos"])
    got = {r.page_id: (r.words, r.tag) for r in found.collect()}
    assert got[0] == (0, "section") and got[1][1] == "body" and 3 not in got and got[4] == (5, "body")
    layers = {r.page_id: r.layer for r in article_roots(nodes, articles=articles).collect()}
    assert layers[0] in ("density", "signature") and layers[4] == "signature" and layers[2] in ("body", "signature")
    nodes.unpersist()


def test_table_functions_are_the_data_frames(spark):
    island = '<script type="application/json">{"text": "prose of it", "x": {"title": "%s"}}</script>' % ("y" * 60)
    pages = [(1, "u", f"<body>{island}<p class=a>one <b>two</b></p></body>"), (1, "u", "<p>other page of the id"), (None, None, None), (2, None, "<i>x</i>"), (2, None, "<i>x</i>")]
    df = spark.createDataFrame([(h, i, u, "more") for i, u, h in pages], "html string, page_id long, url string, extra string")
    df.createOrReplaceTempView("some_pages")
    register(spark)
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    nodes = html_nodes(df).drop("own_text")
    got = spark.sql("SELECT * FROM html_nodes(TABLE(some_pages) PARTITION BY page_id)")
    assert rows(got) == rows(nodes) and got.columns == nodes.columns
    got = spark.sql("SELECT * FROM data_islands(TABLE(some_pages) PARTITION BY page_id)")
    assert rows(got) == rows(data_islands(df)) and got.count() == 2
    joined = spark.sql("SELECT tag, count(*) AS n FROM html_nodes(TABLE(SELECT * FROM some_pages WHERE page_id = 1) PARTITION BY page_id) GROUP BY tag")
    assert {r.tag: r.n for r in joined.collect()} == {"body": 1, "script": 1, "p": 2, "b": 1}
