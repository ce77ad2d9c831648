"""Selectors, rules, roots and whole pages, against a plain walk of small pages."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from brookloom.operators import extract, roots
from brookloom.operators.rules import NodeRule, SiteRule, by_site, closest, selects, with_selectors
from brookloom.sources.html import html_nodes, parse

LONG = "Some words of an article that go on for a while. "


def nodes_of(spark, *pages, url="https://a.example.com/x"):
    return html_nodes(spark.createDataFrame([(i, url, p) for i, p in enumerate(pages)], "page_id long, url string, html string"))


def root_tags(spark, *pages, rules=()):
    nodes = nodes_of(spark, *pages)
    found = roots.article_roots(nodes, rules)
    rows = found.join(nodes.withColumnRenamed("pos", "root_pos").select("page_key", "root_pos", "tag", "attrs"), ["page_key", "root_pos"]).collect()
    return {r.page_id: (r.layer, r.tag, r.attrs.get("class") or r.attrs.get("id") or "") for r in rows}


@pytest.mark.parametrize(
    ("css", "want"),
    [("p", {3, 4}), (".a", {1, 4}), ("div.a", {1}), ("#k", {2}), ("[role=main]", {2}), ("[data-x*=ell]", {3}), ("[data-x^=h]", {3}), ("[data-x$=w], p.b", {4}), ("*", set(range(5))), ("[hidden]", {4})],
)
def test_selectors(spark, css, want):
    page = '<body><div class="a c"></div><section id="k" role="main"><p data-x="hello"></p><p class="b a" data-x="low" hidden></p></section></body>'
    assert {r.pos for r in nodes_of(spark, page).where(selects(css)).collect()} == want


def matches(css, n, of):
    """Whether a node matches a selector, from right to left along its ancestors and siblings."""
    steps = [x for x in re.split(r"\s*([>+~])\s*|\s+", css) if x]

    def compound(c, m):
        tag = re.match(r"[a-z*]*", c)[0]
        classes = m["attrs"].get("class", "").split()
        return tag in ("", "*", m["tag"]) and all(x in classes for x in re.findall(r"\.(\w+)", c))

    def left(k, m):
        if not compound(steps[k], m):
            return False
        if k == 0:
            return True
        how, k = (steps[k - 1], k - 2) if steps[k - 1] in ">+~" else (" ", k - 1)
        up = m["up"]
        if how in "> ":
            while up:
                if left(k, up):
                    return True
                up = None if how == ">" else up["up"]
            return False
        older = [x for x in up["kids"] if x["pos"] < m["pos"]] if up else []
        return any(left(k, x) for x in (older[-1:] if how == "+" else older))

    return left(len(steps) - 1, n)


def test_combinators_match_a_tree_walk(spark):
    r = random.Random(6)

    def grow(depth):
        kids = "".join(grow(depth - 1) for _ in range(r.randrange(4))) if depth else ""
        return f'<{(t := r.choice(["div", "span", "b"]))} class="{r.choice(["", "a", "b", "a c"])}">{kids}</{t}>'

    pages = [f"<body>{''.join(grow(4) for _ in range(3))}</body>" for _ in range(10)]
    nodes = nodes_of(spark, *pages).persist()
    selectors = ["div span", "div > .a", ".a + b", ".a ~ .b", "body > div .a > span", ".a > .b ~ div .c", "div + div > b.a span", "body *", ".a .a .a"]
    df = with_selectors(nodes, selectors)
    rows = df.select("page_id", "pos", *[selects(c).alias(f"s{k}") for k, c in enumerate(selectors)]).collect()
    trees = [parse(p) for p in pages]
    for k, css in enumerate(selectors):
        got = {(x.page_id, x.pos) for x in rows if x[f"s{k}"]}
        want = {(i, n["pos"]) for i, of in enumerate(trees) for n in of if matches(css, n, of)}
        assert got == want, css
        assert want, css
    near = {(x.page_id, x.pos): x.closest for x in closest(nodes, "div > .a, b.b").collect()}
    for i, of in enumerate(trees):
        for n in of:
            up = n
            while up and not (matches("div > .a", up, of) or matches("b.b", up, of)):
                up = up["up"]
            assert near[i, n["pos"]] == (up["pos"] if up else None)
    nodes.unpersist()


@pytest.mark.parametrize("css", ["div >", "> p", "p:first-child", "a > > b", ""])
def test_other_selectors_are_refused(spark, css):
    with pytest.raises(ValueError, match="selector"):
        with_selectors(nodes_of(spark, "<p>"), [css or "div > "])


def test_site_rules_take_combinators(spark):
    page = f"<body><div class=box><p>{LONG}</p></div><section><p>Kept text here</p><p>Next one goes</p></section><main><p>Main text here</p></main></body>"
    rules = (SiteRule("a.example.com", skip_selectors=(".box > p", "section p + p"), root_selector="body > section"),)
    nodes = nodes_of(spark, page)
    assert sorted(r.text for r in extract.extract_blocks(nodes, rules=rules).collect()) == ["Kept text here", "Main text here"]
    assert roots.article_roots(nodes, rules).first().layer == "site"


def test_rules_of_nodes_and_sites(spark):
    page = '<body><form class="newsletter-modal" id="x"></form><form id="modal"></form><nav></nav></body>'
    hits = lambda rule: [r.tag for r in nodes_of(spark, page).where(rule.matches()).orderBy("pos").collect()]
    assert hits(NodeRule(tag="form")) == ["form", "form"] and hits(NodeRule(tag="form", class_pattern="newsletter")) == ["form"] == hits(NodeRule(id_pattern=r"\bmodal\b"))
    assert hits(NodeRule(role="dialog")) == [] and hits(NodeRule(check=lambda: F.col("tag") == "nav")) == ["nav"]
    rules = (SiteRule("a.b.example.com", instructions="one"), SiteRule("*.example.com", instructions="two", terms={"b": "2", "a": "1"}))
    urls = spark.createDataFrame([("https://a.b.example.com/",), ("http://example.com:80/x",), ("https://badexample.com",), (None,)], "url string")
    got = urls.select(by_site(F.col("url"), rules, lambda r: F.lit(r.instructions), F.lit("none")).alias("x")).collect()
    assert [r.x for r in got] == ["one", "two", "none", "none"]
    assert rules[1].prompt() == '"document_terms":{\n  "b": "2",\n  "a": "1"\n}\ntwo' and rules[0].prompt() == "one"


def test_site_rules_skip_subtrees_and_texts(spark):
    page = f"<body><div class=box><p>{LONG}</p></div><p>Sign in to go on</p><p>Kept text here</p></body>"
    rules = (SiteRule("a.example.com", skip_selectors=(".box",), skip_texts=("^sign in",)),)
    assert [r.text for r in extract.extract_blocks(nodes_of(spark, page), rules=rules).collect()] == ["Kept text here"]
    assert extract.extract_blocks(nodes_of(spark, page, url="https://b.example.com"), rules=rules).count() == 3


def test_containers_in_order(spark):
    body = f"<p>{LONG * 3}</p>"
    got = root_tags(
        spark,
        f"<body><main>{body}{body}</main><article>{body}</article></body>",
        f"<body><article></article><article><h1>Title here</h1>{body}</article><article>{body}</article></body>",
        f"<body><article><h1>Title here</h1><div class=article-body>{body}</div></article></body>",
        f"<body><article><h1></h1><div class=article-body>{body}</div></article></body>",
        f"<body><div class=wrap><div class=post-content>{body}<h1>Own title</h1></div></div><p>more words</p></body>",
        f"<body><div class=page><section class=hero><h1>Title here</h1><p>By <i class=author>A</i></p></section><section class=rich-text>{body * 2}</section></div><p>after all</p></body>",
        f"<body><div class=sidebar-wrap><div class=post-content>{body}<h1>Own title</h1></div></div></body>",
    )
    assert got[0][:2] == ("container", "article") and got[1][1] == "article"
    assert got[2][1] == "article" and got[3] == ("container", "article", "")  # the body alone is one with its wrapper
    assert got[4] == ("container", "div", "wrap") and got[5] == ("container", "div", "page") and got[6] == ("container", "div", "post-content")


def test_site_root_and_fall_backs(spark):
    body = f"<p>{LONG * 3}</p>"
    rules = (SiteRule("*.example.com", root_selector="#own"),)
    pages = (f"<body><article>{body}</article><div id=own>{body}</div></body>", f"<body><article>{body}</article><div id=own> </div></body>", "<body><p>short</p></body>")
    got = root_tags(spark, *pages, rules=rules)
    assert got == {0: ("site", "div", "own"), 1: ("container", "article", ""), 2: ("body", "body", "")}


def plain_density(n, of):
    """The density of a node as the rule words it."""
    text = "".join(n["parts"])
    size, cls = len(text.strip()), n["attrs"].get("class", "").lower()
    words = [w for x in cls.split() for w in x.replace("_", "-").split("-") if w]
    if size < 50:
        return 0.0
    below = [m for m in of if n["pos"] < m["pos"] <= n["sub_end"] and m["tag"] == "a"]
    linked = sum(len(x) for m in below for x in m["own"])
    out = max(0, size - linked) / (len(below) + 1) * math.log(size + 1) / (1 + 2 * linked / size)
    out *= {"article": 1.3, "main": 1.2, "section": 1.02}.get("article" if n["attrs"].get("role") == "article" else n["tag"], 1.0)
    out *= 1.2 if set(words) & set(roots.POSITIVE) else 1.0
    out *= 0.5 if set(words) & set(roots.NEGATIVE) else 1.0
    out *= 0.92 if set(words) & set(roots.META) else 1.0
    out *= 0.85 if len(n["kids"]) > 20 and size / len(n["kids"]) < 25 else 1.0
    if n["up"]:
        others = [len("".join(k["parts"])) for k in n["up"]["kids"]]
        out *= 0.85 if size < 0.7 * max(others) else 1.0
        mean = sum(others) / len(others)
        out *= 0.9 if len(others) > 3 and abs(size - mean) / mean < 0.25 else 1.0
    out *= 0.95 if n["depth"] < 3 else 0.9 if n["depth"] > 7 else 1.0
    body = next((len("".join(m["parts"])) for m in of if m["tag"] == "body"), 0)
    if n["tag"] != "body" and body:
        share = size / body
        out *= 1.3 if share >= 0.4 else 1.15 if share >= 0.25 else max(0.1, share / 0.05) if share < 0.05 else 1.0
    return out


def grown(r, depth):
    tag = r.choice(["div", "p", "section", "article", "a", "main", "td"])
    cls = r.choice(["", "", "post", "main-menu", "meta x", "comment"])
    kids = "".join(grown(r, depth - 1) for _ in range(r.randrange(4))) if depth else ""
    return f'<{tag} class="{cls}">{r.choice(["", LONG[: r.randrange(50)], LONG * r.randrange(4)])}{kids}</{tag}>'


def test_densities_match_a_plain_walk(spark):
    r = random.Random(4)
    pages = [f"<html><body>{''.join(grown(r, 5) for _ in range(3))}</body></html>" for _ in range(12)]
    got = {(x.page_id, x.pos): x for x in roots.measured(nodes_of(spark, *pages)).collect()}
    for i, p in enumerate(pages):
        of = parse(p)
        assert len(of) == sum(k == i for k, _ in got)
        for n in of:
            x = got[i, n["pos"]]
            assert x.density == pytest.approx(plain_density(n, of), rel=1e-9), (i, n["pos"])
            assert x.links == sum(m["tag"] == "a" for m in of if n["pos"] < m["pos"] <= n["sub_end"])


def test_dense_roots(spark):
    text = f"<p>{LONG * 20}</p>"
    got = root_tags(
        spark,
        f"<body><div class=cookie-banner>{text * 3}</div><div class=story>{text * 2}</div><div>{'<a href=x>link text here</a>' * 30}</div></body>",
        f"<body><div class=all>{''.join(f'<section class=story-part>{text}</section>' for _ in range(5))}</div></body>",
        f"<body><div><p>{LONG}</p></div></body>",
    )
    assert got[0] == ("density", "div", "story") and got[1] == ("density", "div", "all") and got[2][0] == "body"


def test_container_scores(spark):
    page = "<body><div><h1>T</h1><h2>a</h2><h2>b</h2><p>x</p><p>y</p><img><time></time><nav></nav><b class=related-x></b><i class=byline></i></div></body>"
    nodes = nodes_of(spark, page)
    tops = nodes.where("tag = 'div'").select("page_key", F.col("pos").alias("top_pos"), F.col("sub_end").alias("top_end"))
    row = roots.container_scores(nodes, tops).first()
    assert row.has_h1 and row.score == pytest.approx(20 + 10 + 5 / 800 + 2 + 1 + 8 + 6 - 8 - 8)


def test_containers_are_found_once(spark):
    """The container of each page is held, not found anew for each question about what is around it."""
    nodes = nodes_of(spark, "<body><article><h1>Title</h1><p>Some text.</p></article></body>")
    plan = roots.article_roots(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert any("pos0" in x for x in plan.split("\n") if "InMemoryRelation" in x)
    spark.catalog.clearCache()


def test_prepared_pages(spark):
    island = '<script type="application/json">{"text": "%s"}</script>' % LONG
    rows = [
        (1, "https://a.example.com", f"<body><p>outside text</p><article><h1>Title here</h1><p>{LONG}</p></article></body>"),
        (2, "https://a.example.com", f"<body><article><div hidden><p>{LONG}</p></div></article><p>only outside</p></body>"),
        (3, "https://a.example.com", f"<body><div id=app></div>{island}</body>"),
        (4, "https://a.example.com", "<body><div id=viewer class=pdfViewer></div></body>"),
        (5, "https://a.example.com", "<body></body>"), (6, None, None), (1, "https://a.example.com", "<body><p>another row</p></body>"), (None, None, "<body><p>no id here</p></body>"),
        (7, "u", "<body><p>twice the same</p></body>"), (7, "u", "<body><p>twice the same</p></body>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = roots.prepared(pages).collect()
    by = sorted((r.page_id or 0, r.status, r.full_text) for r in got)
    assert by == sorted([
        (1, "article", f"Title here\n\n{LONG.strip()}"), (2, "body", "only outside"), (3, "data-island", LONG.strip()), (4, "pdf-viewer", ""), (5, "empty", ""), (6, "empty", ""),
        (1, "article", "another row"), (0, "article", "no id here"), (7, "article", "twice the same"), (7, "article", "twice the same"),
    ])
    chunks = roots.page_chunks(pages).collect()
    assert len(chunks) == 7 and sorted(r.block_ids for r in chunks)[-1] == ["b1", "b2"]
    same = extract.extract_blocks(html_nodes(pages.where("page_id = 7"))).collect()
    assert [r.xpath for r in same] == ["/body[1]/p[1]"]  # equal rows are one page
    assert roots.prepared(pages.limit(0)).count() == 0
