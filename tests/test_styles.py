"""Styles of pages against a cascade in plain Python."""

from __future__ import annotations

import random
import re

from brookloom.operators import extract, styles
from brookloom.sources.html import html_nodes, parse


def nodes_of(spark, *pages):
    return html_nodes(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string"))


def declared(body):
    out = []
    for x in body.split(";"):
        m = re.fullmatch(r"\s*(display|visibility)\s*:\s*([\w-]+)\s*(!important)?\s*", x)
        if m:
            out.append((m[1], m[2], bool(m[3])))
    return out


def computed(n, sheets):
    """What the strongest rule says of each property."""
    best = {}
    cls = n["attrs"].get("class", "").split()
    for s, sheet in enumerate(sheets):
        for r, (selectors, body) in enumerate(sheet):
            for css in selectors:
                tag, ids, classes = re.match(r"[a-z]*", css)[0], re.findall(r"#(\w+)", css), re.findall(r"\.(\w+)", css)
                if tag in ("", n["tag"]) and all(i == n["attrs"].get("id") for i in ids) and set(classes) <= set(cls):
                    for k, (p, v, important) in enumerate(declared(body)):
                        strength = (important, False, len(ids), len(classes), tag != "", s, r, k)
                        best[p] = max(best.get(p, ((False,) * 8, None)), (strength, v))
    for k, (p, v, important) in enumerate(declared(n["attrs"].get("style", ""))):
        best[p] = max(best.get(p, ((False,) * 8, None)), ((important, True, 0, 0, 0, 0, 0, k), v))
    return best.get("display", (0, None))[1], best.get("visibility", (0, None))[1]


def test_cascade_is_that_of_plain_python(spark):
    r = random.Random(4)
    body = lambda: ";".join(r.choices(["display:none", "display: block", "visibility:hidden", "visibility : visible", "color:red", "display:none !important", "display:inline!important", ""], k=3))
    selector = lambda: r.choice(["p", "div", "", "*", "b"]) + r.choice(["", ".a", ".b", ".a.c", "#x", "#y.a"])
    pages, sheets = [], []
    for _ in range(25):
        own = [[([s for s in (selector() for _ in range(r.randrange(1, 3))) if s] or ["i"], body()) for _ in range(r.randrange(4))] for _ in range(2)]
        sheets.append(own)
        text = ["/* p{display:none} */" + " ".join(f"{', '.join(s)} {{{b}}}" for s, b in sheet) + "@media print{p{display:none} .a{visibility:hidden}} div > p{display:none}" for sheet in own]
        tags = "".join(f'<{r.choice(["p", "div", "b"])} class="{r.choice(["", "a", "b a", "c a"])}" id="{r.choice(["x", "y", ""])}" style="{r.choice(["", body()])}">t' for _ in range(12))
        pages.append(f"<head><style>{text[0]}</style></head><body><style>{text[1]}</style>{tags}")
    got = {(x.page_key, x.pos): (x.display, x.visibility) for x in styles.told(nodes_of(spark, *pages)).collect()}
    keys = {x.page_id: x.page_key for x in nodes_of(spark, *pages).select("page_id", "page_key").distinct().collect()}
    want = {}
    for i, p in enumerate(pages):
        for n in parse(p):
            said = computed(n, sheets[i])
            if any(said):
                want[keys[i], n["pos"]] = said
    assert got == want and len(want) > 100


def test_hidden_by_class_is_no_block(spark):
    page = '<style>.gone, p.x{display:none} .shown{display:block} @media print{.box{display:none}}</style><body><p class=gone>hidden words here</p><p class=x style="display:block">shown again here</p><div class="box"><p>plain words here</p></div></body>'
    nodes = nodes_of(spark, page, "<body><p class=gone>other page here</p>", None)
    texts = lambda **how: sorted(r.text for r in extract.extract_blocks(nodes, **how).collect())
    assert texts(styles=True) == ["other page here", "plain words here", "shown again here"]
    assert "hidden words here" in texts()
