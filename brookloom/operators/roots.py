"""Where a page's article is, and the preparation of whole pages: root, blocks, fall-backs, chunks.

A site's own rule comes first, then known containers, then the densest container, then the container of what another tool
read, then the body. Questions about a
few nodes of each page (a candidate's ancestors, what lies below them) join those nodes to the page's by page_key and
look at ranges of positions, so work grows with the nodes. Defined results: a page without nodes has no root; of equal
candidates the first in document order counts; equal rows of a page are one page, and ``prepared`` has a row for each.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookloom.operators.blocks import packed_chunks
from brookloom.operators.extract import PAGE, marked_blocks, numbered_blocks
from brookloom.operators.rules import SiteRule, attr, by_site, selects, with_selectors
from brookloom.sources.html import data_islands, html_nodes, keyed

#: Selectors of article containers in order, and those of the article's text alone.
CONTAINERS = (
    ".article-body", ".article-content", ".article-text", ".story-body", ".story-content", ".u-rich-text-blog", ".rich-text", ".blog-content",
    ".post-content", ".entry-content", ".page-content", "article", "[role=article]", "[role=main]", "main", ".main-content", ".content-body",
)
SPECIFIC = (".article-body", ".article-content", ".article-text", ".story-body", ".story-content", ".post-content")
#: Fixed values of the density score: tokens and id patterns by their sign, boosts of tags, thresholds.
TAG_BOOST = (("article", 1.3), ("main", 1.2), ("section", 1.02))
POSITIVE = "article post entry rich story main".split()
NEGATIVE = (
    "nav navigation navbar menu sidebar aside footer header comment comments disqus discourse widget ad ads advert banner social share sharing "
    "related recommended cookie popup modal newsletter subscribe cta promo breadcrumb pagination toolbar mbox callout pullquote"
).split()
META = "metadata meta author byline timestamp tag tags category categories topics topic date time".split()
COMPOUND = r"(?:^|[\s_-])(article|post|entry|blog|page|story|rich)[_-](content|body|text|inner|main)(?:[\s_-]|$)"
POSITIVE_ID = "article|content|post|entry|rich|blog|story|main|body"
NEGATIVE_ID = "nav|menu|sidebar|footer|header|comment|widget|ad|banner|social|share|related|cookie|popup|modal|disqus|discourse"
META_ID = "author|byline|timestamp|tag|category|topic|date|meta"
CONSENT_ID = "onetrust|cookiebot|trustarc|quantcast|consent|gdpr|cookielaw|cookie-law|cookie|privacy"
CONSENT_CLASS = r"onetrust|\bot-sdk|ot-pc|ot-cookie|cookiebot|trustarc|quantcast|qc-cmp|cookie-banner|consent-banner|gdpr-banner|privacy-banner|\bcookies?\b"
CONSENT_VALVE, LEAST_DENSITY, LEAST_SHARE, CELL_TEXT = 5000, 300.0, 0.15, 1000
FURNITURE = "nav|menu|sidebar|footer|header|comment|widget"
WRAPPERS, HEADING_LENGTH = 6, 4


def _signal(words: list[str], pattern: str, more: Column | None = None) -> Column:
    hit = F.arrays_overlap("words", F.array(*map(F.lit, words))) | F.lower(attr("id")).rlike(pattern)
    return hit if more is None else hit | more


def in_consent() -> Column:
    """Inside a consent notice, unless the node's own text is long."""
    before = W.partitionBy(PAGE).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    hit = (F.lower(attr("id")).rlike(CONSENT_ID) | F.lower(attr("class")).rlike(CONSENT_CLASS)) & ~F.col("tag").isin("body", "html")
    return F.coalesce(F.max(F.when(hit, F.col("sub_end"))).over(before) >= F.col("pos"), F.lit(False)) & (F.col("whole") <= CONSENT_VALVE)


def measured(nodes: DataFrame) -> DataFrame:
    """Nodes with length, density, and what of siblings, body and consent the choice of a root asks for.

    ``density``: text for each link, weighed by tag, class and id, children, siblings, depth and share of the body's text.
    """
    page, siblings = W.partitionBy(PAGE), W.partitionBy(PAGE, "parent")
    df = nodes.withColumns(
        {
            "words": F.filter(F.split(F.lower(attr("class")), r"[\s_-]+"), lambda x: x != ""),
            "consent": in_consent(),
        }
    )
    block = F.col("tag").isin("section", "div") & (F.col("length") > 100)
    df = df.withColumns(
        {
            "body_length": F.max(F.when(F.col("tag") == "body", F.col("whole"))).over(page),
            "body_pos": F.min(F.when(F.col("tag") == "body", F.col("pos"))).over(page),
            "longest_sibling": F.max("whole").over(siblings),
            "sibling_sum": F.sum("whole").over(siblings),
            "n_siblings": F.count("*").over(siblings),
            "n_sections": F.count_if(block).over(siblings),
            "section_sum": F.sum(F.when(block, F.col("whole"))).over(siblings),
        }
    )
    n, has_parent = F.col("length").cast("double"), F.col("parent").isNotNull()
    mean, share = F.col("sibling_sum") / F.col("n_siblings"), F.try_divide(n, F.col("body_length"))
    children = F.size("child_tags")
    boost = F.when((F.col("tag") == "article") | (attr("role") == "article"), TAG_BOOST[0][1])
    for tag, x in TAG_BOOST[1:]:
        boost = boost.when(F.col("tag") == tag, x)
    score = (
        F.greatest(n - F.col("link_text"), F.lit(0.0)) / (F.col("links") + 1) * F.ln(n + 1) / (1 + 2 * F.col("link_text") / n) * boost.otherwise(1.0)
        * F.when(_signal(POSITIVE, POSITIVE_ID, F.lower(attr("class")).rlike(COMPOUND)), 1.2).otherwise(1.0)
        * F.when(_signal(NEGATIVE, NEGATIVE_ID), 0.5).otherwise(1.0) * F.when(_signal(META, META_ID), 0.92).otherwise(1.0)
        * F.when((children > 20) & (n / children < 25), 0.85).otherwise(1.0)
        * F.when(has_parent & (n < 0.7 * F.col("longest_sibling")), 0.85).otherwise(1.0)
        * F.when(has_parent & (F.col("n_siblings") > 3) & (F.abs(n - mean) / mean < 0.25), 0.9).otherwise(1.0)
        * F.when(F.col("depth") < 3, 0.95).when(F.col("depth") > 7, 0.9).otherwise(1.0)
        * F.when((F.col("tag") == "body") | share.isNull(), 1.0).when(share >= 0.4, 1.3).when(share >= 0.25, 1.15).when(share < 0.05, F.greatest(F.lit(0.1), share / 0.05)).otherwise(1.0)
    )
    return df.withColumn("density", F.when(F.col("length") < 50, 0.0).otherwise(score))


def candidates(df: DataFrame) -> DataFrame:
    """The measured nodes that may be a root: of semantic tags, roles, telling classes or ids, long table cells, those
    nodes' two nearest ancestors, and where these are fewer than three, the body's own children. None is of a consent notice."""
    tag = F.col("tag")
    telling = F.arrays_overlap("words", F.array(*map(F.lit, POSITIVE))) | F.lower(attr("class")).rlike(COMPOUND) | F.lower(attr("id")).rlike(POSITIVE_ID)
    own = (
        tag.isin("article", "main") | attr("role").isin("main", "article", "region") | (tag.isin("div", "section") & telling) | ((tag == "td") & (F.col("length") > CELL_TEXT))
    ) & ~tag.isin("body", "html") & ~F.col("consent")
    df = df.withColumn("own", own)
    for mark in ("above", "above2"):
        source = F.col("own") if mark == "above" else F.col("above_own")
        below = df.where(source & F.col("parent").isNotNull()).select(PAGE, F.col("parent").alias("pos")).distinct().withColumn(mark, F.lit(True))
        df = df.join(below, [PAGE, "pos"], "left").withColumn(f"{mark}_own", F.coalesce(F.col(mark), F.lit(False)) & ~tag.isin("body", "html")).drop(mark)
    usable = ~tag.isin("body", "html") & ~F.col("consent")
    df = df.withColumn("candidate", usable & (F.col("own") | F.col("above_own") | F.col("above2_own")))
    df = df.withColumn("few", F.count_if("candidate").over(W.partitionBy(PAGE)) < 3)
    return df.where(F.col("candidate") | (F.col("few") & usable & tag.isin("div", "section") & (F.col("parent") == F.col("body_pos"))))


def densest(nodes: DataFrame) -> DataFrame:
    """page_key, root_pos, root_end and density of each page's densest candidate, the first of equal ones.

    Too little density, and there is none. Where it is one of at least three sections and has less than three tenths of
    their text, the node that holds them all takes its place.
    """
    df = measured(nodes)
    best = F.max_by(F.struct("pos", "sub_end", "parent", "density", "whole", "n_sections", "section_sum", "tag", "body_pos"), F.struct("density", -F.col("pos")))
    found = candidates(df).groupBy(PAGE).agg(best.alias("r")).select(PAGE, "r.*").where(F.col("density") >= LEAST_DENSITY)
    fragment = F.col("tag").isin("section", "div") & (F.col("n_sections") >= 3) & (F.col("whole") / F.col("section_sum") < 0.3) & (F.col("parent") > F.col("body_pos"))
    found = found.withColumn("root_pos", F.when(fragment, F.col("parent")).otherwise(F.col("pos"))).select(PAGE, "root_pos", "density")
    return found.join(nodes.select(PAGE, F.col("pos").alias("root_pos"), F.col("sub_end").alias("root_end")), [PAGE, "root_pos"])


def _inside(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Each node with every one of ``tops`` (page_key, top_pos, top_end) that it lies below."""
    return nodes.join(tops, PAGE).where((F.col("pos") > F.col("top_pos")) & (F.col("pos") <= F.col("top_end")))


def container_scores(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """page_key, top_pos, has_h1 and score of each of ``tops`` by eleven counts of what lies below it."""
    tag, cls = F.col("tag"), attr("class")
    n = lambda mark: F.count_if(mark)
    below = _inside(nodes, tops).groupBy(PAGE, "top_pos").agg(
        n(tag == "h1").alias("h1"), n(tag == "h2").alias("h2"), n(tag == "p").alias("p"), n(tag.isin("img", "figure")).alias("figures"), n(tag == "li").alias("li"),
        n(selects("[rel=author], .author, .byline, [class*=author]")).alias("authors"), n((tag == "time") | cls.contains("date") | cls.contains("publish")).alias("times"),
        n(selects("nav, .menu, .sidebar, footer, header")).alias("furniture"), n(selects("button, a.btn")).alias("buttons"), n(cls.contains("related") | cls.contains("recommend")).alias("related"),
    )
    sized = nodes.select(PAGE, F.col("pos").alias("top_pos"), "length")
    df = tops.join(sized, [PAGE, "top_pos"]).join(below, [PAGE, "top_pos"], "left").na.fill(0)
    some = lambda mark, x: F.when(mark, F.lit(float(x))).otherwise(0.0)
    score = (
        some(F.col("h1") == 1, 20) + some(F.col("h1") > 1, -10) + some(F.col("h2") >= 2, 10) + F.least(F.lit(30.0), F.col("length") / 800.0)
        + F.least(F.lit(20), F.col("p")) + F.least(F.lit(5), F.col("figures")) + some(F.col("authors") > 0, 8) + some(F.col("times") > 0, 6)
        - 8 * F.col("furniture") + some(F.col("buttons") > 10, -15) + some(F.col("related") > 0, -8) + some(F.col("li") > 80, -10)
    )
    return df.select(PAGE, "top_pos", "top_end", (F.col("h1") > 0).alias("has_h1"), score.alias("score"))


def _ancestors(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes that hold each page's ``pos0`` and itself, with ``up``: 0 for itself, 1 for its parent and so on."""
    df = nodes.join(found.select(PAGE, "pos0"), PAGE).where((F.col("pos") <= F.col("pos0")) & (F.col("sub_end") >= F.col("pos0")))
    return df.withColumn("up", (F.row_number().over(W.partitionBy(PAGE).orderBy(F.desc("pos"))) - 1).cast("int"))


def refined(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(page_key, pos0, end0) moved to the article's text, or to the article around it where a heading stands outside."""
    specific = {f"s{k}": selects(s) for k, s in enumerate(SPECIFIC)}
    rank = F.coalesce(*[F.when(m, k) for k, m in enumerate(specific.values())])
    flat = nodes.select(PAGE, "pos", "sub_end", "tag", "length", rank.alias("rank"))
    heading = F.col("tag").isin("h1", "h2") & (F.col("length") >= HEADING_LENGTH)
    df = flat.join(found, PAGE)
    picked = df.groupBy(PAGE, "pos0", "end0").agg(
        F.max(F.when(F.col("pos") == F.col("pos0"), F.struct("rank", "tag"))).alias("own"),
        F.min(F.when(F.col("rank").isNotNull() & (F.col("pos") > F.col("pos0")) & (F.col("pos") <= F.col("end0")), F.struct("rank", "pos", "sub_end"))).alias("inner"),
        F.max(F.when((F.col("tag") == "article") & (F.col("pos") < F.col("pos0")) & (F.col("sub_end") >= F.col("end0")), F.struct("pos", "sub_end"))).alias("outer"),
        F.collect_list(F.when(heading, F.col("pos"))).alias("headings"),
    )
    outside = lambda small, large: F.exists("headings", lambda h: (h >= large["pos"]) & (h <= large["sub_end"]) & ~((h >= small["pos"]) & (h <= small["sub_end"])))
    me = F.struct(F.col("pos0").alias("pos"), F.col("end0").alias("sub_end"))
    to_inner = F.struct(F.col("inner.pos").alias("pos"), F.col("inner.sub_end").alias("sub_end"))
    root = (
        F.when(F.col("own.rank").isNotNull(), F.when(F.col("outer").isNotNull() & outside(me, F.col("outer")), F.col("outer")).otherwise(me))
        .when(F.col("inner").isNull(), me)
        .when((F.col("own.tag") == "article") & outside(F.col("inner"), me), me)
        .otherwise(to_inner)
    )
    return picked.select(PAGE, root.alias("r")).select(PAGE, F.col("r.pos").alias("pos0"), F.col("r.sub_end").alias("end0"))


def expanded(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(page_key, pos0, end0) moved up through at most six wrappers, which hold no more text."""
    ups = _ancestors(nodes, found).where(F.col("up") <= WRAPPERS)
    stop = F.col("tag").isin("body", "html") | F.concat(attr("class"), F.lit(" "), attr("id")).rlike(f"(?i){FURNITURE}")
    ups = ups.select(PAGE, "up", F.struct("pos", "sub_end", "length", ((F.col("up") > 0) & stop).alias("stop")).alias("n"))
    chain = ups.groupBy(PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("up", "n"))), lambda x: x["n"]).alias("chain"))
    start = F.struct(F.col("chain")[0]["pos"].alias("pos"), F.col("chain")[0]["sub_end"].alias("sub_end"), F.col("chain")[0]["length"].alias("length"), F.lit(False).alias("stop"))

    def step(held: Column, n: Column) -> Column:
        going = ~held["stop"] & ~n["stop"] & (n["length"] <= held["length"])
        pick = lambda k: F.when(going, n[k]).otherwise(held[k]).alias(k)
        return F.struct(pick("pos"), pick("sub_end"), pick("length"), (~going).alias("stop"))

    top = F.aggregate(F.slice("chain", 2, WRAPPERS), start, step)
    return chain.select(PAGE, top.alias("t")).select(PAGE, F.col("t.pos").alias("pos0"), F.col("t.sub_end").alias("end0"))


def best_ancestor(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(page_key, pos0, end0) moved to the best-scored ancestor up to the first that holds an h1, if it holds none."""
    tops = _ancestors(nodes, found).where(~F.col("tag").isin("body", "html")).select(PAGE, "up", F.col("pos").alias("top_pos"), F.col("sub_end").alias("top_end"))
    scored = container_scores(nodes, tops.select(PAGE, "top_pos", "top_end")).join(tops.select(PAGE, "top_pos", "up"), [PAGE, "top_pos"])
    reach = F.coalesce(F.min(F.when(F.col("has_h1"), F.col("up"))).over(W.partitionBy(PAGE)), F.lit(1 << 30))
    best = F.max_by(F.struct("top_pos", "top_end"), F.struct("score", -F.col("up")))
    picked = scored.withColumn("reach", reach).where("up <= reach").groupBy(PAGE).agg(best.alias("b")).select(PAGE, "b.*")
    kept = found.join(picked, PAGE, "left")
    return kept.select(PAGE, F.coalesce("top_pos", "pos0").alias("pos0"), F.coalesce("top_end", "end0").alias("end0"))


def containers(nodes: DataFrame) -> DataFrame:
    """page_key, pos0 and end0: of the first selector that finds text, the longest match, the first of equal ones."""
    ranks = F.array_compact(F.array(*[F.when(selects(s), k) for k, s in enumerate(CONTAINERS)]))
    df = nodes.select(PAGE, "pos", "sub_end", "length", F.explode(ranks).alias("rank")).where("length > 0")
    best = F.min_by(F.struct("pos", "sub_end"), F.struct("rank", -F.col("length"), "pos"))
    return df.groupBy(PAGE).agg(best.alias("b")).select(PAGE, F.col("b.pos").alias("pos0"), F.col("b.sub_end").alias("end0"))


def article_roots(nodes: DataFrame, rules: tuple[SiteRule, ...] = (), articles: DataFrame | None = None) -> DataFrame:
    """page_key, page_id, url, root_pos, root_end and layer of every page: "site", "container", "density", "signature" or
    "body". ``articles`` (page_key, text) is what another tool has read of the pages; the root around it counts where the
    layers before have none."""
    nodes, layers = held(nodes), []
    if any(r.root_selector for r in rules):
        hit = by_site(F.col("url"), rules, lambda r: selects(r.root_selector) if r.root_selector else F.lit(False), F.lit(False))
        first = F.min(F.struct("pos", "sub_end", (F.col("length") > 0).alias("full")))
        site = with_selectors(nodes, [r.root_selector for r in rules if r.root_selector]).where(hit).groupBy(PAGE).agg(first.alias("f")).where("f.full")
        layers.append(site.select(PAGE, F.lit(0).alias("layer"), F.col("f.pos").alias("root_pos"), F.col("f.sub_end").alias("root_end")))
    # One row a page, held as well: the last step asks for it five times over.
    known = best_ancestor(nodes, held(expanded(nodes, refined(nodes, containers(nodes)))))
    layers.append(known.select(PAGE, F.lit(1).alias("layer"), F.col("pos0").alias("root_pos"), F.col("end0").alias("root_end")))
    layers.append(densest(nodes).select(PAGE, F.lit(2).alias("layer"), "root_pos", "root_end"))
    if articles is not None:
        from brookloom.operators.containment import signature_roots

        layers.append(signature_roots(nodes, articles).select(PAGE, F.lit(3).alias("layer"), "root_pos", "root_end"))
    top = F.min(F.struct((F.col("tag") != "body").alias("other"), "pos", "sub_end"))
    body = nodes.groupBy(PAGE, "page_id", "url").agg(top.alias("t"))
    layers.append(body.select(PAGE, F.lit(4).alias("layer"), F.col("t.pos").alias("root_pos"), F.col("t.sub_end").alias("root_end")))
    every = layers[0]
    for x in layers[1:]:
        every = every.unionByName(x)
    best = every.groupBy(PAGE).agg(F.min(F.struct("layer", "root_pos", "root_end")).alias("r"))
    name = F.element_at(F.array(*map(F.lit, ("site", "container", "density", "signature", "body"))), F.col("r.layer") + 1)
    return best.join(body.select(PAGE, "page_id", "url"), PAGE).select(PAGE, "page_id", "url", "r.root_pos", "r.root_end", name.alias("layer"))


def held(nodes: DataFrame) -> DataFrame:
    """The nodes, kept in memory or on local disks once they are parsed: each question about them reads them there, dealt by
    page, and joins them by page without a shuffle. What a lost executor held is parsed anew. ``unpersist`` them, or clear
    the session's cache, when a job is done with them."""
    return nodes.persist(StorageLevel.MEMORY_AND_DISK)


def is_pdf_viewer() -> Column:
    """Whether a node says that the page shows a PDF drawn by script."""
    return ((attr("id") == "viewer") & F.array_contains(F.split(attr("class"), r"\s+"), "pdfViewer")) | (attr("id") == "viewerContainer")


def prepared(pages: DataFrame, rules: tuple[SiteRule, ...] = (), bare: bool = True, **how) -> DataFrame:
    """One row for each page: page_key, page_id, url, status, blocks (id, tag, text, xpath), full_text and n_blocks.

    ``status`` says where the blocks come from: "article" below the root, "body" where the root has none, "data-island"
    from JSON scripts where neither has; else "pdf-viewer" or "empty", without blocks. ``bare``: as ``html_nodes`` has it.
    """
    pages = keyed(pages)
    nodes = held(html_nodes(pages, bare))
    marked = marked_blocks(nodes, article_roots(nodes, rules), rules=rules, **how).withColumn("any_root", F.max("in_root").over(W.partitionBy(PAGE)))
    found = numbered_blocks(marked, F.when(F.col("any_root"), F.col("in_root")).otherwise(F.col("in_body")), "any_root")
    viewer = nodes.groupBy(PAGE).agg(F.max(is_pdf_viewer()).alias("viewer"))
    cut = F.struct("position", "id", "tag", "text", "xpath")
    plain = found.groupBy(PAGE).agg(F.array_sort(F.collect_list(cut)).alias("blocks"), F.any_value("any_root").alias("any_root"))
    islands = data_islands(pages).select(
        PAGE, F.struct("position", F.concat(F.lit("b"), "position").alias("id"), F.lit("p").alias("tag"), "text", F.concat(F.lit("/data-island/["), F.col("position"), F.lit("]")).alias("xpath")).alias("b")
    )
    other = islands.groupBy(PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col("b.position").cast("long").alias("position"), "b.id", "b.tag", "b.text", "b.xpath"))).alias("island"))
    df = pages.select(PAGE, "page_id", "url").join(plain, PAGE, "left").join(other, PAGE, "left").join(viewer, PAGE, "left")
    status = (
        F.when(F.col("blocks").isNotNull() & F.col("any_root"), "article").when(F.col("blocks").isNotNull(), "body").when(F.col("island").isNotNull(), "data-island")
        .when(F.col("viewer"), "pdf-viewer").otherwise("empty")
    )
    blocks = F.transform(F.coalesce("blocks", "island", F.array().cast("array<struct<position:bigint,id:string,tag:string,text:string,xpath:string>>")), lambda b: F.struct(b["id"].alias("id"), b["tag"].alias("tag"), b["text"].alias("text"), b["xpath"].alias("xpath")))
    df = df.select(PAGE, "page_id", "url", status.alias("status"), blocks.alias("blocks"))
    return df.withColumns({"full_text": F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"), "n_blocks": F.size("blocks")})


def page_chunks(pages: DataFrame, rules: tuple[SiteRule, ...] = (), **how) -> DataFrame:
    """page_key, page_id, url and the chunks of every prepared page that has blocks."""
    heading = F.transform("blocks", lambda b: F.struct(b["id"].alias("id"), b["text"].alias("text"), b["tag"].rlike("^h[1-6]$").alias("heading")))
    return packed_chunks(prepared(pages, rules, **how).select(PAGE, "page_id", "url", heading.alias("blocks")), [PAGE, "page_id", "url"])
