"""Which nodes of a page become text blocks: predicates as columns, subtree rules as running maxima.

A node lies inside a marked subtree if the greatest ``sub_end`` of marked nodes before it reaches its ``pos``: subtrees
nest, so one window in document order answers each ancestor question, and no range join is needed. All windows share
one partitioning, by page; a page is bounded by what one browser shows. Rows with a null or repeated id are pages of
their own (``page_key``), equal rows are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookloom.functions.text import collapse_spaced, is_valid_text, trimmed
from brookloom.operators.rules import NodeRule, SiteRule, any_rule, attr, by_site, either, selects, with_selectors
from brookloom.operators.styles import with_style_hidden

PAGE = "page_key"
#: Tags by role.
BLOCK_TAGS = "h1 h2 h3 h4 h5 h6 p li dd blockquote figcaption".split()
HEADING_TAGS = "h1 h2 h3 h4 h5 h6".split()
NEVER_TAGS = (
    "html head body title meta link base script style noscript iframe template slot embed object param "
    "video audio track source picture map area input textarea code pre kbd samp var tt "
    "table thead tbody tfoot tr td th caption col colgroup dt"
).split()
ASIDE_TAGS = "footer aside nav search dialog address".split()
INLINE_TAGS = (
    "a abbr b bdi bdo br cite code data dfn em i kbd mark q s samp small span strong sub sup time u var wbr "
    "ruby rb rt rp del ins font tt big strike mdspan img"
).split()
NOTICE_TAGS = "div section aside dialog article main nav footer header".split()
#: Words of class tokens, classes of article bodies, and phrases of consent notices.
METADATA_WORDS = "meta author byline category categories dateline".split()
CONTENT_WORDS = "post content article story entry rich".split()
ARTICLE_CLASSES = "article-content article-body article-text story-content story-body story-text main-content content-body content-area post-content entry-content page-content".split()
COOKIE_PHRASES = (
    "accept all", "reject all", "allow all", "cookie settings", "cookie preferences", "manage cookies", "manage your cookies",
    "we use cookies", "uses cookies", "cookie policy", "privacy settings", "your privacy choices", "consent preferences",
)
#: Up to this length of text a noise class counts; fixed value.
NOISE_VALVE = 5000
#: Class tokens of page furniture, for callers without a list of their own: the landmark roles of WAI-ARIA that hold no
#: article, and what they are called in English.
NOISE_CLASSES = (
    "banner navigation search complementary contentinfo dialog alertdialog menu menubar toolbar tablist tooltip status "
    "nav sidebar breadcrumb breadcrumbs pagination pager footer masthead toc login newsletter subscribe advert advertisement ads sponsored "
    "promo cookie consent gdpr comments disqus share social related recommended"
).split()
#: The class that marks blocks which have a translation already.
TRANSLATED_CLASS = "translated-block"

#: What covers a page, and what is of low priority, by class, id, role, style and action.
OVERLAY_RULES = (
    NodeRule(class_pattern=r"\bcookie\b|\bconsent\b|\bgdpr\b|privacy-banner|cookie-banner"),
    NodeRule(id_pattern=r"\bcookie\b|\bconsent\b|\bgdpr\b|privacy"),
    NodeRule(class_pattern=r"\bpopup\b|\bmodal\b|overlay|\bdialog\b|backdrop|lightbox"),
    NodeRule(id_pattern=r"\bpopup\b|\bmodal\b|overlay|\bdialog\b"),
    NodeRule(class_pattern="subscription-popup|paywall|subscribe-popup|newsletter-modal"),
    NodeRule(class_pattern="notification|subscribers"),
    NodeRule(id_pattern="notification|subscribers"),
    NodeRule(role="dialog"),
    NodeRule(role="alertdialog"),
    NodeRule(tag="div", check=lambda: F.lower(attr("style")).rlike(r"position\s*:\s*(fixed|sticky)")),
    NodeRule(tag="form", check=lambda: attr("action").rlike("(?i)^http://")),
)
LOW_PRIORITY_RULES = (
    NodeRule(tag="nav"),
    NodeRule(tag="footer"),
    NodeRule(tag="aside"),
    NodeRule(class_pattern=r"\bad\b|banner|sponsor|\bpromo\b|affiliate|advert"),
    NodeRule(id_pattern=r"\bad\b|banner|sponsor|\bpromo\b|advert"),
    NodeRule(class_pattern=r"\bshare\b|\bsocial\b|comment|related|recommend|sidebar"),
    NodeRule(id_pattern=r"\bshare\b|\bsocial\b|comment|related|recommend|sidebar"),
    NodeRule(class_pattern=r"\bnavbar\b|site-nav|global-nav|\btopbar\b|subscribe|newsletter|\bcookie\b|\bconsent\b"),
    NodeRule(id_pattern=r"\bnavbar\b|site-nav|global-nav|\btopbar\b|subscribe|newsletter|\bcookie\b|\bconsent\b"),
)


def class_tokens() -> Column:
    cls = F.lower(F.coalesce(F.col("attrs")["class"], F.lit("")))
    return F.filter(F.split(cls, r"\s+"), lambda t: (t != "") & ~t.contains(":") & ~t.contains("["))


def _has_class(patterns: list[str]) -> Column:
    """A token equals a pattern, or begins or ends with it at a hyphen or underscore."""
    return F.exists("tokens", lambda t: t.rlike(f"^({'|'.join(patterns)})([-_]|$)|[-_]({'|'.join(patterns)})$"))


def _has_word(words: list[str]) -> Column:
    return F.exists("tokens", lambda t: F.arrays_overlap(F.split(t, "[-_]+"), F.array(*map(F.lit, words))))


def soft_hint() -> Column:
    cls = F.lower(attr("class"))
    rule = lambda words, n: F.when(cls.rlike(words), n).otherwise(0)
    return rule("article|post", 2) + rule("content|body", 2) + rule("main", 1) + rule("sidebar|nav", -3) + rule("footer|comment", -2)


def _hidden(styles: bool) -> Column:
    by_style = F.col("style_hidden") if styles else F.lower(attr("style")).rlike(r"display\s*:\s*none|visibility\s*:\s*hidden")
    return F.map_contains_key("attrs", "hidden") | (attr("aria-hidden") == "true") | by_style


def decided(
    nodes: DataFrame, skip_patterns: tuple[str, ...] = (), noise: list[str] | None = None, rules: tuple[SiteRule, ...] = (), translated_class: str = TRANSLATED_CLASS,
    styles: bool = False,
) -> DataFrame:
    """Nodes with their flags and ``decision``: reject (with all below), skip or accept; the first rule that holds.

    ``noise``: class tokens of page furniture, in place of NOISE_CLASSES. ``rules``: of sites, in order of precedence.
    ``styles``: nodes that the page's own style sheets hide are hidden too, and those that an inline style shows again are not.
    ``low_priority`` is a note that decides nothing.
    """
    if styles:
        nodes = with_style_hidden(nodes)
    own = W.partitionBy(PAGE).orderBy("pos")
    upto, before, after = own.rowsBetween(W.unboundedPreceding, 0), own.rowsBetween(W.unboundedPreceding, -1), own.rowsBetween(1, W.unboundedFollowing)
    within = lambda mark, frame: F.coalesce(F.max(F.when(mark, F.col("sub_end"))).over(frame) >= F.col("pos"), F.lit(False))
    holds = lambda mark: F.coalesce(F.min(F.when(mark, F.col("pos"))).over(after) <= F.col("sub_end"), F.lit(False))
    tag = F.col("tag")
    paragraph = F.lower(attr("class")).contains("public-draftstyledefault-block")
    main = tag.isin("article", "main") | attr("role").isin("main", "article")
    df = with_selectors(nodes, [x for r in rules for x in r.skip_selectors]).withColumn("tokens", class_tokens()).withColumns(
        {
            "content": trimmed(F.col("text")),
            "block": tag.isin(BLOCK_TAGS),
            "paragraph": paragraph,
            "in_main": within(main, upto),
            "in_article": within((tag == "article") | attr("role").isin("main", "article") | _has_class(ARTICLE_CLASSES), upto),
            "block_above": within(tag.isin(BLOCK_TAGS) | paragraph, before),
            "block_below": holds(tag.isin(BLOCK_TAGS)),
            "heading_below": holds(tag.isin(HEADING_TAGS)),
            "only_inline": ~F.exists("child_tags", lambda t: ~t.isin(BLOCK_TAGS + INLINE_TAGS)),
        }
    )
    site = lambda value: by_site(F.col("url"), rules, value, F.lit(False))
    unwanted = site(lambda r: either([F.col("content").rlike(f"(?i){p}") for p in r.skip_texts]))
    low = any_rule(LOW_PRIORITY_RULES) & ~((tag == "header") & F.col("heading_below"))
    df = df.withColumns({"valid": is_valid_text(F.col("content"), skip_patterns) & ~unwanted, "low_priority": low})
    nested_body = (tag == "body") & (F.coalesce(F.col("parent_tag"), F.lit("")) != "html")
    editable = F.map_contains_key("attrs", "contenteditable") & attr("contenteditable").isin("", "true")
    opted_out = F.exists(F.split(attr("class"), r"\s+"), lambda t: t.isin("notranslate", translated_class))
    notice = tag.isin(NOTICE_TAGS) & F.lower("own_text").rlike("|".join(COOKIE_PHRASES))
    decision = (
        F.when(~F.col("in_main") & any_rule(OVERLAY_RULES), "reject")
        .when(tag.isin("svg", "math"), "reject")
        .when((tag.isin(NEVER_TAGS) & ~nested_body) | opted_out | editable, "reject")
        .when(_hidden(styles), "reject")
        .when(_has_class(noise or NOISE_CLASSES) & (F.col("whole") <= NOISE_VALVE), "reject")
        .when(site(lambda r: either([selects(x) for x in r.skip_selectors])), "reject")
        .when(notice, "reject")
        .when(~tag.isin("article", "main") & _has_word(METADATA_WORDS) & ~(tag.isin("section", "div") & _has_word(CONTENT_WORDS)), "reject")
        .when((tag == "header") & F.col("heading_below"), "skip")
        .when((tag == "header") | tag.isin(ASIDE_TAGS), "reject")
        .when(F.col("block") & F.col("block_below"), "skip")
        .when(F.col("block") | F.col("paragraph"), F.when((soft_hint() >= 0) & F.col("valid"), "accept").otherwise("skip"))
        .when(F.col("only_inline") & (F.col("direct_text") | F.col("child_text")) & F.col("valid"), "accept")
        .otherwise("skip")
    )
    df = df.withColumn("decision", decision)
    return df.withColumn("rejected_above", within(F.col("decision") == "reject", before))


def emitted(rejected_above: Column) -> Column:
    """Whether an accepted node is a block: blocks and paragraphs, loose inline text of articles, or a bare text holder."""
    return (F.col("decision") == "accept") & ~rejected_above & F.col("valid") & (
        (F.col("block") & ~F.col("block_below"))
        | (F.col("paragraph") & ~F.col("block"))
        | (F.col("tag").isin(INLINE_TAGS) & F.col("in_article") & ~F.col("block_above") & ~F.col("block"))
        | (~F.col("block") & ~F.col("paragraph") & ~F.col("tag").isin(INLINE_TAGS) & F.col("only_inline") & F.col("direct_text"))
    )


def _below(mark: Column, within: Column) -> Column:
    """Whether a node lies below one that ``mark`` and ``within`` hold for."""
    before = W.partitionBy(PAGE).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(mark & within, F.col("sub_end"))).over(before) >= F.col("pos"), F.lit(False))


def marked_blocks(nodes: DataFrame, roots: DataFrame | None = None, **how) -> DataFrame:
    """Decided nodes with ``in_body`` and ``in_root``: whether each is a block of the walk below the body, and of the walk
    below its page's root (page_key, root_pos, root_end). A walk's root, and what is above, is never tested."""
    df = decided(nodes, **how)
    inner = ~F.col("tag").isin("html", "body")
    df = df.withColumn("rejected_above", _below(F.col("decision") == "reject", inner)).withColumn("in_body", emitted(F.col("rejected_above")))
    if roots is None:
        return df.withColumn("in_root", F.lit(False))
    df = df.join(roots.select(PAGE, "root_pos", "root_end"), PAGE, "left")
    inside = F.coalesce((F.col("pos") > F.col("root_pos")) & (F.col("pos") <= F.col("root_end")), F.lit(False))
    df = df.withColumn("rejected_in_root", _below(F.col("decision") == "reject", inside))
    return df.withColumn("in_root", emitted(F.col("rejected_in_root")) & inside)


def numbered_blocks(df: DataFrame, chosen: Column, *more: str) -> DataFrame:
    """page_key, page_id, url, id, position, xpath, tag, text, heading_path, low_priority and ``more`` of the chosen nodes.

    Of equal texts of a page the first counts. ``heading_path``: texts of all headings that end before the block; only
    headings and blocks take part in finding it.
    """
    own = W.partitionBy(PAGE).orderBy("pos")
    is_heading = F.col("tag").isin(HEADING_TAGS)
    df = df.withColumn("chosen", chosen).where(F.col("chosen") | is_heading)
    df = df.withColumn("headings", F.collect_list(F.when(is_heading & F.col("content").isNotNull(), F.struct("sub_end", "content"))).over(own.rowsBetween(W.unboundedPreceding, -1)))
    first = W.partitionBy(PAGE, "content").orderBy("pos")
    blocks = df.where("chosen").withColumn("nth", F.row_number().over(first)).where("nth = 1").withColumn("position", F.row_number().over(own).cast("long"))
    return blocks.select(
        PAGE, "page_id", "url", F.concat(F.lit("b"), "position").alias("id"), "position", "xpath", "tag", collapse_spaced(F.col("content")).alias("text"),
        F.transform(F.filter("headings", lambda h: h["sub_end"] < F.col("pos")), lambda h: h["content"]).alias("heading_path"), "low_priority", *more,
    )


def extract_blocks(nodes: DataFrame, roots: DataFrame | None = None, **how) -> DataFrame:
    """The blocks below each page's root, or below its body where ``roots`` isn't given: ``numbered_blocks`` has the
    columns."""
    return numbered_blocks(marked_blocks(nodes, roots, **how), F.col("in_body") if roots is None else F.col("in_root"))
