"""Which nodes a page's own style sheets hide: the cascade over its ``<style>`` elements and inline styles, as joins.

Sheets differ from page to page, so their rules are rows, not columns: each selector asks by page for the id, class or tag it
names, nodes stand under all of theirs, and what meets is tested in full. Of what a node is told for ``display`` and for
``visibility`` the strongest counts: important ones, then inline ones, then ids, classes and tags that the selector names,
then the later one. Only rules that speak of the two take part.

Selectors are compounds of a tag, classes and ids; others (combinators, attributes, states) are passed over, and so are
rules inside ``@`` blocks, whose conditions a page alone doesn't settle. Defined results: sheets that break off hold what came
before; declarations without a value are none; nodes that no rule speaks of have no row; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookloom.operators.rules import attr

PAGE = "page_key"
_COMMENT, _AT = r"(?s)/\*.*?(?:\*/|$)", r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*(?:\}|$)|$)"
_RULE, _COMPOUND = r"[^{}]+\{[^{}]*\}", r"^(?:[a-zA-Z][\w-]*|\*)?(?:[.#][\w-]+)*$"
_SAYS = r"(?i)(?:^|;)\s*(?:display|visibility)\s*:[^;]*"
_DECLARATION = "struct<property:string,value:string,important:boolean,place:int>"


def _declarations(body: Column) -> Column:
    """(property, value, important, place) of what a body says of display and visibility."""
    said = F.regexp_extract_all(body, F.lit(_SAYS), F.lit(0))
    part = lambda x, pattern: F.lower(F.trim(F.regexp_extract(x, pattern, 1)))
    one = lambda x, i: F.struct(
        part(x, r"^[;\s]*([\w-]+)").alias("property"), part(x, r":\s*([\w-]*)").alias("value"), x.rlike(r"(?i)!\s*important\s*$").alias("important"), i.alias("place")
    )
    return F.filter(F.transform(said, one), lambda d: d["value"] != "")


def style_rules(nodes: DataFrame) -> DataFrame:
    """page_key, asks (what a node must have to be looked at), tag, ids, classes, rank (sheet and place in it) and the
    declarations of every selector of a page's sheets that speaks of display or visibility."""
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("own", lambda o: o["text"]), ""), _COMMENT, " "), _AT, " ")
    rules = nodes.where("tag = 'style'").select(PAGE, "pos", F.posexplode(F.regexp_extract_all(text, F.lit(_RULE), F.lit(0))).alias("nth", "rule"))
    rules = rules.withColumn("says", _declarations(F.regexp_extract("rule", r"\{([^}]*)\}", 1))).where("size(says) > 0")
    css = F.explode(F.transform(F.split(F.regexp_extract("rule", r"^([^{]*)\{", 1), ","), lambda x: F.trim(x)))
    df = rules.select(PAGE, F.struct("pos", "nth").alias("rank"), "says", css.alias("css")).where(F.col("css").rlike(_COMPOUND) & (F.col("css") != ""))
    df = df.select(
        PAGE, "rank", "says", F.lower(F.regexp_extract("css", r"^([a-zA-Z][\w-]*)", 1)).alias("tag_is"),
        F.regexp_extract_all("css", F.lit(r"#([\w-]+)"), F.lit(1)).alias("ids"), F.regexp_extract_all("css", F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"),
    )
    named = F.coalesce(F.concat(F.lit("#"), F.get("ids", F.lit(0))), F.concat(F.lit("."), F.get("classes", F.lit(0))), F.nullif("tag_is", F.lit("")), F.lit("*"))
    return df.withColumn("asks", named)


def told(nodes: DataFrame) -> DataFrame:
    """page_key, pos, display and visibility: what the strongest of the page's rules and inline styles says, if any does."""
    tokens = F.filter(F.split(attr("class"), r"\s+"), lambda t: t != "")
    own = nodes.select(PAGE, "pos", "tag", attr("id").alias("id"), tokens.alias("tokens"), attr("style").alias("style"))
    has = F.concat(F.array(F.lit("*"), F.col("tag"), F.concat(F.lit("#"), F.col("id"))), F.transform("tokens", lambda t: F.concat(F.lit("."), t)))
    rules = style_rules(nodes)
    met = own.withColumn("asks", F.explode(F.array_distinct(has))).join(rules, [PAGE, "asks"])
    fits = ((F.col("tag_is") == "") | (F.col("tag_is") == F.col("tag"))) & F.forall("ids", lambda i: i == F.col("id")) & (F.size(F.array_except("classes", "tokens")) == 0)
    weight = F.struct(F.size("ids").alias("a"), F.size("classes").alias("b"), (F.col("tag_is") != "").cast("int").alias("c"), F.col("rank.pos").alias("d"), F.col("rank.nth").alias("e"))
    of_rules = met.where(fits).select(PAGE, "pos", F.explode("says").alias("s"), F.lit(False).alias("inline"), weight.alias("weight"))
    none = F.struct(*[F.lit(0).alias(c) for c in "abcde"])
    inline = own.where("style != ''").select(PAGE, "pos", F.explode(_declarations(F.col("style"))).alias("s"), F.lit(True).alias("inline"), none.alias("weight"))
    strength = F.struct("s.important", "inline", "weight", "s.place")
    says = lambda name: F.max_by(F.when(F.col("s.property") == name, F.col("s.value")), F.when(F.col("s.property") == name, strength)).alias(name)
    return of_rules.unionByName(inline).groupBy(PAGE, "pos").agg(says("display"), says("visibility"))


def with_style_hidden(nodes: DataFrame) -> DataFrame:
    """Nodes with ``style_hidden``: whether they are told to be hidden themselves."""
    hidden = F.coalesce(F.col("display") == "none", F.lit(False)) | F.coalesce(F.col("visibility") == "hidden", F.lit(False))
    found = told(nodes).select(PAGE, "pos", hidden.alias("style_hidden")).where("style_hidden")
    return nodes.join(found, [PAGE, "pos"], "left").withColumn("style_hidden", F.coalesce("style_hidden", F.lit(False)))
