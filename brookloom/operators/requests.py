"""Requests to a text service and what comes back: prompts, bodies, lenient results, bilingual pages, sessions.

Prompts are columns over a document's terms and its site's rule; templates belong to the caller. Defined results: null
texts, terms and rules leave their part out; repeated terms are written once; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookloom.functions.text import error_class, output_budget, trimmed, without_base
from brookloom.operators.blocks import packed_chunks
from brookloom.operators.retry import KEY
from brookloom.sources.html import html_nodes

#: A plain instruction, for callers without templates of their own: {source} and {target} are names of languages.
TEMPLATE = 'Translate {source} to {target}. Answer in JSON as {{"translations":[{{"id":"x","translated_text":"y"}}]}} with one entry for each block, under the same ids. Leave addresses and code as they are.'
LANGUAGE_NAMES = {"en": "English", "zh": "Simplified Chinese"}


def quoted(c: Column) -> Column:
    """A string as JSON writes it."""
    whole = F.to_json(F.struct(c.alias("s")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def pretty_blocks(blocks: Column) -> Column:
    """An array of structs with id and text as indented JSON."""
    one = lambda b: F.concat(F.lit('  {\n    "id": '), quoted(b["id"]), F.lit(',\n    "text": '), quoted(b["text"]), F.lit("\n  }"))
    return F.when(F.size(blocks) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform(blocks, one), ",\n"), F.lit("\n]")))


def _language(c: Column, default: str) -> Column:
    out = F.when(F.coalesce(c, F.lit("")) == "", LANGUAGE_NAMES[default])
    return out.when(c == default, LANGUAGE_NAMES[default]).otherwise(c)


def system_prompt(source: Column, target: Column, terms: Column | None = None, site: Column | None = None, style: Column | None = None, templates: dict[str, str] | None = None) -> Column:
    """The template of the style, or TEMPLATE, then the distinct terms in order of their code points, then the site's rules."""
    parts = lambda t: F.replace(F.replace(F.lit(t.replace("{{", "{").replace("}}", "}")), F.lit("{source}"), _language(source, "en")), F.lit("{target}"), _language(target, "zh"))
    body = parts(TEMPLATE)
    for name, template in (templates or {}).items():
        body = F.when(style == name, parts(template)).otherwise(body) if style is not None else body
    if terms is not None:
        held = F.array_sort(F.array_distinct(F.array_compact(terms)))
        body = F.concat(body, F.when(F.size(held) > 0, F.concat(F.lit("\n\nThis page mentions:\n"), F.array_join(held, "\n"))).otherwise(""))
    if site is not None:
        body = F.concat(body, F.when(F.coalesce(site, F.lit("")) != "", F.concat(F.lit("\n\nSite-specific rules:\n"), site)).otherwise(""))
    return body


def request_body(blocks: Column, system: Column, model: str, temperature: float = 0.0) -> Column:
    """The JSON body of a request: system and user messages, a JSON answer asked for, a budget by the blocks' length."""
    said = pretty_blocks(blocks)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    kind = lambda x: F.struct(F.lit(x).alias("type"))
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"), F.array(message("system", system), message("user", F.concat(F.lit("JSON:\n\n"), said))).alias("messages"), kind("json_object").alias("response_format"),
            F.lit(temperature).alias("temperature"), output_budget(said).alias("max_tokens"), kind("disabled").alias("thinking"), F.lit(False).alias("stream"),
        )
    )


def lenient_results(raw: DataFrame) -> DataFrame:
    """doc_id, id and text from JSON results of many shapes: a bare list, or one under translations, results or data. Ids
    may be numbers; the first of four fields that isn't empty counts; the last of equal ids wins."""
    whole = F.try_parse_json("raw")
    lists = [F.try_variant_get(whole, p, "array<variant>") for p in ("$", "$.translations", "$.results", "$.data")]
    rows = raw.select("doc_id", F.posexplode(F.coalesce(*lists)).alias("pos", "item"))
    value = lambda f: F.nullif(F.try_variant_get("item", f"$.{f}", "string"), F.lit(""))
    text = F.coalesce(*map(value, ("translated_text", "translation", "translatedText", "text")), F.try_variant_get("item", "$.text", "string"))
    fields = rows.select("doc_id", "pos", F.try_variant_get("item", "$.id", "string").alias("id"), text.alias("text"))
    return fields.where("id is not null and text is not null").groupBy("doc_id", "id").agg(F.max_by("text", "pos").alias("text"))


def server_results(pages: DataFrame, blocks: DataFrame, id_attribute: str = "data-block-id", result_class: str = "translation") -> DataFrame:
    """page_id, id, text and translated of blocks (page_id, id, text) whose bilingual page (page_id, html) has a result:
    the first node of ``result_class`` below the first that bears the id. Empty and unchanged results don't count."""
    nodes = html_nodes(pages.select("page_id", F.lit("").alias("url"), without_base(F.col("html")).alias("html")))
    bears = nodes.where(F.map_contains_key("attrs", F.lit(id_attribute))).select("page_key", "page_id", F.col("attrs")[id_attribute].alias("id"), F.col("pos").alias("lo"), F.col("sub_end").alias("hi"))
    first = bears.groupBy("page_key", "page_id", "id").agg(F.min(F.struct("lo", "hi")).alias("b")).select("page_key", "page_id", "id", "b.*")
    marked = nodes.where(F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), result_class)).select("page_key", "pos", trimmed(F.col("text")).alias("translated"))
    held = first.join(marked, "page_key").where("pos > lo and pos <= hi").groupBy("page_id", "id").agg(F.min_by("translated", "pos").alias("translated"))
    return blocks.join(held, ["page_id", "id"]).where("translated != '' and translated != text").select("page_id", "id", "text", "translated")


def located(blocks: DataFrame, nodes: DataFrame, id_attribute: str = "data-block-id") -> DataFrame:
    """Blocks (page_key, id, xpath, ...) with ``pos`` of their node: the first that bears the block's id, else that of its
    path; null where there is neither."""
    bears = nodes.where(F.map_contains_key("attrs", F.lit(id_attribute))).groupBy("page_key", F.col("attrs")[id_attribute].alias("id")).agg(F.min("pos").alias("by_id"))
    paths = nodes.groupBy("page_key", "xpath").agg(F.min("pos").alias("by_path"))
    found = blocks.join(bears, ["page_key", "id"], "left").join(paths, ["page_key", "xpath"], "left")
    return found.withColumn("pos", F.coalesce("by_id", "by_path")).drop("by_id", "by_path")


def global_missing(blocks: DataFrame, translated: DataFrame) -> DataFrame:
    """Blocks of a document that no chunk brought back."""
    return blocks.join(translated.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti")


def global_retry(blocks: DataFrame, translated: DataFrame) -> DataFrame:
    """What is missing of every document, packed anew: the pass after each chunk's own retry. A document's missing blocks
    are bounded by its text."""
    rows = F.array_sort(F.collect_list(F.struct("position", "id", "text")))
    missing = global_missing(blocks, translated).groupBy("doc_id").agg(rows.alias("rows"))
    return packed_chunks(missing.select("doc_id", F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["text"].alias("text"), F.lit(False).alias("heading"))).alias("blocks")), ["doc_id"])


def restored(applied: DataFrame) -> DataFrame:
    """Blocks as they were before their results were applied."""
    return applied.drop("translated")


def applied_once(applied: DataFrame, fresh: DataFrame) -> DataFrame:
    """``applied`` (..., translated) with what ``fresh`` (KEY, translated) has for rows that have no result yet."""
    new = fresh.groupBy(*KEY).agg(F.max("translated").alias("new"))
    return applied.join(new, KEY, "left").withColumn("translated", F.coalesce("translated", "new")).drop("new")


def session_stats(chunks: DataFrame) -> DataFrame:
    """doc_id and how its chunks (doc_id, chunk_id, missing, retry_missing, error) went: whole at once, after a retry, still
    incomplete, failed."""
    failed = F.col("error").isNotNull()
    retried = ~failed & (F.col("missing") > 0)
    left = F.coalesce("retry_missing", "missing")
    return chunks.groupBy("doc_id").agg(
        F.count_if(~failed & (F.col("missing") == 0)).alias("fully_ok"), F.count_if(retried).alias("needed_retry"), F.count_if(retried & (left == 0)).alias("recovered"),
        F.count_if(retried & (left > 0)).alias("still_missing"), F.count_if(failed).alias("failed"),
    )


def error_counts(chunks: DataFrame) -> DataFrame:
    """doc_id, class, n and place of the classes of errors, the most frequent first, then by name."""
    counts = chunks.where("error is not null").groupBy("doc_id", error_class(F.col("error")).alias("class")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "class")))


def warm_up(chunk: Column, first: int = 2) -> Column:
    """Whether a chunk belongs to those sent one at a time before others go side by side."""
    return chunk <= first


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """``df`` with metrics that a listener or an Observation reads as the job goes on: rows, and those named."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])


def settings(stored: Column, defaults: dict[str, str]) -> Column:
    """A map of settings: what is stored over the defaults; null values don't count."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    own = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def written_settings(stored: DataFrame, changes: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """owner and settings after ``changes`` (owner, settings, ts) are written to ``stored`` (owner, settings), maps both: what is
    changed, the last by time and of equal times the greatest, over what is stored, over the defaults. A write stores the
    defaults with it; null values change nothing, null owners are one, and owners without a change stay as they are."""
    last = changes.select("owner", "ts", F.explode("settings").alias("name", "value")).where("value is not null")
    last = last.groupBy("owner", "name").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
    new = last.groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("new"))
    held = stored.groupBy("owner").agg(F.max_by("settings", F.size("settings")).alias("held"))
    both = held.join(new.withColumnRenamed("owner", "by"), F.col("owner").eqNullSafe(F.col("by")), "full")
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    written = over(settings(F.col("held"), defaults), F.coalesce("new", F.create_map().cast("map<string,string>")))
    return both.select(F.coalesce("owner", "by").alias("owner"), F.when(F.col("new").isNull(), F.col("held")).otherwise(written).alias("settings"))


def reset_settings(stored: DataFrame, owners: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """``stored`` (owner, settings) with the defaults alone for each of ``owners``."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    again = owners.select(F.col("owner").alias("again")).distinct().withColumn("reset", F.lit(True))
    df = stored.join(again, F.col("owner").eqNullSafe(F.col("again")), "left")
    return df.select("owner", F.when(F.col("reset"), base).otherwise(F.col("settings")).alias("settings"))


def has_setting(held: Column, name: str) -> Column:
    return F.coalesce(F.trim(held[name]) != "", F.lit(False))


#: Tags that hold others, and the least length of a new block's text by where it was found.
GENERIC_TAGS = "div span section article main".split()


def worth_adding(tag: Column, text: Column, later: bool = False) -> Column:
    """Whether a block that a page gained is long enough: any text, over 50 characters for tags that hold others, and over
    ten once the page is translated."""
    n = F.length(trimmed(text))
    return (n > F.when(tag.isin(GENERIC_TAGS), 50).otherwise(0)) & (n > (10 if later else 0))
