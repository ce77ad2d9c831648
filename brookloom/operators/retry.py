"""Results of an external text service: parsing, audit, what is missing, and what goes out again.

Blocks are rows of (doc_id, chunk_id, id, position, text); responses are rows of (doc_id, chunk_id, id, text).
Every operator is one equi-join on the block's key, which both sides are shuffled by once.

Defined results: null keys match nothing, so such blocks are missing and such responses extra; of repeated responses the
last by ``seq`` counts; repeated blocks count each; a null raw result gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookloom.functions.text import token_estimate

KEY = ["doc_id", "chunk_id", "id"]
_FIELDS = ("translated_text", "text", "translation")


def missing_blocks(blocks: DataFrame, responses: DataFrame) -> DataFrame:
    """Blocks without a response."""
    return blocks.join(responses.select(*KEY).distinct(), KEY, "left_anti")


def should_retry(missing: Column, is_retry: Column) -> Column:
    return ~is_retry & (missing > 0)


def retry_chunks(blocks: DataFrame, responses: DataFrame) -> DataFrame:
    """The missing blocks of each chunk as one chunk ``<id>_retry``, order kept, tokens without the block overhead."""
    rows = F.array_sort(F.collect_list(F.struct("position", "id", "text")))
    return (
        missing_blocks(blocks, responses)
        .groupBy("doc_id", "chunk_id")
        .agg(rows.alias("rows"), F.sum(token_estimate(F.col("text"))).alias("estimated_tokens"))
        .select("doc_id", F.concat("chunk_id", F.lit("_retry")).alias("chunk_id"), F.col("rows.id").alias("block_ids"), F.to_json(F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["text"].alias("text")))).alias("json_content"), "estimated_tokens")
    )


def response_audit(blocks: DataFrame, responses: DataFrame) -> DataFrame:
    """Per chunk: blocks, responses, unchanged ones, responses to no block, and missing = extra + blocks - distinct ids."""
    per_block = blocks.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n_blocks"))
    joined = responses.join(blocks.select(*KEY, F.col("text").alias("original")), KEY, "left")
    per_response = joined.groupBy("doc_id", "chunk_id").agg(
        F.count("*").alias("n_responses"),
        F.count_distinct("id").alias("n_ids"),
        F.count_if(F.col("original").isNull()).alias("n_extra"),
        F.count_if(F.col("original") == F.col("text")).alias("n_unchanged"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return per_block.join(per_response, ["doc_id", "chunk_id"], "full").select(
        "doc_id", "chunk_id",
        zero("n_blocks").alias("n_blocks"), zero("n_responses").alias("n_responses"), zero("n_extra").alias("n_extra"), zero("n_unchanged").alias("n_unchanged"),
        (zero("n_extra") + zero("n_blocks") - zero("n_ids")).alias("n_missing"),
    )


def applied(blocks: DataFrame, responses: DataFrame) -> DataFrame:
    """Blocks with their last response, where it differs from the text."""
    last = responses.groupBy(*KEY).agg(F.max_by("text", "seq").alias("translated"))
    return blocks.join(last, KEY).where("translated is not null and translated != text").select(*KEY, "text", "translated")


def recovered_by_text(blocks: DataFrame, translated: DataFrame) -> DataFrame:
    """Untranslated blocks whose text equals that of a translated one of the document: the first such translation."""
    done = blocks.join(translated.select(*KEY, "translated"), KEY).groupBy("doc_id", "text").agg(F.min_by("translated", "position").alias("translated"))
    return blocks.join(translated.select(*KEY), KEY, "left_anti").join(done, ["doc_id", "text"]).select(*KEY, "text", "translated")


def parsed_results(raw: DataFrame) -> DataFrame:
    """doc_id, id and text from JSON results: ``translations`` or a bare list; ids must be strings; the first of three
    fields that is a string counts, empty ones too; the last of equal ids wins; what isn't JSON gives no rows."""
    item = "struct<id:string,translated_text:string,text:string,translation:string>"
    whole = F.try_parse_json("raw")
    listed = F.coalesce(F.try_variant_get(whole, "$.translations", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"))
    is_text = lambda v, p: F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.try_variant_get(v, p, "string"))
    rows = raw.select("doc_id", F.posexplode(listed).alias("pos", "item"))
    fields = rows.select("doc_id", "pos", is_text(F.col("item"), "$.id").alias("id"), F.coalesce(*(is_text(F.col("item"), f"$.{f}") for f in _FIELDS)).alias("text"))
    return fields.where("id is not null and text is not null").groupBy("doc_id", "id").agg(F.max_by("text", "pos").alias("text"))


def sse_deltas(chunks: DataFrame) -> DataFrame:
    """stream_id, seq and delta of a server-sent event stream whose payload pieces may cut lines anywhere.

    Pieces of one stream are joined in order and split; a last line without its end is dropped, as is what follows
    ``[DONE]``, and what isn't JSON. A stream is one response of the service, so its size is bounded by that.
    """
    whole = chunks.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"]), "").alias("all"))
    parts = F.split("all", "\n")
    lines = whole.select("stream_id", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("line", "raw"))
    body = F.regexp_extract(F.rtrim(F.col("raw"), F.lit("\r")), r"^data:\s*(.*)$", 1)
    done = lines.withColumn("body", body).withColumn("end_at", F.min(F.when(F.col("body") == "[DONE]", F.col("line"))).over(_stream()))
    delta = F.get_json_object("body", "$.choices[0].delta.content")
    return done.where("body != '' and (end_at is null or line < end_at)").select("stream_id", F.col("line").cast("long").alias("seq"), delta.alias("delta")).where("delta is not null and delta != ''")


def _stream():
    from pyspark.sql import Window as W

    return W.partitionBy("stream_id")


def with_service(blocks: DataFrame, translate: Callable[[list[dict]], dict[str, str]], cached: DataFrame | None = None) -> DataFrame:
    """Each distinct text goes to ``translate`` once, unless ``cached`` (text, translated) has it; results join back.

    ``translate`` gets a list of {id, text} and returns texts by id; what it leaves out is null. Of several cached results of
    a text the greatest counts.
    """
    texts = blocks.select("text").where("text is not null").distinct()
    cached = cached if cached is not None else blocks.sparkSession.createDataFrame([], "text string, translated string")
    cached = cached.groupBy("text").agg(F.max("translated").alias("translated"))
    new = texts.join(cached.select("text"), "text", "left_anti")

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = [f"b{i + 1}" for i in range(len(f))]
            got = translate([{"id": i, "text": t} for i, t in zip(ids, f["text"], strict=True)]) if len(f) else {}
            yield pd.DataFrame({"text": f["text"], "translated": [got.get(i) for i in ids]})

    fresh = new.mapInPandas(call, T.StructType([T.StructField("text", T.StringType()), T.StructField("translated", T.StringType())]))
    return blocks.join(fresh.unionByName(cached.select("text", "translated")), "text", "left")
