"""Text blocks of plain documents, and their packing into chunks under a token budget.

A document's lines, blocks and chunks stay in its own row as arrays until they are exploded, so nothing is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookloom.functions.text import collapse_spaced, is_valid_text, token_estimate, trimmed

#: Fixed values of the packing.
BLOCK_OVERHEAD, FIRST_TARGET, TARGET, WARM_CHUNKS, HARD_LIMIT, LOOK_AHEAD = 20, 400, 800, 2, 500_000, 5
HEADING_WORDS = 8


def block_texts(text: Column) -> Column:
    """Valid trimmed lines, the first of equal ones."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), trimmed), lambda t: is_valid_text(t)))


def is_heading_line(text: Column) -> Column:
    """A short line without a sentence's end stands for a heading in plain text."""
    return (F.size(F.split(text, r"\s+")) <= HEADING_WORDS) & ~text.rlike(r"[.!?。！？:;,]\W*$")


def document_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, position, id, tag, text and token estimate of each block, numbered within its document.

    A null text has no blocks; rows with an equal id are numbered each from 1.
    """
    return docs.select("doc_id", F.posexplode(block_texts(F.col("text")))).select(
        "doc_id",
        (F.col("pos") + 1).cast("long").alias("position"),
        F.concat(F.lit("b"), F.col("pos") + 1).alias("id"),
        F.when(is_heading_line(F.col("col")), "h2").otherwise("p").alias("tag"),
        collapse_spaced(F.col("col")).alias("text"),
        token_estimate(collapse_spaced(F.col("col"))).alias("tokens"),
    )


def pack(tokens: list[int], headings: list[bool]) -> list[int]:
    """The chunk, from 1, of each block: greedy, and when a chunk is full, up to the next heading if it is near."""
    out: list[int] = []
    chunk, size, i = 1, 0, 0
    while i < len(tokens):
        cost, target = tokens[i] + BLOCK_OVERHEAD, FIRST_TARGET if chunk <= WARM_CHUNKS else TARGET
        filled = bool(out) and out[-1] == chunk
        if size + cost > HARD_LIMIT and filled:
            chunk, size = chunk + 1, 0
        elif size + cost > target and filled:
            near = None if headings[i] else next((k for k in range(i + 1, min(i + LOOK_AHEAD, len(tokens))) if headings[k]), None)
            if near is not None:
                out += [chunk] * (near - i + 1)
                chunk, size, i = chunk + 1, 0, near + 1
                continue
            chunk, size = chunk + 1, 0
        out.append(chunk)
        size += cost
        i += 1
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _starts(tokens: pd.Series, headings: pd.Series) -> pd.Series:
    """Of each row, where its chunks begin, counted from 1."""

    def one(t: list[int], h: list[bool]) -> list[int]:
        chunk = pack([int(x) for x in t], [bool(x) for x in h])
        return [i + 1 for i, c in enumerate(chunk) if not i or c != chunk[i - 1]]

    return pd.Series([one(t, h) for t, h in zip(tokens, headings, strict=True)])


def json_content(blocks: Column) -> Column:
    """Compact JSON of an array of structs with id and text."""
    return F.to_json(F.transform(blocks, lambda b: F.struct(b["id"].alias("id"), b["text"].alias("text"))))


def packed_chunks(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, chunk, chunk_id, block_ids, json_content and estimated_tokens of every chunk of each row's ``blocks`` (id,
    text, heading). A row's blocks are cut into slices before these are exploded, so each block is copied once."""
    held = df.where("size(blocks) > 0").withColumn("tokens", F.transform("blocks", lambda b: token_estimate(b["text"])))
    held = held.withColumn("starts", _starts("tokens", "blocks.heading"))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("blocks") + 1))
    ranges = F.arrays_zip(F.col("starts").alias("lo"), ends.alias("hi"))
    cut = F.transform(ranges, lambda r: F.struct(F.slice("blocks", r["lo"], r["hi"] - r["lo"]).alias("own"), F.slice("tokens", r["lo"], r["hi"] - r["lo"]).alias("tokens")))
    return held.select(*keys, F.posexplode(cut).alias("at", "c")).select(
        *keys,
        (F.col("at") + 1).alias("chunk"),
        F.concat(F.lit("chunk"), F.col("at") + 1).alias("chunk_id"),
        F.col("c.own.id").alias("block_ids"),
        json_content(F.col("c.own")).alias("json_content"),
        F.aggregate("c.tokens", F.lit(0).cast("long"), lambda n, t: n + t + BLOCK_OVERHEAD).alias("estimated_tokens"),
    )


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk, chunk_id, block_ids, json_content and estimated_tokens of every chunk of every document.

    A null text, or one without a valid line, has no chunk; rows with an equal or null id are packed each by itself.
    """
    blocks = F.transform(block_texts(F.col("text")), lambda t, i: F.struct(F.concat(F.lit("b"), i + 1).alias("id"), collapse_spaced(t).alias("text"), is_heading_line(t).alias("heading")))
    return packed_chunks(docs.select("doc_id", blocks.alias("blocks")), ["doc_id"])


def full_text(docs: DataFrame) -> DataFrame:
    """doc_id and its blocks joined by blank lines; documents without a block have no row."""
    return docs.select("doc_id", F.array_join(F.transform(block_texts(F.col("text")), collapse_spaced), "\n\n").alias("full_text"), F.size(block_texts(F.col("text"))).alias("n_blocks")).where("n_blocks > 0")
