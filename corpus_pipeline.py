"""The corpus pipeline: five stages from raw documents to sampled pieces.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame that
is written as Parquet and read again for the next. All stages but the last return the columns of documents.
Contaminated documents go as a whole; documents of junk, and all but one of a group of near copies, go too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brookloom.llm.common import read_table, stored
from brookloom.llm.decontaminate import without_leaks
from brookloom.llm.near_dup import without_near_duplicates
from brookloom.llm.pieces import sampled_pieces
from brookloom.llm.pii import checked, session_key, with_surrogates
from brookloom.llm.quality import kept_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from labels."""
    return kept_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced under the session's key, once no collision is found."""
    key = session_key(spark)
    checked(docs, key)
    return with_surrogates(docs, key)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document, and whether they decode to its text."""
    return sampled_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii_surrogates", pii_surrogates),
    ("sentencepiece", sentencepiece),
]

#: Learned rules, sketches, alignments and draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
