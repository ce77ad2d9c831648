"""Queries of the training-data operators over whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookloom.llm.common import read_table
from brookloom.llm.decontaminate import contamination
from brookloom.llm.divergence import ORACLE_SQL as DIVERGENCE_SQL
from brookloom.llm.divergence import source_divergence
from brookloom.llm.language import language
from brookloom.llm.lm_score import ORACLE_SQL as LM_SQL
from brookloom.llm.lm_score import lm_scores
from brookloom.llm.near_dup import ORACLE_SQL as NEAR_SQL
from brookloom.llm.near_dup import near_duplicates
from brookloom.llm.negatives import ORACLE_SQL as NEGATIVES_SQL
from brookloom.llm.negatives import mined_negatives
from brookloom.llm.pieces import sampled_pieces
from brookloom.llm.pii import checked, pii_surrogates, session_key
from brookloom.llm.quality import quality
from brookloom.llm.secrets import secret_digest
from brookloom.llm.token_files import token_files
from brookloom.llm.topk import ORACLE_SQL as TOP_SQL
from brookloom.llm.topk import vector_top_k
from brookloom.llm.toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(read_table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), threshold=0.85)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces(read_table(spark, sf_dir, "documents"), ids=False)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = read_table(spark, sf_dir, "documents"), session_key(spark)
    checked(docs, key)
    return pii_surrogates(docs, key)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_top_k(read_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined_negatives(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_lm_score": LM_SQL,
        "op5_near_duplicates": NEAR_SQL,
        "op11_source_divergence": DIVERGENCE_SQL,
        "op12_top_k": TOP_SQL,
        "op13_hard_negatives": NEGATIVES_SQL,
    }


QUERIES = (
    op1_toxicity,
    op2_lm_score,
    op3_language_id,
    op4_quality_rules,
    op5_near_duplicates,
    op6_secret_scans,
    op7_token_files,
    op8_decontamination,
    op9_sentencepiece,
    op10_pii_surrogates,
    op11_source_divergence,
    op12_top_k,
    op13_hard_negatives,
)
