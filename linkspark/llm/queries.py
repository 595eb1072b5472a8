"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import ball_tree, mixing, quality_rules
from linkspark.llm.ball_tree import top_inner_products
from linkspark.llm.common import table
from linkspark.llm.language_id import identify_languages
from linkspark.llm.packing import pack
from linkspark.llm.quality_gam import score_quality
from linkspark.llm.simhash import simhash_components
from linkspark.llm.surrogates import session_key, surrogated
from linkspark.llm.token_counts import token_counts
from linkspark.llm.toxicity import score_toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogated(table(spark, sf_dir, "documents"), session_key(spark))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("d2")


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("opened")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_surrogates, op3_toxicity, op4_quality_rules, op5_quality_gam, op6_mixing, op7_simhash, op8_packing, op9_ball_tree, op10_language_id)}
SQL: dict[str, str] = {"op4_quality_rules": quality_rules.oracle(), "op6_mixing": mixing.oracle(), "op9_ball_tree": ball_tree.SQL}
