"""The llm operators as queries over the test tables."""

from __future__ import annotations

from granary.llm import oracles
from granary.llm.common import shared, small_batches, table
from granary.plans.registry import Registry
from pyspark.sql import DataFrame, SparkSession

REGISTRY = Registry()


@REGISTRY.query("op1_chat_formatting", oracles.CHAT)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(id AS BIGINT) AS turn, IF(id = 0, 'user', 'assistant') AS role, '" + said + "' AS text FROM range(2)"
    )
    return chat.digests(turns.unionByName(more))


@REGISTRY.query("op8_quality_rules", oracles.QUALITY_RULES)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import quality_rules

    return quality_rules.digest(table(spark, sf_dir, "documents"))


@REGISTRY.query("op3_secret_scans")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import secrets

    return secrets.digest(table(spark, sf_dir, "documents"))


@REGISTRY.query("op10_license_scans")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import licenses

    return licenses.digest(table(spark, sf_dir, "documents"))


@REGISTRY.query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import pieces

    small_batches(spark)
    return pieces.digest(table(spark, sf_dir, "documents"))


@REGISTRY.query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import sharding

    return sharding.digest(table(shared(spark), sf_dir, "documents"))


@REGISTRY.query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import decontaminate

    small_batches(spark)
    return decontaminate.leaks(table(shared(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@REGISTRY.query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import quality_mil

    small_batches(spark)
    return quality_mil.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@REGISTRY.query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import jaccard_join

    small_batches(spark)
    return jaccard_join.join_components(table(shared(spark), sf_dir, "documents"))


@REGISTRY.query("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import lm_scoring

    small_batches(spark)
    return lm_scoring.score(table(shared(spark), sf_dir, "documents"))
