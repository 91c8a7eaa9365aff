"""The queries of this subpackage, by the names under which the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.mixing import mixed_rows

    return mixed_rows(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.chat import format_conversations, read_back

    tricky = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.union(more)))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.vectors import vector_groups

    return vector_groups(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_packing": op4_packing,
        "op5_mixing": op5_mixing,
        "op6_language_id": op6_language_id,
        "op7_chat_format": op7_chat_format,
        "op8_vector_dedup": op8_vector_dedup,
        "op9_sharding": op9_sharding,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    from tidewater.llm import exact, licenses, mixing, oracles

    return {
        "op1_license_scan": licenses.ORACLE_SQL,
        "op2_exact_dedup": exact.ORACLE_SQL,
        "op3_jaccard_join": oracles.JACCARD,
        "op5_mixing": mixing.ORACLE_SQL,
        "op7_chat_format": oracles.CHAT,
        "op8_vector_dedup": oracles.VECTORS,
    }
