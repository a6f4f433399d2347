"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op2_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.language import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.token_files import token_file_digest
    from tarnlake.llm.tokens import public_path

    return token_file_digest(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.packing import pack
    from tarnlake.llm.tokens import public_path

    return pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k == "pipeline" or k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    from tarnlake.llm import decontam, sharding, topk

    return {"op5_stratified_shards": sharding.SQL, "op7_exact_top_k": topk.SQL, "op10_decontamination": decontam.SQL}
