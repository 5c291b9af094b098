"""Registered queries of this subpackage: op<N>_<name>(spark, sf_dir) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from puckline.llm import (convtrie, decontaminate, langid, licenses, mixing, neardup, pii, quality, sharding, tokenalign, topk,
                          toxicity, warc)
from puckline.llm.common import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op11_tokenalign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.align(table(spark, sf_dir, "documents"))


def op12_convtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_sharding": op8_sharding,
    "op9_langid": op9_langid,
    "op10_neardup": op10_neardup,
    "op11_tokenalign": op11_tokenalign,
    "op12_convtrie": op12_convtrie,
    "op13_licenses": op13_licenses,
}

#: The other operators have no equivalent in SQL; tests/llm holds them against brute force.
ORACLE: dict[str, str] = {
    "op1_topk": topk.ORACLE_SQL,
    "op3_mixing": mixing.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op12_convtrie": convtrie.ORACLE_SQL,
    "op13_licenses": licenses.ORACLE_SQL,
}
