"""Registered queries of the training-data operators: opN_<name> over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import containment, conversations, html_text, langid, mih, minmax, mixing, ppm, rlz, slots, suffixes, treap, warc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(read(spark, sf_dir, "documents"))


def op2_prediction_by_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.report(read(spark, sf_dir, "documents"))


def op3_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.report(read(spark, sf_dir, "documents"))


def op4_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_multi_index_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.report(read(spark, sf_dir, "embeddings"))


def op6_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(read(spark, sf_dir, "documents"), width=4).drop("key")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op8_url_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(read(spark, sf_dir, "pages"))


def op11_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.report(read(spark, sf_dir, "documents"))


def op12_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(read(spark, sf_dir, "conversations"))


def op13_k2_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_induced_sorting": op1_induced_sorting,
    "op2_prediction_by_partial_matching": op2_prediction_by_partial_matching,
    "op3_relative_lz": op3_relative_lz,
    "op4_containment": op4_containment,
    "op5_multi_index_hash": op5_multi_index_hash,
    "op6_min_max_hash": op6_min_max_hash,
    "op7_mixing": op7_mixing,
    "op8_url_difference": op8_url_difference,
    "op9_language_id": op9_language_id,
    "op10_warc_index": op10_warc_index,
    "op11_virtual_slots": op11_virtual_slots,
    "op12_checkpointed_repair": op12_checkpointed_repair,
    "op13_k2_treap": op13_k2_treap,
}

SQL: dict[str, str] = {
    "op4_containment": containment.SQL,
    "op7_mixing": mixing.SQL,
    "op12_checkpointed_repair": conversations.SQL,
    "op13_k2_treap": treap.SQL,
}
