"""The registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiccases.llm import (chat, decontaminate, fingerprints, hard_negatives, html_extract, jaccard_join, language_id,
                            licenses, metric_search, packing, spelling, suffix_dedup, url_filter)
from civiccases.llm.common import table
from civiccases.llm.sql import SQL
from civiccases.session import ensure_checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_table(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_table(table(spark, sf_dir, "documents"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_table(table(spark, sf_dir, "documents"), with_text=True)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked_messages(table(spark, sf_dir, "conversations"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text_table(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_documents(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_table(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_table(table(spark, sf_dir, "documents"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_search.top_k(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", shifted))


OPERATORS = [op1_best_fit_packing, op2_license_scan, op3_decontamination, op4_fingerprints, op5_repeated_passages,
             op6_chat_format, op7_main_text, op8_jaccard_join, op9_language, op10_url_filter, op11_spelling_variants,
             op12_exact_top_k, op13_hard_negatives]


def _in_shared_session(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {f.__name__: _in_shared_session(f) for f in OPERATORS}
