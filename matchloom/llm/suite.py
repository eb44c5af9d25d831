"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchloom.plans.durable import fresh_path

from . import bpe_rows, decontaminate, exact_dedup, filter_audit, language, licenses, line_dedup, mixing, simhash, substring, token_planes, url_filter, whitening
from .common import read_table


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, folder, "documents"))


def op2_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_planes.write_tokens(read_table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_planes.read_tokens(spark, path, with_ids=False)


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(read_table(spark, folder, "documents"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.substring_dedup(read_table(spark, folder, "documents"), with_text=False)


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_spans(read_table(spark, folder, "documents"))


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read_table(spark, folder, "documents"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest_rows(line_dedup.line_dedup(read_table(spark, folder, "documents")))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.url_filter(read_table(spark, folder, "pages"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_audit(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op12_bpe_rows(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_rows.encoded(read_table(spark, folder, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(read_table(spark, folder, "embeddings"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_planes": op2_token_planes,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_source_mix": op7_source_mix,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_decontamination": op10_decontamination,
    "op11_filter_audit": op11_filter_audit,
    "op12_bpe_rows": op12_bpe_rows,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op5_substring_dedup": substring.SQL,
    "op7_source_mix": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
}
