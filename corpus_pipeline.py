"""Corpus pipeline: language ID, near-dedup, decontamination, source mix and token files, one stage after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontaminate, language, mixing, near_copies, token_planes
from matchloom.llm.common import read_table, spool_small
from matchloom.plans.durable import fresh_path, spool

#: Words in a shingle and least similarity (Jaccard) of near copies.
SHINGLE, SIMILARITY = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject; the models learn from the labels of ``docs``."""
    return language.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; null ids come last."""
    return near_copies.one_of_each(docs, width=SHINGLE, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; rows that repeat an id or have none are dealt their own copies."""
    # Rows are told apart by a number that is written once, so that the join gives each row its copies and no other's;
    # the caller's columns are numbered meanwhile, so that none can clash with it.
    names = docs.columns
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))
    numbered = spool_small(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    sized = numbered.select("_row", *(F.col(f"c{names.index(c)}").alias(c) for c in ("doc_id", "text", "source")))
    copies = mixing.row_copies(sized, "_row").filter("copies > 0").select(F.col("row").alias("_row"), F.sequence(F.lit(1), F.col("copies").cast("int")).alias("_copies"))
    # One way at every size: texts are dealt by row to their copies and sorted, which can spill.
    joined = numbered.join(spool(copies, "copies").hint("merge"), "_row").withColumn("_copy", F.explode("_copies"))
    return joined.select(*(F.col(f"c{k}").alias(name) for k, name in enumerate(names)))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = fresh_path(spark, "tokens")
    token_planes.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_planes.read_tokens(spark, path, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: Models, shingles and tokens have no SQL; tests/llm compares near_dedup and source_mix with plain loops, the other stages through their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
