"""Exact dedup: skew-safe combining of equal texts, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, whole_text


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Column | None = None) -> DataFrame:
    """One row per distinct text: ``text``, ``keep_id`` (largest id) and ``group_size``.

    Every stage groups by the digest and the whole text, so equal digests of different texts never meet:
    the map side combines what a task holds, the salted groups combine what a digest's salt holds, and the winners
    of the salts are combined last. A text that a third of all rows share therefore reaches the last stage as at
    most ``salts`` rows. ``digest`` only spreads the work; any expression of ``text`` gives the same result.
    """
    rows = plain(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.withColumns({
        "digest": F.xxhash64("text") if digest is None else digest,
        "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)),
    })
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size")).drop("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. A null text is the empty text. Null ids never win against an
    id; a class of null ids only has a null ``keep_id`` and its rows are kept. Rows that repeat both id and text are
    one document: they count in ``group_size`` and share one verdict. No rows give no rows. The classes are handed
    back to the rows by SHA-256 of the text; Spark splits a hot class in that join.
    """
    classes = text_classes(docs, id_col, text_col, salts).select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    rows = plain(docs, id_col, text_col).select(
        F.col(f"`{id_col}`").alias("doc_id"), F.sha2(whole_text(text_col).cast("binary"), 256).alias("text_sha256")
    )
    return rows.join(classes, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows, one per distinct text, as ``doc_id`` and ``text``."""
    return text_classes(docs, id_col, text_col).select(F.col("keep_id").alias("doc_id"), "text")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
