"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.plans.durable import fresh_path

#: A word is a run of anything but ASCII white space; bytes.split() cuts UTF-8 text the same way.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of the caller cannot clash with working names."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def trim_worker() -> None:
    """Give the memory of finished Arrow batches back; workers outlive tasks and would keep it through later stages."""
    pa.default_memory_pool().release_unused()


def slices(sizes: list[int], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``most`` bytes each."""
    low, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most or i == len(sizes) - 1:
            yield low, i + 1
            low, size = i + 1, 0


def spool_small(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once in the shared folder, pressed with zstandard, and read it back."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
