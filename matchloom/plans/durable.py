"""Durable intermediate tables: lineage is cut by a written table, never by local storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def durable_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``, or a scratch folder in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="matchloom-")
    return _LOCAL_ROOTS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{durable_root(spark)}/matchloom/{label}-{uuid.uuid4().hex}"


def spool(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> DataFrame:
    """A per-key summary written out, so that joins see its true size and broadcast it only when it is small."""
    return spool(df, "summary")
