"""Layered tables, append ledgers, incremental merges and resumable results."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.plans.durable import measured
from matchloom.plans.ordered import latest_per_key
from matchloom.sources.readers import path_exists


class TableStore:
    """Parquet tables under root/layer/dataset."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str, dataset: str) -> str:
        return f"{self.root}/{layer}/{dataset}"

    def exists(self, layer: str, dataset: str) -> bool:
        return path_exists(self.spark, self.path(layer, dataset))

    def write(self, df: DataFrame, layer: str, dataset: str, mode: str = "overwrite", partition: Sequence[str] = ()) -> None:
        """Overwriting a partitioned table replaces only the partitions that arrive; merged tables change by ``merge_into``."""
        if self.versioned(layer, dataset):
            raise ValueError(f"{layer}/{dataset} is kept in versions: use merge_into")
        writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*partition) if partition else writer).parquet(self.path(layer, dataset))

    def read(self, layer: str, dataset: str) -> DataFrame:
        if not self.versioned(layer, dataset):
            return self.spark.read.parquet(self.path(layer, dataset))
        places = self.manifest(layer, dataset)
        commits = [r[0] for r in places.select("_commit").distinct().collect()]  # commits that still hold a partition
        if not commits:
            return self.spark.read.parquet(f"{self.path(layer, dataset)}/data").limit(0)
        files = [self.spark.read.parquet(f"{self.path(layer, dataset)}/data/{c}").withColumn("_commit", F.lit(c)) for c in commits]
        rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), files)
        partition = next(c for c in places.columns if not c.startswith("_"))
        live = measured(places.select(F.col(partition).alias("_place"), F.col("_commit").alias("_held"), F.lit(True).alias("_live")))
        return rows.join(live, (F.col("_commit") == F.col("_held")) & F.col(partition).eqNullSafe(F.col("_place")), "left_semi").drop("_commit")

    def versioned(self, layer: str, dataset: str) -> bool:
        return path_exists(self.spark, f"{self.path(layer, dataset)}/manifest/_version=*/*.parquet")

    def manifest(self, layer: str, dataset: str) -> DataFrame:
        """(partition value, _commit, _version) of the latest version: which commit holds each partition."""
        every = self.spark.read.parquet(f"{self.path(layer, dataset)}/manifest")
        return every.filter(F.col("_version") == every.agg(F.max("_version")).first()[0])

    def commit(self, rows: DataFrame, layer: str, dataset: str, partition: str, kept: DataFrame | None, version: int) -> None:
        """Write ``rows`` beside the table, then switch: the next version's manifest is one file, and a reader sees it or the last one.

        ``kept`` is what stays of the last manifest. A writer that stops between the two steps leaves the table as it was;
        two writers of one version cannot both succeed.
        """
        name = uuid.uuid4().hex
        rows.sortWithinPartitions(partition).write.parquet(f"{self.path(layer, dataset)}/data/{name}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path(layer, dataset)}/data/{name}")
        held = written.select(partition).distinct().withColumn("_commit", F.lit(name))
        places = held if kept is None else kept.select(partition, "_commit").unionByName(held)
        self.switch(places, layer, dataset, version)

    def switch(self, places: DataFrame, layer: str, dataset: str, version: int) -> None:
        places.coalesce(1).write.mode("error").parquet(f"{self.path(layer, dataset)}/manifest/_version={version}")

    def row_count(self, layer: str, dataset: str) -> int:
        return self.read(layer, dataset).count()

    def datasets(self, layer: str) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{layer}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def bytes_on_disk(self, layer: str, dataset: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(layer, dataset))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Appended rows with the last one per key."""
    return latest_per_key(spark.read.parquet(path), list(keys), list(order))


def delta_cutoff(df: DataFrame, column: str, season_start: Column, overlap_days: int = 7) -> Column:
    """Reread from max(season start, latest row minus the overlap), as a one-row literal."""
    latest = df.agg(F.max(column).alias("m")).first()["m"]
    if latest is None:
        return season_start
    return F.greatest(season_start, F.lit(latest) - F.expr(f"INTERVAL {overlap_days} DAYS"))


def merge_latest(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union in which delta rows replace base rows of the same key."""
    tagged = base.withColumn("_rank", F.lit(0)).unionByName(delta.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(tagged, list(keys), ["_rank", *order]).drop("_rank")


def merge_into(store: TableStore, layer: str, dataset: str, delta: DataFrame, keys: Sequence[str], order: Sequence[str], partition: str) -> None:
    """Merge a delta into a table kept in versions, rewriting only the partitions that hold the delta's keys before or after.

    A key whose partition value changes leaves its old partition. Null partition values and keys are values like others, and
    values are never part of a folder's name. Readers see the table before or after the merge (``TableStore.commit``).
    A table written without versions is taken over whole. The manifest holds one row per partition.
    """
    if not store.exists(layer, dataset):
        store.commit(latest_per_key(delta, list(keys), list(order)), layer, dataset, partition, None, 1)
        return
    present = store.read(layer, dataset)
    if not store.versioned(layer, dataset):
        store.commit(merge_latest(present, delta, keys, order), layer, dataset, partition, None, 1)
        return
    last = store.manifest(layer, dataset)
    arriving = delta.select(*(F.col(k).alias(f"_of_{k}") for k in keys)).distinct()
    known = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    before = present.join(arriving, known, "left_semi").select(partition)
    touched = measured(before.unionByName(delta.select(partition)).distinct().select(F.col(partition).alias("_touched")))
    inside = F.col(partition).eqNullSafe(F.col("_touched"))
    merged = merge_latest(present.join(touched, inside, "left_semi"), delta, keys, order)
    store.commit(merged, layer, dataset, partition, last.join(touched, inside, "left_anti"), last.first()["_version"] + 1 if not last.isEmpty() else 1)


def expected_chunks(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """Date-range chunks that should exist between two dates."""
    begins = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"INTERVAL {days} DAYS"))).alias("chunk_start"))
    return begins.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.lit(end).cast("date")))


def chunk_completeness(expected: DataFrame, landed: DataFrame, schema_version: int) -> DataFrame:
    """DONE (an empty chunk is valid), RELOAD (zero bytes or an old schema), MISSING.

    ``landed`` has (chunk_start, rows, bytes, schema_version).
    """
    both = expected.join(landed, "chunk_start", "left")
    state = F.when(F.col("bytes").isNull(), "MISSING").when(
        (F.col("bytes") == 0) | (F.coalesce(F.col("schema_version"), F.lit(-1)) != schema_version), "RELOAD"
    ).otherwise("DONE")
    return both.withColumn("state", state)


def remaining(wanted: DataFrame, done: DataFrame, keys: Sequence[str], version: str | None = None, version_column: str = "version") -> DataFrame:
    """Work that has no finished row (of the wanted version)."""
    have = done if version is None else done.filter(F.col(version_column) == version)
    return wanted.join(have.select(*keys).distinct(), list(keys), "left_anti")


def content_hash(df: DataFrame, volatile: Sequence[str] = (), name: str = "content_hash") -> DataFrame:
    """Stable hash of a row's content in column-name order, without volatile columns."""
    cols = sorted(c for c in df.columns if c not in volatile)
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*cols)), 256))


def changed_rows(current: DataFrame, previous: DataFrame, key: str, volatile: Sequence[str] = ()) -> DataFrame:
    """Rows whose content differs from the stored version, or is new."""
    now = content_hash(current, [*volatile, key])
    old = content_hash(previous, [*volatile, key]).select(key, F.col("content_hash").alias("_old"))
    return now.join(old, key, "left").filter(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")


def save_report(df: DataFrame, path: str, formats: Sequence[str] = ("parquet",)) -> None:
    """Write a report; nested columns become JSON text in CSV."""
    for fmt in formats:
        out = df
        if fmt == "csv":
            nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
            out = df.withColumns({n: F.to_json(n) for n in nested}) if nested else df
        writer = out.write.mode("overwrite")
        getattr(writer.option("header", "true") if fmt == "csv" else writer, fmt)(f"{path}.{fmt}")


def bounded_history(old: DataFrame, new: DataFrame, order: Sequence[str], keep: int = 500) -> DataFrame:
    """Appended history cut to its most recent rows."""
    return old.unionByName(new).orderBy(*[F.col(c).desc() for c in order]).limit(keep)
