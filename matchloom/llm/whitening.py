"""Embedding whitening: covariance of distinct quantised vectors by weighted centred products, each vector whitened once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spool_small, trim_worker

#: Entries of vectors that a task holds as a matrix at once.
BLOCK = 1 << 20
#: First level of the sum of the tasks' products: so many partial sums for each row of the matrix.
PARTS = 64


def _pack(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            # A batch of long vectors goes through in slices.
            step = max(1, BLOCK * len(ids) // max(1, len(vectors.flatten())))
            for low in range(0, len(ids), step):
                lists, keys = vectors.slice(low, step), ids.slice(low, step)
                flat = lists.flatten().cast(pa.float64())
                values = flat.to_numpy(zero_copy_only=False)
                with np.errstate(invalid="ignore", over="ignore"):
                    x = np.floor(scale * values)
                    bad = ~(np.abs(x) < 2.0**63)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                offsets -= offsets[0]
                spoilt = np.append(0, np.cumsum(bad))
                good = (spoilt[offsets[1:]] == spoilt[offsets[:-1]]) & (offsets[1:] > offsets[:-1])
                whole = np.where(bad, 0.0, x).astype("<i8")
                packed = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets * 8), pa.py_buffer(whole.tobytes())])
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([keys.filter(keep), packed.filter(keep).cast(pa.binary())], names=["vec_id", "x"])
            trim_worker()

    return run


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, x): each entry c of a vector as the whole number floor(scale * c), eight bytes each, lowest first.

    Rows whose vector is null, empty or holds null or non-finite entries go; an entry whose number leaves the range of a
    long counts as non-finite. No number is a negative zero.
    """
    chosen = rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).filter("vector is not null")
    schema = T.StructType([T.StructField("vec_id", chosen.schema["vec_id"].dataType), T.StructField("x", T.BinaryType())])
    return chosen.mapInArrow(_pack(scale), schema)


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        step = max(1, BLOCK // dims)
        for low in range(0, len(batch), step):
            part = batch.slice(low, step)
            yield part, np.frombuffer(b"".join(part.column(0).to_pylist()), "<i8").reshape(len(part), dims)
        trim_worker()


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for part, x in _matrices(batches, dims):
            w = part.column(1).to_numpy().astype(np.int64)
            n, total = n + int(w.sum()), total + w @ x
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            columns = [np.arange(dims, dtype=np.int32), np.full(dims, n), total, low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "n", "total", "low", "high"])

    return run


def _products(dims: int, mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = None
        for part, x in _matrices(batches, dims):
            centred = x - mean
            found = (centred * part.column(1).to_numpy()[:, None]).T @ centred
            gram = found if gram is None else gram + found
        if gram is not None:
            place = TaskContext.get().partitionId() % PARTS
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, place, np.int32)), pa.array([row.tobytes() for row in gram], pa.binary())], names=["dim", "place", "row"]
            )

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(row, "<f8") for row in table.column("row").to_pylist()], axis=0)
    return pa.table({"dim": table.column("dim")[:1], "place": table.column("place")[:1], "row": pa.array([total.tobytes()], pa.binary())})


def _whiten(dims: int, n: int, total: list[int], vectors: np.ndarray, roots: np.ndarray, fits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(total, dtype=np.int64 if fits else object)
        for part, x in _matrices(batches, dims):
            apart = n * (x if fits else x.astype(object)) - sums
            deviation = (apart * apart).sum(axis=1)
            if not fits:
                deviation = [int(v) if int(v) < 2**63 else None for v in deviation]
            z = (apart.astype(np.float64) / n) @ vectors / roots
            z = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(deviation, pa.int64()), z], names=["x", "weight", "deviation", "z"])

    return run


def components(gram: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, shares of the trace) of the covariance, by falling eigenvalue.

    The largest entry of each vector is positive. An eigenvalue that is zero to double precision is zero.
    """
    values, vectors = np.linalg.eigh((gram + gram.T) / (2 * n))
    trace = float(values.sum())
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    values = np.where(values > len(gram) * np.finfo(float).eps * max(trace, 0.0), values, 0.0)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values, vectors, values / trace if trace > 0 else np.zeros_like(values)


def whitened(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 4, weights: str = "one", scale: float = 256.0
) -> DataFrame:
    """Rows by component up to ``most``: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Equal quantised vectors x are grouped; each distinct one is fitted with weight one (``weights="one"``) or its number of
    rows (``"count"``). ``n`` is the sum of weights, S the weighted sum of x. Products of centred vectors are gathered as a
    matrix in each task and added in two levels; only sums by dimension and the finished dims x dims matrix reach the
    driver, for the eigenvectors. Each distinct vector is whitened once and joined back by the SHA-256 of x; Spark splits
    a hot vector in that join.

    Rows that ``quantised`` drops give nothing, and so do vectors of another length than the most frequent one (of equally
    frequent ones the longest). Rows that repeat an id or have none are kept as they are. A component without variance
    (one distinct vector, or fewer than ``most`` directions) has a null ``whitened``, ``explained`` zero and no part in
    ``identity_error``, which is null if no component has variance. A ``deviation`` beyond the range of a long is null.
    No rows give no rows.
    """
    spark = rows.sparkSession
    packed = quantised(rows, id_col, vector_col, scale)
    distinct = spool_small(packed.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    lengths = distinct.groupBy(F.length("x").alias("bytes")).agg(F.sum("copies").alias("rows"))
    widest = lengths.agg(F.max_by("bytes", F.struct("rows", "bytes")).alias("bytes")).first()
    columns = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if widest is None or widest["bytes"] is None:
        return spark.createDataFrame([], T.StructType([packed.schema["vec_id"], *T.StructType.fromDDL(columns).fields]))
    dims = widest["bytes"] // 8
    if weights not in ("one", "count"):
        raise ValueError(f"weights are one or count, not {weights}")
    fit = distinct.filter(F.length("x") == 8 * dims).select("x", (F.lit(1) if weights == "one" else F.col("copies")).cast("long").alias("weight"))

    by_dim = fit.mapInArrow(_sums(dims), "dim int, n long, total long, low long, high long").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")
    ).orderBy("dim").collect()
    n, total = by_dim[0]["n"], [r["total"] for r in by_dim]
    reach = max(max(n * r["high"] - r["total"], r["total"] - n * r["low"], n * max(r["high"], -r["low"]), abs(r["total"])) for r in by_dim)
    shape = "dim int, place int, row binary"
    partial = fit.mapInArrow(_products(dims, np.array([t / n for t in total])), shape)
    summed = partial.groupBy("dim", "place").applyInArrow(_added, shape).groupBy("dim").applyInArrow(_added, shape)
    gram = np.stack([np.frombuffer(r["row"], "<f8") for r in summed.orderBy("dim").collect()])
    values, vectors, explained = components(gram, n, most)

    roots = np.where(values > 0, np.sqrt(values), np.nan)
    flat = fit.mapInArrow(_whiten(dims, n, total, vectors, roots, dims * reach * reach < 2**63), "x binary, weight long, deviation long, z array<double>")
    done = spool_small(flat.select(F.unhex(F.sha2("x", 256)).alias("digest"), "weight", "deviation", "z"), "whitened")
    live = [k for k in range(len(values)) if values[k] > 0]
    error = None
    if live:
        z, w = [F.col("z")[k] for k in range(len(values))], F.col("weight")
        found = done.agg(*(F.sum(w * z[i]).alias(f"m{i}") for i in live), *(F.sum(w * z[i] * z[j]).alias(f"p{i}_{j}") for i in live for j in live if j >= i)).first()
        error = max(abs(found[f"p{i}_{j}"] / n - found[f"m{i}"] * found[f"m{j}"] / n / n - (i == j)) for i in live for j in live if j >= i)
    keyed = packed.select("vec_id", F.unhex(F.sha2("x", 256)).alias("digest"))
    shares = F.array(*(F.lit(float(v)) for v in explained))
    return keyed.join(done, "digest").select("vec_id", "deviation", F.posexplode("z").alias("at", "value")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"), shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
