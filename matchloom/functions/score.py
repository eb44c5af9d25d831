"""Forecast-evaluation aggregates with map-side combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import prob

# Ten equal-width confidence bins, edges as i * 0.1 in binary floating point.
EDGES = [i * 0.1 for i in range(10)]


def bin_of(conf: Column) -> Column:
    """Bin index for [lo, hi) bins with the last one closed."""
    return (F.size(F.filter(F.array(*[F.lit(e) for e in EDGES]), lambda e: conf >= e)) - 1).cast("long")


def forecast_terms(p: Column, y: Column, floor: float = 1e-12) -> dict[str, Column]:
    """Row-level terms of the metric bundle for a normalised vector."""
    return {
        "_ll": prob.log_loss(p, y, floor),
        "_br": prob.brier(p, y),
        "_hit": (prob.favourite(p) == y).cast("double"),
        "_conf": F.array_max(p),
    }


def bundle(df: DataFrame, keys: Sequence[str], p: str, y: str, floor: float = 1e-12) -> DataFrame:
    """rows, accuracy, logloss, brier and ECE per key: partial sums per confidence bin, then per key."""
    terms = forecast_terms(F.col(p), F.col(y), floor)
    lines = df.select(*keys, prob.normalise(F.col(p), floor).alias(p), F.col(y).alias(y)).withColumns(terms)
    binned = lines.groupBy(*keys, bin_of(F.col("_conf")).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(c) for c in terms],
    )
    n = F.sum("_n")
    return binned.groupBy(*keys).agg(
        n.alias("rows"),
        (F.sum("_hit") / n).alias("accuracy"),
        (F.sum("_ll") / n).alias("logloss"),
        (F.sum("_br") / n).alias("brier"),
        (F.sum(F.abs(F.col("_hit") - F.col("_conf"))) / n).alias("ece"),
    )


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def binary_terms(p: Column, y: Column, eps: float = 1e-15) -> dict[str, Column]:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return {
        "accuracy": mean_or_zero(((p >= 0.5).cast("int") == y.cast("int")).cast("double")),
        "brier": mean_or_zero((p - y) * (p - y)),
        "logloss": mean_or_zero(-(y * F.ln(q) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - q))),
    }


def error_terms(pred: Column, actual: Column) -> dict[str, Column]:
    d = pred - actual
    return {
        "mae": mean_or_zero(F.abs(d)),
        "rmse": F.sqrt(mean_or_zero(d * d)),
        "exact": mean_or_zero((F.round(pred) == F.round(actual)).cast("double")),
    }
