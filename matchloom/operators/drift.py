"""Drift, decayed expert loss and rolling conformal signals from earlier rows only."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from matchloom.functions import prob
from matchloom.plans.durable import measured
from matchloom.plans.ordered import Timeline

ORDER = ["datetime", "game_id"]
# Recent and reference depth, minimum history, and response scales of the drift scores.
RECENT, REFERENCE, MIN_HISTORY = 12, 96, 24


def _bounded(raw: Column, scale: float) -> Column:
    return prob.clip01(F.lit(1.0) - F.exp(-raw / F.lit(scale)))


def _mean(cols: list[Column]) -> Column:
    return sum(cols[1:], start=cols[0]) / len(cols)


def output_drift(df: DataFrame, experts: Sequence[str], keys: Sequence[str] = ("league",), classes: int = 3) -> DataFrame:
    """Shift of recent expert outputs against older ones, plus the current departure from the recent mean."""
    cells = {f"_e{j}_{i}": F.col(e)[i] for j, e in enumerate(experts) for i in range(classes)}
    base = df.withColumns(cells)
    line = Timeline(base, list(keys), ORDER).rolling({n: F.col(n) for n in cells}, [RECENT, REFERENCE])
    old_n = F.col(f"n_{REFERENCE}") - F.col(f"n_{RECENT}")
    recent = {n: F.col(f"{n}_{RECENT}") / RECENT for n in cells}
    older = {n: (F.col(f"{n}_{REFERENCE}") - F.col(f"{n}_{RECENT}")) / F.nullif(old_n, F.lit(0)) for n in cells}
    moved = _mean([F.abs(recent[n] - older[n]) for n in cells])
    now = _mean([F.abs(F.col(n) - recent[n]) for n in cells])
    score = F.when(F.col(f"n_{REFERENCE}") >= MIN_HISTORY, _bounded(0.75 * moved + 0.25 * now, 0.12)).otherwise(0.0)
    return line.withColumn("output_drift", score).select(*df.columns, "output_drift")


def feature_drift(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("league",)) -> DataFrame:
    """Location and scale change of pre-game features, mapped to [0, 1]."""

    def build(frame):
        recent, older = frame(RECENT), frame(REFERENCE, RECENT)
        out = {"_n": F.count(F.lit(1)).over(frame(REFERENCE))}
        for f in features:
            x = F.col(f).cast("double")
            out |= {f"_mr_{f}": F.avg(x).over(recent), f"_sr_{f}": F.stddev_samp(x).over(recent)}
            out |= {f"_mo_{f}": F.avg(x).over(older), f"_so_{f}": F.stddev_samp(x).over(older)}
        return out

    line = Timeline(df, list(keys), ORDER).trailing(REFERENCE, build)
    tiny = F.lit(1e-6)
    location = lambda f: F.abs(F.col(f"_mr_{f}") - F.col(f"_mo_{f}")) / F.greatest(F.col(f"_so_{f}"), tiny)
    scale = lambda f: F.abs(F.ln((F.col(f"_sr_{f}") + tiny) / (F.col(f"_so_{f}") + tiny)))
    raw = _mean([0.5 * location(f) + 0.5 * scale(f) for f in features])
    score = F.when(F.col("_n") >= MIN_HISTORY, _bounded(raw, 2.0)).otherwise(0.0)
    return line.withColumn("feature_drift", score).select(*df.columns, "feature_drift")


def mmd_scores(recent: np.ndarray, current: np.ndarray) -> np.ndarray:
    """Bounded RBF-MMD of one current vector against each row's recent window; shapes (B, n, f) and (B, f)."""
    mean = recent.mean(axis=1, keepdims=True)
    sd = np.maximum(recent.std(axis=1, ddof=1, keepdims=True), 1e-6)
    pool = np.concatenate([(recent - mean) / sd, (current[:, None, :] - mean) / sd], axis=1)
    d2 = ((pool[:, :, None, :] - pool[:, None, :, :]) ** 2).sum(axis=3)
    # Distances are symmetric, so the median of all positive ones is that of the pairs; others are sorted behind.
    pairs = d2[(slice(None), *np.triu_indices(d2.shape[1], 1))]
    pairs = np.sort(np.where(pairs > 0, pairs, np.inf), axis=1)
    known = (pairs < np.inf).sum(axis=1)
    at = lambda place: np.take_along_axis(pairs, np.maximum(place, 0)[:, None], axis=1)[:, 0]
    mid = np.where(known > 0, np.maximum((at((known - 1) // 2) + at(known // 2)) / 2, 1e-6), 1.0)
    gamma = 1.0 / np.maximum(2.0 * mid, 1e-6)
    k = np.exp(-gamma[:, None, None] * np.clip(d2, 0.0, 1e6))
    n = recent.shape[1]
    mmd2 = k[:, :n, :n].mean(axis=(1, 2)) + k[:, n, n] - 2.0 * k[:, :n, n].mean(axis=1)
    return np.clip(1.0 - np.exp(-np.maximum(mmd2, 0.0)), 0.0, 1.0)


def _mmd(window: pd.Series, current: pd.Series) -> pd.Series:
    out = np.zeros(len(window))
    full = np.flatnonzero([w is not None and len(w) == RECENT for w in window])
    for part in np.array_split(full, max(1, len(full) // 2000)):
        if len(part):
            now = np.stack(current.to_numpy()[part]).astype(float)
            past = np.concatenate([row for i in part for row in window.iat[i]]).astype(float)
            out[part] = mmd_scores(past.reshape(len(part), RECENT, -1), now)
    return pd.Series(out)


def mmd_drift(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("league",)) -> DataFrame:
    """Kernel distance of the current pre-game vector from the last twelve; windows hold twelve small vectors."""
    vec = F.array(*[F.col(f).cast("double") for f in features])
    line = Timeline(df.withColumn("_vec", vec), list(keys), ORDER)
    seen = line.trailing(
        MIN_HISTORY, lambda f: {"_past": F.collect_list("_vec").over(f(RECENT)), "_n": F.count(F.lit(1)).over(f(MIN_HISTORY))}
    )
    past = F.when(F.col("_n") >= MIN_HISTORY, F.col("_past"))
    # Made here: a function of Spark kept by the module could not travel with it once used.
    score = F.pandas_udf(_mmd, DoubleType())
    return seen.withColumn("mmd_drift", score(past, F.col("_vec"))).select(*df.columns, "mmd_drift")


def expert_losses(
    df: DataFrame, experts: Sequence[str], y: str = "actual", keys: Sequence[str] = ("league",), short: int = 24, long: int = 96, half_life: float = 24.0
) -> DataFrame:
    """Half-life weighted log loss of each expert over the last ``short`` and ``long`` earlier rows.

    Missing expert vectors are skipped; a horizon without values takes the other horizon's loss.
    """
    losses = {f"_ll_{e}": prob.log_loss(F.col(e), F.col(y)) for e in experts}
    base = df.withColumns(losses)
    line = Timeline(base, list(keys), ORDER).decayed({n: F.col(n) for n in losses}, half_life / math.log(2.0), widths=[short, long])
    out = {}
    for e in experts:
        s, l = F.col(f"_ll_{e}_{short}"), F.col(f"_ll_{e}_{long}")
        out |= {f"{e}_short_loss": F.coalesce(s, l), f"{e}_long_loss": F.coalesce(l, s)}
    return line.withColumns(out).select(*df.columns, *out)


def conformal(
    df: DataFrame, p: str = "p", y: str = "actual", current: str | None = None, keys: Sequence[str] = ("league",), depth: int = 120,
    minimum: int = 30, alpha: float = 0.10,
) -> DataFrame:
    """Rolling conformal p-values per class, the prediction set at ``alpha`` and a bounded uncertainty signal."""
    base = df.withColumn("_score", F.lit(1.0) - F.col(p)[F.col(y).cast("int")])
    line = Timeline(base, list(keys), ORDER).trailing(depth, lambda f: {"_scores": F.collect_list("_score").over(f(depth))})
    now = F.col(current or p)
    line = line.withColumn("_scores", F.coalesce(F.col("_scores"), F.array().cast("array<double>")))
    n = F.size("_scores")
    pvalue = lambda q: (F.lit(1.0) + F.size(F.filter("_scores", lambda s: s >= F.lit(1.0) - q - F.lit(1e-12)))) / (n + 1)
    line = line.withColumn("p_values", F.when(n >= minimum, F.transform(now, pvalue)))
    kept = F.size(F.filter("p_values", lambda v: v > alpha)).cast("long")
    set_risk = prob.clip01((kept - 1) / F.lit(2.0))
    signal = prob.clip01(0.6 * set_risk + 0.4 * prob.top_gap_risk(now))
    have = F.col("p_values").isNotNull()
    return line.withColumns(
        {
            "set_size": F.when(have, kept), "top_gap": prob.top_gap(now), "entropy": prob.entropy(now),
            "conformal_signal": F.when(have, signal).otherwise(0.0), "history_rows": n.cast("long"),
        }
    ).select(*df.columns, "p_values", "set_size", "top_gap", "entropy", "conformal_signal", "history_rows")


def _placed(df: DataFrame, keys: list[str], pos: str, n: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their rank, and rows per key; the join on the key needs no shuffle while groups are small."""
    line = Timeline(df, keys, ORDER)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    return line.positions(pos), measured(size) if line.sliced else size


def recency_weights(df: DataFrame, keys: Sequence[str] = ("league",), half_life: float = 1800.0, floor: float = 0.20) -> DataFrame:
    """2^(-age / half-life) with age 0 for the latest row of the key, clipped to [floor, 1]."""
    keys = list(keys)
    placed, size = _placed(df, keys, "_pos", "_size")
    age = (F.col("_size") - F.col("_pos")).cast("double")
    weight = F.least(F.greatest(F.pow(F.lit(2.0), -age / F.lit(max(100.0, half_life))), F.lit(floor)), F.lit(1.0))
    return placed.join(size, keys).withColumn("weight", weight).select(*df.columns, "weight")


def chrono_split(
    df: DataFrame, keys: Sequence[str] = ("league",), cuts: Sequence[tuple[str, float, int]] = (("fit", 0.60, 60), ("tune", 0.75, 90)), last: str = "eval"
) -> DataFrame:
    """Chronological split label per row: each (label, fraction, floor) ends at max(floor, int(n * fraction))."""
    keys = list(keys)
    placed, size = _placed(df, keys, "pos", "n")
    label = F.lit(last)
    for name, fraction, floor in reversed(list(cuts)):
        end = F.greatest(F.lit(floor), F.floor(F.col("n") * F.lit(fraction)))
        label = F.when(F.col("pos") <= end, name).otherwise(label)
    return placed.join(size, keys).withColumn("split", label)


def late_windows(df: DataFrame, keys: Sequence[str] = ("league",), minimum: int = 200, floor: int = 50) -> DataFrame:
    """Rows of the last two quarters of each key's timeline, labelled window_1 and window_2."""
    keys = list(keys)
    placed, size = _placed(df, keys, "_pos", "_n")
    half = F.greatest(F.lit(floor), F.floor(F.col("_n") / 4))
    back = F.col("_n") - F.col("_pos")
    label = F.when(back < half, "window_2").when(back < 2 * half, "window_1")
    return placed.join(size, keys).filter(F.col("_n") >= minimum).withColumn("window", label).filter("window is not null").select(*df.columns, "window")
