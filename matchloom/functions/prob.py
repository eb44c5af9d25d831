"""Probability vectors as array columns: all expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: higher-order functions do not hoist what they repeat."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def vector(*cols: Column | str) -> Column:
    return F.array(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in cols])


def scale_to_one(xs: Column) -> Column:
    return let(xs, lambda v: let(total(v), lambda mass: F.transform(v, lambda x: x / mass)))


def normalise(p: Column, floor: float = 1e-12) -> Column:
    """Clip to [floor, 1] and divide by the mass."""
    return scale_to_one(F.transform(p, lambda x: F.least(F.greatest(x, F.lit(floor)), F.lit(1.0))))


def clip_prob(p: Column) -> Column:
    """Non-finite entries become 1/k, entries are floored at 1e-9, mass becomes one."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    safe = lambda v: F.transform(v, lambda x: F.greatest(F.when(bad(x), F.lit(1.0) / F.size(v)).otherwise(x), F.lit(1e-9)))
    return scale_to_one(let(p, safe))


def temper(p: Column, temperature: Column | float, floor: float = 1e-12) -> Column:
    """Power scaling p^(1/T) of a normalised vector."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    t = F.least(F.greatest(t, F.lit(0.1)), F.lit(10.0))
    return scale_to_one(let(F.lit(1.0) / t, lambda power: F.transform(normalise(p, floor), lambda x: F.pow(x, power))))


def softmax(z: Column, temperature: float = 1.0) -> Column:
    shifted = lambda v, best: F.transform(v, lambda x: F.exp(F.greatest((x - best) / F.lit(temperature), F.lit(-50.0))))
    return scale_to_one(let(z, lambda v: let(F.array_max(v), lambda best: shifted(v, best))))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(q / (F.lit(1.0) - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * F.ln(F.greatest(x, F.lit(1e-12))))


def normalised_entropy(p: Column) -> Column:
    return clip01(entropy(p) / F.ln(F.size(p).cast("double")))


def top(p: Column, rank: int = 1) -> Column:
    return F.element_at(F.sort_array(p, asc=False), rank)


def top_gap(p: Column) -> Column:
    return let(F.sort_array(p, asc=False), lambda v: F.element_at(v, 1) - F.element_at(v, 2))


def top_gap_risk(p: Column, scale: float = 0.25) -> Column:
    return clip01(F.lit(1.0) - top_gap(p) / F.lit(scale))


def favourite(p: Column) -> Column:
    """0-based index of the first maximum."""
    return let(p, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("long"))


def mean_of(xs: Column) -> Column:
    return let(xs, lambda v: total(v) / F.size(v))


def pop_sd(xs: Column) -> Column:
    squares = lambda v, m: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(v)
    return F.sqrt(let(xs, lambda v: let(total(v) / F.size(v), lambda m: squares(v, m))))


def disagreement(experts: list[Column], classes: int = 3) -> Column:
    """Mean over classes of the population deviation across expert vectors."""
    parts = [pop_sd(F.array(*[e[i] for e in experts])) for i in range(classes)]
    return sum(parts[1:], start=parts[0]) / classes


def mix(experts: list[Column], weights: Column, classes: int = 3) -> Column:
    """Weighted mean of expert vectors, renormalised."""
    blend = lambda w: F.array(*[sum((w[j] * e[i] for j, e in enumerate(experts)), start=F.lit(0.0)) for i in range(classes)])
    return normalise(let(scale_to_one(weights), blend))


def mix_two(a: Column, b: Column, alpha: Column | float, floor: float = 1e-12) -> Column:
    weight = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else alpha
    return normalise(F.zip_with(a, b, lambda x, y: (F.lit(1.0) - weight) * x + weight * y), floor)


def log_loss(p: Column, y: Column, floor: float = 1e-12) -> Column:
    """-ln p[y]; a missing vector gives null, never a loss."""
    return F.when(p.isNotNull(), -F.ln(F.greatest(F.element_at(p, (y + 1).cast("int")), F.lit(floor))))


def brier(p: Column, y: Column) -> Column:
    return F.aggregate(
        F.transform(p, lambda x, i: (x - F.when(i == y, 1.0).otherwise(0.0))),
        F.lit(0.0),
        lambda acc, d: acc + d * d,
    )


def risk_features(p: Column, disagree: Column) -> dict[str, Column]:
    """Four confidence-fragility features of a forecast."""
    best, second = top(p, 1), top(p, 2)
    return {
        "risk_top": F.lit(1.0) - best,
        "risk_margin": F.lit(1.0) - (best - second) / F.greatest(best, F.lit(1e-12)),
        "risk_entropy": normalised_entropy(p),
        "risk_disagreement": clip01(disagree / F.lit(0.25)),
    }


def shrink_by_risk(p: Column, risk: Column, beta: Column | float) -> Column:
    b = F.lit(float(beta)) if isinstance(beta, (int, float)) else beta
    return temper(p, F.lit(1.0) + clip01(b / F.lit(1.5)) * F.lit(1.5) * clip01(risk))


def slope(values: Column) -> Column:
    """Least-squares slope of an array against 0..n-1."""

    def fit(v: Column, mid: Column, m: Column) -> Column:
        n = F.size(v).cast("double")
        num = total(F.transform(v, lambda x, i: (i - mid) * (x - m)))
        return num / F.nullif(n * (n * n - 1) / 12, F.lit(0.0))

    return let(values, lambda v: let((F.size(v) - 1) / 2, lambda mid: let(total(v) / F.size(v), lambda m: fit(v, mid, m))))
