"""Score distributions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions import prob


def _ln_factorial(k: int) -> float:
    return math.lgamma(k + 1.0)


def poisson_pmf(k: int, lam: Column, floor: float = 1e-6) -> Column:
    rate = F.greatest(lam, F.lit(floor))
    return F.exp(-rate + F.lit(float(k)) * F.ln(rate) - F.lit(_ln_factorial(k)))


def poisson_pmfs(lam: Column, top: int, floor: float = 1e-6) -> list[Column]:
    """P(0), ..., P(top)."""
    return [poisson_pmf(k, lam, floor) for k in range(top + 1)]


def poisson_array(lam: Column, top: int, floor: float = 1e-6) -> Column:
    """``poisson_pmfs`` as one array, made in a loop: the logarithm is taken once, and the generated code stays small enough to be compiled."""
    count = F.array(*[F.lit(float(k)) for k in range(top + 1)])
    logs = F.array(*[F.lit(_ln_factorial(k)) for k in range(top + 1)])
    values = lambda rate, log: F.zip_with(count, logs, lambda k, f: F.exp(-rate + k * log - f))
    return prob.let(F.greatest(lam, F.lit(floor)), lambda rate: prob.let(F.ln(rate), lambda log: values(rate, log)))


def poisson_cdf(lam: Column, upto: int) -> Column:
    return sum((poisson_pmf(k, lam) for k in range(1, upto + 1)), start=poisson_pmf(0, lam))


def low_total(lam_home: Column, lam_away: Column, threshold: int = 6) -> Column:
    """P(total <= threshold) under independent Poisson sides."""
    return F.least(F.greatest(poisson_cdf(lam_home + lam_away, threshold), F.lit(0.0)), F.lit(1.0))


def low_total_truncated(lam_home: Column, lam_away: Column, threshold: int = 6, max_total: int = 30) -> Column:
    """Same, renormalised over totals 0..max_total."""
    lam = lam_home + lam_away
    return poisson_cdf(lam, threshold) / poisson_cdf(lam, max_total)


def low_both_sides(lam_home: Column, lam_away: Column, threshold: int = 6) -> Column:
    """P(both sides <= threshold)."""
    return poisson_cdf(lam_home, threshold) * poisson_cdf(lam_away, threshold)


def line_probs(lam_home: Column, lam_away: Column, line: Column, max_total: int = 40) -> Column:
    """struct(low, high) for a half-point line; null for an integer (push) line or no line."""
    lam = lam_home + lam_away
    half = F.abs(line - F.floor(line) - F.lit(0.5)) < F.lit(1e-9)
    pmf = F.array(*[poisson_pmf(k, lam) for k in range(max_total + 1)])
    low = F.aggregate(
        F.slice(pmf, F.lit(1), F.least(F.floor(line).cast("int") + 1, F.lit(max_total + 1))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    low = F.least(F.greatest(low, F.lit(0.0)), F.lit(1.0))
    return F.when(half & (line >= 0), F.struct(low.alias("low"), (F.lit(1.0) - low).alias("high")))


def poisson_nll(y: Column, mu: Column) -> Column:
    rate = F.least(F.greatest(mu, F.lit(1e-6)), F.lit(50.0))
    return rate - y * F.ln(rate) + ln_factorial(y)


def ln_factorial(y: Column) -> Column:
    """ln(y!) of a non-negative integer column by summing logarithms."""
    return F.when(y >= 1, F.aggregate(
        F.sequence(F.lit(1), F.greatest(y, F.lit(1)).cast("int")), F.lit(0.0), lambda acc, j: acc + F.ln(j.cast("double"))
    )).otherwise(0.0)


def _rising_ln(y: Column, r: Column) -> Column:
    """lgamma(y+r) - lgamma(r) for integer y."""
    return F.when(y >= 1, F.aggregate(
        F.sequence(F.lit(0), F.greatest(y, F.lit(1)).cast("int") - 1), F.lit(0.0), lambda acc, j: acc + F.ln(r + j)
    )).otherwise(0.0)


def nb_nll(y: Column, mu: Column, alpha: Column) -> Column:
    """Negative-binomial NLL with dispersion alpha; alpha = 0 is Poisson."""
    rate = F.least(F.greatest(mu, F.lit(1e-6)), F.lit(50.0))
    a = F.when(alpha > 0, alpha).otherwise(1.0)
    r = F.lit(1.0) / a
    p = r / (r + rate)
    logpmf = (
        _rising_ln(y, r) - ln_factorial(y)
        + r * F.ln(F.greatest(p, F.lit(1e-12)))
        + y * F.ln(F.greatest(F.lit(1.0) - p, F.lit(1e-12)))
    )
    return F.when(alpha > 0, -logpmf).otherwise(poisson_nll(y, mu))


def nb_cdf(mu: Column, size: Column, upto: int = 6) -> Column:
    """P(X <= upto) for a negative binomial with mean mu and shape size."""
    p = size / (size + mu)
    terms = F.transform(
        F.sequence(F.lit(0), F.lit(upto)),
        lambda k: F.exp(_rising_ln(k, size) - ln_factorial(k) + size * F.ln(p) + k * F.ln(F.lit(1.0) - p)),
    )
    return F.least(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x), F.lit(1.0))


def low_bivariate(mu_home: Column, mu_away: Column, shared: Column, threshold: int = 6) -> Column:
    """P(total <= threshold): the total is X + Y + 2Z with independent Poisson parts."""
    mh, ma = F.greatest(mu_home, F.lit(1e-9)), F.greatest(mu_away, F.lit(1e-9))
    z = F.least(F.greatest(shared, F.lit(0.0)), mh, ma)
    rest = mh + ma - 2 * z
    parts = lambda w, r: [w[k] * prob.total(F.slice(r, 1, threshold - 2 * k + 1)) for k in range(threshold // 2 + 1)]
    low = prob.let(poisson_array(z, threshold // 2, 1e-300), lambda w: prob.let(poisson_array(rest, threshold), lambda r: sum(parts(w, r), start=F.lit(0.0))))
    return F.least(low, F.lit(1.0))


def consistency_adjust(lam: Column, split: Column, sign: int) -> Column:
    """Scale a side's mean by the win-probability split: lam * (1 +/- 0.08 * clip(split, +/-0.35))."""
    bounded = F.least(F.greatest(split, F.lit(-0.35)), F.lit(0.35))
    return lam * (F.lit(1.0) + F.lit(0.08 * sign) * bounded)
