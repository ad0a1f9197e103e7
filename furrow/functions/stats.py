"""Statistical expressions built from plain column arithmetic."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

from furrow import constants as K


def z_score(confidence: float = 0.95) -> float:
    """Two-sided normal quantile of a confidence level."""
    return NormalDist().inv_cdf((1 + confidence) / 2)


def ks_p_value(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value, clamped to [0, 1]."""
    lam = d * F.sqrt(n1 * n2 / (n1 + n2))
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    # below 0.2 the survival function is 1 to more than twelve digits
    return F.when(lam < 0.2, 1.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * tail))
    )


def normal_cdf(x: Column, terms: int = 120) -> Column:
    """Standard normal distribution function by its power series; beyond eight
    spreads it is 0 or 1 to more than fourteen digits."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(x.alias("sum"), x.alias("term")),
        lambda s, k: F.struct(
            (s["sum"] + s["term"] * x * x / (2 * k + 1)).alias("sum"), (s["term"] * x * x / (2 * k + 1)).alias("term")
        ),
        lambda s: s["sum"],
    )
    inside = 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
    return F.when(x < -8, 0.0).when(x > 8, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def adf_p_value(tau: Column) -> Column:
    """Approximate unit-root p-value, constant-only case (MacKinnon 1994)."""
    small, large = (normal_cdf(_polynomial(tau, c)) for c in (K.ADF_SMALL_P, K.ADF_LARGE_P))
    inside = F.when(tau <= K.ADF_TAU_STAR, small).otherwise(large)
    return (
        F.when(tau.isNull() | F.isnan(tau), F.lit(None).cast("double"))
        .when(tau > K.ADF_TAU_MAX, 1.0).when(tau < K.ADF_TAU_MIN, 0.0).otherwise(inside)
    )


def adf_critical(level: str, nobs: Column) -> Column:
    """Finite-sample critical value, constant-only case (MacKinnon 2010)."""
    return _polynomial(1.0 / nobs.cast("double"), K.ADF_CRITICAL[level])
