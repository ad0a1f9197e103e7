"""Distribution drift: two-sample Kolmogorov-Smirnov over date windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from furrow import constants as K
from furrow.functions.dates import between_days
from furrow.functions.stats import ks_p_value
from furrow.operators.prefix import running_totals
from furrow.operators.series import as_of_column


def ks_statistic(
    prices: DataFrame,
    keys: list[str],
    as_of=None,
    days: int = 90,
    min_rows: int = 10,
    value: str = "modal_price",
) -> DataFrame:
    """Largest gap between the two empirical distributions of each key.

    Recent rows are ``[as_of - days, as_of)``, prior rows the ``days`` before.
    Values are counted before anything is ordered, and the ordering is split by
    value range, so a hot crop is not one task.
    """
    end = as_of_column(prices, as_of)
    recent = F.col("date") >= F.date_sub(end, days)
    counted = (
        prices.filter(F.col(value).isNotNull() & between_days(F.col("date"), end, 2 * days, 0))
        .withColumn("_recent", recent)
        .groupBy(*keys, value)
        .agg(F.count_if(~F.col("_recent")).alias("c1"), F.count_if("_recent").alias("c2"))
    )
    steps = running_totals(counted, keys, value, ["c1", "c2"])
    gap = F.abs(F.col("cum_c1") / F.col("total_c1") - F.col("cum_c2") / F.col("total_c2"))
    return (
        steps.filter((F.col("total_c1") >= min_rows) & (F.col("total_c2") >= min_rows))
        .groupBy(*keys, F.col("total_c1").alias("n1"), F.col("total_c2").alias("n2"))
        .agg(F.max(gap).alias("statistic"))
    )


def ks_drift(
    prices: DataFrame, keys: list[str], as_of=None, days: int = 90,
    min_rows: int = 10, alpha: float = K.DRIFT_ALPHA, exact: bool = False,
) -> DataFrame:
    """Statistic, p-value, its method and drift flag per key.

    The caller chooses the method, and sample sizes never change it: asymptotic
    by default, or ``exact=True``, whose work grows with the product of the two
    sample sizes.
    """
    stat = ks_statistic(prices, keys, as_of, days, min_rows)
    p = _exact_p("n1", "n2", "statistic") if exact else ks_p_value(F.col("statistic"), F.col("n1"), F.col("n2"))
    return stat.withColumns({"p_value": p, "method": F.lit("exact" if exact else "asymptotic")}).withColumn(
        "drift", F.col("p_value") < alpha
    )


def exact_ks_p(n1: int, n2: int, d: float) -> float:
    """P(D >= d) for continuous samples.

    The pooled values are drawn one by one; ``inside[i]`` is the probability that
    i of them came from the smaller sample and the gap never reached d. A gap
    times n1 * n2 is a whole number, so the comparison is exact; what crosses is
    added up.
    """
    m, n = sorted((int(n1), int(n2)))
    reach = round(d * m * n)
    if reach <= 0:
        return 1.0
    i = np.arange(m + 1)
    inside, crossed = np.zeros(m + 1), 0.0
    inside[0] = 1.0
    for drawn in range(m + n):
        left = m + n - drawn
        grown = inside * (m - i) / left
        inside = inside * np.maximum(n - (drawn - i), 0) / left
        inside[1:] += grown[:-1]
        over = np.abs(i * n - (drawn + 1 - i) * m) >= reach
        crossed += inside[over].sum()
        inside[over] = 0.0
    return float(min(1.0, crossed))


@F.pandas_udf(DoubleType())
def _exact_p(n1: pd.Series, n2: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([exact_ks_p(a, b, c) for a, b, c in zip(n1, n2, d)])
