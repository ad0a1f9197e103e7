"""Running totals, quantiles, drift and unit-root tests against brute force."""

import datetime as dt
import itertools
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.functions.stats import adf_critical, adf_p_value, normal_cdf
from furrow.operators import drift, stationarity
from furrow.operators.prefix import exact_quantiles, running_totals


def test_running_totals_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"k": "hot", "v": np.r_[rng.lognormal(3, 2, 3000).round(1), -5.0, 1e9]})
    cold = pd.DataFrame({"k": [f"c{i}" for i in range(50)], "v": 1.0})
    pdf = pd.concat([hot, cold]).assign(n=1)
    out = running_totals(spark.createDataFrame(pdf), ["k"], "v", ["n"], cells=64).toPandas()
    want = pdf.groupby(["k", "v"]).n.sum().groupby("k").cumsum()
    got = out.set_index(["k", "v"]).cum_n.sort_index()
    assert (got == want.sort_index()).all() and len(got) == len(want)
    q = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", {"p50": 0.5, "p95": 0.95}).toPandas().set_index("k")
    assert q.loc["hot", "p50"] == pytest.approx(hot.v.quantile(0.5))
    assert q.loc["hot", "p95"] == pytest.approx(hot.v.quantile(0.95))
    assert q.loc["c7", "p50"] == 1.0


def test_exact_ks_p_by_enumeration():
    for n1, n2 in ((3, 4), (4, 4), (2, 5)):
        draws = list(itertools.combinations(range(n1 + n2), n1))
        stats = []
        for pick in draws:
            side = np.isin(np.arange(n1 + n2), pick)
            stats.append(np.abs(np.cumsum(side) / n1 - np.cumsum(~side) / n2).max())
        for d in sorted(set(np.round(stats, 12))):
            want = np.mean(np.asarray(stats) >= d - 1e-9)
            assert drift.exact_ks_p(n1, n2, d) == pytest.approx(want)


def test_drift_groups(spark):
    end = dt.date(2024, 7, 1)
    rows = []
    for i in range(1, 181):
        day = end - dt.timedelta(days=i)
        rows += [("same", day, float(i % 90)), ("apart", day, 1.0 if i <= 90 else 2.0)]
        if i <= 5:
            rows.append(("few", day, 1.0))
    rows.append(("same", end, 1e6))  # the as-of day itself is outside the window
    df = spark.createDataFrame(rows, "crop string, date date, modal_price double")
    for exact in (False, True):
        out = {r.crop: r for r in drift.ks_drift(df, ["crop"], end, exact=exact).collect()}
        assert set(out) == {"same", "apart"}
        assert out["same"].statistic == 0 and out["same"].p_value == 1 and not out["same"].drift
        assert out["apart"].statistic == 1 and out["apart"].drift
        assert out["apart"].n1 == 90 and out["apart"].n2 == 90


def test_adf_tables(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(adf_p_value(F.lit(-2.8615))) == pytest.approx(0.05, abs=1e-3)
    assert one(adf_p_value(F.lit(-20.0))) == 0.0 and one(adf_p_value(F.lit(3.0))) == 1.0
    assert one(adf_p_value(F.lit(None).cast("double"))) is None
    assert one(adf_critical("5pct", F.lit(100))) == pytest.approx(-2.8909, abs=1e-3)
    for x in (-7.5, -3.0, -0.1, 0.0, 1.96, 6.0):
        assert one(normal_cdf(F.lit(x))) == pytest.approx(NormalDist().cdf(x), abs=1e-13)


def pair(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(0, 1, 300)
    walk = np.cumsum(np.random.default_rng(0).normal(0, 1, 300))
    start = dt.date(2020, 1, 1)
    rows = [("c", m, start + dt.timedelta(days=i), float(v)) for m, y in (("noise", noise), ("walk", walk)) for i, v in enumerate(y)]
    rows += [("c", "constant", start + dt.timedelta(days=i), 1.0) for i in range(50)]
    return spark.createDataFrame(rows, "crop string, mandi string, date date, modal_price double")


def test_adf_and_differencing(spark):
    df = pair(spark)
    out = {r.mandi: r for r in stationarity.adf_test(df).collect()}
    assert out["noise"].p_value < 0.05 < out["walk"].p_value
    assert out["constant"].p_value is None or np.isnan(out["constant"].p_value)
    series, diagnostics = stationarity.make_stationary(df)
    counts = {r.mandi: (r["count"], r.d) for r in series.groupBy("mandi", F.col("differenced").alias("d")).count().collect()}
    assert counts["noise"] == (300, False) and counts["walk"] == (299, True)
    assert series.filter("value is null").count() == 0
    rows = {(r.mandi, r.stage): r for r in diagnostics.collect()}
    assert rows["walk", "original"].differencing_applied and rows["walk", "differenced"].is_stationary
    assert not rows["noise", "original"].differencing_applied and ("noise", "differenced") not in rows
    _, loose = stationarity.make_stationary(df, significance=0.99)
    assert {r.stage for r in loose.collect()} == {"original"}  # the caller's level decides


def plain_adf(y):
    """(statistic, lag, observations) by least squares on whole design matrices."""
    n = len(y)
    change, top = np.diff(y), stationarity.top_lag(n)

    def fit(lags, skip):
        rows = np.arange(skip, len(change))
        x = np.column_stack([y[rows], np.ones(len(rows))] + [change[rows - i] for i in range(1, lags + 1)])
        beta, *_ = np.linalg.lstsq(x, change[rows], rcond=None)
        return x, beta, ((change[rows] - x @ beta) ** 2).sum(), len(rows)

    scores = []
    for lag in range(top + 1):
        _, _, rss, m = fit(lag, top)
        scores.append((m * np.log(rss / m) + 2 * (lag + 2), lag))
    lag = min(scores)[1]
    x, beta, rss, m = fit(lag, lag)
    return beta[0] / np.sqrt(np.linalg.inv(x.T @ x)[0, 0] * rss / max(m - x.shape[1], 1)), lag, m


def test_adf_by_moments_is_the_regression(spark):
    rng = np.random.default_rng(4)
    series = {
        "short": rng.normal(0, 1, 9), "eight": rng.normal(0, 1, 8), "noise": rng.normal(50, 3, 400), "walk": 900 + np.cumsum(rng.normal(0, 2, 700)),
        "season": 100 + 10 * np.sin(np.arange(500) / 7) + rng.normal(0, 1, 500), "steps": np.cumsum(rng.integers(-2, 3, 150)).astype(float),
    }
    ar = rng.normal(0, 1, 600)
    for t in range(3, 600):
        ar[t] += 0.5 * ar[t - 1] - 0.3 * ar[t - 3]
    series["lags"] = 1000 + ar
    start = dt.date(2020, 1, 1)
    rows = [("c", m, start + dt.timedelta(days=i), float(v)) for m, y in series.items() for i, v in enumerate(y)]
    rows += [("c", "gaps", start + dt.timedelta(days=i), None if i % 9 == 4 else float(v)) for i, v in enumerate(series["noise"])]
    rows += [("c", "few", start + dt.timedelta(days=i), float(i % 3)) for i in range(7)]
    rows += [("c", "none", start, None)]
    series["gaps"] = np.array([v for i, v in enumerate(series["noise"]) if i % 9 != 4])
    df = spark.createDataFrame(rows, "crop string, mandi string, date date, modal_price double")
    out = {r.mandi: r for r in stationarity.adf_test(df).collect()}
    assert set(out) == {*series, "few"} and out["few"].adf_statistic is None and out["few"].p_value is None
    for name, y in series.items():
        stat, lag, m = plain_adf(y)
        assert (out[name].used_lag, out[name].nobs) == (lag, m), name
        assert out[name].adf_statistic == pytest.approx(stat, rel=1e-7), name
    empty = stationarity.adf_test(df.where("false"))
    assert empty.count() == 0
