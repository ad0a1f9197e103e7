"""Forecast branches against a plain numpy restatement."""

import datetime as dt

import numpy as np
import pytest

from furrow.plans import backtest, forecast

START = dt.date(2024, 1, 1)


def series(name, values):
    return [("wheat", name, START + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]


def expected(values, horizon):
    """The published additive decomposition, written step by step."""
    y = np.asarray(values, float)[-90:]
    n = len(y)
    period = max(2, min(7, n // 3))
    weights = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    half = len(weights) // 2
    trend = np.full(n, np.nan)
    for i in range(half, n - half):
        trend[i] = weights @ y[i - half : i + half + 1]
    last = n - 1 - half
    xs = np.arange(half, min(half + period, last))
    k, c = np.polyfit(xs, trend[xs], 1)
    trend[:half] = k * np.arange(half) + c
    xs = np.arange(max(half, last - period), last)
    k, c = np.polyfit(xs, trend[xs], 1)
    trend[last + 1 :] = k * np.arange(last + 1, n) + c
    means = np.array([(y - trend)[p::period].mean() for p in range(period)])
    seasonal = np.resize(means - means.mean(), n)
    slope, intercept = np.polyfit(np.arange(n), y, 1)
    sd = np.diff(y).std(ddof=1) or y.mean() * 0.03
    i = np.arange(1, horizon + 1)
    point = slope * (n + i) + intercept + seasonal[(n + i) % n]
    return point, 1.96 * sd * np.sqrt(i)


CASES = {n: np.random.default_rng(n).uniform(1500, 2500, n).round(2) for n in (14, 15, 18, 21, 40, 100)}


@pytest.fixture(scope="module")
def prices(spark):
    rows = []
    for n, v in CASES.items():
        rows += series(f"n{n}", v)
    rows += series("short", [100, 110, 120, None]) + series("blank", [None, None]) + series("flat", [2500] * 100)
    return spark.createDataFrame(rows, "crop string, mandi string, date date, modal_price double")


@pytest.fixture(scope="module")
def days(prices):
    pdf = forecast.baseline_forecast(prices, 30, START, digits=None).toPandas()
    return {m: g.sort_values("step").reset_index(drop=True) for m, g in pdf.groupby("mandi")}


@pytest.mark.parametrize("n", sorted(CASES))
def test_matches_numpy(days, n):
    point, width = expected(CASES[n], 30)
    got = days[f"n{n}"]
    assert np.allclose(got.predicted_price, point)
    assert np.allclose(got.upper_bound - got.predicted_price, width)
    assert got.date[0] == START + dt.timedelta(days=1)


def test_short_blank_and_constant(days):
    assert (days["short"].predicted_price == 120).all()
    assert np.allclose(days["short"].lower_bound, 114) and np.allclose(days["short"].upper_bound, 126)
    assert (days["blank"].predicted_price == 2000).all()
    flat = days["flat"]
    assert np.allclose(flat.predicted_price, 2500)
    assert flat.upper_bound[0] == pytest.approx(2500 + 1.96 * 75)


def test_aligned_option_differs_by_position(prices):
    got = forecast.baseline_forecast(prices.filter("mandi = 'n40'"), 1, START, aligned=True, digits=None).first()
    y = CASES[40]
    slope, intercept = np.polyfit(np.arange(40), y, 1)
    season = got.predicted_price - (slope * 40 + intercept)
    point, _ = expected(y, 40)
    # phase of position 40 is 40 % 7; parity index 40 + i wraps to i, phase i % 7
    i = 40 % 7
    assert season == pytest.approx(point[i - 1] - (slope * (40 + i) + intercept))


def test_extension_widens_five_percent_a_day(prices):
    base = forecast.baseline_forecast(prices.filter("mandi = 'n100'"), 30, START, digits=None)
    out = {r.step: r for r in forecast.extend_horizon(base, 33).collect()}
    assert len(out) == 33 and out[33].predicted_price == out[30].predicted_price
    w30 = out[30].upper_bound - out[30].lower_bound
    assert out[33].upper_bound - out[33].lower_bound == pytest.approx(w30 * 1.05**3)
    assert out[33].date == START + dt.timedelta(days=33)


def test_report(spark, prices):
    asked = spark.createDataFrame([("cotton", "nowhere"), ("saffron", "nowhere"), ("wheat", "flat")], "crop string, mandi string")
    rows = {(r.crop, r.mandi): r for r in forecast.forecast_report(prices, 7, START, requested=asked).collect()}
    flat = rows["wheat", "flat"]
    assert flat.recommendation == "SELL" and flat.avg_predicted_price == 2500 and flat.msp == 2275
    assert flat.recommendation_reason == "Predicted avg price ₹2,500 is 9.9% above MSP ₹2,275"
    assert len(flat.forecast) == 7 and flat.forecast[0].date == START + dt.timedelta(days=1)
    cotton = rows["cotton", "nowhere"]
    assert cotton.current_price == 7020 and cotton.recommendation == "HOLD"  # equal is not above
    assert cotton.forecast[0].lower_bound == pytest.approx(7020 * 0.95)
    saffron = rows["saffron", "nowhere"]
    assert saffron.current_price == 2000 and saffron.recommendation_reason.startswith("No MSP data available for saffron")
    assert rows["wheat", "short"].current_price == 120
    assert rows["wheat", "blank"].current_price == 2275
    with pytest.raises(ValueError):
        forecast.forecast_report(prices, 91)


def test_backtest_failure_marks_and_extra_model(spark, prices):
    part = prices.filter("mandi in ('n40', 'n100', 'flat')")
    extra = spark.createDataFrame([], "crop string, mandi string, horizon int, date date, predicted double, lower_bound double, upper_bound double")
    rows = {(r.mandi, r.horizon, r.model_name): r for r in backtest.backtest(part, [30, 60], {"other": extra}).collect()}
    assert len(rows) == 3 * 2 * 3
    assert rows["flat", 30, "naive"].rmse == 0 and rows["flat", 30, "naive"].pi_coverage_95 == 100
    assert rows["n100", 30, "naive"].n_train_samples == 70 and rows["n100", 30, "naive"].n_test_samples == 30
    assert rows["n100", 30, "other"].rmse == 999 and rows["n100", 30, "other"].pi_coverage_95 == 0
    assert rows["n40", 60, "trend-season"].rmse == 999  # nothing left to train on
    y = CASES[100]
    assert rows["n100", 30, "naive"].rmse == pytest.approx(np.sqrt(np.mean((y[70:] - y[69:99]) ** 2)))
    point, _ = expected(y[:70], 30)
    assert rows["n100", 30, "trend-season"].rmse == pytest.approx(np.sqrt(np.mean((y[70:] - point) ** 2)))


def test_bootstrap_paths_by_loops(spark):
    import hashlib

    import datetime as dt

    from pyspark.sql import functions as F

    from furrow.plans import forecast as P

    start = dt.date(2024, 1, 1)
    y = [100.0 + i * 0.5 + (i * 7 % 5) for i in range(40)]
    rows = [("c", "m", start + dt.timedelta(days=i), v) for i, v in enumerate(y)] + [("c", "few", start + dt.timedelta(days=i), 1.0) for i in range(9)]
    prices = spark.createDataFrame(rows, "crop string, mandi string, date date, modal_price double")
    as_of = F.lit(start + dt.timedelta(days=39))
    got = {(r.step, r.draw): r.value for r in P.bootstrap_draws(prices, 10, as_of, draws=4, block=3).collect()}
    base = {r.step: r.predicted_price for r in P.baseline_forecast(prices, 10, as_of, digits=None).filter("mandi = 'm'").collect()}
    changes = [b - a for a, b in zip(y, y[1:])]
    mean = sum(changes) / len(changes)
    assert len(got) == 40
    for draw in range(1, 5):
        total = 0.0
        for step in range(1, 11):
            block, inside = divmod(step - 1, 3)
            drawn = int(hashlib.md5(f"c|m|{draw}|{block}".encode()).hexdigest()[:7], 16) % len(changes)
            total += changes[(drawn + inside) % len(changes)] - mean
            assert abs(got[step, draw] - base[step] - total) < 1e-9
