"""Contract of the feature matrix, checked by plain Python over several series."""

import datetime as dt
import math
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from furrow import constants as K
from furrow.functions.dates import week_cycle
from furrow.operators.features import engineer_features

FIRST = dt.date(2022, 11, 20)
SCHEMA = "mandi string, crop string, date date, " + ", ".join(f"{c} double" for c in K.MERGED_COLUMNS)


def market(mandi, days, crop="tur", slope=0.0, gap=None, blank=None):
    """Rows of one series: a rising price with a weekly swing. Every ``gap``-th day
    is missing; ``blank`` = (row, column) is NULL."""
    rows = []
    for i in range(days):
        if gap and i % gap == gap - 1:
            continue
        price = 640.0 + slope * i + 25 * math.sin(i * 2 * math.pi / 7) + (i * 37 % 11)
        row = {
            "modal_price": price, "msp": 600.0 + 10 * (i // 200), "min_price": price - 8 - i % 5, "max_price": price + 6 + i % 3,
            "arrivals_tonnes": 12.0 + i * 13 % 29, "rainfall_mm": float(i * 7 % 5 == 0), "max_temp": 27.0 + i % 9,
            "min_temp": 11.0 + i % 4, "freight_index": 70.0 + (i * i) % 17, "futures_price": price * (0.9 + (i * 19 % 23) / 100),
        }
        assert set(row) == set(K.MERGED_COLUMNS)
        if blank and len(rows) == blank[0]:
            row[blank[1]] = None
        rows.append((mandi, crop, FIRST + dt.timedelta(days=i), *(row[c] for c in K.MERGED_COLUMNS)))
    return rows


SERIES = {
    "rising": market("rising", 140, slope=1.5), "flat": market("flat", 125), "gaps": market("gaps", 160, slope=-0.8, gap=6),
    "short": market("short", 90), "null": market("null", 130, slope=0.3, blank=(100, "arrivals_tonnes")),
}


def table(spark, *names, rows=None):
    given = rows if rows is not None else [r for n in names or SERIES for r in SERIES[n]]
    return spark.createDataFrame(given, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def features(spark):
    found = engineer_features(table(spark)).collect()
    return {(r.mandi, r.date): r for r in found}


def column(name, mandi):
    place = 3 + K.MERGED_COLUMNS.index(name)
    return [r[place] for r in SERIES[mandi]], [r[2] for r in SERIES[mandi]]


def test_columns_and_complete_rows(spark, features):
    assert engineer_features(table(spark, "flat")).columns == ["crop", "mandi", "date", *K.FEATURE_NAMES]
    assert len(set(K.FEATURE_NAMES)) == 53
    count = {m: sum(k[0] == m for k in features) for m in SERIES}
    longest = max(K.PRICE_LAGS)
    assert count["rising"] == 140 - longest and count["flat"] == 125 - longest and count["short"] == 0
    assert count["gaps"] == len(SERIES["gaps"]) - longest  # windows count rows, not days
    assert 0 < count["null"] < 130 - longest
    assert all(v is not None for r in features.values() for v in r)


@pytest.mark.parametrize("mandi", ["rising", "gaps"])
def test_lags_and_windows_by_loops(features, mandi):
    price, days = column("modal_price", mandi)
    sacks, _ = column("arrivals_tonnes", mandi)
    rain, _ = column("rainfall_mm", mandi)
    hot, _ = column("max_temp", mandi)
    cold, _ = column("min_temp", mandi)
    freight, _ = column("freight_index", mandi)
    ahead, _ = column("futures_price", mandi)
    for i in range(max(K.PRICE_LAGS), len(price)):
        got = features[mandi, days[i]]
        back = lambda values, n: values[i - n + 1 : i + 1]
        want = {f"price_lag_{k}": price[i - k] for k in K.PRICE_LAGS} | {f"arrivals_lag_{k}": sacks[i - k] for k in K.ARRIVAL_LAGS}
        for w in K.ROLL_WINDOWS:
            want |= {f"price_rmean_{w}": mean(back(price, w)), f"price_rstd_{w}": stdev(back(price, w))}
            want |= {f"arrivals_rmean_{w}": mean(back(sacks, w)), f"arrivals_rstd_{w}": stdev(back(sacks, w))}
        want["rainfall_roll_10d"] = sum(back(rain, 10))
        want["temp_rmean_7"] = mean([(a + b) / 2 for a, b in zip(back(hot, 7), back(cold, 7))])
        want["arrivals_market_share"] = sacks[i] / sum(back(sacks, 30))
        want["price_momentum_7d"] = (price[i] / price[i - 7] - 1) * 100
        want["freight_momentum"] = (freight[i] / freight[i - 7] - 1) * 100
        x, y = ([v[j] / v[j - 1] - 1 for j in range(i - 13, i + 1)] for v in (price, ahead))
        cov = sum((a - mean(x)) * (b - mean(y)) for a, b in zip(x, y)) / 13
        want["cbot_correlation_14d"] = cov / (stdev(x) * stdev(y))
        for name, value in want.items():
            assert got[name] == pytest.approx(value, rel=1e-9, abs=1e-9), (name, i)


def test_row_wise_features(features):
    for r in features.values():
        assert r.msp_distance == pytest.approx(r.modal_price - r.msp) and r.msp_pct == pytest.approx(100 * r.msp_distance / r.msp)
        assert (r.price_spread, r.temp_range) == pytest.approx((r.max_price - r.min_price, r.max_temp - r.min_temp))
        assert r.price_volatility == pytest.approx(r.price_spread / r.modal_price)
        assert r.futures_basis == pytest.approx(r.modal_price - r.futures_price)
        assert (r.is_rabi, r.is_kharif) == (int(r.date.month in (10, 11, 12, 1, 2, 3)), int(r.date.month in (6, 7, 8, 9)))
        assert r.month_sin == pytest.approx(math.sin(r.date.month * math.pi / 6)) and r.month_cos == pytest.approx(math.cos(r.date.month * math.pi / 6))
        assert r.drought_flag == int(r.rainfall_roll_10d < 1)
        ratio = r.futures_price / r.modal_price
        assert r.futures_roll_signal == (1 if ratio > 1.05 else -1 if ratio < 0.95 else 0)


def test_series_do_not_touch_each_other(spark, features):
    alone = {(r.mandi, r.date): r for r in engineer_features(table(spark, "gaps")).collect()}
    assert alone == {k: v for k, v in features.items() if k[0] == "gaps"}


def test_dates_as_text_in_any_order(spark, features):
    text = table(spark, "flat").withColumn("date", F.col("date").cast("string")).orderBy(F.rand(8))
    again = {(r.mandi, r.date): r for r in engineer_features(text).collect()}
    assert again.keys() == {k for k in features if k[0] == "flat"}
    for key, row in again.items():
        assert [float(row[c]) for c in K.FEATURE_NAMES] == pytest.approx([float(features[key][c]) for c in K.FEATURE_NAMES])


def test_announcement_days_and_the_rise_on_them(spark):
    rows = market("m", 112)
    place = 3 + K.MERGED_COLUMNS.index("msp")
    rows = [(*r[:place], 500.0 if i < 103 else 540.0, *r[place + 1 :]) for i, r in enumerate(rows)]
    day = lambda i: rows[i][2]
    told = spark.createDataFrame([("tur", day(103)), ("tur", day(60)), ("gram", day(108))], "crop string, announced_on date")
    got = {r.date: r for r in engineer_features(table(spark, rows=rows), told).collect()}
    since = [got[day(i)].days_since_msp_announcement for i in range(100, 112)]
    assert since == [40, 41, 42, 0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert [round(got[day(i)].msp_hike_pct, 9) for i in (102, 103, 104, 108)] == [0, 8, 0, 0]


def test_a_price_that_stands_still(spark):
    place = 3 + K.MERGED_COLUMNS.index("modal_price")
    rows = [(*r[:place], 700.0, *r[place + 1 :]) for r in market("m", 95)]
    got = engineer_features(table(spark, rows=rows)).collect()
    assert len(got) == 5 and {r.cbot_correlation_14d for r in got} == {0.0}


def test_a_price_of_zero_costs_the_rows_that_divide_by_it(spark):
    place = 3 + K.MERGED_COLUMNS.index("modal_price")
    rows = [(*r[:place], 0.0 if i == 99 else r[place], *r[place + 1 :]) for i, r in enumerate(market("m", 110))]
    days = {r.date for r in engineer_features(table(spark, rows=rows)).collect()}
    assert {i for i in range(90, 110) if rows[i][2] not in days} == {99, 106}


def test_week_53(spark):
    one = spark.createDataFrame([(dt.date(2026, 12, 30),)], "d date").select(*week_cycle(F.col("d"))).first()
    assert tuple(one) == pytest.approx((math.sin(53 * math.pi / 26), math.cos(53 * math.pi / 26)))
