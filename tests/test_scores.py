"""Scores, splits, selection and attribution on tiny frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow import constants as K
from furrow.operators import aggregates as A, joins, splits, windows as W
from furrow.plans import backtest, learn

START = dt.date(2024, 1, 1)


def dated(values, crop="w", mandi="m"):
    return [(crop, mandi, START + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]


PRICES = "crop string, mandi string, date date, modal_price double"


def test_error_edge_cases(spark):
    rows = [
        ("one", START, 10.0, 9.0, 8.0, 11.0),
        ("zero", START, 0.0, 1.0, None, None), ("zero", START + dt.timedelta(1), 4.0, 2.0, None, None),
    ]
    df = spark.createDataFrame(rows, "k string, date date, actual double, predicted double, lower_bound double, upper_bound double")
    out = {r.k: r for r in A.forecast_errors(df, ["k"]).collect()}
    assert out["one"].directional_accuracy == 50 and out["one"].pi_coverage_95 == 100 and out["one"].mape == 10
    assert out["zero"].mape == 50 and out["zero"].pi_coverage_95 == 0 and out["zero"].directional_accuracy == 100
    assert out["zero"].rmse == pytest.approx(np.sqrt(2.5))


def test_promotion_margin(spark):
    new = spark.createDataFrame([("a", "m", 98.0), ("b", "m", 97.0), ("c", "m", 5.0)], "crop string, mandi string, rmse_after double")
    old = spark.createDataFrame([("a", "m", 100.0), ("b", "m", 100.0)], "crop string, mandi string, rmse_before double")
    out = {r.crop: (r.model_promoted, r.improvement_pct) for r in A.champion_challenger(new, old).collect()}
    assert out == {"a": (False, 2.0), "b": (True, 3.0), "c": (True, 100.0)}


def test_scaling_constant_and_train_only(spark):
    df = spark.createDataFrame(dated([1, 2, 3, 10]), PRICES).withColumn("c", F.lit(5.0))
    out = A.minmax_scale(df, ["modal_price", "c"]).orderBy("date").collect()
    assert [r.c_scaled for r in out] == [0.0] * 4 and out[-1].modal_price_scaled == 1.0
    train = A.minmax_scale(df, ["modal_price"], fit_on=F.col("modal_price") < 4).orderBy("date").collect()
    assert train[2].modal_price_scaled == 1.0 and train[3].modal_price_scaled == 4.5


def test_folds_match_the_block_rule(spark):
    n, k = 23, 3
    rows = splits.split_ts_folds(spark.createDataFrame(dated(range(n)), PRICES), k).collect()
    block = n // (k + 1)
    for f in range(k):
        start = n - (k - f) * block
        val = sorted(r.pos for r in rows if r.fold == f and r.side == "validate")
        train = sorted(r.pos for r in rows if r.fold == f and r.side == "train")
        assert val == list(range(start, start + block)) and train == list(range(start))
    kept = {r.fold for r in splits.split_ts_folds(spark.createDataFrame(dated(range(n)), PRICES), k, 8).collect()}
    assert kept == set()  # blocks of 5 rows are too short


def test_windows_have_no_leak(spark):
    out = W.sequence_windows(spark.createDataFrame(dated(range(12)), PRICES), 4, 3).orderBy("date").collect()
    assert len(out) == 12 - 4 - 3 + 1
    assert out[0].x == [0, 1, 2, 3] and out[0].y == [4, 5, 6]


def test_leaderboard_ties_go_to_the_first_model(spark):
    rows = [(m, 1.0, 1.0, 1.0, 5.0, 5.0) for m in ("b", "a")]
    board = spark.createDataFrame(rows, "model_name string, rmse double, mae double, mape double, directional_accuracy double, pi_coverage_95 double")
    assert {r.best_model for r in A.leaderboard_best(board, ["a", "b"]).collect()} == {"a"}


def test_cv_score_without_folds_is_infinite(spark):
    df = spark.createDataFrame([("c", None, None), ("d", 0, 2.0), ("d", 0, 1.0), ("d", 1, 3.0)], "cfg string, fold int, rmse double")
    out = {r.cfg: r.score for r in A.cv_score(df, ["cfg"]).collect()}
    assert out == {"c": float("inf"), "d": 2.0}


def test_run_summary_and_delta_map(spark):
    runs = spark.createDataFrame(
        [("w", "b", "success", True), ("w", "a", "success", True), ("w", "c", "failed", False)],
        "crop string, mandi string, status string, model_promoted boolean",
    )
    out = {r.outcome: (r.runs, r.markets, r.total) for r in A.run_summary(runs).collect()}
    assert out == {"promoted": (2, "a, b", 2), "skipped": (0, "None", 0), "failed": (1, "c", 1)}
    new = spark.createDataFrame([("w", "f1", 0.5), ("w", "f2", 0.25)], "crop string, feature string, importance double")
    old = spark.createDataFrame([("w", "f1", 0.2)], "crop string, feature string, importance double")
    row = joins.delta_map(joins.importance_delta(new, old, ["crop"]), ["crop"]).first()
    assert row.feature_importance_delta == {"f1": pytest.approx(0.3), "f2": 0.25}


def test_best_config_defaults(spark):
    cfg = spark.createDataFrame([("Wheat", 2, 64, 0.1, 0.01, 30, 16, 5.0), ("wheat", 1, 256, 0.3, 0.01, 90, 16, 4.0)],
                                "crop string, id int, lstm_units int, dropout double, learning_rate double, sequence_length int, batch_size int, rmse double")
    crops = spark.createDataFrame([("WHEAT",), ("Tur",)], "crop string")
    out = {r.crop: (r.lstm_units, r.batch_size) for r in A.best_config(cfg, crops, K.DEFAULT_CONFIG).collect()}
    assert out == {"WHEAT": (256, 16), "Tur": (128, 32)}


@pytest.fixture(scope="module")
def feature_rows(spark):
    rng = np.random.default_rng(1)
    names = K.FEATURE_NAMES
    rows = []
    for m in ("m1", "m2"):
        level = 1000.0
        for i in range(150):
            level += rng.normal(0, 10)
            rows.append(("Wheat" if m == "m1" else "Ragi", m, START + dt.timedelta(days=i),
                         level, *rng.normal(0, 1, len(names) - 1).tolist()))
    schema = "crop string, mandi string, date date, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema).cache()


def test_regression_is_repeatable_and_attribution_adds_up(spark, feature_rows):
    model, scored = learn.regress_forecast(feature_rows, 5)
    again, _ = learn.regress_forecast(feature_rows, 5)
    assert np.allclose(model.coefficients, again.coefficients)
    assert scored.count() > 0
    long = learn.linear_attribution(feature_rows, learn.coefficient_table(spark, model))
    sums = long.groupBy("crop", "mandi", "date").agg(F.sum("attribution").alias("s"))
    means = feature_rows.agg(*[F.avg(c).alias(c) for c in K.FEATURE_NAMES])
    base = means.select(learn.linear_score(model).alias("b")).first().b
    got = feature_rows.withColumn("p", learn.linear_score(model)).join(sums, ["crop", "mandi", "date"])
    worst = got.agg(F.max(F.abs(F.col("p") - F.lit(base) - F.col("s")))).first()[0]
    assert worst < 1e-6


def plain_ridge(x, y, penalty):
    """(coefficients, intercept) by least squares on standardised columns with penalty rows."""
    mean, sd = x.mean(0), x.std(0)
    z = np.where(sd > 0, (x - mean) / np.where(sd > 0, sd, 1), 0)
    n, p = z.shape
    tall = np.vstack([z, np.sqrt(penalty * n) * np.eye(p)])
    w = np.linalg.lstsq(tall, np.r_[y - y.mean(), np.zeros(p)], rcond=None)[0]
    w = np.where(sd > 0, w / np.where(sd > 0, sd, 1), 0)
    return w, y.mean() - w @ mean


def test_all_horizons_from_one_matrix(spark, feature_rows):
    feature_rows = feature_rows.withColumn("is_rabi", F.lit(1.0))  # a constant feature
    model, scored = learn.regress_forecast(feature_rows, [1, 5, 3])
    pdf = feature_rows.toPandas().sort_values(["mandi", "date"])
    for h in (1, 3, 5):
        train = []
        for _, f in pdf.groupby("mandi"):
            f = f.assign(y=f.modal_price.shift(-h), far=f.modal_price.shift(-5)).dropna()
            train.append(f.iloc[: int(len(f) * 0.8) - 5])
        train = pd.concat(train)
        w, b = plain_ridge(train[K.FEATURE_NAMES].to_numpy(), train.y.to_numpy(), 0.1)
        got = scored.filter(F.col("horizon") == h).toPandas().set_index(["mandi", "date"]).predicted
        x = pdf.set_index(["mandi", "date"]).loc[got.index, K.FEATURE_NAMES].to_numpy()
        assert np.allclose(got, x @ w + b, rtol=1e-8) and len(got) == 2 * 29
        if h == 5:
            assert np.allclose(model.coefficients, w, atol=1e-8) and model.coefficients[K.FEATURE_NAMES.index("is_rabi")] == 0
            resid = train.y.to_numpy() - train[K.FEATURE_NAMES].to_numpy() @ w - b
            assert model.rmse == pytest.approx(np.sqrt((resid**2).mean()))


def test_learned_selection_against_plain_folds(spark, feature_rows):
    out = learn.learned_select(feature_rows, 5, [3, 53], [0.01, 1.0]).collect()
    pdf = feature_rows.toPandas().sort_values(["mandi", "date"])
    for r in out:
        errors = []
        for fold in range(3):
            train, check = [], []
            for _, f in pdf.groupby("mandi"):
                f = f.assign(y=f.modal_price.shift(-5)).dropna()
                block = len(f) // 4
                start = len(f) - (3 - fold) * block
                train.append(f.iloc[: start - 5])
                check.append(f.iloc[start : start + block])
            train, check = pd.concat(train), pd.concat(check)
            names = K.FEATURE_NAMES[: r.depth]
            w, b = plain_ridge(train[names].to_numpy(), train.y.to_numpy(), r.penalty)
            errors.append(np.sqrt(((check.y - check[names].to_numpy() @ w - b) ** 2).mean()))
        assert r.score == pytest.approx(np.mean(errors), rel=1e-7) and r.folds == 3
    assert [r.score for r in out if r.best] == [min(r.score for r in out)]
    assert learn.learned_select(feature_rows.filter("false"), 5, [3], [1.0]).count() == 0


def test_transfer_scores_only_the_other_crop(feature_rows):
    _, scored = learn.regress_forecast(feature_rows, 5, fit_crops=K.HIGH_DATA_CROPS, score_crops=K.LOW_DATA_CROPS)
    assert {r.crop for r in scored.select("crop").distinct().collect()} == {"Ragi"}


def test_back_test_with_the_regression(spark):
    """The regression is scored on the same days, learns nothing from them, and fails alone."""
    rng = np.random.default_rng(5)
    n, columns = 400, [c for c in K.MERGED_COLUMNS if c != "modal_price"]
    frames = []
    for mandi in ("A", "B"):
        f = pd.DataFrame({c: rng.uniform(50, 90, n) for c in columns})
        f.insert(0, "modal_price", 100 + np.cumsum(rng.normal(0, 1, n)))
        f.insert(0, "date", pd.date_range("2024-01-01", periods=n).date)
        f.insert(0, "mandi", mandi)
        frames.append(f)
    short = frames[0].head(60).assign(mandi="short")
    prices = spark.createDataFrame(pd.concat([*frames, short]).assign(crop="wheat"))
    stored = learn.stored_features(prices)
    learned = learn.holdout_forecasts(stored, prices, [30])
    rows = {(r.mandi, r.model_name): r for r in backtest.backtest(prices, [30], {"regression": learned}).collect()}
    assert len(rows) == 9
    assert all(rows[m, "regression"].rmse < 100 and rows[m, "regression"].pi_coverage_95 > 0 for m in "AB")
    assert rows["A", "regression"].n_test_samples == rows["A", "naive"].n_test_samples == 60
    assert rows["short", "regression"].rmse == backtest.FAILED  # no feature row reaches its test days
    last = prices.groupBy("mandi").agg(F.max("date").alias("d"))
    spoiled = prices.join(last, "mandi").withColumn(
        "modal_price", F.when(F.col("date") > F.date_sub("d", 30), 1e6).otherwise(F.col("modal_price"))
    )
    other = learn.holdout_forecasts(learn.stored_features(spoiled), spoiled, [30])
    early = F.col("date") <= F.date_sub(F.lit(frames[0].date.max()), 30)
    a, b = ({(r.mandi, r.date): r.predicted for r in x.filter(early).collect()} for x in (learned, other))
    assert a and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)
