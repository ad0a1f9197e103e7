"""Back-test: every series, horizon and model scored in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from furrow.operators.aggregates import forecast_errors
from furrow.operators.series import SERIES, in_order
from furrow.operators.splits import test_size, with_position
from furrow.plans.forecast import TAIL, fit_tails, projection

NAIVE = "naive"
BASELINE = "trend-season"
FAILED = 999.0
KEYS = [*SERIES, "horizon"]
BAND = ["predicted", "lower_bound", "upper_bound"]


def holdouts(prices: DataFrame, horizons: list[int]) -> DataFrame:
    """One row per series and horizon: the training tail ``y``, the test days
    (at most ``horizon``) and both sizes.

    Only the last 90 training rows and the first ``horizon`` test rows of a
    series pass the filter, so the gathered arrays are short; they stay in the
    partition the window already built.
    """
    known = with_position(prices.filter(F.col("modal_price").isNotNull())).withColumn(
        "before", F.lag("modal_price", 1).over(in_order())
    )
    rows = (
        known.select(*SERIES, "date", "modal_price", "before", "pos", "n")
        .withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
        .withColumn("n_test", test_size(F.col("n"), F.col("horizon")))
        .withColumn("n_train", F.col("n") - F.col("n_test"))
        .filter(
            (F.col("pos") >= F.col("n_train") - TAIL)
            & (F.col("pos") < F.greatest(F.col("n_train"), F.lit(0)) + F.col("horizon"))
        )
    )
    is_train = F.col("pos") < F.col("n_train")
    return (
        rows.groupBy(*KEYS)
        .agg(
            F.sort_array(F.collect_list(F.when(is_train, F.struct("date", "modal_price")))).alias("_t"),
            F.sort_array(
                F.collect_list(F.when(~is_train, F.struct("date", "modal_price", "before")))
            ).alias("_days"),
            F.greatest(F.max("n_train"), F.lit(0)).alias("n_train_samples"),
            F.max("n_test").alias("n_test_samples"),
        )
        .withColumn("y", F.transform("_t", lambda r: r["modal_price"]))
        .withColumn("n", F.size("y"))
        .drop("_t")
    )


def _band(point, lower, upper, name: str):
    return F.struct(
        F.lit(name).alias("model_name"),
        point.alias("predicted"), lower.alias("lower_bound"), upper.alias("upper_bound"),
    )


def predictions(prices: DataFrame, horizons: list[int]) -> DataFrame:
    """Test days with both models' forecasts: the walk-forward naive one (the
    previous actual, 5 % band) and trend-plus-season fitted on the training
    tail.  A model that cannot predict leaves NULL."""
    days = fit_tails(holdouts(prices, horizons)).select(
        "*", F.posexplode_outer("_days").alias("_i", "_day")
    )
    before = F.col("_day.before")
    both = F.array(
        _band(before, before * 0.95, before * 1.05, NAIVE),
        _band(*projection(F.col("_i") + 1), BASELINE),
    )
    return (
        days.select(
            *KEYS, "n_train_samples", "n_test_samples", F.col("_day.date").alias("date"),
            F.col("_day.modal_price").alias("actual"), F.explode(both).alias("_m"),
        )
        .select(
            *KEYS, "n_train_samples", "n_test_samples", "date", "actual", "_m.model_name",
            *[F.col(f"_m.{c}").alias(c) for c in BAND],
        )
    )


def with_extra_model(rows: DataFrame, name: str, extra: DataFrame) -> DataFrame:
    """Add another model's forecasts (series, horizon, date, predicted,
    lower_bound, upper_bound) for the same test days."""
    frame = rows.filter(F.col("model_name") == NAIVE).drop("model_name", *BAND)
    added = frame.join(extra.select(*KEYS, "date", *BAND), [*KEYS, "date"], "left")
    return rows.unionByName(added.withColumn("model_name", F.lit(name)))


def backtest(
    prices: DataFrame, horizons: list[int], extra: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Scores per (series, horizon, model); a model without any prediction for
    a grid row gets the failure marks."""
    rows = predictions(prices, horizons)
    for name, other in (extra or {}).items():
        rows = with_extra_model(rows, name, other)
    keys = [*KEYS, "model_name", "n_train_samples", "n_test_samples"]
    usable = F.when(F.col("predicted").isNotNull(), F.col("actual"))
    scores = forecast_errors(rows.withColumn("actual", usable), keys)
    marks = {"rmse": FAILED, "mae": FAILED, "mape": FAILED,
             "directional_accuracy": 0.0, "pi_coverage_95": 0.0}
    failed = F.col("rmse").isNull()
    return scores.select(
        *KEYS, "model_name",
        *[F.when(failed, F.lit(v)).otherwise(F.col(m)).alias(m) for m, v in marks.items()],
        "n_train_samples", "n_test_samples",
    )
