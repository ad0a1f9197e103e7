"""Group aggregates: scores, leaderboards, intervals, trend, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from furrow.functions.stats import z_score
from furrow.operators.series import SERIES, in_order


def history_summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Minimum, maximum and rounded mean of the known prices."""
    return (
        df.filter(F.col("modal_price").isNotNull())
        .groupBy(*(keys or SERIES))
        .agg(
            F.min("modal_price").alias("min_price"),
            F.max("modal_price").alias("max_price"),
            F.bround(F.avg("modal_price"), 0).alias("avg_price"),
        )
    )


def max_id_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("id").alias("max_id"))


def minmax_scale(
    df: DataFrame, columns: list[str], keys: list[str] | None = None, fit_on: Column | None = None
) -> DataFrame:
    """Scale columns to [0, 1] per series; a constant column becomes 0.

    ``fit_on`` restricts which rows define the range (training rows only, to
    avoid leaking the test range); by default all rows do.
    """
    part = Window.partitionBy(*(keys or SERIES))
    used = F.lit(True) if fit_on is None else fit_on
    out = {}
    for c in columns:
        low = F.min(F.when(used, F.col(c))).over(part)
        high = F.max(F.when(used, F.col(c))).over(part)
        out[f"{c}_min"], out[f"{c}_max"] = low, high
    scaled = {
        f"{c}_scaled": F.coalesce(
            F.try_divide(
                F.col(c) - F.col(f"{c}_min"), F.col(f"{c}_max") - F.col(f"{c}_min")
            ),
            F.lit(0.0),
        )
        for c in columns
    }
    return df.withColumns(out).withColumns(scaled)


def minmax_inverse(scaled: Column, low: Column, high: Column) -> Column:
    return scaled * (high - low) + low


def forecast_errors(
    predictions: DataFrame, keys: list[str], order: str = "date"
) -> DataFrame:
    """RMSE, MAE, MAPE, direction and coverage per group, unrounded.

    ``predictions``: keys, ``order``, actual, predicted, lower_bound,
    upper_bound.  A group is one series under one model (daily grain).
    """
    spec = in_order(keys, order)
    step = {
        "_da": F.signum(F.col("actual") - F.lag("actual", 1).over(spec)),
        "_dp": F.signum(F.col("predicted") - F.lag("predicted", 1).over(spec)),
    }
    err = F.col("actual") - F.col("predicted")
    return (
        predictions.withColumns(step)
        .groupBy(*keys)
        .agg(
            F.sqrt(F.avg(err * err)).alias("rmse"),
            F.avg(F.abs(err)).alias("mae"),
            mape(F.col("actual"), F.col("predicted")).alias("mape"),
            direction(F.col("_da"), F.col("_dp")).alias("directional_accuracy"),
            coverage(F.col("actual"), F.col("lower_bound"), F.col("upper_bound")).alias(
                "pi_coverage_95"
            ),
            F.count(F.lit(1)).alias("n"),
        )
    )


def mape(actual: Column, predicted: Column) -> Column:
    """Mean absolute percentage error over non-zero actuals; 0 if none."""
    part = F.when(actual != 0, F.abs((actual - predicted) / actual))
    return F.coalesce(F.avg(part) * 100, F.lit(0.0))


def direction(actual_step: Column, predicted_step: Column) -> Column:
    """Share of steps with the right sign; 50 without any step."""
    hit = F.when(actual_step.isNotNull(), (actual_step == predicted_step).cast("double"))
    return F.coalesce(F.avg(hit) * 100, F.lit(50.0))


def coverage(actual: Column, lower: Column, upper: Column) -> Column:
    """Share of actuals inside the bounds; 0 without bounds."""
    inside = F.coalesce(((actual >= lower) & (actual <= upper)).cast("double"), F.lit(0.0))
    return F.avg(inside) * 100


METRICS = ["rmse", "mae", "mape", "directional_accuracy", "pi_coverage_95", "training_time_s"]


def leaderboard(evaluations: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Mean of every metric per model."""
    return evaluations.groupBy("model_name").agg(
        *[F.avg(m).alias(m) for m in (metrics or METRICS)]
    )


def leaderboard_best(board: DataFrame, model_order: list[str]) -> DataFrame:
    """Best model per metric: lowest error, highest accuracy; ties go to the
    model listed first.  The board has one row per model."""
    place = F.array_position(F.array(*[F.lit(m) for m in model_order]), F.col("model_name"))
    row = board.withColumn("_place", place)
    picks = {}
    for metric in ("rmse", "mae", "mape"):
        picks[metric] = F.min_by("model_name", F.struct(F.col(metric), F.col("_place")))
    for metric in ("directional_accuracy", "pi_coverage_95"):
        picks[metric] = F.min_by("model_name", F.struct(-F.col(metric), F.col("_place")))
    best = row.agg(*[c.alias(m) for m, c in picks.items()])
    return best.unpivot([], list(picks), "metric", "best_model")


def pivot_mean(
    evaluations: DataFrame, row: str, column: str, values: list, metric: str = "rmse"
) -> DataFrame:
    """Mean metric as row x column table with an explicit column list."""
    return evaluations.groupBy(row).pivot(column, values).agg(F.avg(metric))


def improvement_over(evaluations: DataFrame, baseline: str) -> DataFrame:
    """Percent RMSE gain of each other model over a baseline model; without a
    baseline the mean over models stands in."""
    board = evaluations.groupBy("model_name").agg(F.avg("rmse").alias("rmse"))
    reference = board.agg(
        F.coalesce(
            F.max(F.when(F.col("model_name") == baseline, F.col("rmse"))), F.avg("rmse")
        )
    ).scalar()
    return (
        board.withColumn("baseline_rmse", reference)
        .filter(F.col("model_name") != baseline)
        .withColumn(
            "improvement_pct",
            (F.col("baseline_rmse") - F.col("rmse")) / F.col("baseline_rmse") * 100,
        )
    )


def ensemble_interval(
    draws: DataFrame, keys: list[str], value: str, confidence: float = 0.95
) -> DataFrame:
    """Mean and normal interval of repeated draws (population spread)."""
    z = z_score(confidence)
    return (
        draws.groupBy(*keys)
        .agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
        .withColumn("lower_bound", F.col("mean") - z * F.col("std"))
        .withColumn("upper_bound", F.col("mean") + z * F.col("std"))
    )


def residual_interval(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Prediction +/- 1.96 residual spreads; 5 % of the mean for one row."""
    part = Window.partitionBy(*keys)
    spread = F.when(
        F.count(F.lit(1)).over(part) > 1,
        F.stddev_pop(F.col("actual") - F.col("predicted")).over(part),
    ).otherwise(F.avg("predicted").over(part) * 0.05)
    return predictions.withColumn("spread", spread).withColumns(
        {
            "lower_bound": F.col("predicted") - 1.96 * F.col("spread"),
            "upper_bound": F.col("predicted") + 1.96 * F.col("spread"),
        }
    )


def linear_trend(tail: DataFrame, value: str = "modal_price") -> DataFrame:
    """Least-squares line of a value against its position in the series."""
    return (
        tail.withColumn("_x", F.row_number().over(in_order()) - 1)
        .groupBy(*SERIES)
        .agg(
            F.regr_slope(F.col(value), F.col("_x")).alias("slope"),
            F.regr_intercept(F.col(value), F.col("_x")).alias("intercept"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def step_volatility(tail: DataFrame, value: str = "modal_price") -> DataFrame:
    """Sample spread of the steps; 3 % of the mean when undefined or zero."""
    step = F.col(value) - F.lag(value, 1).over(in_order())
    return (
        tail.withColumn("_step", step)
        .groupBy(*SERIES)
        .agg(F.stddev_samp("_step").alias("_s"), F.avg(value).alias("_mean"))
        .select(
            *SERIES,
            F.when(F.col("_s").isNull() | (F.col("_s") == 0), F.col("_mean") * 0.03)
            .otherwise(F.col("_s"))
            .alias("volatility"),
        )
    )


def attribution_importance(attributions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean |attribution| over the steps of a sample, then over samples.

    ``attributions``: keys, sample, step, feature, attribution.
    """
    keys = keys or []
    per_sample = attributions.groupBy(*keys, "sample", "feature").agg(
        F.avg(F.abs("attribution")).alias("_m")
    )
    return per_sample.groupBy(*keys, "feature").agg(F.avg("_m").alias("importance"))


def attribution_signed(attributions: DataFrame) -> DataFrame:
    """Signed mean over the steps of each sample."""
    return attributions.groupBy("sample", "feature").agg(
        F.avg("attribution").alias("contribution")
    )


def cv_score(folds: DataFrame, keys: list[str], score: str = "rmse") -> DataFrame:
    """Mean over folds of each fold's best score; infinity without folds.

    ``folds``: keys, fold, score (NULL fold for a skipped configuration).
    """
    best = folds.groupBy(*keys, "fold").agg(F.min(score).alias("_best"))
    return best.groupBy(*keys).agg(
        F.coalesce(F.avg("_best"), F.lit(float("inf"))).alias("score")
    )


def horizon_mean(forecast: DataFrame) -> DataFrame:
    """Mean forecast over the horizon of each series."""
    return forecast.groupBy(*SERIES).agg(F.avg("predicted_price").alias("avg_predicted_price"))


def run_status(runs: DataFrame) -> DataFrame:
    """Classify finished runs as promoted, skipped or failed."""
    return runs.withColumn(
        "outcome",
        F.when(F.col("status") == "failed", "failed")
        .when(F.col("model_promoted"), "promoted")
        .otherwise("skipped"),
    )


def run_names(runs: DataFrame, size: int = 100) -> DataFrame:
    """Names of a whole run by outcome: (outcome, part, total, names).

    A row lists about ``size`` of an outcome's distinct "crop @ market" names in
    order, dealt by a hash of the name, so that no row gathers a run's names; an
    outcome without names reads 'None'.
    """
    name = F.concat_ws(" @ ", "crop", "mandi")
    done = run_status(runs).select("outcome", name.alias("name")).distinct()
    totals = done.groupBy("outcome").agg(F.count(F.lit(1)).alias("total"))
    dealt = done.join(totals, "outcome").withColumn("parts", F.ceil(F.col("total") / size).cast("bigint"))
    dealt = dealt.withColumn("part", F.conv(F.substring(F.md5("name"), 1, 7), 16, 10).cast("bigint") % F.col("parts"))
    listed = dealt.groupBy("outcome", "part", "total").agg(F.sort_array(F.collect_list("name")).alias("_n"))
    every = runs.sparkSession.createDataFrame([(o,) for o in ("promoted", "skipped", "failed")], "outcome string")
    return every.join(listed, "outcome", "left").select(
        "outcome", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce(F.array_join("_n", ", "), F.lit("None")).alias("names"),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Counts and ordered market names per crop and outcome, with the total of
    the outcome; a missing outcome reads 'None'.

    Names are listed per crop (its distinct markets), so no row gathers the
    names of the whole run.
    """
    done = run_status(runs)
    names = (
        done.groupBy("crop", "outcome")
        .agg(F.count(F.lit(1)).alias("runs"), F.sort_array(F.collect_set("mandi")).alias("_m"))
        .select("crop", "outcome", "runs", F.array_join("_m", ", ").alias("markets"))
    )
    frame = done.select("crop").distinct().withColumn(
        "outcome", F.explode(F.array(*[F.lit(o) for o in ("promoted", "skipped", "failed")]))
    )
    totals = names.groupBy("outcome").agg(F.sum("runs").alias("total"))
    return (
        frame.join(names, ["crop", "outcome"], "left")
        .join(totals, "outcome", "left")
        .select(
            "crop", "outcome",
            F.coalesce("runs", F.lit(0)).alias("runs"),
            F.coalesce("markets", F.lit("None")).alias("markets"),
            F.coalesce("total", F.lit(0)).alias("total"),
        )
    )


def top_by(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows of an ordering (TakeOrdered: no full sort)."""
    return df.orderBy(*order).limit(n)


def ranked(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """1..n rank inside each key, where a key holds the fixed feature set."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best_config(configs: DataFrame, crops: DataFrame, defaults: dict) -> DataFrame:
    """Lowest-RMSE configuration per crop; defaults where a crop has none."""
    fields = list(defaults)
    best = (
        configs.groupBy(F.lower("crop").alias("_key"))
        .agg(F.min(F.struct("rmse", "id", *fields)).alias("_best"))
    )
    return (
        crops.select("crop").distinct()
        .join(best, F.lower("crop") == F.col("_key"), "left")
        .select(
            "crop", F.col("_best.rmse").alias("rmse"),
            *[F.coalesce(F.col(f"_best.{f}"), F.lit(defaults[f])).alias(f) for f in fields],
        )
    )


def latest_topk(explanations: DataFrame, k: int = 10) -> DataFrame:
    """Rows of the newest date per crop with stored rank up to ``k``."""
    newest = explanations.groupBy("crop").agg(F.max("prediction_date").alias("prediction_date"))
    return explanations.filter(F.col("rank") <= k).join(
        newest, ["crop", "prediction_date"], "left_semi"
    )


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 7) -> DataFrame:
    """Repeatable random order: by a seeded hash of the row's key."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)


def champion_challenger(
    challengers: DataFrame, champions: DataFrame, margin: float = 0.02
) -> DataFrame:
    """Promote a challenger that beats the champion by more than ``margin``;
    without a champion it is promoted at 100 %."""
    gain = F.try_divide(F.col("rmse_before") - F.col("rmse_after"), F.col("rmse_before"))
    return (
        challengers.join(champions, SERIES, "left")
        .withColumn("model_promoted", F.coalesce(gain > margin, F.lit(True)))
        .withColumn("improvement_pct", F.coalesce(F.bround(gain * 100, 2), F.lit(100.0)))
    )
