"""Trend-plus-seasonal forecasts for all series in one plan.

The last (at most 90) prices of a series are gathered into one short array and
every step of the decomposition is array arithmetic on it, so the whole
forecast costs a single shuffle on the series key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from furrow import constants as K
from furrow.functions import arrays as A, numbers
from furrow.operators.series import SERIES, as_of_column

TAIL = 90
MIN_POINTS = 14


def future_dates(series: DataFrame, as_of: Column, horizon: int) -> DataFrame:
    """as_of + 1 ... as_of + horizon for every series."""
    return series.select(*SERIES, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).withColumn(
        "date", F.date_add(as_of, F.col("step"))
    )


def last_known(prices: DataFrame) -> DataFrame:
    """Latest known price per series, else the support price, else 2000."""
    last = prices.groupBy(*SERIES).agg(
        F.max_by("modal_price", F.when(F.col("modal_price").isNotNull(), F.col("date"))).alias("_p")
    )
    fallback = F.coalesce(numbers.support_price(F.col("crop")), F.lit(K.DEFAULT_PRICE))
    return last.select(*SERIES, F.coalesce("_p", fallback).alias("current_price"))


def tails(prices: DataFrame, n: int = TAIL) -> DataFrame:
    """Per series: ``y`` (last known prices, oldest first) and their count.

    The row_number filter prunes map-side, so at most ``n`` rows per series and
    map task reach the shuffle.
    """
    known = F.col("modal_price").isNotNull()
    newest = Window.partitionBy(*SERIES).orderBy(known.desc(), F.col("date").desc())
    return (
        prices.select(*SERIES, "date", "modal_price")
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= n)
        .groupBy(*SERIES)
        .agg(F.sort_array(F.collect_list(F.when(known, F.struct("date", "modal_price")))).alias("_t"))
        .select(*SERIES, F.transform("_t", lambda r: r["modal_price"]).alias("y"))
        .withColumn("n", F.size("y"))
    )


def decompose(tail: DataFrame) -> DataFrame:
    """Add period, trend and the centred seasonal profile to ``tails`` rows.

    Additive decomposition: centred moving average (half weights at both ends
    for an even period), its ends extended along the line through the nearest
    ``period`` trend points, then the mean detrended value of each phase.
    Series under 14 points get empty arrays.
    """
    long_enough = F.col("n") >= MIN_POINTS
    empty = A.empty()
    y, n, period, half = F.col("y"), F.col("n"), F.col("period"), F.col("_half")

    def moving(i: Column) -> Column:
        around = A.total(F.slice(y, i - half + 1, 2 * half + 1))
        ends = F.get(y, i - half) + F.get(y, i + half)
        return (around - F.when(period % 2 == 0, ends * 0.5).otherwise(0.0)) / period

    df = tail.withColumn(
        "period", F.greatest(F.lit(2), F.least(F.lit(7), F.floor(n / 3).cast("int")))
    ).withColumn("_half", F.floor(period / 2).cast("int"))
    last = n - 1 - half
    df = df.withColumn(
        "_mid", F.when(long_enough, F.transform(F.sequence(half, last), moving)).otherwise(empty)
    )
    head_points = F.least(half + period, last) - half
    back_first = F.greatest(half, last - period)
    mid = F.col("_mid")
    df = df.withColumns(
        {
            "_head": F.when(long_enough, A.fit_line(F.slice(mid, 1, head_points), half)),
            "_tail": F.when(
                long_enough,
                A.fit_line(F.slice(mid, back_first - half + 1, last - back_first), back_first),
            ),
        }
    )
    df = df.withColumn(
        "trend",
        F.when(
            long_enough,
            F.concat(
                A.line_values(F.col("_head"), F.lit(0), half),
                mid,
                A.line_values(F.col("_tail"), last + 1, half),
            ),
        ).otherwise(empty),
    )
    df = df.withColumn("_detrended", F.zip_with(y, "trend", lambda a, b: a - b))

    def phase_mean(p: Column) -> Column:
        same = F.filter("_detrended", lambda v, i: i % period == p)
        return A.total(same) / F.size(same)

    df = df.withColumn(
        "_phases",
        F.when(long_enough, F.transform(F.sequence(F.lit(0), period - 1), phase_mean)).otherwise(empty),
    )
    centre = A.total(F.col("_phases")) / period
    return df.withColumn("seasonal", F.transform("_phases", lambda v: v - centre)).drop(
        "_half", "_mid", "_head", "_tail", "_detrended", "_phases"
    )


def seasonal_profile(prices: DataFrame) -> DataFrame:
    """Long rows (series, period, phase, seasonal) of the last 90 prices."""
    # an outer explode: the inner one infers filters on its input, and pushing
    # them down would repeat the whole decomposition inside the filter
    return (
        decompose(tails(prices))
        .select(*SERIES, "period", F.posexplode_outer("seasonal").alias("phase", "seasonal"))
        .filter(F.col("phase").isNotNull())
    )


def fit_tails(tail: DataFrame) -> DataFrame:
    """Add trend line, step spread, seasonal profile and last price to rows
    with an array ``y`` of ``n`` prices; the array itself is dropped."""
    y, n = F.col("y"), F.col("n")
    return (
        decompose(tail)
        .withColumn("_line", F.when(n >= MIN_POINTS, A.fit_line(y, F.lit(0))))
        .withColumn("_vol", F.when(n >= MIN_POINTS, A.step_spread(y, n)))
        .withColumn("_last", F.try_element_at(y, F.lit(-1)))
        .drop("trend", "y")
    )


def projection(step: Column, aligned: bool = False) -> tuple[Column, Column, Column]:
    """(predicted, lower, upper) ``step`` days ahead on ``fit_tails`` columns.

    Under 14 known prices the forecast is flat at the last price with a 5 %
    band.  By default the phase counts from the series start and wraps at its
    length, and the trend continues one position late; ``aligned`` puts both on
    the day after the last observation.
    """
    n, period, last = F.col("n"), F.col("period"), F.col("_last")
    position = n - 1 + step if aligned else n + step
    phase = position % period if aligned else F.try_mod(position, n) % period
    point = (
        F.col("_line.slope") * position + F.col("_line.intercept") + F.get(F.col("seasonal"), phase)
    )
    width = 1.96 * F.col("_vol") * F.sqrt(step)
    long_enough = n >= MIN_POINTS
    return (
        F.when(long_enough, point).otherwise(last),
        F.when(long_enough, point - width).otherwise(last * 0.95),
        F.when(long_enough, point + width).otherwise(last * 1.05),
    )


def baseline_forecast(
    prices: DataFrame, horizon: int = 30, as_of=None, aligned: bool = False, digits: int | None = 2
) -> DataFrame:
    """Trend plus season for ``horizon`` days after ``as_of``, every series."""
    step = F.col("step")
    days = (
        fit_tails(tails(prices))
        .withColumn("_last", F.coalesce("_last", F.lit(K.DEFAULT_PRICE)))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .withColumn("date", F.date_add(as_of_column(prices, as_of), step))
    )
    names = ["predicted_price", "lower_bound", "upper_bound"]
    values = projection(step, aligned)
    if digits is not None:
        values = tuple(numbers.display_round(v, digits) for v in values)
    return days.select(*SERIES, "step", "date", *[v.alias(c) for v, c in zip(values, names)])


def hashed_draw(*parts: Column | str, below: Column) -> Column:
    """A whole number from 0 to ``below`` - 1, drawn by hashing a counter.

    The draw depends on its parts alone, so it is the same on every engine, in
    any order and on every retry.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % below


def bootstrap_draws(
    prices: DataFrame, horizon: int = 30, as_of=None, draws: int = 50, block: int = 7
) -> DataFrame:
    """(series, step, date, draw, value): ``draws`` paths around the forecast.

    A path adds up day-to-day changes of the series' tail, less their mean, drawn
    in blocks of ``block`` consecutive days, so that a week's pattern stays
    together. Series under 14 known prices have no paths.
    """
    y, n = F.col("y"), F.col("n")
    steps = F.zip_with(F.slice(y, 2, n - 1), F.slice(y, 1, n - 1), lambda b, a: b - a)
    changes = tails(prices).filter(n >= MIN_POINTS).select(*SERIES, (n - 1).alias("_m"), steps.alias("_steps"))
    changes = changes.withColumn("_mean", A.total(F.col("_steps")) / F.col("_m"))
    base = baseline_forecast(prices, horizon, as_of, digits=None).select(*SERIES, "step", "date", "predicted_price")
    rows = base.join(changes, SERIES).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    place = F.col("step") - 1
    start = hashed_draw(*SERIES, F.col("draw"), F.floor(place / block), below=F.col("_m"))
    change = F.col("_steps")[((start + place % block) % F.col("_m")).cast("int")] - F.col("_mean")
    path = Window.partitionBy(*SERIES, "draw").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    slim = rows.select(*SERIES, "step", "date", "draw", "predicted_price", change.alias("_change"))
    return slim.select(*SERIES, "step", "date", "draw", (F.col("predicted_price") + F.sum("_change").over(path)).alias("value"))


def next_prices(prices: DataFrame) -> DataFrame:
    """Newest known price and the next day's forecast, one row per series."""
    fitted = fit_tails(tails(prices)).withColumn("_last", F.coalesce("_last", F.lit(K.DEFAULT_PRICE)))
    return fitted.select(
        *SERIES, F.col("_last").alias("current_price"), projection(F.lit(1))[0].alias("next_price")
    )


def flat_forecast(levels: DataFrame, horizon: int, as_of: Column) -> DataFrame:
    """Flat projection of ``current_price`` with a 5 % band."""
    price = F.col("current_price")
    return (
        levels.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(
            *SERIES, "step", F.date_add(as_of, F.col("step")).alias("date"),
            price.alias("predicted_price"),
            (price - price * 0.05).alias("lower_bound"),
            (price + price * 0.05).alias("upper_bound"),
        )
    )


def extend_horizon(forecast: DataFrame, horizon: int) -> DataFrame:
    """Pad short forecasts: the last mean repeats and the half-width grows 5 %
    per extra day."""
    last = forecast.groupBy(*SERIES).agg(
        F.max_by(
            F.struct("step", "date", "predicted_price", "lower_bound", "upper_bound"), "step"
        ).alias("_l")
    )
    half = (F.col("_l.upper_bound") - F.col("_l.lower_bound")) / 2
    extra = F.col("step") - F.col("_l.step")
    padded = (
        last.filter(F.col("_l.step") < horizon)
        .withColumn("step", F.explode(F.sequence(F.col("_l.step") + 1, F.lit(horizon))))
        .select(
            *SERIES, "step", F.date_add("_l.date", extra).alias("date"),
            F.col("_l.predicted_price").alias("predicted_price"),
            (F.col("_l.predicted_price") - half * F.pow(F.lit(1.05), extra)).alias("lower_bound"),
            (F.col("_l.predicted_price") + half * F.pow(F.lit(1.05), extra)).alias("upper_bound"),
        )
    )
    return forecast.filter(F.col("step") <= horizon).select(padded.columns).unionByName(padded)


def forecast_report(
    prices: DataFrame, horizon: int = 30, as_of=None, floors: DataFrame | None = None,
    requested: DataFrame | None = None,
) -> DataFrame:
    """One row per series: current price, support price, mean forecast, advice
    with its reason, and the forecast days as a nested array.

    ``requested`` may list series without any price row; they are answered flat
    at their support price (or 2000).  ``floors`` (crop, msp) overrides the
    built-in support prices.
    """
    if not 1 <= horizon <= 90:
        raise ValueError("horizon must be between 1 and 90 days")
    levels = last_known(prices)
    days = baseline_forecast(prices, horizon, as_of)
    if requested is not None:
        fallback = F.coalesce(numbers.support_price(F.col("crop")), F.lit(K.DEFAULT_PRICE))
        unseen = (
            requested.select(*SERIES).distinct().join(levels, SERIES, "left_anti")
            .withColumn("current_price", fallback)
        )
        days = days.unionByName(flat_forecast(unseen, horizon, as_of_column(prices, as_of)))
        levels = levels.unionByName(unseen)
    nested = days.groupBy(*SERIES).agg(
        # exact decimal mean of the displayed prices, independent of row order
        F.bround(F.avg(F.col("predicted_price").cast("decimal(18,2)")), 2)
        .cast("double")
        .alias("avg_predicted_price"),
        F.sort_array(
            F.collect_list(F.struct("date", "predicted_price", "lower_bound", "upper_bound"))
        ).alias("forecast"),
    )
    report = nested.join(levels, SERIES)
    if floors is None:
        report = report.withColumn("msp", numbers.support_price(F.col("crop")))
    else:
        report = report.join(floors.select("crop", "msp"), "crop", "left")
    average, msp = F.col("avg_predicted_price"), F.col("msp")
    return report.select(
        *SERIES,
        F.lit(horizon).alias("horizon_days"),
        numbers.display_round(F.col("current_price")).alias("current_price"),
        "msp", "avg_predicted_price",
        numbers.advice(average, msp).alias("recommendation"),
        numbers.advice_reason(F.col("crop"), average, msp).alias("recommendation_reason"),
        "forecast",
    )
