"""Row-based window operators over date-ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from furrow import constants as K
from furrow.operators.series import SERIES, in_order


def rolling(aggregate, value: Column, width: int, spec: WindowSpec) -> Column:
    """Aggregate over the last ``width`` rows; NULL until all are present."""
    frame = spec.rowsBetween(-(width - 1), 0)
    return F.when(F.count(value).over(frame) == width, aggregate(value).over(frame))


def lag_columns(value: str, prefix: str, lags: list[int], spec: WindowSpec) -> dict[str, Column]:
    return {f"{prefix}_lag_{k}": F.lag(value, k).over(spec) for k in lags}


def roll_columns(value: str, prefix: str, widths: list[int], spec: WindowSpec) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for w in widths:
        out[f"{prefix}_rmean_{w}"] = rolling(F.avg, F.col(value), w, spec)
        out[f"{prefix}_rstd_{w}"] = rolling(F.stddev_samp, F.col(value), w, spec)
    return out


def price_lags(df: DataFrame) -> DataFrame:
    return df.withColumns(lag_columns("modal_price", "price", K.PRICE_LAGS, in_order()))


def price_roll(df: DataFrame) -> DataFrame:
    return df.withColumns(roll_columns("modal_price", "price", K.ROLL_WINDOWS, in_order()))


def arrivals_lags(df: DataFrame) -> DataFrame:
    return df.withColumns(lag_columns("arrivals_tonnes", "arrivals", K.ARRIVAL_LAGS, in_order()))


def arrivals_roll(df: DataFrame) -> DataFrame:
    return df.withColumns(roll_columns("arrivals_tonnes", "arrivals", K.ROLL_WINDOWS, in_order()))


def rain_roll(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "rainfall_roll_10d", rolling(F.sum, F.col("rainfall_mm"), 10, in_order())
    )


def momentum(value: str, rows: int, spec: WindowSpec) -> Column:
    before = F.lag(value, rows).over(spec)
    return F.try_divide(F.col(value) - before, before) * 100


def day_on_day(value: str, spec: WindowSpec) -> Column:
    """Relative change against the previous row."""
    before = F.lag(value, 1).over(spec)
    return F.try_divide(F.col(value) - before, before)


def rolling_corr(x: Column, y: Column, width: int, spec: WindowSpec) -> Column:
    """Rolling Pearson correlation; 0 where undefined (short or constant)."""
    frame = spec.rowsBetween(-(width - 1), 0)
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    corr = F.try_divide(
        F.covar_samp(xs, ys).over(frame),
        F.stddev_samp(xs).over(frame) * F.stddev_samp(ys).over(frame),
    )
    full = F.count(xs).over(frame) == width
    return F.coalesce(F.when(full, corr), F.lit(0.0))


def spot_futures_corr(df: DataFrame, width: int = 14) -> DataFrame:
    spec = in_order()
    return (
        df.withColumns(
            {
                "_spot": day_on_day("modal_price", spec),
                "_futures": day_on_day("futures_price", spec),
            }
        )
        .withColumn(
            "cbot_correlation_14d", rolling_corr(F.col("_spot"), F.col("_futures"), width, spec)
        )
        .drop("_spot", "_futures")
    )


def temp_roll(df: DataFrame) -> DataFrame:
    mean = (F.col("max_temp") + F.col("min_temp")) / 2
    return df.withColumn("temp_rmean_7", rolling(F.avg, mean, 7, in_order()))


def arrivals_share(df: DataFrame) -> DataFrame:
    total = rolling(F.sum, F.col("arrivals_tonnes"), 30, in_order())
    share = F.try_divide(F.col("arrivals_tonnes"), total)
    return df.withColumn("arrivals_market_share", F.coalesce(share, F.lit(0.0)))


def first_difference(df: DataFrame, value: str = "modal_price") -> DataFrame:
    """Change against the previous row; the leading row of a series is dropped."""
    change = F.col(value) - F.lag(value, 1).over(in_order())
    return df.withColumn("diff", change).filter(F.col("diff").isNotNull())


def sequence_windows(
    df: DataFrame, length: int, horizon: int, value: str = "modal_price"
) -> DataFrame:
    """Sliding inputs of ``length`` rows with the ``horizon`` values after them.

    Targets start strictly after the window, so no input row leaks into them.
    """
    spec = in_order()
    return (
        df.withColumns(
            {
                "x": F.collect_list(value).over(spec.rowsBetween(-(length - 1), 0)),
                "y": F.collect_list(value).over(spec.rowsBetween(1, horizon)),
            }
        )
        .filter((F.size("x") == length) & (F.size("y") == horizon))
        .select(*SERIES, "date", "x", "y")
    )


def multi_lead(df: DataFrame, steps: int, value: str = "modal_price") -> DataFrame:
    """Targets lead(0..steps-1) as columns; rows without all of them dropped."""
    spec = in_order()
    return (
        df.withColumns({f"y_{i}": F.lead(value, i).over(spec) for i in range(steps)})
        .withColumn("_row", F.lead("date", steps - 1).over(spec))
        .filter(F.col("_row").isNotNull())
        .drop("_row")
    )


def running_contribution(df: DataFrame, base: Column, top: int = 15) -> DataFrame:
    """Waterfall geometry: bars start where the previous one ended.

    ``df`` has (sample, feature, contribution); the feature list per sample is
    the fixed feature set, so the window partition is small by construction.
    """
    order = Window.partitionBy("sample").orderBy(F.abs("contribution").desc(), "feature")
    before = F.sum("contribution").over(order.rowsBetween(-top, -1))
    return (
        df.withColumn("rank", F.row_number().over(order))
        .withColumn("bar_start", base + F.coalesce(before, F.lit(0.0)))
        .filter(F.col("rank") <= top)
        .withColumn("bar_end", F.col("bar_start") + F.col("contribution"))
    )


def price_changes(df: DataFrame, keys: list[str], order: str, price: str) -> DataFrame:
    """Rows whose price differs from the previous one of the key."""
    before = F.lag(price, 1).over(in_order(keys, order))
    return df.withColumn("previous_price", before).filter(
        F.col("previous_price").isNull() | (F.col(price) != F.col("previous_price"))
    )


def rmse_degradation(
    gauge: DataFrame, keys: list[str], days: int = 7, factor: float = 1.1, hold_seconds: int = 3600
) -> DataFrame:
    """Alert samples of a gauge (keys, ts, rmse): above ``factor`` x its trailing
    mean, continuously for ``hold_seconds``.

    The gauge must be sampled on a fixed grid (``ops.sample_gauge``), which
    bounds a label's partition by elapsed time instead of by event volume.
    """
    seconds = F.unix_timestamp("ts")
    spec = in_order(keys, "_s")
    return (
        gauge.withColumn("_s", seconds)
        .withColumn("trailing_mean", F.avg("rmse").over(spec.rangeBetween(-days * 86400, 0)))
        .withColumn("breach", F.col("rmse") > factor * F.col("trailing_mean"))
        .withColumn("_held", F.bool_and("breach").over(spec.rangeBetween(-hold_seconds, 0)))
        .withColumn("_first", F.min("_s").over(spec.rangeBetween(-hold_seconds, 0)))
        .withColumn("firing", F.col("_held") & (F.col("_first") <= F.col("_s") - hold_seconds))
        .drop("_s", "_held", "_first")
    )
