"""The 53-column feature matrix, all series in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from furrow import constants as K
from furrow.functions import dates, numbers
from furrow.operators import windows as W
from furrow.operators.joins import attach_announcements
from furrow.operators.series import SERIES, in_order


def engineer_features(df: DataFrame, announcements: DataFrame | None = None) -> DataFrame:
    """Series keys, date and the 53 features; incomplete rows dropped.

    ``df`` is at daily grain with the columns of ``MERGED_COLUMNS``.  Every
    window uses the same partition and order, so all windows together cost one
    Exchange and one Sort.
    """
    spec = in_order()
    df = df.withColumn("date", dates.iso_date(F.col("date")))
    df = df.select(*SERIES, "date", *K.MERGED_COLUMNS)
    if announcements is not None:
        # back to one partition per series: a join on the crop alone would leave
        # every market of a crop in the same window task
        df = attach_announcements(df, announcements)
        known = F.filter("_announced", lambda d: d <= F.col("date"))
        df = df.withColumns(
            {"_last": F.array_max(known), "_today": F.array_contains("_announced", F.col("date"))}
        ).drop("_announced").repartition(*SERIES)
    else:
        df = df.withColumns({"_last": F.lit(None).cast("date"), "_today": F.lit(False)})

    mean_temp = (F.col("max_temp") + F.col("min_temp")) / 2
    price, msp = F.col("modal_price"), F.col("msp")
    df = df.withColumns(
        {
            **W.lag_columns("modal_price", "price", K.PRICE_LAGS, spec),
            **W.roll_columns("modal_price", "price", K.ROLL_WINDOWS, spec),
            **W.lag_columns("arrivals_tonnes", "arrivals", K.ARRIVAL_LAGS, spec),
            **W.roll_columns("arrivals_tonnes", "arrivals", K.ROLL_WINDOWS, spec),
            "rainfall_roll_10d": W.rolling(F.sum, F.col("rainfall_mm"), 10, spec),
            "freight_momentum": W.momentum("freight_index", 7, spec),
            "price_momentum_7d": W.momentum("modal_price", 7, spec),
            "temp_rmean_7": W.rolling(F.avg, mean_temp, 7, spec),
            "_arrivals_30": W.rolling(F.sum, F.col("arrivals_tonnes"), 30, spec),
            "_spot": W.day_on_day("modal_price", spec),
            "_futures": W.day_on_day("futures_price", spec),
            "_msp_before": F.lag("msp", 1).over(spec),
        }
    )
    df = df.withColumn(
        "cbot_correlation_14d", W.rolling_corr(F.col("_spot"), F.col("_futures"), 14, spec)
    )

    day = F.col("date")
    month_sin, month_cos = dates.month_cycle(day)
    week_sin, week_cos = dates.week_cycle(day)
    hike = F.when(
        F.col("_today") & (F.col("_msp_before") > 0),
        (msp - F.col("_msp_before")) / F.col("_msp_before") * 100,
    )
    df = df.withColumns(
        {
            "month_sin": month_sin,
            "month_cos": month_cos,
            "is_rabi": dates.is_rabi(day),
            "is_kharif": dates.is_kharif(day),
            "msp_distance": numbers.floor_gap(price, msp),
            "msp_pct": numbers.floor_gap_pct(price, msp),
            "days_since_msp_announcement": F.coalesce(
                F.date_diff(day, F.col("_last")), F.lit(0)
            ),
            "msp_hike_pct": F.coalesce(hike, F.lit(0.0)),
            "drought_flag": numbers.drought_flag(F.col("rainfall_roll_10d")),
            "futures_basis": price - F.col("futures_price"),
            "futures_roll_signal": numbers.futures_signal(F.col("futures_price"), price),
            "price_spread": numbers.price_spread(F.col("max_price"), F.col("min_price")),
            "price_volatility": numbers.price_volatility(
                F.col("max_price"), F.col("min_price"), price
            ),
            "temp_range": F.col("max_temp") - F.col("min_temp"),
            "week_sin": week_sin,
            "week_cos": week_cos,
            "arrivals_market_share": F.coalesce(
                F.try_divide(F.col("arrivals_tonnes"), F.col("_arrivals_30")), F.lit(0.0)
            ),
        }
    )
    return require_complete(df.select(*SERIES, "date", *K.FEATURE_NAMES))


def require_complete(df: DataFrame) -> DataFrame:
    """Drop rows with any missing feature."""
    return df.na.drop("any", subset=[c for c in df.columns if c in K.FEATURE_NAMES])

