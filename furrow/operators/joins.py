"""Equi-joins, the as-of announcement join and the bounded look-back fill.

No broadcast is forced on tables that grow: Spark broadcasts a side only when
its measured size is under the configured threshold, and otherwise sort-merges
with adaptive splitting of hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from furrow import constants as K
from furrow.functions import numbers, text
from furrow.operators.series import SERIES, in_order

WEATHER_METRICS = ["rainfall_mm", "max_temp", "min_temp", "humidity", "wind_speed"]


def subscriptions_with_users(subscriptions: DataFrame, users: DataFrame) -> DataFrame:
    """Left join on the user id; subscriptions without a user stay."""
    phones = users.select(F.col("id").alias("user_id"), F.col("phone").alias("user_phone"))
    return subscriptions.join(phones, "user_id", "left")


def attach_announcements(df: DataFrame, announcements: DataFrame) -> DataFrame:
    """Add ``_announced``: the sorted announcement dates of the row's crop.

    Distinct dates per crop are bounded by the calendar, so the array is a
    small per-crop value; the as-of lookup then needs no window over the crop
    (which would put every market of a hot crop into one task).
    """
    per_crop = announcements.groupBy("crop").agg(
        F.sort_array(F.collect_set("announced_on")).alias("_announced")
    )
    return df.join(per_crop, "crop", "left").withColumn(
        "_announced", F.coalesce("_announced", F.array().cast("array<date>"))
    )


def days_since_announcement(df: DataFrame, announcements: DataFrame) -> DataFrame:
    """Days since the latest announcement on or before each row; 0 if none."""
    last = F.array_max(F.filter("_announced", lambda d: d <= F.col("date")))
    return (
        attach_announcements(df, announcements)
        .withColumn(
            "days_since_msp_announcement", F.coalesce(F.date_diff("date", last), F.lit(0))
        )
        .drop("_announced")
    )


def floor_price_hike(df: DataFrame, announcements: DataFrame) -> DataFrame:
    """Percent change of the floor price on announcement days, else 0."""
    before = F.lag("msp", 1).over(in_order())
    marks = announcements.select("crop", F.col("announced_on").alias("date")).distinct()
    return (
        df.withColumn("_before", before)
        .join(marks.withColumn("_on", F.lit(True)), ["crop", "date"], "left")
        .withColumn(
            "msp_hike_pct",
            F.coalesce(
                F.when(
                    F.col("_on") & (F.col("_before") > 0),
                    (F.col("msp") - F.col("_before")) / F.col("_before") * 100,
                ),
                F.lit(0.0),
            ),
        )
        .drop("_before", "_on")
    )


def merge_price_weather(
    prices: DataFrame, weather: DataFrame, place: str = "mandi"
) -> DataFrame:
    """Prices with the weather of their place and day (left join)."""
    side = weather.withColumnRenamed("district", place)
    return prices.join(side, [place, "date"], "left")


def forward_fill_weather(weather: DataFrame, days: int = 3) -> DataFrame:
    """Fill each missing metric from the nearest of the previous ``days``
    calendar days of the district; never further back, never forward."""
    recent = (
        Window.partitionBy("district").orderBy(F.unix_date("date")).rangeBetween(-days, -1)
    )
    return weather.withColumns(
        {m: F.coalesce(F.col(m), F.last(m, ignorenulls=True).over(recent)) for m in WEATHER_METRICS}
    )


def experiment_grid(
    pairs: DataFrame, horizons: list[int], models: list[str]
) -> DataFrame:
    """Every (crop, mandi) pair with every horizon and model, by exploding the
    two fixed lists (no cross join)."""
    return (
        pairs.select(*SERIES)
        .distinct()
        .withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
        .withColumn("model_name", F.explode(F.array(*[F.lit(m) for m in models])))
    )


def with_support_price(df: DataFrame, crop: str = "crop") -> DataFrame:
    """Support price of each row's crop (16 fixed entries as a literal map)."""
    return df.withColumn("msp", numbers.support_price(F.col(crop)))


def keep_max_id(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows that are not the newest id of their key."""
    newest = df.groupBy(*keys).agg(F.max("id").alias("id"))
    return df.join(newest.select("id"), "id", "left_semi")


def selective_pairs(grid: DataFrame, crops: DataFrame) -> DataFrame:
    """Grid rows whose crop is listed."""
    return grid.join(crops.select("crop").distinct(), "crop", "left_semi")


def importance_delta(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New minus old importance per feature; a feature without an old value
    keeps its new one."""
    before = old.select(*keys, "feature", F.col("importance").alias("_old"))
    return (
        new.join(before, [*keys, "feature"], "left")
        .withColumn(
            "delta",
            numbers.display_round(F.col("importance") - F.coalesce("_old", F.lit(0.0)), 6),
        )
        .drop("_old")
    )


def delta_map(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Importance deltas as one map per key, the shape of the run log.

    The feature list is the fixed feature set, so the map is small.
    """
    return deltas.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "delta")))).alias(
            "feature_importance_delta"
        )
    )


def label_features(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Plain-language label of a feature; its own name when unknown."""
    return df.withColumn(
        "label", F.coalesce(numbers.lookup(F.col(feature), K.FEATURE_LABELS), F.col(feature))
    )


def alerts_due(
    subscriptions: DataFrame, users: DataFrame, forecasts: DataFrame
) -> DataFrame:
    """Triggered subscriptions with address and message variables.

    ``forecasts`` has one row per series: (crop, mandi, current_price,
    next_price).  One equi-join replaces a forecast call per subscription.
    """
    address = text.target_phone(F.col("phone_number"), F.col("user_phone"))
    trigger: Column = numbers.alert_trigger(
        F.col("threshold_price"), F.col("current_price"), F.col("next_price")
    )
    return (
        subscriptions_with_users(subscriptions.filter("is_active"), users)
        .withColumn("phone", address)
        .filter(F.col("phone").isNotNull())
        .join(forecasts, SERIES)
        .filter(trigger)
        .select(
            "id", "phone", "language", *SERIES, "threshold_price", "current_price", "next_price",
            F.concat(
                text.title_case(F.col("crop")), F.lit(" @ "), text.title_case(F.col("mandi"))
            ).alias("title"),
            F.concat(F.lit("₹"), F.col("next_price").cast("string"), F.lit("/q")).alias("quote"),
        )
    )
