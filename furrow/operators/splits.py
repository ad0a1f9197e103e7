"""Position-based splits of ordered series and set operations on samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from furrow.operators.series import SERIES, in_order, min_rows_gate


def with_position(df: DataFrame, keys: list[str] | None = None, order: str = "date") -> DataFrame:
    """Add ``pos`` (0-based) and ``n`` (series length)."""
    keys = keys or SERIES
    return df.withColumns(
        {
            "pos": F.row_number().over(in_order(keys, order)) - 1,
            "n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    )


def test_size(n: Column, horizon: Column | int) -> Column:
    """Held-out rows: the horizon, or 15 % of the series if that is more."""
    horizon = F.lit(horizon) if isinstance(horizon, int) else horizon
    return F.greatest(horizon.cast("bigint"), F.floor(n * 0.15))


def train_rows(train_share: float = 0.8, horizon: int | None = None) -> Column:
    """Rows before the cut: a share of the series, or all but its held-out rows."""
    if horizon is None:
        return F.floor(F.col("n") * train_share)
    return F.col("n") - test_size(F.col("n"), horizon)


def side(cut: Column) -> Column:
    return F.when(F.col("pos") < cut, "train").otherwise("test")


def split_temporal(df: DataFrame, train_share: float = 0.8, horizon: int | None = None) -> DataFrame:
    """First part trains, the rest tests, by position in the series."""
    return with_position(df).withColumn("split", side(train_rows(train_share, horizon)))


def split_ts_folds(df: DataFrame, k: int = 3, min_side: int = 0) -> DataFrame:
    """Expanding-window folds: fold f validates on the f-th of the last ``k``
    blocks of n // (k + 1) rows and trains on everything before.  A fold with
    ``min_side`` rows or fewer on either side is skipped."""
    block = F.floor(F.col("n") / (k + 1))
    start = F.col("n") - (k - F.col("fold")) * block
    return (
        with_position(df)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("_start", start)
        .withColumn("_block", block)
        .filter((F.col("_start") > min_side) & (F.col("_block") > min_side))
        .filter(F.col("pos") < F.col("_start") + F.col("_block"))
        .withColumn("side", F.when(F.col("pos") < F.col("_start"), "train").otherwise("validate"))
        .drop("_start", "_block")
    )


def walk_forward_naive(df: DataFrame, horizon: int, value: str = "modal_price") -> DataFrame:
    """One-step-ahead forecasts of the first ``horizon`` test rows: the previous
    actual value, with a 5 % band."""
    before = F.lag(value, 1).over(in_order())
    rows = with_position(df).withColumn("predicted", before)
    cut = F.col("n") - test_size(F.col("n"), horizon)
    return (
        rows.filter((F.col("pos") >= cut) & (F.col("pos") < cut + horizon))
        .select(
            *SERIES, "date", F.col(value).alias("actual"), "predicted",
            (F.col("predicted") * 0.95).alias("lower_bound"),
            (F.col("predicted") * 1.05).alias("upper_bound"),
        )
    )


def pool_series(df: DataFrame, crops: list[str], min_rows: int = 50) -> DataFrame:
    """Rows of the listed crops' long enough series as one training set."""
    return min_rows_gate(df.filter(F.col("crop").isin(crops)), min_rows)


def append_future(df: DataFrame, days: int, value: str = "modal_price") -> DataFrame:
    """History plus ``days`` future rows carrying the last value forward."""
    last = df.groupBy(*SERIES).agg(
        F.max("date").alias("_last"), F.max_by(value, "date").alias(value)
    )
    future = last.select(
        *SERIES,
        F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", days))).alias("date"),
        value,
        F.lit(True).alias("is_future"),
    )
    history = df.select(*SERIES, "date", value, F.lit(False).alias("is_future"))
    return history.unionByName(future)
