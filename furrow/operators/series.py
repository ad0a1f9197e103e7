"""Series conventions shared by every operator.

A series is identified by ``SERIES`` and carries at most one row per calendar
day (``daily_grain`` enforces it).  That is the size bound behind every window
partitioned by series: a century of history is 36,525 short rows, however many
raw rows one hot market contributed before the daily aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

SERIES = ["crop", "mandi"]


def in_order(keys: list[str] | None = None, order: str = "date") -> WindowSpec:
    """The one partition/sort all row windows share, so Spark plans it once."""
    return Window.partitionBy(*(keys or SERIES)).orderBy(order)


def daily_grain(df: DataFrame, version: str, keys: list[str] | None = None) -> DataFrame:
    """One row per series and date: the newest version."""
    return latest_per_key(df, [*(keys or SERIES), "date"], [version])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key.

    ``row_number() = 1`` lets Spark keep only the first row per key inside each
    map task (WindowGroupLimit), so a hot key never travels as a whole.
    """
    return tail_n(df, 1, keys, order)


def tail_n(df: DataFrame, n: int, keys: list[str] | None = None, order=("date",)) -> DataFrame:
    """Last ``n`` rows per key, pruned map-side the same way."""
    newest = Window.partitionBy(*(keys or SERIES)).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def min_rows_gate(df: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Keep series with at least ``n`` rows (counts combine map-side)."""
    keys = keys or SERIES
    enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return df.join(enough.select(*keys), keys, "left_semi")


def newest_date(df: DataFrame, column: str = "date") -> Column:
    """Newest date of a table as a scalar subquery (no driver round trip)."""
    return df.agg(F.max(column)).scalar()


def as_of_column(df: DataFrame, as_of, column: str = "date") -> Column:
    """Explicit as-of date (or column), or the newest date in the data."""
    if isinstance(as_of, Column):
        return as_of
    return newest_date(df, column) if as_of is None else F.lit(as_of).cast("date")
