"""Numeric expressions: parsing, shape features, guards and display rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from furrow import constants as K


def json_number(payload: Column, key: str) -> Column:
    """Numeric field of a JSON text payload; NULL when absent or unparsable."""
    return F.get_json_object(payload, f"$.{key}").try_cast("double")


def parse_price(text: Column) -> Column:
    """Text to double, NULL on anything that is not a number."""
    return F.trim(text).try_cast("double")


def fill_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Replace NULL by a per-column default."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the listed columns where missing, then fill numeric NULLs with 0."""
    missing = {c: F.lit(0.0) for c in columns if c not in df.columns}
    return df.withColumns(missing).na.fill(0.0)


def floor_gap(price: Column, floor_price: Column) -> Column:
    return price - floor_price


def floor_gap_pct(price: Column, floor_price: Column) -> Column:
    return F.try_divide(price - floor_price, floor_price) * 100


def price_spread(max_price: Column, min_price: Column) -> Column:
    return max_price - min_price


def price_volatility(max_price: Column, min_price: Column, price: Column) -> Column:
    return F.try_divide(max_price - min_price, price)


def futures_signal(futures: Column, spot: Column) -> Column:
    """+1 when futures are over 5 % above spot, -1 when over 5 % below, else 0."""
    return F.when(futures > spot * 1.05, 1).when(futures < spot * 0.95, -1).otherwise(0)


def drought_flag(rain_sum: Column) -> Column:
    """1 below the drought threshold, 0 otherwise or when unknown.

    Rounding first keeps float noise in the sum (ten times 0.1) off the edge.
    """
    return F.coalesce((F.round(rain_sum, 6) < K.DROUGHT_MM).cast("int"), F.lit(0))


def change_pct(current: Column, previous: Column) -> Column:
    """Percent change; 0 without a positive previous value."""
    return F.when(previous > 0, (current - previous) / previous * 100).otherwise(0.0)


def display_round(value: Column, digits: int = 2) -> Column:
    """Half-even rounding, as printed in reports."""
    return F.bround(value, digits)


def alert_trigger(threshold: Column, current: Column, forecast: Column) -> Column:
    """Threshold 0 is a daily alert; otherwise either price must exceed it."""
    return F.coalesce(
        (threshold == 0.0) | (current > threshold) | (forecast > threshold), F.lit(False)
    )


def advice(average: Column, floor_price: Column) -> Column:
    return F.when(average > floor_price, "SELL").otherwise("HOLD")


def advice_pct(average: Column, floor_price: Column) -> Column:
    """Distance to the support price in percent, always positive, one digit."""
    return display_round(F.abs(average - floor_price) / floor_price * 100, 1)


def advice_reason(crop: Column, average: Column, floor_price: Column) -> Column:
    """Sentence explaining the advice, with thousands separators."""
    avg_text = F.format_number(average, 0)
    floor_text = F.format_number(floor_price, 0)
    pct = advice_pct(average, floor_price).cast("string")
    head = F.concat(F.lit("Predicted avg price ₹"), avg_text, F.lit(" is "), pct)
    return (
        F.when(
            floor_price.isNull(),
            F.concat(
                F.lit("No MSP data available for "), crop,
                F.lit(". Average predicted price: ₹"), avg_text,
            ),
        )
        .when(average > floor_price, F.concat(head, F.lit("% above MSP ₹"), floor_text))
        .otherwise(
            F.concat(head, F.lit("% below MSP ₹"), floor_text, F.lit(" — consider holding"))
        )
    )


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table as a literal map; NULL when unknown."""
    pairs = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.lit(kv[1])], table.items(), [])
    return F.try_element_at(F.create_map(*pairs), key)


def support_price(crop: Column) -> Column:
    """Support price of a crop, case-insensitive; NULL when unknown."""
    return lookup(F.lower(crop), K.SUPPORT_PRICE)
