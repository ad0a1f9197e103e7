"""Date expressions: parsing, windows, seasons and cycles."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from furrow import constants as K

# accepted feed formats, first match wins (one- or two-digit day and month)
FEED_FORMATS = ["d/M/yyyy", "yyyy-M-d", "d-M-yyyy"]


def parse_feed_date(text: Column) -> Column:
    """First accepted format after trimming; NULL when none matches."""
    trimmed = F.trim(text)
    return F.coalesce(
        *[F.try_to_timestamp(trimmed, F.lit(fmt)) for fmt in FEED_FORMATS]
    ).cast("date")


def iso_date(value: Column) -> Column:
    """Date from a date, timestamp or ISO string."""
    return F.to_date(value)


def since(day: Column, as_of: Column, days: int) -> Column:
    """``day >= as_of - days``: open-ended look-back."""
    return day >= F.date_sub(as_of, days)


def between_days(day: Column, as_of: Column, start: int, end: int) -> Column:
    """Half-open window ``[as_of - start, as_of - end)``."""
    return (day >= F.date_sub(as_of, start)) & (day < F.date_sub(as_of, end))


def is_rabi(day: Column) -> Column:
    return F.month(day).isin(K.RABI_MONTHS).cast("int")


def is_kharif(day: Column) -> Column:
    return F.month(day).isin(K.KHARIF_MONTHS).cast("int")


def month_cycle(day: Column) -> tuple[Column, Column]:
    """(sin, cos) of the month on a 12-month circle."""
    angle = F.month(day) * F.lit(2 * math.pi) / 12
    return F.sin(angle), F.cos(angle)


def week_cycle(day: Column) -> tuple[Column, Column]:
    """(sin, cos) of the ISO week on a 52-week circle (week 53 allowed)."""
    angle = F.weekofyear(day) * F.lit(2 * math.pi) / 52
    return F.sin(angle), F.cos(angle)
