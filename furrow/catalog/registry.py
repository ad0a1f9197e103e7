"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from furrow.sources.canonical import load, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, *needs: str, sql: str | None = None):
    """Register a query; ``needs`` are the canonical tables its twin selects
    from, ``sql`` is the twin's body (it may open with further CTEs)."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = (with_clause(*needs) + "\n" if needs else "") + sql.strip()
        return fn

    return register


def q(value, digits: int = 4) -> Column:
    """Result column rounded by plain arithmetic, equal on both engines.

    The offset is a little over one half: means of two-decimal values often lie
    exactly half-way, where the last bit of a sum would decide.
    """
    value = F.col(value) if isinstance(value, str) else value
    scale = 10.0**digits
    return F.floor(value * scale + 0.5001) / scale


def qs(value: str, digits: int = 4) -> str:
    """SQL text of ``q``."""
    return f"floor(({value})*1e{digits}+0.5001)/1e{digits}"


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: q(c, digits) for c in columns})


def newest(spark: SparkSession, sf_dir: str, table: str, column: str) -> Column:
    """Newest date of a given table from one column of its files."""
    return load(spark, sf_dir, table).agg(F.max(F.to_date(column))).scalar()


def newest_ship(spark: SparkSession, sf_dir: str) -> Column:
    return newest(spark, sf_dir, "lineitem", "l_shipdate")
