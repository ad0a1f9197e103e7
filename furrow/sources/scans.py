"""Series scans over the stored price table (JSON payload per row)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from furrow import constants as K, schemas
from furrow.functions import dates, numbers, text
from furrow.operators.series import as_of_column
from furrow.sources import sinks

PRICE_FIELDS = ["modal_price", "min_price", "max_price"]


def payload_struct(raw: DataFrame) -> DataFrame:
    """Parse the JSON payload once, with a fixed schema."""
    return raw.withColumn("_p", F.from_json("raw_data", schemas.PRICE_PAYLOAD))


def market(payload: str = "_p") -> Column:
    """Market name, whichever of the three keys carries it."""
    return F.coalesce(*[F.col(f"{payload}.{k}") for k in ("market_name", "mandi", "market")])


def in_date_order(rows: DataFrame, newest_first: bool = False) -> DataFrame:
    """Sort by date, ties by id: the id also lets Spark split one busy date
    over several sort partitions."""
    keys = [F.col("fetch_date"), F.col("id")]
    return rows.orderBy(*[k.desc() for k in keys] if newest_first else keys)


def scan_series(
    raw: DataFrame, crop: str, mandi: str, as_of=None, years: int = 3
) -> DataFrame:
    """Training rows of one crop and market since ``years`` back, ascending.

    The date and crop predicates sit on plain columns and reach the Parquet
    scan; the market lives in the payload and is filtered after parsing.
    """
    recent = dates.since(F.col("fetch_date"), as_of_column(raw, as_of, "fetch_date"), years * 365)
    rows = in_date_order(
        payload_struct(raw.filter(text.same_text(F.col("crop"), crop) & recent)).filter(
            text.like_text(market(), mandi)
        )
    )
    picked = rows.select(
        F.col("fetch_date").alias("date"),
        *[F.col(f"_p.{c}").alias(c) for c in K.MERGED_COLUMNS],
    )
    return numbers.fill_defaults(picked, K.TRAINING_DEFAULTS)


def price_history(
    raw: DataFrame, crop: str, mandi: str, days: int = 365, as_of=None
) -> DataFrame:
    """Rows of the last ``days`` days, newest first, with the record count.

    The count is a scalar subquery, not a window over the whole result.
    """
    if not 1 <= days <= 3650:
        raise ValueError("days must be between 1 and 3650")
    recent = dates.since(F.col("fetch_date"), as_of_column(raw, as_of, "fetch_date"), days)
    name = F.coalesce(market(), F.lit(""))
    rows = payload_struct(raw.filter(text.like_text(F.col("crop"), crop) & recent)).filter(
        text.market_contains(name, mandi)
    )
    total = rows.agg(F.count(F.lit(1))).scalar()
    return in_date_order(rows, newest_first=True).select(
        F.col("fetch_date").alias("date"),
        *[F.col(f"_p.{c}").alias(c) for c in PRICE_FIELDS],
        F.when(name == "", mandi).otherwise(name).alias("mandi"),
        total.alias("total_records"),
    )


def forecast_history(
    raw: DataFrame, crop: str, mandi: str, days: int = 365, as_of=None
) -> DataFrame:
    """Chronological rows with the eleven forecast inputs and their defaults."""
    recent = dates.since(F.col("fetch_date"), as_of_column(raw, as_of, "fetch_date"), days)
    rows = in_date_order(
        payload_struct(raw.filter(text.like_text(F.col("crop"), crop) & recent)).filter(
            text.market_contains(market(), mandi)
        )
    ).select(
        F.col("fetch_date").alias("date"),
        *[F.col(f"_p.{c}").alias(c) for c in K.MERGED_COLUMNS],
    )
    return numbers.fill_defaults(rows, K.HISTORY_DEFAULTS)


def eval_series(raw: DataFrame, crop: str, mandi: str, min_rows: int = 120) -> DataFrame:
    """Four typed columns of an exact crop and market; empty when the series
    has fewer than ``min_rows`` rows."""
    fields = [*PRICE_FIELDS, "arrivals_tonnes"]
    rows = raw.filter((F.col("crop") == crop) & (text.market_key(F.col("raw_data")) == mandi))
    enough = rows.agg(F.count(F.lit(1)) >= min_rows).scalar()
    return in_date_order(rows.filter(enough)).select(
        F.col("fetch_date").alias("date"),
        *[numbers.json_number(F.col("raw_data"), c).alias(c) for c in fields],
    )


def scan_subscriptions(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.filter(F.col("is_active"))


def json_text(raw: bytes) -> str:
    """A JSON document in the encoding it begins in; where its bytes are none of
    it stands a character that no document may hold."""
    encoding = json.detect_encoding(raw)
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return raw.decode(encoding, "replace").replace("\ufffd", "\0")


def scan_trials(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Tuning trials: hyperparameters and score of each JSON document.

    ``whole_files`` reads one document per file; otherwise one per line. Files are
    listed and read by a few tasks a core; where only Spark reaches the store, it
    lists them on the driver and gives a task 32 small ones at most.
    """
    reader = spark.read.schema(schemas.TRIAL).option("multiLine", whole_files)
    files = sinks.read_documents(spark, path) if whole_files else None
    if files is not None:
        docs = reader.json(files.map(json_text))
    else:
        docs = reader.json(path)
        if whole_files:
            docs = docs.coalesce(4 * spark.sparkContext.defaultParallelism)
    return docs.select("trial_id", "hyperparameters.values.*", "score", "status")


def sort_dates(df: DataFrame, ascending: bool = True) -> DataFrame:
    """Global date order: a range partitioning, not one task."""
    day = F.col("date")
    return df.orderBy("crop", "mandi", day.asc() if ascending else day.desc())
