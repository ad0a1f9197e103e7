"""Landed price and weather responses to canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from furrow import schemas
from furrow.functions import dates, numbers


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Records of landed feed files (one JSON response per file)."""
    landed = spark.read.schema(schemas.FEED_PAYLOAD).option("multiLine", True).json(path)
    return landed.select(F.explode("records").alias("record")).select("record.*")


def explode_feed(responses: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per record of a response column; other columns are kept."""
    others = [c for c in responses.columns if c != payload]
    return (
        responses.withColumn("_p", F.from_json(payload, schemas.FEED_PAYLOAD))
        .select(*others, F.explode("_p.records").alias("_r"))
        .select(*others, *[F.col(f"_r.{f}").alias(f"rec_{f}") for f in schemas.FEED_FIELDS])
    )


def project_feed(records: DataFrame, as_of: Column) -> DataFrame:
    """Feed records to (crop, state, fetch_date, payload struct).

    ``records`` is the output of ``explode_feed`` with the requested crop and
    state; a key missing from the record takes the request's value, a bad or
    missing date becomes ``as_of``.
    """
    def rec(name: str, default: Column | str = "") -> Column:
        default = F.lit(default) if isinstance(default, str) else default
        return F.coalesce(F.col(f"rec_{name}"), default)

    payload = F.struct(
        rec("commodity", F.col("crop")).alias("commodity"),
        rec("market").alias("market"),
        rec("state", F.col("state")).alias("state"),
        rec("district").alias("district"),
        numbers.parse_price(F.col("rec_min_price")).alias("min_price"),
        numbers.parse_price(F.col("rec_max_price")).alias("max_price"),
        numbers.parse_price(F.col("rec_modal_price")).alias("modal_price"),
        rec("arrival_date").alias("arrival_date"),
        numbers.parse_price(F.col("rec_arrivals")).alias("arrivals_tonnes"),
    )
    kept = [c for c in records.columns if not c.startswith("rec_")]
    return records.select(
        *kept,
        F.coalesce(dates.parse_feed_date(F.col("rec_arrival_date")), as_of).alias("fetch_date"),
        payload.alias("payload"),
    )


def payload_json(projected: DataFrame) -> DataFrame:
    """The payload struct as stored JSON text (NULL fields are left out)."""
    return projected.withColumn("raw_data", F.to_json("payload")).drop("payload")


def flatten_weather(responses: DataFrame, payload: str = "payload") -> DataFrame:
    """Nested weather response to flat metrics; no rain entry means 0."""
    others = [c for c in responses.columns if c != payload]
    return responses.withColumn("_w", F.from_json(payload, schemas.WEATHER_PAYLOAD)).select(
        *others,
        F.coalesce(F.col("_w.rain.`1h`"), F.lit(0.0)).alias("rainfall_mm"),
        F.col("_w.main.temp_max").alias("max_temp"),
        F.col("_w.main.temp_min").alias("min_temp"),
        F.col("_w.main.humidity").alias("humidity"),
        F.col("_w.wind.speed").alias("wind_speed"),
    )


def quarantine(
    df: DataFrame, checks: dict[str, Column], crop: str = "crop", state: str = "state"
) -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows): a row fails when any check is not true.

    Error rows carry crop, state and the names of the failed checks.
    """
    failed = F.concat_ws(
        "; ", *[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]
    )
    flagged = df.withColumn("error_message", failed)
    good = flagged.filter(F.col("error_message") == "").drop("error_message")
    bad = flagged.filter(F.col("error_message") != "").select(
        F.col(crop).alias("crop"), F.col(state).alias("state"), "error_message",
        *[c for c in df.columns if c not in (crop, state)],
    )
    return good, bad
