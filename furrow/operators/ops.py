"""Operational metrics over event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from furrow import constants as K
from furrow.operators.prefix import exact_quantiles
from furrow.operators.series import latest_per_key


def metric_counter(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def bucket_columns(value: Column, edges: list[float]) -> list[Column]:
    """Cumulative counts per upper edge, plus the total."""
    counts = [
        F.count_if(value <= edge).alias(f"le_{str(edge).replace('.', '_')}") for edge in edges
    ]
    return [*counts, F.count(value).alias("total")]


def bucket_quantile(p: float, edges: list[float]) -> Column:
    """Quantile estimate from cumulative buckets: linear inside a bucket, the
    last edge beyond it."""
    names = [f"le_{str(e).replace('.', '_')}" for e in edges]
    target = F.col("total") * p
    out = F.lit(edges[-1])
    for i in range(len(edges) - 1, -1, -1):
        below = F.col(names[i - 1]) if i else F.lit(0)
        low = edges[i - 1] if i else 0.0
        inside = low + (edges[i] - low) * F.try_divide(target - below, F.col(names[i]) - below)
        out = F.when(F.col(names[i]) >= target, F.coalesce(inside, F.lit(low))).otherwise(out)
    return out


def latency_histogram(
    events: DataFrame, keys: list[str], value: str = "latency", edges: list[float] | None = None
) -> DataFrame:
    """Cumulative buckets, bucket-estimated and exact p50/p95/p99 per label."""
    edges = edges or K.LATENCY_EDGES
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    buckets = events.groupBy(*keys).agg(*bucket_columns(F.col(value), edges))
    estimates = buckets.withColumns({f"est_{n}": bucket_quantile(p, edges) for n, p in points.items()})
    return estimates.join(exact_quantiles(events, keys, value, points), keys)


def hit_rate(events: DataFrame, keys: list[str], hit: str = "cache_hit") -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count_if(F.col(hit)).alias("hits"),
        F.count_if(~F.col(hit)).alias("misses"),
        F.try_divide(F.count_if(F.col(hit)), F.count(F.col(hit))).alias("hit_rate"),
    )


def sample_gauge(
    events: DataFrame, keys: list[str], value: str, step_seconds: int, tie: str
) -> DataFrame:
    """Gauge samples on a fixed grid: the last value inside each step."""
    slot = (F.unix_timestamp("ts") / step_seconds).cast("bigint") * step_seconds
    gridded = events.withColumn("_slot", slot)
    newest = latest_per_key(gridded, [*keys, "_slot"], ["ts", tie])
    return newest.select(
        *keys, F.timestamp_seconds("_slot").alias("ts"), F.col(value).alias("rmse")
    )
