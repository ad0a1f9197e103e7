"""Running totals over an unbounded key without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def running_totals(
    df: DataFrame, keys: list[str], value: str, sums: list[str], cells: int = 4096
) -> DataFrame:
    """Inclusive running sums of ``sums`` per key, ordered by numeric ``value``.

    Output: one row per (keys, value) with ``cum_<sum>`` and, per key,
    ``total_<sum>`` columns; equal values count together.  Works in two levels,
    both exact:

    1. rows are pre-aggregated per distinct value (combines map-side), and each
       value falls into one of ``cells`` ordered cells of its key's range on a
       logarithmic scale, so one outlier does not crowd the rest together;
    2. cell totals (at most ``cells + 1`` small rows per key) give each cell its
       starting offset, and values are accumulated inside their cell only.

    A key holding a third of all rows is thus spread over up to ``cells`` tasks.
    """
    per_value = df.groupBy(*keys, value).agg(*[F.sum(s).alias(s) for s in sums])
    scale = F.signum(value) * F.log1p(F.abs(value))
    ranged = per_value.withColumn("_g", scale)
    totals = [f"total_{s}" for s in sums]
    bounds = ranged.groupBy(*keys).agg(
        F.min("_g").alias("_lo"), F.max("_g").alias("_hi"),
        *[F.sum(s).alias(t) for s, t in zip(sums, totals)],
    )
    share = F.try_divide(F.col("_g") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    celled = (
        ranged.join(bounds, keys)
        .withColumn("_cell", F.coalesce(F.floor(share * cells), F.lit(0)))
        .drop("_g", "_lo", "_hi")
    )
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        celled.groupBy(*keys, "_cell")
        .agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
        .select(
            *keys, "_cell",
            *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        )
    )
    inside = (
        Window.partitionBy(*keys, "_cell")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return celled.join(offsets, [*keys, "_cell"]).select(
        *keys, value, *sums, *totals,
        *[(F.sum(s).over(inside) + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per key from running counts.

    ``percentile`` would hold every distinct value of a group in one buffer;
    here only the two neighbouring order statistics leave the partial
    aggregation.
    """
    counted = df.filter(F.col(value).isNotNull()).select(
        *keys, value, F.lit(1).cast("bigint").alias("n")
    )
    ranked = running_totals(counted, keys, value, ["n"])
    picks = []
    for name, p in probabilities.items():
        place = F.lit(p) * (F.col("total_n") - 1)
        picks += [
            F.min(F.when(F.col("cum_n") > F.floor(place), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("cum_n") > F.ceil(place), F.col(value))).alias(f"_hi_{name}"),
        ]
    picked = ranked.groupBy(*keys, "total_n").agg(*picks)
    out = []
    for name, p in probabilities.items():
        place = F.lit(p) * (F.col("total_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return picked.select(*keys, *out)
