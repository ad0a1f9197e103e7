"""Array arithmetic on short per-series arrays, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A lambda variable is never inlined, whatever the optimizer does with
    projections.  Keep chains short: every level adds to analysis time.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty() -> Column:
    return F.array().cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def fit_line(values: Column, first: Column) -> Column:
    """Least-squares struct (slope, intercept) of an array at x = first, first+1, ..."""
    n = F.size(values)
    mean_x = first + (n - 1) / F.lit(2.0)
    mean_y = total(values) / n
    spread = total(F.transform(values, lambda v, i: (first + i - mean_x) * (v - mean_y)))
    square = total(
        F.transform(values, lambda v, i: (first + i - mean_x) * (first + i - mean_x))
    )
    slope = F.coalesce(F.try_divide(spread, square), F.lit(0.0))
    return F.struct(slope.alias("slope"), (mean_y - slope * mean_x).alias("intercept"))


def line_values(line: Column, start: Column, count: Column) -> Column:
    """``count`` values of a line from position ``start`` on."""
    return F.transform(
        F.array_repeat(F.lit(0), count),
        lambda _, i: line["slope"] * (start + i) + line["intercept"],
    )


def step_spread(y: Column, n: Column) -> Column:
    """Sample spread of the steps of ``y``; 3 % of its mean when zero."""
    steps = F.zip_with(F.slice(y, 2, n - 1), F.slice(y, 1, n - 1), lambda b, a: b - a)
    mean = total(steps) / (n - 1)
    square = F.aggregate(steps, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    spread = F.sqrt(square / (n - 2))
    return F.when(spread == 0, total(y) / n * 0.03).otherwise(spread)
