"""Unit-root test per series and differencing of the non-stationary ones.

The regressions of the test need only cross-moments of the level, a constant and
the lagged changes. Over a whole series these are sums of products of a value
with the one so many rows before: one mergeable sum a lag, added up in the same
grouping for every series. A few rows at both ends turn them into the moments of
any sample that starts later. One matrix then holds all lag orders: sweeping its
columns one after another leaves the residual sum of squares of each order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from furrow.functions.stats import adf_critical, adf_p_value
from furrow.operators.series import SERIES, in_order
from furrow.operators.windows import first_difference
from furrow.session import materialise

#: Values below which a series is not tested.
LEAST = 8
LEVELS = ("1pct", "5pct", "10pct")


def top_lag(n: int) -> int:
    """The largest lag order that is tried on ``n`` values."""
    return max(0, min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2))


def lag_moments(df: DataFrame, keys: list[str], value: str, order: str, lags: int) -> DataFrame:
    """Per key: n, m (changes), sums of products, and the rows at both ends.

    v is the value less the first one (the constant takes that up), d the change
    to the next row. ``p[k]`` sums d(r) d(r-k), ``q[k]`` sums v(r) d(r-k); head
    and tail hold (v, d) of the first and last 2 ``lags`` + 2 rows.
    """
    spec = in_order(keys, order)
    whole = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.select(*keys, order, F.col(value).alias("y")).withColumns({
        "r": F.row_number().over(spec) - 2, "n": F.count(F.lit(1)).over(whole), "v": F.lag("y").over(spec) - F.first("y").over(whole),
        "d": F.col("y") - F.lag("y").over(spec),
    })
    rows = rows.withColumns({f"d{k}": F.lag("d", k).over(spec) if k else F.col("d") for k in range(lags + 1)})
    edge = 2 * lags + 2
    ends = lambda inside: F.sort_array(F.collect_list(F.when((F.col("r") >= 0) & inside, F.struct("r", "v", "d"))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.max("n").alias("n"), (F.max("n") - 1).alias("m"), (F.min("y") == F.max("y")).alias("constant"),
        zero(F.sum("v")).alias("sv"), zero(F.sum(F.col("v") * F.col("v"))).alias("svv"),
        F.array(*[zero(F.sum(F.col("d") * F.col(f"d{k}"))) for k in range(lags + 1)]).alias("p"),
        F.array(*[zero(F.sum(F.col("v") * F.col(f"d{k}"))) for k in range(lags + 1)]).alias("q"),
        ends(F.col("r") < edge).alias("head"), F.reverse(ends(F.col("r") >= F.col("n") - 1 - edge)).alias("tail"),
    )


# Sums over rows first..first+count-1 of the head, or the last ones of the tail; none if count <= 0.
_SUM = "aggregate(transform(array_repeat(0, greatest(int({count}), 0)), (z, e) -> {term}), 0D, (a, x) -> a + x)"


def moment_matrix(start: str, lags: str) -> Column:
    """Cross-moments over the rows from ``start`` on of: v, 1, the changes 1 to
    ``lags`` rows before, and the change itself."""
    v = lambda r: f"head[int({r})].v"
    # k rows before: 1 to lags for the lagged changes, 0 for the last column
    k = lambda a: f"case when {a} = {lags} + 2 then 0 else {a} - 1 end"
    level_one = f"sv - {_SUM.format(count=start, term='head[e].v')}"
    level_level = f"svv - {_SUM.format(count=start, term='head[e].v * head[e].v')}"
    # sum of d(r-k) telescopes: v(m-k) - v(start-k)
    ends_at = "(tail[0].v + tail[0].d)"
    one_lag = lambda k: f"(case when {k} = 0 then {ends_at} else tail[int({k}) - 1].v end) - {v(f'{start} - {k}')}"
    before = _SUM.format(count=f"{start} - kk", term="head[int(kk) + e].v * head[e].d")
    level_lag = lambda k: f"transform(array({k}), kk -> q[int(kk)] - {before})[0]"
    early = _SUM.format(count=f"{start} - w.low - w.gap", term="head[int(w.gap) + e].d * head[e].d")
    late = _SUM.format(count="w.low", term="tail[e].d * tail[e + int(w.gap)].d")
    lag_lag = lambda i, j: (
        f"transform(array(struct(least({i}, {j}) as low, abs({i} - {j}) as gap)), w -> p[int(w.gap)] - {early} - {late})[0]"
    )
    entry = f"""case
        when i = 0 and j = 0 then {level_level}
        when i + j = 1 then {level_one}
        when i = 1 and j = 1 then double(m - {start})
        when i = 0 then {level_lag(k('j'))} when j = 0 then {level_lag(k('i'))}
        when i = 1 then {one_lag(f'({k("j")})')} when j = 1 then {one_lag(f'({k("i")})')}
        else {lag_lag(f'({k("i")})', f'({k("j")})')} end"""
    side = f"sequence(0, int({lags}) + 2)"
    return F.expr(f"transform({side}, i -> transform({side}, j -> {entry}))")


def swept(matrix: str, columns: str) -> Column:
    """(m, rss): the matrix with its first ``columns`` columns swept, and the
    last diagonal element after each of them.

    Swept in full, the last column holds the coefficients and the swept block the
    inverse. A column that depends on those before it is passed over.
    """
    state = "struct<m:array<array<double>>,rss:array<double>>"
    one = """transform(s.m, (row, i) -> case
        when i = k then transform(row, (x, j) -> case when j = k then 1 / x else x / row[k] end)
        else transform(row, (x, j) -> case when j = k then -x / s.m[k][k] else x - row[k] * s.m[k][j] / s.m[k][k] end) end)"""
    stays = f"abs(s.m[k][k]) <= 1e-11 * abs({matrix}[k][k])"
    step = f"transform(array(case when {stays} then s.m else {one} end), t -> struct(t as m, concat(s.rss, array(t[size(t) - 1][size(t) - 1])) as rss))[0]"
    first = f"struct({matrix} as m, cast(array() as array<double>) as rss)"
    return F.expr(f"aggregate(sequence(0, int({columns}) - 1), cast({first} as {state}), (s, k) -> cast({step} as {state}))")


def unit_root(moments: DataFrame) -> DataFrame:
    """The test of every row of ``lag_moments`` with ``top`` beside it: adf_statistic
    (t-ratio of the lagged level), used_lag, nobs.

    Constant-only regression of the change on the lagged level and lagged
    changes; the lag order minimises AIC on the common sample and the chosen
    model is fitted again on every row that it can use. A series that is too
    short or constant is not tested.
    """
    tried = moments.withColumn("tested", (F.col("n") >= LEAST) & ~F.col("constant"))
    tried = tried.withColumn("common", F.when(F.col("tested"), moment_matrix("top", "top")))
    tried = tried.withColumn("rss", F.when(F.col("tested"), swept("common", "top + 2")["rss"]))
    rows = "(m - top)"
    score = f"{rows} * ln(greatest(rss[lag + 1], 1e-300D) / {rows}) + 2 * (lag + 2)"
    tried = tried.withColumn(
        "used_lag", F.expr(f"case when tested then array_min(transform(sequence(0, int(top)), lag -> struct({score} as score, lag as lag))).lag end")
    )
    tried = tried.withColumn("own", F.when(F.col("tested"), moment_matrix("used_lag", "used_lag")))
    tried = tried.withColumn("fit", F.when(F.col("tested"), swept("own", "used_lag + 2")["m"]))
    tried = tried.withColumn("nobs", F.when(F.col("tested"), F.col("m") - F.col("used_lag")).cast("int"))
    error = "sqrt(greatest(fit[0][0] * fit[used_lag + 2][used_lag + 2] / greatest(nobs - used_lag - 2, 1), 0D))"
    return tried.withColumn(
        "adf_statistic", F.expr(f"case when tested then coalesce(try_divide(fit[0][used_lag + 2], {error}), double('NaN')) end")
    )


def adf_stages(df: DataFrame, significance: float | None = 0.05, value: str = "modal_price") -> DataFrame:
    """A row ``original`` per series and, where that one is not stationary, a
    row ``differenced``; without ``significance`` only the first.

    A series is at daily grain; both stages share one shuffle on the series.
    """
    y = F.col(value).cast("double")
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    slim = df.select(*SERIES, "date", F.when(known(y), y).alias("y"))
    given = [F.struct(F.lit("original").alias("stage"), F.col("y").alias("y"))]
    if significance is not None:
        given.append(F.struct(F.lit("differenced").alias("stage"), (F.col("y") - F.col("before")).alias("y")))
    both = slim.withColumn("before", F.lag("y").over(in_order())).select(*SERIES, "date", F.explode(F.array(*given)).alias("s"))
    both = both.select(*SERIES, "s.stage", "date", "s.y").where("y is not null")
    longest = slim.where("y is not null").groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    moments = lag_moments(both, [*SERIES, "stage"], "y", "date", top_lag(longest))
    top = F.least(F.ceil(12.0 * F.pow(F.col("n") / 100.0, F.lit(0.25))), F.floor(F.col("n") / 2) - 2)
    found = unit_root(moments.withColumn("top", F.greatest(top, F.lit(0)).cast("int")))
    tau, nobs = F.col("adf_statistic"), F.col("nobs")
    out = found.select(
        *SERIES, "stage", "adf_statistic", adf_p_value(tau).alias("p_value"),
        *[adf_critical(level, nobs).alias(f"critical_{level}") for level in LEVELS], "used_lag", "nobs",
    )
    if significance is None:
        return out
    first = out.where("stage = 'original'").select(*SERIES, (F.col("p_value") > significance).alias("again"))
    return out.join(first, SERIES).where("stage = 'original' or again").drop("again")


def adf_test(df: DataFrame, value: str = "modal_price") -> DataFrame:
    """One row per series with a known value."""
    return adf_stages(df, None, value).drop("stage")


def make_stationary(
    df: DataFrame, significance: float = 0.05, value: str = "modal_price"
) -> tuple[DataFrame, DataFrame]:
    """(series, diagnostics): non-stationary series are differenced once and
    tested again; the diagnostics carry one row per test stage.

    The test result, at most two short rows a series, is stored once for both.
    """
    stages = materialise(adf_stages(df, significance, value))
    failed = (F.col("stage") == "original") & (F.col("p_value") > significance)
    rejected = stages.filter(failed).select(*SERIES)
    levels = df.select(*SERIES, "date", F.col(value).alias("value"))
    changed = first_difference(levels.join(rejected, SERIES, "left_semi"), "value").select(
        *SERIES, "date", F.col("diff").alias("value")
    )
    kept = levels.join(rejected, SERIES, "left_anti").filter(F.col("value").isNotNull())
    series = kept.withColumn("differenced", F.lit(False)).unionByName(
        changed.withColumn("differenced", F.lit(True))
    )
    diagnostics = stages.select(
        *SERIES, F.lit("ADF").alias("test_name"), "stage",
        "adf_statistic", "p_value", "critical_1pct", "critical_5pct", "critical_10pct",
        (F.col("p_value") <= significance).alias("is_stationary"),
        F.when(F.col("stage") == "original", F.col("p_value") > significance).otherwise(True)
        .alias("differencing_applied"),
    )
    return series, diagnostics
