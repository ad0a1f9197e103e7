"""Group aggregates, leaderboards, statistics, operational metrics, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import constants as K
from furrow.catalog.joins import ATTR, attributions
from furrow.catalog.registry import newest_ship, q, qs, query, rounded
from furrow.functions.stats import z_score
from furrow.operators import aggregates as A, drift, ops, series, stationarity
from furrow.sources.canonical import load, table

MODELS = ["lag1", "lag7", "mean7"]
SERIES = ["crop", "mandi"]
TRIO = [*SERIES, "model_name"]


def predictions(spark, sf):
    return table(spark, sf, "predictions")


# errors of every (series, model), shared by the score queries
ERRORS = """
    , st as (select *, sign(actual - lag(actual) over w) as da, sign(predicted - lag(predicted) over w) as dp
      from predictions window w as (partition by crop, mandi, model_name order by date)),
    ev as (select crop, mandi, model_name, sqrt(avg((actual - predicted) * (actual - predicted))) as rmse,
        avg(abs(actual - predicted)) as mae,
        coalesce(avg(case when actual <> 0 then abs((actual - predicted) / actual) end) * 100, 0) as mape,
        coalesce(avg(case when da is not null then case when da = dp then 1.0 else 0.0 end end) * 100, 50)
          as directional_accuracy,
        avg(case when actual between lower_bound and upper_bound then 1.0 else 0.0 end) * 100
          as pi_coverage_95,
        count(*) as n
      from st group by crop, mandi, model_name)"""


def evaluations(spark, sf):
    return A.forecast_errors(predictions(spark, sf), TRIO)


def score_query(name, column):
    twin = ERRORS + f" select crop, mandi, model_name, {', '.join(f'{qs(c)} as {c}' for c in column)} from ev"

    @query(name, "predictions", sql=twin)
    def run(spark, sf):
        return rounded(evaluations(spark, sf).select(*TRIO, *column), column)

    return run


score_query("err_rmse_mae", ["rmse", "mae"])
score_query("err_mape", ["mape"])
score_query("err_direction", ["directional_accuracy"])
score_query("err_coverage", ["pi_coverage_95"])

SCORES = ["rmse", "mae", "mape", "directional_accuracy", "pi_coverage_95"]


@query("history_summary", "daily_prices", sql=f"""
    select crop, mandi, min(modal_price) as min_price, max(modal_price) as max_price,
      cast(round_even(avg(modal_price), 0) as double) as avg_price
    from daily_prices where date >= (select max(date) from daily_prices) - 30
    group by crop, mandi""")
def history_summary(spark, sf):
    recent = table(spark, sf, "daily_prices").filter(
        F.col("date") >= F.date_sub(newest_ship(spark, sf), 30)
    )
    return A.history_summary(recent)


@query("max_id_per_key", "raw_prices", sql="""
    select crop, state, fetch_date, max(id) as max_id from raw_prices group by crop, state, fetch_date""")
def max_id_per_key(spark, sf):
    return A.max_id_per_key(table(spark, sf, "raw_prices"), ["crop", "state", "fetch_date"])


@query("minmax_scale", "daily_prices", sql=f"""
    , s as (select crop, mandi, date, modal_price, min(modal_price) over w as lo,
        max(modal_price) over w as hi, min(msp) over w as mlo, max(msp) over w as mhi, msp
      from daily_prices window w as (partition by crop, mandi))
    select crop, mandi, date, coalesce((modal_price - lo) / nullif(hi - lo, 0), 0) as modal_price_scaled,
      coalesce((msp - mlo) / nullif(mhi - mlo, 0), 0) as msp_scaled,
      {qs('coalesce((modal_price - lo) / nullif(hi - lo, 0), 0) * (hi - lo) + lo')} as restored from s""")
def minmax_scale(spark, sf):
    scaled = A.minmax_scale(table(spark, sf, "daily_prices"), ["modal_price", "msp"])
    back = A.minmax_inverse(
        F.col("modal_price_scaled"), F.col("modal_price_min"), F.col("modal_price_max")
    )
    return scaled.select(
        *SERIES, "date", "modal_price_scaled", "msp_scaled", q(back).alias("restored")
    )


@query("leaderboard", "predictions", sql=ERRORS + " select model_name, " + ", ".join(
    f"{qs(f'avg({c})')} as {c}" for c in SCORES) + " from ev group by model_name")
def leaderboard(spark, sf):
    return rounded(A.leaderboard(evaluations(spark, sf), SCORES), SCORES)


def best_sql(metric, order):
    return (f"select '{metric}' as metric, (select model_name from bd order by {metric} {order}, "
            f"model_name limit 1) as best_model")


@query("leaderboard_best", "predictions", sql=ERRORS + ", bd as (select model_name, " + ", ".join(
    f"avg({c}) as {c}" for c in SCORES) + " from ev group by model_name) " + " union all ".join(
    best_sql(c, "asc" if c in ("rmse", "mae", "mape") else "desc") for c in SCORES))
def leaderboard_best(spark, sf):
    return A.leaderboard_best(A.leaderboard(evaluations(spark, sf), SCORES), MODELS)


@query("pivot_crop_model", "predictions", sql=ERRORS + " select crop, " + ", ".join(
    f"{qs(f'''avg(case when model_name = '{m}' then rmse end)''')} as {m}" for m in MODELS
) + " from ev group by crop")
def pivot_crop_model(spark, sf):
    return rounded(A.pivot_mean(evaluations(spark, sf), "crop", "model_name", MODELS), MODELS)


@query("improve_vs_baseline", "predictions", sql=ERRORS + f"""
    , bd as (select model_name, avg(rmse) as rmse from ev group by model_name),
    r as (select coalesce(max(case when model_name = 'lag1' then rmse end), avg(rmse)) as base from bd)
    select model_name, {qs('rmse')} as rmse, {qs('base')} as baseline_rmse,
      {qs('(base - rmse) / base * 100')} as improvement_pct
    from bd, r where model_name <> 'lag1'""")
def improve_vs_baseline(spark, sf):
    return rounded(
        A.improvement_over(evaluations(spark, sf), "lag1"), ["rmse", "baseline_rmse", "improvement_pct"]
    )


Z = repr(z_score())


@query("model_spread", "predictions", sql=f"""
    , d as (select crop, mandi, date, avg(predicted) as mean, stddev_pop(predicted) as std
      from predictions group by crop, mandi, date)
    select crop, mandi, date, {qs('mean')} as mean, {qs('std')} as std,
      {qs(f'mean - {Z}::double * std')} as lower_bound, {qs(f'mean + {Z}::double * std')} as upper_bound
    from d""")
def model_spread(spark, sf):
    """Mean and interval of the three lag models of a day."""
    out = A.ensemble_interval(predictions(spark, sf), [*SERIES, "date"], "predicted")
    return rounded(out, ["mean", "std", "lower_bound", "upper_bound"])


@query("residual_interval", "predictions", sql=f"""
    , s as (select crop, mandi, model_name, date, predicted, case when count(*) over w > 1
        then stddev_pop(actual - predicted) over w else avg(predicted) over w * 0.05::double end as spread
      from predictions window w as (partition by crop, mandi, model_name))
    select crop, mandi, model_name, date, {qs('spread', 3)} as spread,
      {qs('predicted - 1.96::double * spread', 3)} as lower_bound,
      {qs('predicted + 1.96::double * spread', 3)} as upper_bound from s""")
def residual_interval(spark, sf):
    out = A.residual_interval(predictions(spark, sf), TRIO)
    cols = ["spread", "lower_bound", "upper_bound"]
    return rounded(out.select(*TRIO, "date", *cols), cols, 3)


TAIL90 = """
    , t as (select crop, mandi, date, modal_price as y,
        row_number() over (partition by crop, mandi order by date desc) as rn from daily_prices),
    s as (select crop, mandi, date, y, row_number() over (partition by crop, mandi order by date) - 1 as i,
        count(*) over (partition by crop, mandi) as n from t where rn <= 90)"""


@query("linear_trend", "daily_prices", sql=TAIL90 + f"""
    select crop, mandi, {qs('regr_slope(y, i)')} as slope, {qs('regr_intercept(y, i)')} as intercept,
      count(*) as n from s group by crop, mandi""")
def linear_trend(spark, sf):
    tail = series.tail_n(table(spark, sf, "daily_prices"), 90)
    return rounded(A.linear_trend(tail), ["slope", "intercept"])


@query("step_volatility", "daily_prices", sql=TAIL90 + f"""
    , d as (select crop, mandi, y, y - lag(y) over (partition by crop, mandi order by i) as dy from s),
    v as (select crop, mandi, stddev_samp(dy) as sd, avg(y) as m from d group by crop, mandi)
    select crop, mandi, {qs('case when sd is null or sd = 0 then m * 0.03::double else sd end')}
      as volatility from v""")
def step_volatility(spark, sf):
    tail = series.tail_n(table(spark, sf, "daily_prices"), 90)
    return rounded(A.step_volatility(tail), ["volatility"])


KS = """
    , e as (select max(date) as e from daily_prices),
    x as (select crop, modal_price as v, case when date < e - 90 then 1 else 0 end as a,
        case when date >= e - 90 then 1 else 0 end as b
      from daily_prices, e where date >= e - 180 and date < e),
    c as (select crop, v, sum(a) over w as c1, sum(b) over w as c2 from x
      window w as (partition by crop order by v range between unbounded preceding and current row)),
    n as (select crop, sum(a) as n1, sum(b) as n2 from x group by crop having sum(a) >= 10 and sum(b) >= 10),
    d as (select c.crop, cast(n1 as bigint) as n1, cast(n2 as bigint) as n2,
        max(abs(cast(c1 as double) / cast(n1 as double) - cast(c2 as double) / cast(n2 as double)))
          as statistic
      from c join n on c.crop = n.crop group by c.crop, n1, n2),
    l as (select *, statistic * sqrt(cast(n1 * n2 as double) / (n1 + n2)) as lam from d),
    p as (select crop, n1, n2, statistic, case when lam < 0.2 then 1.0::double else greatest(0, least(1,
        2 * list_sum(list_transform(range(1, 101), lambda k:
          (case when k % 2 = 1 then 1.0 else -1.0 end) * exp(-2.0::double * k * k * lam * lam))))) end
          as p_value from l)"""


@query("ks_drift", "daily_prices", sql=KS + f"""
    select crop, n1, n2, {qs('statistic', 8)} as statistic, {qs('p_value', 6)} as p_value,
      p_value < 0.05::double as drift from p""")
def ks_drift(spark, sf):
    out = drift.ks_drift(table(spark, sf, "daily_prices"), ["crop"], newest_ship(spark, sf))
    return out.select(
        "crop", "n1", "n2", q("statistic", 8).alias("statistic"), q("p_value", 6).alias("p_value"), "drift"
    )


# the pooled values drawn one by one: i of them from the first sample, with probability pr
EXACT = KS + """
    , lat as (select crop, n1, n2, statistic, cast(round(statistic * n1 * n2) as bigint) as reach from p),
    ex as (with recursive walk(crop, n1, n2, reach, drawn, i, pr) as (
        select crop, n1, n2, reach, cast(0 as bigint), cast(0 as bigint), 1.0::double from lat where reach > 0
        union all
        select crop, n1, n2, reach, drawn + 1, i, sum(pr) from (
          select crop, n1, n2, reach, drawn, i + up as i,
            pr * (case when up = 1 then n1 - i else n2 - (drawn - i) end) / (n1 + n2 - drawn) as pr
          from walk, (select unnest([0, 1]) as up) where drawn < n1 + n2) s
        where pr > 0 and abs(i * n2 - (drawn + 1 - i) * n1) < reach
        group by crop, n1, n2, reach, drawn, i)
      select crop, 1 - sum(case when drawn = n1 + n2 then pr else 0 end) as p_value from walk group by crop)"""


@query("ks_drift_exact", "daily_prices", sql=EXACT + f"""
    select lat.crop, n1, n2, {qs('statistic', 8)} as statistic, {qs('coalesce(ex.p_value, 1)', 6)} as p_value,
      'exact' as method, coalesce(ex.p_value, 1) < 0.05::double as drift
    from lat left join ex on ex.crop = lat.crop""")
def ks_drift_exact(spark, sf):
    """Exact small-sample p-values by lattice-path counting."""
    out = drift.ks_drift(table(spark, sf, "daily_prices"), ["crop"], newest_ship(spark, sf), exact=True)
    return rounded(rounded(out, ["statistic"], 8), ["p_value"], 6)


def sweep_sql(name: str, given: str, skip: str, lags: str) -> str:
    """CTEs: the regression of ``given`` (key, v, d, m and more) on its level, a
    constant and ``lags`` changes over the rows from ``skip`` on: one row a swept
    column, ``k`` of them done, with the matrix and the residual sums so far."""
    return f"""
    , {name}_x as (select *, list_transform(range(0, {lags} + 3), lambda c: case
          when c = 0 then v[{skip} + 1:m] when c = 1 then list_transform(range({skip}, m), lambda x: 1::double)
          when c = {lags} + 2 then d[{skip} + 1:m] else d[{skip} - c + 2:m - c + 1] end) as cols from {given}),
    {name} as (with recursive sw as (
        select crop, mandi, stage, {lags} as lags, m - {skip} as nobs, 0 as k, cast([] as double[]) as rss,
          list_transform(cols, lambda a: list_transform(cols, lambda b: list_inner_product(a, b))) as mt from {name}_x
        union all
        select crop, mandi, stage, lags, nobs, k + 1, list_append(rss, nt[lags + 3][lags + 3]), nt
        from (select *, list_transform(mt, lambda row, i: case
            when i = k + 1 then list_transform(row, lambda x, j: case when j = k + 1 then 1 / x else x / row[k + 1] end)
            else list_transform(row, lambda x, j: case when j = k + 1 then -x / mt[k + 1][k + 1]
              else x - row[k + 1] * mt[k + 1][j] / mt[k + 1][k + 1] end) end) as nt from sw where k < lags + 2))
      select * from sw where k = lags + 2)"""


def cdf_sql(x: str) -> str:
    """Standard normal distribution function of ``x`` by its power series."""
    odd = "lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)"
    total = f"list_sum(list_transform(range(0, 121), lambda k: exp((2 * k + 1) * ln(abs({x})) - ({odd}))))"
    return f"""(case when {x} < -8 then 0 when {x} > 8 then 1 when {x} = 0 then 0.5
      else 0.5 + sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {total} end)"""


def poly_sql(x: str, coefficients) -> str:
    return " + ".join(f"({c!r})::double * pow({x}, {i})" for i, c in enumerate(coefficients))


def unit_root_sql(source: str) -> str:
    """CTE ``tested``: both test stages of every series of ``source``, straight from the regressions."""
    return f"""
    , y0 as (select crop, mandi, date, modal_price::double as y,
        modal_price::double - lag(modal_price::double) over (partition by crop, mandi order by date) as dy from {source}),
    s0 as (
      select crop, mandi, 'original' as stage, list(y order by date) as y, count(*) as n from y0 where y is not null group by 1, 2
      union all
      select crop, mandi, 'differenced', list(dy order by date), count(*) from y0 where dy is not null group by 1, 2),
    s1 as (select crop, mandi, stage, n, n - 1 as m, list_transform(y, lambda x: x - y[1]) as v,
        list_transform(range(1, n), lambda i: y[i + 1] - y[i]) as d,
        cast(greatest(least(ceil(12 * pow(n / 100.0, 0.25)), n // 2 - 2), 0) as int) as top
      from s0 where n >= 8 and list_min(y) < list_max(y)){sweep_sql('common', 's1', 'top', 'top')},
    best as (select crop, mandi, stage, list_min(list_transform(range(0, lags + 1), lambda l:
        {{'score': nobs * ln(greatest(rss[l + 2], 1e-300) / nobs) + 2 * (l + 2), 'lag': l}})).lag as used from common),
    s2 as (select s1.*, used from s1 join best using (crop, mandi, stage)){sweep_sql('own', 's2', 'used', 'used')},
    st as (select crop, mandi, stage, lags as used_lag, nobs,
        mt[1][lags + 3] / sqrt(greatest(mt[1][1] * mt[lags + 3][lags + 3] / greatest(nobs - lags - 2, 1), 0)) as tau from own),
    sp as (select *, case when tau <= {K.ADF_TAU_STAR} then {poly_sql('tau', K.ADF_SMALL_P)} else {poly_sql('tau', K.ADF_LARGE_P)} end as z from st),
    tested as (select s0.crop, s0.mandi, s0.stage, tau as adf_statistic,
        case when tau > {K.ADF_TAU_MAX} then 1 when tau < {K.ADF_TAU_MIN} then 0 else {cdf_sql('z')} end as p_value,
        """ + ", ".join(f"{poly_sql('(1.0 / nobs)', K.ADF_CRITICAL[c])} as critical_{c}" for c in stationarity.LEVELS) + """,
        used_lag, nobs from s0 left join sp using (crop, mandi, stage))"""


UNIT_ROOT = ["adf_statistic", "p_value", "critical_1pct", "critical_5pct", "critical_10pct"]
UNIT_ROOT_SQL = ", ".join(f"{qs(c, 6)} as {c}" for c in UNIT_ROOT)


@query("adf_test", "daily_prices", sql=unit_root_sql("daily_prices") + f"""
    select crop, mandi, {UNIT_ROOT_SQL}, used_lag::int as used_lag, nobs::int as nobs from tested where stage = 'original'""")
def adf_test(spark, sf):
    return rounded(stationarity.adf_test(table(spark, sf, "daily_prices")), UNIT_ROOT, 6)


@query("make_stationary", "walk_prices", sql=unit_root_sql("walk_prices") + f"""
    select t.crop, t.mandi, 'ADF' as test_name, t.stage, {UNIT_ROOT_SQL.replace('((', '((t.')},
      t.p_value <= 0.05::double as is_stationary,
      case when t.stage = 'original' then t.p_value > 0.05::double else true end as differencing_applied
    from tested t join tested o on o.crop = t.crop and o.mandi = t.mandi and o.stage = 'original'
    where t.stage = 'original' or o.p_value > 0.05::double""")
def make_stationary(spark, sf):
    """Diagnostics of all series and of a random walk beside each."""
    _, diagnostics = stationarity.make_stationary(table(spark, sf, "walk_prices"))
    return rounded(diagnostics, UNIT_ROOT, 6)


@query("attr_importance", sql=ATTR + f"""
    , m as (select sample, feature, avg(abs(attribution)) as m from attributions group by sample, feature)
    select feature, {qs('avg(m)', 8)} as importance from m group by feature""")
def attr_importance(spark, sf):
    return rounded(A.attribution_importance(attributions(spark, sf)), ["importance"], 8)


@query("attr_signed", sql=ATTR + f"""
    select sample, feature, {qs('avg(attribution)', 8)} as contribution
    from attributions group by sample, feature""")
def attr_signed(spark, sf):
    return rounded(A.attribution_signed(attributions(spark, sf)), ["contribution"], 8)


@query("cv_score", "configs", sql=f"""
    , f as (select crop, lstm_units, sequence_length, id % 4 as fold, min(rmse) as best
      from configs group by crop, lstm_units, sequence_length, id % 4)
    select crop, lstm_units, sequence_length, {qs('avg(best)')} as score
    from f group by crop, lstm_units, sequence_length""")
def cv_score(spark, sf):
    folds = table(spark, sf, "configs").withColumn("fold", F.col("id") % 4)
    return rounded(A.cv_score(folds, ["crop", "lstm_units", "sequence_length"]), ["score"])


# per series: promotion of the best finished run against the deployed one
PROMOTED = """
    , after as (select crop, mandi, min(rmse_after) as rmse_after from runs
                where rmse_after is not null group by crop, mandi),
    before as (select crop, mandi, min(rmse_before) as rmse_before from runs
               where rmse_before is not null group by crop, mandi),
    cc as (select a.crop, a.mandi, rmse_after, rmse_before,
        coalesce((rmse_before - rmse_after) / rmse_before > 0.02::double, true) as model_promoted,
        coalesce((rmse_before - rmse_after) / rmse_before * 100, 100) as improvement
      from after a left join before b on a.crop = b.crop and a.mandi = b.mandi)"""


def challenged(spark, sf):
    runs = table(spark, sf, "runs")
    after = runs.filter("rmse_after is not null").groupBy(*SERIES).agg(
        F.min("rmse_after").alias("rmse_after")
    )
    before = runs.filter("rmse_before is not null").groupBy(*SERIES).agg(
        F.min("rmse_before").alias("rmse_before")
    )
    return A.champion_challenger(after, before, K.PROMOTION_MARGIN)


@query("champion_challenger", "runs", sql=PROMOTED + f"""
    select crop, mandi, rmse_after, rmse_before, model_promoted,
      {qs('improvement', 2)} as improvement_pct from cc""")
def champion_challenger(spark, sf):
    return rounded(challenged(spark, sf), ["improvement_pct"], 2)


@query("run_summary", "runs", sql="""
    , o as (select crop, mandi, case when status = 'failed' then 'failed'
        when coalesce((rmse_before - rmse_after) / rmse_before > 0.02::double, true) then 'promoted'
        else 'skipped' end as outcome from runs),
    g as (select crop, outcome, count(*) as runs,
        array_to_string(list_sort(list(distinct mandi)), ', ') as markets from o group by crop, outcome),
    f as (select c.crop, x.outcome from (select distinct crop from o) c,
        (select unnest(['promoted', 'skipped', 'failed']) as outcome) x),
    t as (select outcome, cast(sum(runs) as bigint) as total from g group by outcome)
    select f.crop, f.outcome, coalesce(g.runs, 0) as runs, coalesce(g.markets, 'None') as markets,
      coalesce(t.total, 0) as total
    from f left join g on f.crop = g.crop and f.outcome = g.outcome
    left join t on f.outcome = t.outcome""")
def run_summary(spark, sf):
    return A.run_summary(judged(spark, sf))


def judged(spark, sf):
    gain = F.try_divide(F.col("rmse_before") - F.col("rmse_after"), F.col("rmse_before"))
    return table(spark, sf, "runs").withColumn(
        "model_promoted", F.coalesce(gain > K.PROMOTION_MARGIN, F.lit(True))
    )


@query("run_names", "runs", sql="""
    , o as (select distinct concat(crop, ' @ ', mandi) as name, case when status = 'failed' then 'failed'
        when coalesce((rmse_before - rmse_after) / rmse_before > 0.02::double, true) then 'promoted'
        else 'skipped' end as outcome from runs),
    t as (select outcome, count(*) as total from o group by outcome),
    p as (select o.*, total, ('0x' || substr(md5(name), 1, 7))::bigint % ((total + 4) // 5) as part from o join t using (outcome)),
    l as (select outcome, part, total, array_to_string(list(name order by name), ', ') as names from p group by all)
    select x.outcome, coalesce(part, 0) as part, coalesce(total, 0) as total, coalesce(names, 'None') as names
    from (select unnest(['promoted', 'skipped', 'failed']) as outcome) x left join l on l.outcome = x.outcome""")
def run_names(spark, sf):
    """Promoted, skipped and failed names of the whole run, about five a row."""
    return A.run_names(judged(spark, sf), 5)


@query("metric_counter", "ops_events", sql="""
    select label, status_code, count(*) as n from ops_events group by label, status_code""")
def metric_counter(spark, sf):
    return ops.metric_counter(table(spark, sf, "ops_events"), ["label", "status_code"])


def edge_name(e):
    return f"le_{str(e).replace('.', '_')}"


EDGES = K.LATENCY_EDGES


def estimate_sql(p):
    out = f"{EDGES[-1]}::double"
    for i in range(len(EDGES) - 1, -1, -1):
        below = edge_name(EDGES[i - 1]) if i else "0"
        low = EDGES[i - 1] if i else 0.0
        out = (f"case when {edge_name(EDGES[i])} >= total * {p}::double then {low}::double + "
               f"({EDGES[i]}::double - {low}::double) * (total * {p}::double - {below}) / "
               f"nullif({edge_name(EDGES[i])} - {below}, 0) else {out} end")
    return out


@query("latency_histogram", "ops_events", sql=", h as (select label, " + ", ".join(
    f"count(*) filter (where latency <= {e}::double) as {edge_name(e)}" for e in EDGES
) + """, count(latency) as total, quantile_cont(latency, 0.5) as p50, quantile_cont(latency, 0.95) as p95,
      quantile_cont(latency, 0.99) as p99 from ops_events group by label)
    select h.* exclude (p50, p95, p99), """ + ", ".join(
    f"{qs(f'p{int(p * 100)}', 6)} as p{int(p * 100)}, {qs(estimate_sql(p), 6)} as est_p{int(p * 100)}"
    for p in (0.5, 0.95, 0.99)) + " from h")
def latency_histogram(spark, sf):
    out = ops.latency_histogram(table(spark, sf, "ops_events"), ["label"])
    return rounded(out, ["p50", "p95", "p99", "est_p50", "est_p95", "est_p99"], 6)


@query("hit_rate", "ops_events", sql="""
    select label, count(*) filter (where cache_hit) as hits,
      count(*) filter (where not cache_hit) as misses,
      cast(count(*) filter (where cache_hit) as double) / count(cache_hit) as hit_rate
    from ops_events group by label""")
def hit_rate(spark, sf):
    return ops.hit_rate(table(spark, sf, "ops_events"), ["label"])


@query("best_config", "configs", sql="""
    , c as (select distinct crop from (select p_type as crop from part
            union all select n_name as crop from nation)),
    b as (select *, row_number() over (partition by crop order by rmse, id) as rn from configs)
    select c.crop, b.rmse, coalesce(b.lstm_units, 128) as lstm_units, coalesce(b.dropout, 0.2::double) as dropout,
      coalesce(b.learning_rate, 0.001::double) as learning_rate,
      coalesce(b.sequence_length, 60) as sequence_length, coalesce(b.batch_size, 32) as batch_size
    from c left join b on lower(c.crop) = b.crop and b.rn = 1""")
def best_config(spark, sf):
    crops = load(spark, sf, "part").select(F.col("p_type").alias("crop")).unionByName(
        load(spark, sf, "nation").select(F.col("n_name").alias("crop"))
    )
    return A.best_config(table(spark, sf, "configs"), crops, K.DEFAULT_CONFIG)


@query("top_features", sql=ATTR + f"""
    , m as (select sample, feature, avg(abs(attribution)) as m from attributions group by sample, feature),
    i as (select feature, avg(m) as importance from m group by feature)
    select feature, {qs('importance', 8)} as importance from i order by importance desc, feature limit 15""")
def top_features(spark, sf):
    importance = A.attribution_importance(attributions(spark, sf))
    top = A.top_by(importance, 15, F.col("importance").desc(), F.col("feature"))
    return rounded(top, ["importance"], 8)


@query("top_trials", "configs", sql="""
    select id, crop, lstm_units, dropout, sequence_length, rmse from configs order by rmse, id limit 5""")
def top_trials(spark, sf):
    trials = table(spark, sf, "configs").select(
        "id", "crop", "lstm_units", "dropout", "sequence_length", "rmse"
    )
    return A.top_by(trials, 5, F.col("rmse"), F.col("id"))


@query("shuffle_rows", "daily_prices", sql="select crop, mandi, date, modal_price from daily_prices")
def shuffle_rows(spark, sf):
    rows = table(spark, sf, "daily_prices").select(*SERIES, "date", "modal_price")
    return A.shuffle_rows(rows, [*SERIES, "date"])
