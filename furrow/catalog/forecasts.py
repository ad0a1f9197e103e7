"""Forecast, back-test, learning and selection jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import constants as K
from furrow.catalog.aggregates import KS, TAIL90, SCORES, Z
from furrow.catalog.joins import ATTR, attributions
from furrow.catalog.registry import newest, newest_ship, q, qs, query, rounded
from furrow.catalog.scalars import duck_title, template_sql
from furrow.catalog.windows import features_sql
from furrow.operators import aggregates as A, drift, joins, replies
from furrow.plans import backtest as B, forecast as P, learn
from furrow.session import materialise, shared_folder
from furrow.sources import sinks
from furrow.sources.canonical import announcements_of, table

SERIES = ["crop", "mandi"]
KEYS = [*SERIES, "date"]
BOUNDS = ["predicted_price", "lower_bound", "upper_bound"]


def prices(spark, sf):
    return table(spark, sf, "daily_prices")


def season_ctes(keys: str, horizon: str) -> str:
    """CTEs from the tails ``s`` (keys, i, n, y) to ``fc``, for tails of 14 rows or more."""
    k = keys
    w = f"partition by {k} order by i"
    on = " and ".join(f"{{0}}.{c} = {{1}}.{c}" for c in k.split(", "))

    def j(a, b):
        return on.format(a, b)

    cols = ", ".join(f"m.{c}" for c in k.split(", "))
    return f"""
    , s0 as (select *, greatest(2, least(7, n // 3)) as p, greatest(2, least(7, n // 3)) // 2 as h
             from s where n >= 14),
    m as (select *, case when i between h and n - 1 - h then (sum(y) over ({w} rows between h preceding
        and h following) - case when p % 2 = 0 then 0.5::double * (lag(y, h) over ({w})
        + lead(y, h) over ({w})) else 0 end) / p end as tr from s0),
    hd as (select {k}, regr_slope(tr, i) as a, regr_intercept(tr, i) as b from m
           where i >= h and i < least(h + p, n - 1 - h) group by {k}),
    tl as (select {k}, regr_slope(tr, i) as a, regr_intercept(tr, i) as b from m
           where i >= greatest(h, n - 1 - h - p) and i < n - 1 - h group by {k}),
    de as (select {cols}, m.i, m.p, m.y - case when m.i < h then hd.a * m.i + hd.b
             when m.i > m.n - 1 - h then tl.a * m.i + tl.b else tr end as v
           from m join hd on {j('m', 'hd')} join tl on {j('m', 'tl')}),
    ph as (select {k}, i % p as phase, avg(v) as v from de group by {k}, i % p),
    se as (select {k}, phase, v - avg(v) over (partition by {k}) as seasonal from ph),
    st as (select *, y - lag(y) over ({w}) as dy from s0),
    ln as (select {k}, max(n) as n, max(p) as period, regr_slope(y, i) as slope,
             regr_intercept(y, i) as intercept,
             case when coalesce(stddev_samp(dy), 0) = 0 then avg(y) * 0.03::double
                  else stddev_samp(dy) end as vol
           from st group by {k}),
    hz as (select ln.*, unnest(range(1, {horizon} + 1)) as step from ln),
    fc as (select hz.*, slope * (n + step) + intercept + seasonal as p,
             1.96::double * vol * sqrt(step) as ci
           from hz join se on {j('hz', 'se')} and se.phase = ((hz.n + hz.step) % hz.n) % hz.period)"""


BASELINE = TAIL90 + season_ctes("crop, mandi", "30")
LAST_DAY = "(select max(date) from daily_prices)"


@query("future_dates", "daily_prices", sql=f"""
    select distinct crop, mandi, cast(k as int) as step, {LAST_DAY} + cast(k as int) as date
    from daily_prices, (select unnest(range(1, 31)) as k)""")
def future_dates(spark, sf):
    return P.future_dates(
        prices(spark, sf).select(*SERIES).distinct(), newest_ship(spark, sf), 30
    )


@query("seasonal_profile", "daily_prices", sql=BASELINE + f"""
    select crop, mandi, 7 as period, phase, {qs('seasonal')} as seasonal from se""")
def seasonal_profile(spark, sf):
    return rounded(P.seasonal_profile(prices(spark, sf)), ["seasonal"])


@query("baseline_forecast", "daily_prices", sql=BASELINE + f"""
    select crop, mandi, cast(step as int) as step, {LAST_DAY} + cast(step as int) as date,
      {qs('p', 3)} as predicted_price, {qs('p - ci', 3)} as lower_bound, {qs('p + ci', 3)} as upper_bound
    from fc""")
def baseline_forecast(spark, sf):
    out = P.baseline_forecast(prices(spark, sf), 30, newest_ship(spark, sf), digits=None)
    return rounded(out, BOUNDS, 3)


@query("ensemble_interval", "daily_prices", sql=BASELINE + f"""
    , cg as (select crop, mandi, i - 1 as nth, n - 1 as m, y - lag(y) over (partition by crop, mandi order by i) as c from s where n >= 14),
    cm as (select crop, mandi, nth, m, c - avg(c) over (partition by crop, mandi) as c from cg where c is not null),
    dw as (select fc.crop, fc.mandi, step, p, draw, m,
        (('0x' || substr(md5(concat_ws('|', fc.crop, fc.mandi, draw::varchar, ((step - 1) // 7)::varchar)), 1, 7))::bigint % m + (step - 1) % 7) % m as nth
      from fc join (select distinct crop, mandi, m from cm) using (crop, mandi), (select unnest(range(1, 51)) as draw)),
    pa as (select dw.crop, dw.mandi, step, draw, p + sum(c) over (partition by dw.crop, dw.mandi, draw order by step) as value
      from dw join cm on cm.crop = dw.crop and cm.mandi = dw.mandi and cm.nth = dw.nth),
    en as (select crop, mandi, step, avg(value) as mean, stddev_pop(value) as std from pa group by crop, mandi, step)
    select crop, mandi, cast(step as int) as step, {LAST_DAY} + cast(step as int) as date, {qs('mean', 3)} as mean, {qs('std', 3)} as std,
      {qs(f'mean - {Z}::double * std', 3)} as lower_bound, {qs(f'mean + {Z}::double * std', 3)} as upper_bound from en""")
def ensemble_interval(spark, sf):
    """Mean and normal interval of 50 bootstrapped paths, every series and day ahead."""
    draws = P.bootstrap_draws(prices(spark, sf), 30, newest_ship(spark, sf))
    out = A.ensemble_interval(draws, [*SERIES, "step", "date"], "value")
    return rounded(out, ["mean", "std", "lower_bound", "upper_bound"], 3)


@query("horizon_mean", "daily_prices", sql=BASELINE + f"""
    select crop, mandi, {qs('avg(p)', 3)} as avg_predicted_price from fc group by crop, mandi""")
def horizon_mean(spark, sf):
    days = P.baseline_forecast(prices(spark, sf), 30, newest_ship(spark, sf), digits=None)
    return rounded(A.horizon_mean(days), ["avg_predicted_price"], 3)


@query("flat_forecast", "spot_prices", sql="""
    , s as (select crop, mandi, modal_price as y, count(*) over (partition by crop, mandi) as n,
        row_number() over (partition by crop, mandi order by date) - 1 as i
      from spot_prices where modal_price is not null)""" + season_ctes("crop, mandi", "7") + f"""
    , every as (
      select crop, mandi, step, p, p - ci as lo, p + ci as hi from fc
      union all
      select crop, mandi, k as step, y as p, y * 0.95::double as lo, y * 1.05::double as hi
      from s, (select unnest(range(1, 8)) as k) where n < 14 and i = n - 1)
    select crop, mandi, cast(step as int) as step,
      (select cast(max(ts) as date) from events) + cast(step as int) as date,
      {qs('p', 3)} as predicted_price, {qs('lo', 3)} as lower_bound, {qs('hi', 3)} as upper_bound from every""")
def flat_forecast(spark, sf):
    """Short series: flat under 14 prices, trend and season from there on."""
    out = P.baseline_forecast(
        table(spark, sf, "spot_prices"), 7, newest(spark, sf, "events", "ts"), digits=None
    )
    return rounded(out, BOUNDS, 3)


@query("alerts_due", "subscriptions", "users", "daily_prices", sql=BASELINE + f"""
    , f as (select s.crop, s.mandi, s.y as current_price, {qs('fc.p', 2)} as next_price
      from s join fc on fc.crop = s.crop and fc.mandi = s.mandi and fc.step = 1 where s.i = s.n - 1),
    p as (select b.*, coalesce(nullif(b.phone_number, ''), nullif(u.phone, '')) as ph
      from subscriptions b left join users u on b.user_id = u.id where b.is_active)
    select p.id, case when starts_with(ph, 'whatsapp:') then ph
      when starts_with(ph, '+') then concat('whatsapp:', ph)
      else concat('whatsapp:+91', ph) end as phone, language, p.crop, p.mandi, threshold_price,
      current_price, next_price,
      concat({duck_title('p.crop')}, ' @ ', {duck_title('p.mandi')}) as title,
      concat('₹', cast(next_price as varchar), '/q') as quote
    from p join f on p.crop = f.crop and p.mandi = f.mandi
    where ph is not null and (threshold_price = 0 or current_price > threshold_price
                              or next_price > threshold_price)""")
def alerts_due(spark, sf):
    """Subscriptions due by today's price or tomorrow's forecast of their market."""
    levels = P.next_prices(prices(spark, sf)).withColumn("next_price", q("next_price", 2))
    return joins.alerts_due(table(spark, sf, "subscriptions"), table(spark, sf, "users"), levels)


@query("extend_horizon", "daily_prices", sql=BASELINE + f"""
    , al as (select crop, mandi, step, p, p - ci as lo, p + ci as hi from fc
      union all
      select crop, mandi, 30 + k as step, p, p - ci * power(1.05::double, k) as lo,
        p + ci * power(1.05::double, k) as hi
      from fc, (select unnest([1, 2, 3]) as k) where step = 30)
    select crop, mandi, cast(step as int) as step, {LAST_DAY} + cast(step as int) as date,
      {qs('p', 3)} as predicted_price, {qs('lo', 3)} as lower_bound, {qs('hi', 3)} as upper_bound from al""")
def extend_horizon(spark, sf):
    days = P.baseline_forecast(prices(spark, sf), 30, newest_ship(spark, sf), digits=None)
    return rounded(P.extend_horizon(days, 33), BOUNDS, 3)


# mean forecast of each series with its advice, from ``fc``
REPORT = """
    , d as (select crop, mandi, step, cast(round_even(p, 2) as decimal(18,2)) as p from fc),
    g as (select crop, mandi, sum(cast(p * 100 as bigint)) as cents, count(*) as n from d group by crop, mandi),
    a as (select crop, mandi, floor(cast(cents as double) / n) as whole,
            cents - n * cast(floor(cast(cents as double) / n) as bigint) as rest, n from g),
    v as (select crop, mandi, n, cast(whole + case when 2 * rest > n or (2 * rest = n and whole % 2 <> 0)
            then 1 else 0 end as double) / 100 as avg_p from a),
    c as (select crop, mandi, max(msp) as msp, arg_max(modal_price, date) as current_price
          from daily_prices group by crop, mandi),
    x as (select v.*, c.msp, c.current_price,
            cast(round_even(abs(avg_p - msp) / msp * 100, 1) as double) as pct from v join c
            on v.crop = c.crop and v.mandi = c.mandi)
    , rp as (select x.*, case when avg_p > msp then 'SELL' else 'HOLD' end as recommendation,
      concat('Predicted avg price ₹', format('{:,.0f}', avg_p), ' is ', cast(pct as varchar),
        case when avg_p > msp then '% above MSP ₹' else '% below MSP ₹' end, format('{:,.0f}', msp),
        case when avg_p > msp then '' else ' — consider holding' end) as recommendation_reason from x)"""


@query("forecast_report", "daily_prices", sql=BASELINE + REPORT + f"""
    select x.crop, x.mandi, 30 as horizon_days, current_price, msp, avg_p as avg_predicted_price,
      recommendation, recommendation_reason,
      cast(n as int) as days, cast(d.p as double) as first_price, {LAST_DAY} + 30 as last_day
    from rp x join d on d.crop = x.crop and d.mandi = x.mandi and d.step = 1""")
def forecast_report(spark, sf):
    daily = prices(spark, sf)
    floors = daily.groupBy("crop").agg(F.max("msp").alias("msp"))
    out = P.forecast_report(daily, 30, newest_ship(spark, sf), floors)
    return out.select(
        *[c for c in out.columns if c != "forecast"],
        F.size("forecast").alias("days"),
        F.get("forecast", F.lit(0))["predicted_price"].alias("first_price"),
        F.try_element_at("forecast", F.lit(-1))["date"].alias("last_day"),
    )


def reply_sql(kind: str, templates: dict[str, str], slots: dict[str, str]) -> str:
    text = template_sql("lang", templates)
    for name, value in slots.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return f"select crop, mandi, lang, '{kind}' as command, {text} as reply from both_, langs"


NAMED = {"crop": duck_title("crop"), "mandi": duck_title("mandi")}


@query("market_replies", "daily_prices", sql=TAIL90 + season_ctes("crop, mandi", "7") + REPORT + f"""
    , hist as (select crop, mandi, min(modal_price) as lo, max(modal_price) as hi, avg(modal_price) as mid
      from daily_prices where date >= {LAST_DAY} - 30 group by crop, mandi),
    both_ as (select rp.*, lo, hi, mid from rp left join hist on rp.crop = hist.crop and rp.mandi = hist.mandi),
    langs as (select unnest({K.LANGUAGES}) as lang),
    every as (
    """ + reply_sql("history", K.HISTORY_TEMPLATE, {
        **NAMED, "min": "cast(lo as varchar)", "max": "cast(hi as varchar)",
        "avg": "cast(cast(round_even(mid, 0) as bigint) as varchar)"}) + " union all " + reply_sql(
    "forecast", K.FORECAST_TEMPLATE, {
        **NAMED, "current": "cast(current_price as varchar)", "msp": "cast(msp as varchar)",
        "avg": "cast(avg_p as varchar)", "rec": "recommendation", "reason": "recommendation_reason"}) + """)
    select * from every where reply is not null""")
def market_replies(spark, sf):
    """History and 7-day forecast replies of every market in every language."""
    daily = materialise(prices(spark, sf).select(*KEYS, "modal_price", "msp"))
    as_of = newest_ship(spark, sf)
    floors = daily.groupBy("crop").agg(F.max("msp").alias("msp"))
    recent = A.history_summary(daily.filter(F.col("date") >= F.date_sub(as_of, 30)))
    return replies.market_replies(P.forecast_report(daily, 7, as_of, floors), recent)


def backtest_sql() -> str:
    horizon = "(select unnest([30, 60, 90]) as horizon)"
    return f"""
    , p as (select crop, mandi, date, modal_price, row_number() over (partition by crop, mandi order by date) - 1 as pos,
        lag(modal_price) over (partition by crop, mandi order by date) as before,
        count(*) over (partition by crop, mandi) as cnt from daily_prices),
    h as (select p.*, horizon, cast(greatest(horizon, floor(cnt * 0.15::double)) as bigint) as n_test
          from p, {horizon}),
    hh as (select *, cnt - n_test as n_train from h),
    s as (select crop, mandi, horizon, modal_price as y, pos - (n_train - 90) as i, 90 as n from hh
          where pos >= n_train - 90 and pos < n_train)
    {season_ctes('crop, mandi, horizon', '90')},
    act as (select crop, mandi, horizon, date, modal_price as actual, before, pos - n_train + 1 as step
            from hh where pos >= n_train and pos < n_train + horizon),
    predictions as (
      select crop, mandi, horizon, 'naive' as model_name, date, actual, before as predicted,
        before * 0.95::double as lower_bound, before * 1.05::double as upper_bound from act
      union all
      select a.crop, a.mandi, a.horizon, 'trend-season', a.date, actual, f.p, f.p - f.ci, f.p + f.ci
      from act a join fc f on a.crop = f.crop and a.mandi = f.mandi and a.horizon = f.horizon
        and a.step = f.step),
    dr as (select *, sign(actual - lag(actual) over w) as da, sign(predicted - lag(predicted) over w) as dp
      from predictions window w as (partition by crop, mandi, horizon, model_name order by date)),
    ev as (select crop, mandi, horizon, model_name,
        sqrt(avg((actual - predicted) * (actual - predicted))) as rmse, avg(abs(actual - predicted)) as mae,
        coalesce(avg(case when actual <> 0 then abs((actual - predicted) / actual) end) * 100, 0) as mape,
        coalesce(avg(case when da is not null then case when da = dp then 1.0 else 0.0 end end) * 100, 50)
          as directional_accuracy,
        avg(case when actual between lower_bound and upper_bound then 1.0 else 0.0 end) * 100
          as pi_coverage_95
      from dr group by crop, mandi, horizon, model_name),
    sz as (select crop, mandi, horizon, max(n_train) as n_train_samples, max(n_test) as n_test_samples
           from hh group by crop, mandi, horizon)"""


BACKTEST = backtest_sql()


@query("backtest", "daily_prices", sql=BACKTEST + f"""
    select ev.crop, ev.mandi, ev.horizon, model_name,
      {', '.join(f'{qs(c, 3)} as {c}' for c in SCORES)}, n_train_samples, n_test_samples
    from ev join sz on ev.crop = sz.crop and ev.mandi = sz.mandi and ev.horizon = sz.horizon""")
def backtest(spark, sf):
    return rounded(B.backtest(prices(spark, sf), K.HORIZONS), SCORES, 3)


@query("pivot_model_horizon", "daily_prices", sql=BACKTEST + " select model_name, " + ", ".join(
    f"{qs(f'avg(case when horizon = {h} then rmse end)', 3)} as h{h}" for h in K.HORIZONS
) + " from ev group by model_name")
def pivot_model_horizon(spark, sf):
    wide = A.pivot_mean(B.backtest(prices(spark, sf), K.HORIZONS), "model_name", "horizon", K.HORIZONS)
    return wide.select("model_name", *[q(F.col(f"`{h}`"), 3).alias(f"h{h}") for h in K.HORIZONS])


def features(spark, sf):
    daily = materialise(prices(spark, sf))
    return learn.stored_features(daily, announcements_of(daily))


STEPS = list(range(1, K.OUTPUT_STEPS + 1))


def matrix_sql() -> str:
    """CTE ``fe``: the feature matrix in full digits; ``rw``: its rows with all
    targets, their place and the length of their series."""
    full = features_sql(lambda value, digits=0: f"({value})")
    head, _, tail = full.rpartition("select * from f where")
    leads = ", ".join(f"lead(modal_price, {h}) over w" for h in STEPS)
    return head.rstrip() + f"""
    , fe as (select * from f where {tail}),
    tg as (select *, [{', '.join(f'{n}::double' for n in K.FEATURE_NAMES)}] as x, [{leads}] as y from fe
      window w as (partition by crop, mandi order by date)),
    rw as (select crop, mandi, date, x, y, row_number() over (partition by crop, mandi order by date) - 1 as pos,
        count(*) over (partition by crop, mandi) as n from tg where y[{len(STEPS)}] is not null)"""


def ridge_sql(train: str, targets: int, penalty: str = "0.1") -> str:
    """CTE ``lm``: weights ``w`` and intercepts ``b`` of the ridge regressions of
    ``train`` (configuration ``cfg``, x, y), by sweeping the features out of the
    matrix of products. ``penalty`` may use columns of ``cfg``."""
    p = len(K.FEATURE_NAMES)
    return f"""
    , cells as (select cfg, i, list(list_concat(x, y)[i]) as v from {train}, (select unnest(range(1, {p + targets + 1})) as i) group by cfg, i),
    st as (select cfg, i, v, list_avg(v) as mu, list_stddev_pop(v) as sd from cells),
    zz as (select cfg, i, mu, sd, list_transform(v, lambda a: case when i > {p} then a - mu when sd > 0 then (a - mu) / sd else 0 end) as z from st),
    gg as (select a.cfg, a.i, list(list_inner_product(a.z, b.z) / len(a.z) + case when a.i = b.i and a.i <= {p} then {penalty} else 0 end order by b.i) as r
      from zz a join zz b on a.cfg = b.cfg group by a.cfg, a.i),
    mx as (select cfg, list(r order by i) as mt from gg group by cfg),
    ss as (select cfg, list(mu order by i) as mu, list(sd order by i) as sd from zz group by cfg),
    sw as (with recursive s as (
        select cfg, 0 as k, mt from mx
        union all
        select cfg, k + 1, list_transform(mt, lambda row, i: case
            when i = k + 1 then list_transform(row, lambda x, j: case when j = k + 1 then 1 / x else x / row[k + 1] end)
            else list_transform(row, lambda x, j: case when j = k + 1 then -x / mt[k + 1][k + 1]
              else x - row[k + 1] * mt[k + 1][j] / mt[k + 1][k + 1] end) end) from s where k < {p})
      select cfg, mt from s where k = {p}),
    wt as (select cfg, mu, list_transform(range(1, {targets + 1}), lambda t: list_transform(range(1, {p + 1}), lambda i:
        case when sd[i] > 0 then mt[i][{p} + t] / sd[i] else 0 end)) as w from sw join ss using (cfg)),
    lm as (select cfg, w, list_transform(range(1, {targets + 1}), lambda t: mu[{p} + t] - list_inner_product(w[t], mu[1:{p}])) as b from wt)"""


def learned_sql(fit: str = "true", score: str = "true") -> str:
    """CTE ``ev``: errors of the direct regressions per series and horizon."""
    return matrix_sql() + f"""
    , tr as (select 0 as cfg, x, y from rw where pos < floor(n * 0.8::double) - {len(STEPS)} and {fit})""" + ridge_sql("tr", len(STEPS)) + f"""
    , pr as (select crop, mandi, h as horizon, date, y[h] as actual, list_inner_product(x, w[h]) + b[h] as predicted
      from (select * from rw where pos >= floor(n * 0.8::double) and {score}) r, lm, (select unnest(range(1, {len(STEPS) + 1})) as h)),
    sp as (select *, case when count(*) over s > 1 then stddev_pop(actual - predicted) over s else avg(predicted) over s * 0.05::double end as spread
      from pr window s as (partition by crop, mandi, horizon)),
    dr as (select *, sign(actual - lag(actual) over w) as da, sign(predicted - lag(predicted) over w) as dp from sp
      window w as (partition by crop, mandi, horizon order by date)),
    ev as (select crop, mandi, horizon, sqrt(avg((actual - predicted) * (actual - predicted))) as rmse, avg(abs(actual - predicted)) as mae,
        coalesce(avg(case when actual <> 0 then abs((actual - predicted) / actual) end) * 100, 0) as mape,
        coalesce(avg(case when da is not null then case when da = dp then 1.0 else 0.0 end end) * 100, 50) as directional_accuracy,
        avg(case when abs(actual - predicted) <= 1.96::double * spread then 1.0 else 0.0 end) * 100 as pi_coverage_95, count(*) as n
      from dr group by crop, mandi, horizon)"""


def learned_bands_sql() -> str:
    """CTE ``lp``: the regressions' forecasts of every test day, one fit a horizon."""
    full = features_sql(lambda value, digits=0: f"({value})")
    head, _, tail = full.rpartition("select * from f where")
    leads = ", ".join(f"lead(modal_price, {h}) over w as y{h}, lead(date, {h}) over w as d{h}" for h in K.HORIZONS)
    pick = lambda c: "case horizon " + " ".join(f"when {h} then {c}{h}" for h in K.HORIZONS) + " end"
    return f"""
    , fst as (select crop, mandi, horizon, date as first_day from hh where pos = n_train),
    lp as (with one as (select 1) {head.rstrip()}
      , tg as (select crop, mandi, [{', '.join(f'{n}::double' for n in K.FEATURE_NAMES)}] as x, {leads} from f where {tail}
          window w as (partition by crop, mandi order by date)),
      ex as (select crop, mandi, x, horizon, {pick('y')} as y1, {pick('d')} as target, first_day
        from tg join fst using (crop, mandi) where {pick('y')} is not null),
      tr as (select horizon as cfg, x, [y1] as y from ex where target < first_day){ridge_sql('tr', 1)},
      rm as (select cfg, sqrt(avg(pow(y[1] - list_inner_product(x, w[1]) - b[1], 2))) as spread from tr join lm using (cfg) group by cfg)
      select crop, mandi, horizon, target as date, list_inner_product(x, w[1]) + b[1] as predicted, 1.96::double * spread as width
      from ex join lm on lm.cfg = horizon join rm on rm.cfg = horizon where target >= first_day)"""


@query("backtest_models", "daily_prices", "announcements", sql=BACKTEST + learned_bands_sql() + f"""
    , lr as (select act.crop, act.mandi, act.horizon, act.date, case when predicted is not null then actual end as actual,
        predicted, predicted - width as lower_bound, predicted + width as upper_bound
      from act left join lp on lp.crop = act.crop and lp.mandi = act.mandi and lp.horizon = act.horizon and lp.date = act.date),
    ld as (select *, sign(actual - lag(actual) over w) as da, sign(predicted - lag(predicted) over w) as dp from lr
      window w as (partition by crop, mandi, horizon order by date)),
    le as (select crop, mandi, horizon, 'regression' as model_name,
        sqrt(avg((actual - predicted) * (actual - predicted))) as rmse, avg(abs(actual - predicted)) as mae,
        coalesce(avg(case when actual <> 0 then abs((actual - predicted) / actual) end) * 100, 0) as mape,
        coalesce(avg(case when da is not null then case when da = dp then 1.0 else 0.0 end end) * 100, 50) as directional_accuracy,
        avg(case when actual between lower_bound and upper_bound then 1.0 else 0.0 end) * 100 as pi_coverage_95
      from ld group by crop, mandi, horizon),
    al as (select * from ev union all select crop, mandi, horizon, model_name, coalesce(rmse, 999), coalesce(mae, 999),
        case when rmse is null then 999 else mape end, case when rmse is null then 0 else directional_accuracy end,
        case when rmse is null then 0 else pi_coverage_95 end from le)
    select al.crop, al.mandi, al.horizon, model_name,
      {', '.join(f'{qs(c, 3)} as {c}' for c in SCORES)}, n_train_samples, n_test_samples
    from al join sz on al.crop = sz.crop and al.mandi = sz.mandi and al.horizon = sz.horizon""")
def backtest_models(spark, sf):
    """The back-test with the learned regression beside the other two models."""
    daily = materialise(prices(spark, sf))
    learned = learn.holdout_forecasts(learn.stored_features(daily, announcements_of(daily)), daily, K.HORIZONS)
    return rounded(B.backtest(daily, K.HORIZONS, {"regression": learned}), SCORES, 3)


SCORED = ", ".join(f"{qs(c, 3)} as {c}" for c in SCORES)
RICH, OTHER = ["STANDARD", "MEDIUM", "LARGE"], ["PROMO", "SMALL", "ECONOMY"]


@query("regress_forecast", "daily_prices", "announcements", sql=learned_sql() + f"""
    select crop, mandi, horizon, {SCORED}, n from ev""")
def regress_forecast(spark, sf):
    """Held-out scores of the pooled direct regressions, per series and horizon."""
    _, scored = learn.regress_forecast(features(spark, sf), STEPS)
    return rounded(A.forecast_errors(scored, [*SERIES, "horizon"]), SCORES, 3)


def in_list(crops) -> str:
    return "crop in (" + ", ".join(f"'{c}'" for c in crops) + ")"


@query("pooled_transfer", "daily_prices", "announcements", sql=learned_sql(in_list(RICH), in_list(OTHER)) + f"""
    select crop, mandi, horizon, {SCORED}, n from ev where horizon = {K.OUTPUT_STEPS}""")
def pooled_transfer(spark, sf):
    """Fit on three data-rich crops, score the other ones."""
    _, scored = learn.regress_forecast(features(spark, sf), K.OUTPUT_STEPS, fit_crops=RICH, score_crops=OTHER)
    return rounded(A.forecast_errors(scored, [*SERIES, "horizon"]), SCORES, 3)


@query("linear_attribution", "daily_prices", "announcements", sql=learned_sql() + f"""
    , names as (select unnest(range(1, {len(K.FEATURE_NAMES) + 1})) as i, unnest([{', '.join(f"'{n}'" for n in K.FEATURE_NAMES)}]) as feature),
    vals as (select crop, mandi, feature, i, x[i] as v from tg, names),
    bg as (select i, avg(v) as m from vals group by i),
    per as (select crop, mandi, feature, avg(abs(w[{K.OUTPUT_STEPS}][vals.i] * (v - m))) as a from vals join bg using (i), lm group by crop, mandi, feature)
    select crop, feature, {qs('avg(a)', 3)} as importance from per group by crop, feature""")
def linear_attribution(spark, sf):
    """Mean |attribution| of each feature of the regression at the last horizon, per crop."""
    rows = features(spark, sf)
    model, _ = learn.regress_forecast(rows, STEPS)
    long = learn.linear_attribution(rows, learn.coefficient_table(spark, model))
    out = A.attribution_importance(long.withColumn("sample", F.struct(*SERIES)), ["crop"])
    return rounded(out, ["importance"], 3)


DEPTHS, PENALTIES = [10, len(K.FEATURE_NAMES)], [0.01, 0.1, 1.0]


@query("cv_select_learned", "daily_prices", "announcements", sql=matrix_sql() + f"""
    , fd as (select r.*, fold, n // 4 as block, n - (3 - fold) * (n // 4) as start from rw r, (select unnest([0, 1, 2]) as fold)),
    fk as (select * from fd where n - 3 * block > 30 and block > 30),
    grid as (select fold, depth, penalty, {{'fold': fold, 'depth': depth, 'penalty': penalty}} as cfg
      from (select unnest([0, 1, 2]) as fold), (select unnest({DEPTHS}) as depth), (select unnest({PENALTIES}::double[]) as penalty)),
    tr as (select cfg, list_transform(x, lambda a, i: case when i <= depth then a else 0 end) as x, [y[{K.OUTPUT_STEPS}]] as y
      from fk join grid using (fold) where pos < start - {K.OUTPUT_STEPS})""" + ridge_sql("tr", 1, "a.cfg.penalty") + f"""
    , er as (select g.fold, g.depth, g.penalty, sqrt(avg(pow(y[{K.OUTPUT_STEPS}] - list_inner_product(x, w[1]) - b[1], 2))) as rmse
      from fk join grid g using (fold) join lm on lm.cfg = g.cfg where pos >= start and pos < start + block group by all),
    sc as (select depth, penalty, avg(rmse) as score, count(*) as folds from er group by depth, penalty)
    select depth::int as depth, penalty, {qs('score', 3)} as score, folds::int as folds,
      row_number() over (order by score, depth, penalty) = 1 as best from sc""")
def cv_select_learned(spark, sf):
    """Feature depth and penalty of the learned model by expanding folds."""
    out = learn.learned_select(features(spark, sf), K.OUTPUT_STEPS, DEPTHS, PENALTIES)
    stored = materialise(out)  # the table that a fit reads its configuration from
    return rounded(stored, ["score"], 3)


@query("save_explanations", sql=ATTR + f"""
    , imp as (select sample, feature, avg(abs(attribution)) as importance,
        arg_max(attribution, vec_id) as last_value from attributions group by sample, feature),
    l as (select * from (values """ + ", ".join(
        "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in K.FEATURE_LABELS.items()
    ) + f""") v(feature, label))
    select cast(imp.sample as varchar) as crop, imp.feature as feature_name,
      {qs('importance', 8)} as shap_value, {qs('last_value', 8)} as feature_value,
      coalesce(l.label, imp.feature) as farmer_label,
      cast(row_number() over (partition by imp.sample order by importance desc, imp.feature) as int) as rank
    from imp left join l on l.feature = imp.feature""")
def save_explanations(spark, sf):
    rows = attributions(spark, sf).select(
        F.col("sample").cast("string").alias("crop"), "sample", "vec_id", "feature", "attribution",
        F.col("attribution").alias("value"),
    )
    table_rows = learn.explanation_rows(rows, ["crop"], "vec_id").select(
        "crop", F.col("feature").alias("feature_name"), q("importance", 8).alias("shap_value"),
        q("feature_value", 8).alias("feature_value"), F.col("label").alias("farmer_label"), "rank",
    )
    folder = shared_folder(spark)
    sinks.append_log(table_rows, folder, "explanations")
    return sinks.read_log(spark, folder, table_rows.schema)


WIDTHS = [3, 7, 14, 30]


@query("cv_select", "daily_prices", sql="""
    , g as (select crop, mandi, date, modal_price, row_number() over (partition by crop, mandi order by date) - 1 as pos,
        count(*) over (partition by crop, mandi) as n, """ + ", ".join(
        f"avg(modal_price) over (partition by crop, mandi order by date rows between {w} preceding "
        f"and 1 preceding) as w{w}" for w in WIDTHS) + """
      from daily_prices),
    f as (select g.*, fold, n // 4 as block, n - (3 - fold) * (n // 4) as start
          from g, (select unnest([0, 1, 2]) as fold)),
    v as (select * from f where start > 30 and block > 30 and pos >= start and pos < start + block),
    l as (""" + " union all ".join(
        f"select crop, mandi, fold, 'w{w}' as config, modal_price - w{w} as e from v" for w in WIDTHS) + f"""),
    r as (select crop, mandi, config, fold, sqrt(avg(e * e)) as rmse from l group by crop, mandi, config, fold),
    sc as (select crop, mandi, config, avg(rmse) as score from r group by crop, mandi, config),
    b as (select *, row_number() over (partition by crop, mandi order by score, config) as rn from sc)
    select crop, mandi, config, {qs('score', 3)} as score from b where rn = 1""")
def cv_select(spark, sf):
    return rounded(learn.cv_select(prices(spark, sf), WIDTHS), ["score"], 3)


@query("drift_to_pairs", "daily_prices", sql=KS + """
    select distinct d.crop, d.mandi from daily_prices d
    where d.crop in (select crop from p where p_value < 0.05::double)""")
def drift_to_pairs(spark, sf):
    daily = prices(spark, sf)
    drifted = drift.ks_drift(daily, ["crop"], newest_ship(spark, sf)).filter("drift")
    pairs = joins.experiment_grid(daily, [30], ["naive"]).select(*SERIES)
    return joins.selective_pairs(pairs, drifted)
