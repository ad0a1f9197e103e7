"""Window operators, the feature matrix, splits and set operations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from furrow import constants as K
from furrow.catalog.joins import ATTR, attributions
from furrow.catalog.registry import q, qs, query, rounded
from furrow.operators import aggregates as A, ops, series, splits, windows as W
from furrow.operators.features import engineer_features
from furrow.plans import forecast
from furrow.session import materialise
from furrow.sources.canonical import announcements_of, load, table

SERIES = ["crop", "mandi"]
KEYS = [*SERIES, "date"]
WIN = "window w as (partition by crop, mandi order by date)"


def prices(spark, sf):
    return table(spark, sf, "daily_prices")


def lag_sql(value, prefix, lags):
    return ", ".join(f"lag({value}, {k}) over w as {prefix}_lag_{k}" for k in lags)


def over(width):
    return f"over (partition by crop, mandi order by date rows between {width - 1} preceding and current row)"


def roll_sql(value, prefix, digits=3, qs=qs):
    out = []
    for w in K.ROLL_WINDOWS:
        full = f"count({value}) {over(w)} = {w}"
        out.append(f"case when {full} then {qs(f'avg({value}) {over(w)}', digits)} end as {prefix}_rmean_{w}")
        out.append(f"case when {full} then {qs(f'stddev_samp({value}) {over(w)}', digits)} end as {prefix}_rstd_{w}")
    return ", ".join(out)


def roll_names(prefix):
    return [f"{prefix}_{s}_{w}" for w in K.ROLL_WINDOWS for s in ("rmean", "rstd")]


@query("price_lags", "daily_prices", sql=f"""
    select crop, mandi, date, {lag_sql('modal_price', 'price', K.PRICE_LAGS)} from daily_prices {WIN}""")
def price_lags(spark, sf):
    return W.price_lags(prices(spark, sf)).select(*KEYS, *[f"price_lag_{k}" for k in K.PRICE_LAGS])


@query("price_roll", "daily_prices", sql=f"""
    select crop, mandi, date, {roll_sql('modal_price', 'price')} from daily_prices""")
def price_roll(spark, sf):
    cols = roll_names("price")
    return rounded(W.price_roll(prices(spark, sf)).select(*KEYS, *cols), cols, 3)


@query("arrivals_lags", "daily_prices", sql=f"""
    select crop, mandi, date, {lag_sql('arrivals_tonnes', 'arrivals', K.ARRIVAL_LAGS)}
    from daily_prices {WIN}""")
def arrivals_lags(spark, sf):
    out = W.arrivals_lags(prices(spark, sf))
    return out.select(*KEYS, *[f"arrivals_lag_{k}" for k in K.ARRIVAL_LAGS])


@query("arrivals_roll", "daily_prices", sql=f"""
    select crop, mandi, date, {roll_sql('arrivals_tonnes', 'arrivals')} from daily_prices""")
def arrivals_roll(spark, sf):
    cols = roll_names("arrivals")
    return rounded(W.arrivals_roll(prices(spark, sf)).select(*KEYS, *cols), cols, 3)


@query("rain_roll", "daily_prices", sql=f"""
    select crop, mandi, date, case when count(rainfall_mm) {over(10)} = 10
      then {qs(f'sum(rainfall_mm) {over(10)}')} end as rainfall_roll_10d from daily_prices""")
def rain_roll(spark, sf):
    return rounded(
        W.rain_roll(prices(spark, sf)).select(*KEYS, "rainfall_roll_10d"), ["rainfall_roll_10d"]
    )


@query("momentum_7", "daily_prices", sql=f"""
    select crop, mandi, date,
      (modal_price - lag(modal_price, 7) over w) / nullif(lag(modal_price, 7) over w, 0) * 100
        as price_momentum_7d,
      (freight_index - lag(freight_index, 7) over w) / nullif(lag(freight_index, 7) over w, 0) * 100
        as freight_momentum
    from daily_prices {WIN}""")
def momentum_7(spark, sf):
    spec = series.in_order()
    return prices(spark, sf).select(
        *KEYS, W.momentum("modal_price", 7, spec).alias("price_momentum_7d"),
        W.momentum("freight_index", 7, spec).alias("freight_momentum"),
    )


CORR = f"""
    , ch as (select crop, mandi, date,
        (modal_price - lag(modal_price) over w) / nullif(lag(modal_price) over w, 0) as x,
        (futures_price - lag(futures_price) over w) / nullif(lag(futures_price) over w, 0) as y
      from daily_prices {WIN}),
    co as (select crop, mandi, date, coalesce(case when count(x) {over(14)} = 14
        then covar_samp(x, y) {over(14)}
             / nullif(stddev_samp(x) {over(14)} * stddev_samp(y) {over(14)}, 0) end, 0)
        as cbot_correlation_14d from ch)"""


@query("spot_futures_corr", "daily_prices", sql=CORR + f"""
    select crop, mandi, date, {qs('cbot_correlation_14d', 6)} as cbot_correlation_14d from co""")
def spot_futures_corr(spark, sf):
    out = W.spot_futures_corr(prices(spark, sf)).select(*KEYS, "cbot_correlation_14d")
    return rounded(out, ["cbot_correlation_14d"], 6)


@query("temp_roll", "daily_prices", sql=f"""
    select crop, mandi, date, case when count(*) {over(7)} = 7
      then {qs(f'avg((max_temp + min_temp) / 2) {over(7)}')} end as temp_rmean_7 from daily_prices""")
def temp_roll(spark, sf):
    return rounded(W.temp_roll(prices(spark, sf)).select(*KEYS, "temp_rmean_7"), ["temp_rmean_7"])


@query("arrivals_share", "daily_prices", sql=f"""
    select crop, mandi, date, coalesce(case when count(*) {over(30)} = 30 then
      arrivals_tonnes / nullif(sum(arrivals_tonnes) {over(30)}, 0) end, 0) as arrivals_market_share
    from daily_prices""")
def arrivals_share(spark, sf):
    return W.arrivals_share(prices(spark, sf)).select(*KEYS, "arrivals_market_share")


@query("first_difference", "daily_prices", sql=f"""
    , d as (select crop, mandi, date, modal_price - lag(modal_price) over w as diff
            from daily_prices {WIN})
    select * from d where diff is not null""")
def first_difference(spark, sf):
    return W.first_difference(prices(spark, sf)).select(*KEYS, "diff")


TWO_PI = repr(2 * math.pi)
# digits shown per feature; 3 for values in the thousands
PLAIN = [*K.MERGED_COLUMNS, *[f"price_lag_{k}" for k in K.PRICE_LAGS],
         *[f"arrivals_lag_{k}" for k in K.ARRIVAL_LAGS], "is_rabi", "is_kharif",
         "days_since_msp_announcement", "drought_flag", "futures_roll_signal"]
DIGITS = {n: 3 for n in K.FEATURE_NAMES if n not in PLAIN}

def features_sql(qs=qs):
    """CTEs and final select of the feature matrix; ``qs`` says how derived columns are shown."""
    return CORR + f"""
    , base as (select d.*, {lag_sql('modal_price', 'price', K.PRICE_LAGS)},
        {lag_sql('arrivals_tonnes', 'arrivals', K.ARRIVAL_LAGS)},
        lag(freight_index, 7) over w as f7, lag(msp, 1) over w as m1,
        count(*) {over(10)} as n10, count(*) {over(30)} as n30,
        sum(cast(rainfall_mm as decimal(14,2))) {over(10)} as rain10,
        sum(arrivals_tonnes) {over(30)} as arr30,
        case when count(*) {over(7)} = 7 then avg((max_temp + min_temp) / 2) {over(7)} end as temp_rmean_7,
        {roll_sql('modal_price', 'price', qs=qs)}, {roll_sql('arrivals_tonnes', 'arrivals', qs=qs)}
      from daily_prices d {WIN}),
    f as (select b.crop, b.mandi, b.date, {', '.join('b.' + c for c in K.MERGED_COLUMNS)},
        {', '.join(f'price_lag_{k}' for k in K.PRICE_LAGS)}, {', '.join(roll_names('price'))},
        {', '.join(f'arrivals_lag_{k}' for k in K.ARRIVAL_LAGS)}, {', '.join(roll_names('arrivals'))},
        {qs(f'sin(extract(month from b.date)*{TWO_PI}::double/12)', 3)} as month_sin,
        {qs(f'cos(extract(month from b.date)*{TWO_PI}::double/12)', 3)} as month_cos,
        cast(extract(month from b.date) in (10,11,12,1,2,3) as int) as is_rabi,
        cast(extract(month from b.date) in (6,7,8,9) as int) as is_kharif,
        {qs('modal_price - msp', 3)} as msp_distance,
        {qs('(modal_price - msp) / nullif(msp, 0) * 100', 3)} as msp_pct,
        coalesce(b.date - a.announced_on, 0) as days_since_msp_announcement,
        {qs('coalesce(case when h.crop is not null and m1 > 0 then (msp - m1) / m1 * 100 end, 0)', 3)}
          as msp_hike_pct,
        {qs('case when n10 = 10 then cast(rain10 as double) end', 3)} as rainfall_roll_10d,
        case when n10 = 10 and rain10 < 1.0 then 1 else 0 end as drought_flag,
        {qs('(freight_index - f7) / nullif(f7, 0) * 100', 3)} as freight_momentum,
        {qs('modal_price - futures_price', 3)} as futures_basis,
        case when futures_price > modal_price * 1.05::double then 1
             when futures_price < modal_price * 0.95::double then -1 else 0 end as futures_roll_signal,
        {qs('cbot_correlation_14d', 3)} as cbot_correlation_14d,
        {qs('max_price - min_price', 3)} as price_spread,
        {qs('(max_price - min_price) / nullif(modal_price, 0)', 3)} as price_volatility,
        {qs('(modal_price - price_lag_7) / nullif(price_lag_7, 0) * 100', 3)} as price_momentum_7d,
        {qs('max_temp - min_temp', 3)} as temp_range, {qs('temp_rmean_7', 3)} as temp_rmean_7,
        {qs(f'sin(extract(week from b.date)*{TWO_PI}::double/52)', 3)} as week_sin,
        {qs(f'cos(extract(week from b.date)*{TWO_PI}::double/52)', 3)} as week_cos,
        {qs('case when n30 = 30 then arrivals_tonnes / nullif(arr30, 0) else 0 end', 3)}
          as arrivals_market_share
      from base b asof left join announcements a on b.crop = a.crop and b.date >= a.announced_on
      left join announcements h on h.crop = b.crop and h.announced_on = b.date
      join co on co.crop = b.crop and co.mandi = b.mandi and co.date = b.date)
    select * from f where price_lag_90 is not null and freight_momentum is not null
      and price_volatility is not null and price_momentum_7d is not null"""


FEATURES = features_sql()


@query("features_53", "daily_prices", "announcements", sql=FEATURES)
def features_53(spark, sf):
    daily = materialise(prices(spark, sf))  # read twice: features and announcement days
    out = engineer_features(daily, announcements_of(daily))
    return out.withColumns({c: q(c, d) for c, d in DIGITS.items()})


@query("last_known", "raw_prices", sql="""
    , p as (select case crop when 'error' then 'Mustard' else crop end as crop, state as mandi,
        fetch_date as date, id,
        try_cast(json_extract_string(raw_data, '$.modal_price') as double) as price from raw_prices),
    r as (select *, row_number() over (partition by crop, mandi order by date desc, id desc) as rn
          from p where price is not null)
    select distinct p.crop, p.mandi, coalesce(r.price, case when p.crop = 'Mustard' then 5650 else 2000 end)
      as current_price
    from p left join r on r.crop = p.crop and r.mandi = p.mandi and r.rn = 1""")
def last_known(spark, sf):
    from furrow.functions.numbers import json_number

    # one of the crops with a support price; its market S4 and view in S2 have no price at all
    crop = F.when(F.col("crop") == "error", "Mustard").otherwise(F.col("crop"))
    raw = table(spark, sf, "raw_prices").select(
        crop.alias("crop"), F.col("state").alias("mandi"), "id", F.col("fetch_date").alias("date"),
        json_number(F.col("raw_data"), "modal_price").alias("modal_price"),
    )
    # newest priced row per day first: the operator expects daily grain
    daily = series.daily_grain(raw.filter("modal_price is not null"), "id")
    unpriced = raw.filter("modal_price is null").select(*SERIES, "id", "date", "modal_price")
    return forecast.last_known(daily.select(*SERIES, "id", "date", "modal_price").unionByName(unpriced))


@query("tail_n", "daily_prices", sql="""
    , r as (select crop, mandi, date, modal_price, row_number() over (partition by crop, mandi
                                                order by date desc) as rn from daily_prices)
    select crop, mandi, date, modal_price from r where rn <= 90""")
def tail_n(spark, sf):
    return series.tail_n(prices(spark, sf).select(*KEYS, "modal_price"), 90)


@query("latest_per_key", "raw_prices", sql="""
    , r as (select *, row_number() over (partition by crop, state order by fetch_date desc, id desc) as rn
            from raw_prices)
    select crop, state, fetch_date, id, raw_data from r where rn = 1""")
def latest_per_key(spark, sf):
    raw = table(spark, sf, "raw_prices").select("crop", "state", "fetch_date", "id", "raw_data")
    return series.latest_per_key(raw, ["crop", "state"], ["fetch_date", "id"])


# explanations: one run per vector, features ranked inside the run
RANKED = ATTR + """
    , r as (select vec_id, sample, feature, attribution,
        row_number() over (partition by vec_id order by abs(attribution) desc, feature) as rank
      from attributions)"""


@query("latest_topk", sql=RANKED + """
    , l as (select sample, max(vec_id) as vec_id from r group by sample)
    select cast(r.sample as varchar) as crop, date '2024-01-01' + cast(r.vec_id as int) as prediction_date,
      feature, rank from r join l on l.sample = r.sample and l.vec_id = r.vec_id where rank <= 10""")
def latest_topk(spark, sf):
    ranked = A.ranked(
        attributions(spark, sf), ["vec_id"], F.abs("attribution").desc(), F.col("feature")
    )
    stored = ranked.select(
        F.col("sample").cast("string").alias("crop"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("vec_id").cast("int")).alias("prediction_date"),
        "feature", "rank",
    )
    return A.latest_topk(stored, 10)


@query("feature_rank", sql=ATTR + f"""
    , m as (select sample, feature, avg(abs(attribution)) as importance from attributions
            group by sample, feature)
    select sample, feature, {qs('importance', 8)} as importance,
      row_number() over (partition by sample order by importance desc, feature) as rank from m""")
def feature_rank(spark, sf):
    imp = attributions(spark, sf).groupBy("sample", "feature").agg(
        F.avg(F.abs("attribution")).alias("importance")
    )
    return rounded(
        A.ranked(imp, ["sample"], F.col("importance").desc(), F.col("feature")), ["importance"], 8
    )


@query("sequence_windows", "daily_prices", sql="""
    , s as (select crop, mandi, date, modal_price as v, count(*) over a as nx, count(*) over b as ny,
        first_value(modal_price) over a as x_first, first_value(modal_price) over b as y_first,
        last_value(modal_price) over b as y_last,
        sum(cast(modal_price as decimal(14,2))) over a as sx,
        sum(cast(modal_price as decimal(14,2))) over b as sy
      from daily_prices
      window a as (partition by crop, mandi order by date rows between 59 preceding and current row),
             b as (partition by crop, mandi order by date rows between 1 following and 30 following))
    select crop, mandi, date, x_first, v as x_last, cast(sx as double) as x_sum, y_first, y_last,
      cast(sy as double) as y_sum from s where nx = 60 and ny = 30""")
def sequence_windows(spark, sf):
    def total(c):
        return F.aggregate(c, F.lit(0).cast("decimal(18,2)"),
                           lambda a, v: (a + v.cast("decimal(14,2)")).cast("decimal(18,2)")).cast("double")

    return W.sequence_windows(prices(spark, sf), 60, K.OUTPUT_STEPS).select(
        *KEYS, F.get("x", F.lit(0)).alias("x_first"), F.get("x", F.lit(59)).alias("x_last"),
        total("x").alias("x_sum"), F.get("y", F.lit(0)).alias("y_first"),
        F.get("y", F.lit(29)).alias("y_last"), total("y").alias("y_sum"),
    )


LEADS = [f"y_{i}" for i in range(K.OUTPUT_STEPS)]


@query("multi_lead", "daily_prices", sql=", l as (select crop, mandi, date, " + ", ".join(
    f"lead(modal_price, {i}) over w as y_{i}" for i in range(K.OUTPUT_STEPS)
) + f" from daily_prices {WIN}) select * from l where y_{K.OUTPUT_STEPS - 1} is not null")
def multi_lead(spark, sf):
    return W.multi_lead(prices(spark, sf), K.OUTPUT_STEPS).select(*KEYS, *LEADS)


POS = """
    , p as (select crop, mandi, date, modal_price, row_number() over (partition by crop, mandi order by date) - 1 as pos,
        count(*) over (partition by crop, mandi) as n from daily_prices)"""


@query("split_temporal", "daily_prices", sql=POS + """
    select crop, mandi, date, case when pos < floor(n * 0.8::double) then 'train' else 'test' end as split,
      case when pos < n - greatest(60, floor(n * 0.15::double)) then 'train' else 'test' end as split_60
    from p""")
def split_temporal(spark, sf):
    rows = splits.with_position(prices(spark, sf))
    return rows.select(
        *KEYS, splits.side(splits.train_rows()).alias("split"),
        splits.side(splits.train_rows(horizon=60)).alias("split_60"),
    )


@query("split_ts_folds", "daily_prices", sql=POS + """
    , f as (select p.*, fold, n // 4 as block, n - (3 - fold) * (n // 4) as start
            from p, (select unnest([0, 1, 2]) as fold))
    select crop, mandi, date, fold, case when pos < start then 'train' else 'validate' end as side
    from f where start > 60 and block > 60 and pos < start + block""")
def split_ts_folds(spark, sf):
    return splits.split_ts_folds(prices(spark, sf), 3, 60).select(*KEYS, "fold", "side")


@query("running_contribution", sql=RANKED + f"""
    , c as (select *, coalesce(sum(attribution) over (partition by vec_id
        order by abs(attribution) desc, feature rows between unbounded preceding and 1 preceding), 0) as before
      from r)
    select vec_id, feature, rank, {qs('10 + before', 6)} as bar_start,
      {qs('10 + before + attribution', 6)} as bar_end from c where rank <= 15""")
def running_contribution(spark, sf):
    one = attributions(spark, sf).select(
        F.col("vec_id").alias("sample"), "feature", F.col("attribution").alias("contribution")
    )
    out = W.running_contribution(one, F.lit(10.0), 15)
    return out.select(
        F.col("sample").alias("vec_id"), "feature", "rank",
        q("bar_start", 6).alias("bar_start"), q("bar_end", 6).alias("bar_end"),
    )


@query("walk_forward_naive", "daily_prices", sql=POS + """
    , l as (select *, lag(modal_price) over (partition by crop, mandi order by date) as predicted,
              n - greatest(30, floor(n * 0.15::double)) as cut from p)
    select crop, mandi, date, modal_price as actual, predicted, predicted * 0.95::double as lower_bound,
      predicted * 1.05::double as upper_bound from l where pos >= cut and pos < cut + 30""")
def walk_forward_naive(spark, sf):
    return splits.walk_forward_naive(prices(spark, sf), 30)


@query("rmse_degradation", "ops_events", sql=f"""
    , g0 as (select label, epoch(ts) as s, latency, event_id, ts from ops_events),
    g1 as (select label, cast(floor(s / 900) * 900 as bigint) as slot, latency,
        row_number() over (partition by label, floor(s / 900) order by ts desc, event_id desc) as rn from g0),
    g as (select label, slot, latency as rmse, avg(latency) over (partition by label order by slot
        range between 604800 preceding and current row) as m from g1 where rn = 1),
    b as (select *, rmse > 1.1::double * m as breach from g),
    h as (select *, bool_and(breach) over w as held, min(slot) over w as first_slot from b
      window w as (partition by label order by slot range between 3600 preceding and current row))
    select label, slot, rmse, {qs('m', 6)} as trailing_mean, breach,
      held and first_slot <= slot - 3600 as firing from h""")
def rmse_degradation(spark, sf):
    gauge = ops.sample_gauge(
        table(spark, sf, "ops_events").withColumn("ts", F.col("ts").cast("timestamp")),
        ["label"], "latency", 900, "event_id",
    )
    out = W.rmse_degradation(gauge, ["label"])
    return out.select(
        "label", F.unix_timestamp("ts").alias("slot"), "rmse",
        q("trailing_mean", 6).alias("trailing_mean"), "breach", "firing",
    )


@query("price_changes", "raw_prices", sql="""
    , d as (select event_type as crop, cast(user_id % 3 as varchar) as mandi, cast(ts as date) as date,
        floor(value / 20) as price,
        row_number() over (partition by event_type, user_id % 3, cast(ts as date) order by event_id desc) as rn
      from events),
    l as (select crop, mandi, date, price, lag(price) over (partition by crop, mandi order by date) as previous_price
      from d where rn = 1)
    select * from l where previous_price is null or price <> previous_price""")
def price_changes(spark, sf):
    """Batch form of the price-change feed: newest price per day, changes only."""
    rows = load(spark, sf, "events").select(
        F.col("event_type").alias("crop"), (F.col("user_id") % 3).cast("string").alias("mandi"),
        F.to_date("ts").alias("date"), F.floor(F.col("value") / 20).cast("double").alias("price"), "event_id",
    )
    daily = series.daily_grain(rows, "event_id").drop("event_id")
    return W.price_changes(daily, SERIES, "date", "price")


@query("pool_series", sql="""
    with e as (select event_type as crop, concat('M', cast(user_id % 40 as varchar)) as mandi, ts as date,
        event_id as id, value as modal_price from events)
    select * from e where crop in ('click', 'view', 'signup') and (crop, mandi) in (
      select (crop, mandi) from e group by crop, mandi having count(*) >= 50)""")
def pool_series(spark, sf):
    rows = load(spark, sf, "events").select(
        F.col("event_type").alias("crop"),
        F.concat(F.lit("M"), (F.col("user_id") % 40).cast("string")).alias("mandi"),
        F.col("ts").alias("date"), F.col("event_id").alias("id"), F.col("value").alias("modal_price"),
    )
    return splits.pool_series(rows, ["click", "view", "signup"], 50)


@query("append_future", "daily_prices", sql="""
    , l as (select crop, mandi, date, modal_price, row_number() over (partition by crop, mandi
                                             order by date desc) as rn from daily_prices)
    select crop, mandi, date, modal_price, false as is_future from daily_prices
    union all
    select crop, mandi, date + cast(k as int) as date, modal_price, true as is_future
    from l, (select unnest(range(1, 31)) as k) where rn = 1""")
def append_future(spark, sf):
    return splits.append_future(prices(spark, sf), 30)
