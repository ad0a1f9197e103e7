"""Scans, landed feeds, upserts and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.catalog.registry import newest, query
from furrow.functions import dates, numbers
from furrow.session import shared_folder
from furrow.sources import feed, scans, sinks
from furrow.sources.canonical import load, table

J = "json_extract_string"
MARKET = f"coalesce({J}(raw_data,'$.market_name'), {J}(raw_data,'$.mandi'), {J}(raw_data,'$.market'))"


def num(key: str) -> str:
    return f"try_cast({J}(raw_data,'$.{key}') as double)"


@query("scan_series", "raw_prices", sql=f"""
    select fetch_date as date, {num('modal_price')} as modal_price, coalesce({num('msp')}, 2000) as msp,
      {num('min_price')} as min_price, {num('max_price')} as max_price,
      {num('arrivals_tonnes')} as arrivals_tonnes, coalesce({num('rainfall_mm')}, 0) as rainfall_mm,
      coalesce({num('max_temp')}, 35) as max_temp, coalesce({num('min_temp')}, 20) as min_temp,
      coalesce({num('freight_index')}, 100) as freight_index, {num('futures_price')} as futures_price
    from raw_prices
    where lower(crop) = 'purchase' and {MARKET} ilike 'm1'
      and fetch_date >= (select max(fetch_date) from raw_prices) - 1095""")
def scan_series(spark, sf):
    raw = table(spark, sf, "raw_prices")
    return scans.scan_series(raw, "Purchase", "m1", newest(spark, sf, "events", "ts"))


@query("price_history", "raw_prices", sql=f"""
    , hit as (select fetch_date as date, {num('modal_price')} as modal_price,
        {num('min_price')} as min_price, {num('max_price')} as max_price,
        coalesce({MARKET}, 'M2') as mandi
      from raw_prices
      where crop ilike 'click' and (coalesce({MARKET}, '') = '' or lower({MARKET}) like '%m2%')
        and fetch_date >= (select max(fetch_date) from raw_prices) - 10)
    select *, (select count(*) from hit) as total_records from hit""")
def price_history(spark, sf):
    raw = table(spark, sf, "raw_prices")
    return scans.price_history(raw, "CLICK", "M2", 10, newest(spark, sf, "events", "ts"))


@query("forecast_history", "raw_prices", sql=f"""
    select fetch_date as date, {num('modal_price')} as modal_price, coalesce({num('msp')}, 0) as msp,
      {num('min_price')} as min_price, {num('max_price')} as max_price,
      coalesce({num('arrivals_tonnes')}, 0) as arrivals_tonnes, coalesce({num('rainfall_mm')}, 0) as rainfall_mm,
      {num('max_temp')} as max_temp, {num('min_temp')} as min_temp,
      coalesce({num('freight_index')}, 100) as freight_index, {num('futures_price')} as futures_price
    from raw_prices
    where crop ilike 'view' and (coalesce({MARKET}, '') = '' or lower({MARKET}) like '%m0%')
      and fetch_date >= (select max(fetch_date) from raw_prices) - 365""")
def forecast_history(spark, sf):
    raw = table(spark, sf, "raw_prices")
    return scans.forecast_history(raw, "view", "m0", 365, newest(spark, sf, "events", "ts"))


@query("eval_series", "raw_prices", sql=f"""
    , hit as (select fetch_date as date, {num('modal_price')} as modal_price,
        {num('min_price')} as min_price, {num('max_price')} as max_price,
        {num('arrivals_tonnes')} as arrivals_tonnes
      from raw_prices where crop = 'signup' and {MARKET} = 'M1')
    select * from hit where (select count(*) from hit) >= 120""")
def eval_series(spark, sf):
    return scans.eval_series(table(spark, sf, "raw_prices"), "signup", "M1")


REC = ["commodity", "market", "state", "district", "arrival_date", "min_price", "max_price",
       "modal_price", "arrivals"]
EXPLODED = ", recs as (select response_id, crop, state, " + ", ".join(
    f"{J}(payload, '$.records[' || i || '].{f}') as rec_{f}" for f in REC
) + " from feed_responses, (select unnest([0, 1]) as i))"


@query("feed_explode", "feed_responses", sql=EXPLODED + " select * from recs")
def feed_explode(spark, sf):
    return feed.explode_feed(table(spark, sf, "feed_responses"))


def duck_date(text: str) -> str:
    return "cast(coalesce(" + ", ".join(
        f"try_strptime(trim({text}), '{f}')" for f in ("%d/%m/%Y", "%Y-%m-%d", "%d-%m-%Y")
    ) + ") as date)"


@query("feed_project", "feed_responses", sql=EXPLODED + f"""
    select response_id, crop,
      coalesce({duck_date('rec_arrival_date')},
               (select cast(max(o_orderdate) as date) from orders)) as fetch_date,
      coalesce(rec_commodity, crop) as commodity, coalesce(rec_market, '') as market,
      coalesce(rec_state, state) as state, coalesce(rec_district, '') as district,
      try_cast(trim(rec_min_price) as double) as min_price,
      try_cast(trim(rec_max_price) as double) as max_price,
      try_cast(trim(rec_modal_price) as double) as modal_price,
      coalesce(rec_arrival_date, '') as arrival_date,
      try_cast(trim(rec_arrivals) as double) as arrivals_tonnes
    from recs""")
def feed_project(spark, sf):
    records = feed.explode_feed(table(spark, sf, "feed_responses"))
    out = feed.project_feed(records, newest(spark, sf, "orders", "o_orderdate"))
    return out.select("response_id", "crop", "fetch_date", "payload.*")


@query("weather_flatten", "weather_responses", sql=f"""
    select id, district, date,
      coalesce(cast({J}(payload, '$.rain.1h') as double), 0) as rainfall_mm,
      cast({J}(payload, '$.main.temp_max') as double) as max_temp,
      cast({J}(payload, '$.main.temp_min') as double) as min_temp,
      cast({J}(payload, '$.main.humidity') as double) as humidity,
      cast({J}(payload, '$.wind.speed') as double) as wind_speed
    from weather_responses""")
def weather_flatten(spark, sf):
    return feed.flatten_weather(table(spark, sf, "weather_responses"))


TRIAL_DOC = """
    concat('{"trial_id":"', cast(p_partkey as varchar(20)), '","hyperparameters":{"values":{',
      '"lstm_units":', cast(64 * (1 + p_partkey % 3) as varchar(20)),
      ',"dropout":0.', cast(1 + p_partkey % 3 as varchar(20)), ',"learning_rate":0.001',
      ',"sequence_length":', cast(30 * (1 + p_size % 3) as varchar(20)),
      ',"batch_size":16}},"score":', cast(cast(p_retailprice as decimal(12,2)) as varchar(20)),
      ',"status":"COMPLETED"}')"""


TRIALS = """
    select cast(p_partkey as varchar) as trial_id, cast(64 * (1 + p_partkey % 3) as int) as lstm_units,
      cast(1 + p_partkey % 3 as double) / 10 as dropout, cast(0.001 as double) as learning_rate,
      cast(30 * (1 + p_size % 3) as int) as sequence_length, cast(16 as int) as batch_size,
      cast(p_retailprice as double) as score, 'COMPLETED' as status
    from part"""


@query("scan_trial_files", sql=TRIALS)
def scan_trial_files(spark, sf):
    """One document a file, as a tuner leaves them."""
    folder = shared_folder(spark)
    docs = load(spark, sf, "part").select(F.expr(TRIAL_DOC).alias("value"))
    sinks.write_documents(docs, folder, per_folder=10_000)
    return scans.scan_trials(spark, folder)


@query("scan_trials", sql=TRIALS)
def scan_trials(spark, sf):
    folder = shared_folder(spark)
    docs = load(spark, sf, "part").select(F.expr(TRIAL_DOC).alias("value"))
    docs.write.text(folder)
    return scans.scan_trials(spark, folder, whole_files=False)


@query("upsert_prices", "raw_prices", sql="""
    , merged as (
      select 0 as new_row, id, crop, state, fetch_date, raw_data from raw_prices
      where fetch_date <= date '2024-01-20'
      union all
      select 1 as new_row, id, crop, state, fetch_date, concat(raw_data, ' ') as raw_data
      from raw_prices where fetch_date >= date '2024-01-15'),
    numbered as (select *, row_number() over (partition by crop, state, fetch_date
                                              order by new_row desc, id desc) as rn from merged)
    select id, crop, state, fetch_date, raw_data from numbered where rn = 1""")
def upsert_prices(spark, sf):
    raw = table(spark, sf, "raw_prices").drop("created_at")
    current = raw.filter("fetch_date <= date '2024-01-20'")
    incoming = raw.filter("fetch_date >= date '2024-01-15'").withColumn(
        "raw_data", F.concat("raw_data", F.lit(" "))
    )
    return sinks.upsert_prices(current, incoming)


@query("upsert_weather", "weather_obs", sql="""
    select o.district, o.date,
      case when o.date >= date '2024-01-20' then o.rainfall_mm + 1 else o.rainfall_mm end as rainfall_mm,
      o.max_temp, o.min_temp, o.humidity, o.wind_speed
    from weather_obs o
    union all
    select concat('N', district) as district, date, rainfall_mm + 1, max_temp, min_temp, humidity, wind_speed
    from weather_obs where date >= date '2024-01-20'""")
def upsert_weather(spark, sf):
    observed = table(spark, sf, "weather_obs")
    incoming = observed.filter("date >= date '2024-01-20'").withColumn(
        "rainfall_mm", F.col("rainfall_mm") + 1
    )
    opened = incoming.withColumn("district", F.concat(F.lit("N"), "district"))  # stations not seen before
    return sinks.upsert_weather(observed, incoming.unionByName(opened), ["wind_speed"])


@query("replace_diagnostics", "daily_prices", sql="""
    , cur as (select crop, mandi, 'ADF' as test_name, 'original' as stage,
        cast(count(*) as double) as adf_statistic from daily_prices group by crop, mandi),
    inc as (select crop, mandi, 'ADF' as test_name,
        case when mandi = 'M2' then 'differenced' else 'original' end as stage,
        max(modal_price) as adf_statistic
      from daily_prices where mandi <> 'M0' group by crop, mandi)
    select * from cur c where not exists (select 1 from inc i where i.crop = c.crop
      and i.mandi = c.mandi and i.test_name = c.test_name and i.stage = c.stage)
    union all select * from inc""")
def replace_diagnostics(spark, sf):
    prices = table(spark, sf, "daily_prices")

    def rows(df, stage, value):
        return df.groupBy("crop", "mandi").agg(value.alias("adf_statistic")).select(
            "crop", "mandi", F.lit("ADF").alias("test_name"), stage.alias("stage"), "adf_statistic"
        )

    current = rows(prices, F.lit("original"), F.count(F.lit(1)).cast("double"))
    incoming = rows(
        prices.filter("mandi <> 'M0'"),
        F.when(F.col("mandi") == "M2", "differenced").otherwise("original"),
        F.max("modal_price"),
    )
    return sinks.replace_by_key(current, incoming, sinks.DIAGNOSTIC_KEY)


@query("append_log", "runs", sql="""
    select id, crop, mandi, rmse_before, status from runs where status = 'success'
    union all select id, crop, mandi, rmse_before, status from runs where status = 'failed'""")
def append_log(spark, sf):
    folder = shared_folder(spark)
    runs = table(spark, sf, "runs").select("id", "crop", "mandi", "rmse_before", "status")
    for run, status in (("1", "success"), ("2", "failed"), ("1", "success")):  # the first run is repeated
        sinks.append_log(runs.filter(F.col("status") == status), folder, run)
    return sinks.read_log(spark, folder, runs.schema)


@query("quarantine_bad", "feed_text", sql=f"""
    , flagged as (select crop, state, id, concat_ws('; ',
        case when try_cast(trim(modal_price) as double) is null then 'bad price' end,
        case when {duck_date('arrival_date')} is null then 'bad date' end) as error_message
      from feed_text)
    select * from flagged where error_message <> ''""")
def quarantine_bad(spark, sf):
    checks = {
        "bad price": numbers.parse_price(F.col("modal_price")).isNotNull(),
        "bad date": dates.parse_feed_date(F.col("arrival_date")).isNotNull(),
    }
    _, bad = feed.quarantine(table(spark, sf, "feed_text"), checks)
    return bad.select("crop", "state", "id", "error_message")


@query("write_csv", "daily_prices", sql="select crop, mandi, date, modal_price, msp from daily_prices")
def write_csv(spark, sf):
    folder = shared_folder(spark)
    rows = table(spark, sf, "daily_prices").select("crop", "mandi", "date", "modal_price", "msp")
    sinks.write_csv(rows, folder)
    return sinks.read_csv(spark, folder, rows.schema)


@query("scan_subscriptions", "subscriptions", sql="select * from subscriptions where is_active")
def scan_subscriptions(spark, sf):
    return scans.scan_subscriptions(table(spark, sf, "subscriptions"))


@query("dedupe_keep_max_id", "raw_prices", sql="""
    select id, crop, state, fetch_date from raw_prices where id in (
      select max(id) from raw_prices group by crop, state, fetch_date)""")
def dedupe_keep_max_id(spark, sf):
    from furrow.operators.joins import keep_max_id

    raw = table(spark, sf, "raw_prices").select("id", "crop", "state", "fetch_date")
    return keep_max_id(raw, sinks.PRICE_KEY)


@query("sort_dates", "daily_prices", sql="select crop, mandi, date, modal_price from daily_prices")
def sort_dates(spark, sf):
    rows = table(spark, sf, "daily_prices").select("crop", "mandi", "date", "modal_price")
    return scans.sort_dates(rows, ascending=False)
