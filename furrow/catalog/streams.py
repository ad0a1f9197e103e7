"""Streaming jobs drained over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import constants as K
from furrow.catalog.aggregates import edge_name
from furrow.catalog.forecasts import season_ctes
from furrow.catalog.ingest import J
from furrow.catalog.registry import newest, qs, query, rounded
from furrow.catalog.scalars import COMMANDS
from furrow.functions.numbers import json_number
from furrow.plans import forecast
from furrow.session import materialise, shared_folder
from furrow.sources.canonical import load, table
from furrow.streaming import jobs


def stream(spark, sf, name):
    """A given table as a file stream (the pattern matches a file or a folder)."""
    schema = load(spark, sf, name).schema
    return jobs.file_stream(spark, f"{sf}/{name[:-1]}[{name[-1]}].parquet", schema)


def event_prices(spark, sf):
    return stream(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("crop"),
        F.concat(F.lit("M"), (F.col("user_id") % 3).cast("string")).alias("mandi"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
    )


@query("price_change_feed", "market_days", sql=f"""
    , mi as (select event_type as crop, concat('M', cast(user_id % 3 as varchar)) as mandi,
        date_trunc('minute', ts) + interval 1 minute as ts, arg_max(value, ts) as price
      from events group by 1, 2, 3),
    ch as (select crop, mandi, mi.ts, price, lag(price) over (partition by crop, mandi order by mi.ts) as prev
      from mi),
    s as (select crop, mandi, modal_price as y, count(*) over (partition by crop, mandi) as n,
        row_number() over (partition by crop, mandi order by date) - 1 as i
      from market_days where modal_price is not null)""" + season_ctes("crop, mandi", "7") + f"""
    , expect as (select crop, mandi, avg(p) as average from (
        select crop, mandi, p from fc union all select crop, mandi, y from s where n < 14 and i = n - 1)
      group by crop, mandi),
    floors as (select crop, floor(avg(modal_price)) + 0.5 as msp from market_days group by crop)
    select ch.crop, ch.mandi, ts, price,
      {qs('case when prev > 0 then (price - prev) / prev * 100 else 0 end')} as change_pct,
      case when average > msp then 'SELL' else 'HOLD' end as recommendation
    from ch left join expect e on e.crop = ch.crop and e.mandi = ch.mandi left join floors f on f.crop = ch.crop
    where prev is null or prev <> price""")
def price_change_feed(spark, sf):
    """Price changes with the current advice of their market."""
    days = materialise(table(spark, sf, "market_days"))
    floors = days.groupBy("crop").agg((F.floor(F.avg("modal_price")) + 0.5).alias("msp"))
    reports = forecast.forecast_report(days, 7, newest(spark, sf, "events", "ts"), floors)
    changes = jobs.price_change_feed(event_prices(spark, sf).drop("id"), reports=materialise(reports))
    out = jobs.run_available(changes, shared_folder(spark))
    return rounded(out, ["change_pct"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


SUBS = """
    with s as (select c_custkey as subscription_id,
        case c_custkey % 5 when 0 then 'click' when 1 then 'view' when 2 then 'signup'
                           when 3 then 'error' else 'purchase' end as crop,
        concat('M', cast(c_nationkey % 3 as varchar(4))) as mandi, 
        case when c_custkey % 50 = 0 then 0 else 300 + c_acctbal / 50 end as threshold_price,
        c_custkey % 4 <> 0 as is_active
      from {customer})"""


@query("stream_alerts", sql=SUBS.format(customer="customer") + """
    , e as (select event_id, event_type as crop, concat('M', cast(user_id % 3 as varchar)) as mandi, value,
        row_number() over (partition by event_type, user_id % 3, date_trunc('minute', ts)
          order by ts desc, value desc, event_id desc) as rn
      from events where value is not null and ts is not null)
    select e.event_id as id, s.subscription_id, s.crop, s.mandi, e.value as price
    from e join s on s.crop = e.crop and s.mandi = e.mandi
    where rn = 1 and s.is_active and (s.threshold_price = 0 or e.value > s.threshold_price)""")
def stream_alerts(spark, sf):
    subs = spark.sql(
        SUBS + " select subscription_id as id, crop, mandi, threshold_price, is_active from s",
        customer=load(spark, sf, "customer"),
    )
    due = jobs.run_available(jobs.stream_alerts(event_prices(spark, sf), subs), shared_folder(spark))
    return due.select("id", "subscription_id", "crop", "mandi", "price")


@query("session_state", "messages", sql=COMMANDS + """
    , g as (select sender, turn, lang from cmd where command = 'language'),
    k as (select sender, turn, crop, mandi from cmd where command in ('subscribe', 'forecast'))
    select s.sender, coalesce((select arg_max(lang, turn) from g where g.sender = s.sender), 'english') as lang,
      (select arg_max(crop, turn) from k where k.sender = s.sender) as crop,
      (select arg_max(mandi, turn) from k where k.sender = s.sender) as mandi
    from (select sender from g union select sender from k) s""".replace(" k as (select sender", " kk as (select sender")
    .replace("from k where k.sender", "from kk where kk.sender").replace("sender from k)", "sender from kk)"))
def session_state(spark, sf):
    from furrow.sources.canonical import TABLES

    said = spark.sql(TABLES["messages"], conversations=stream(spark, sf, "conversations"))
    sessions = jobs.session_state(said.select("sender", "body", F.col("turn").alias("seq")))
    return jobs.run_until_idle(sessions, shared_folder(spark))


@query("stream_metrics", "ops_events", sql=f"""
    select date_trunc('hour', ts) as window_start, label, """ + ", ".join(
        f"count(*) filter (where latency <= {e}::double) as {edge_name(e)}" for e in K.LATENCY_EDGES
    ) + f""", count(latency) as total, count(*) filter (where status_code >= 400) as errors,
      {qs('cast(count(*) filter (where status_code >= 400) as double) / count(*)', 6)} as error_rate,
      {qs('cast(count(*) filter (where cache_hit) as double) / count(cache_hit)', 6)} as hit_rate
    from ops_events group by 1, 2""")
def stream_metrics(spark, sf):
    from furrow.sources.canonical import TABLES

    events = spark.sql(TABLES["ops_events"], events=stream(spark, sf, "events"))
    metrics = jobs.stream_metrics(events.withColumn("ts", F.col("ts").cast("timestamp")))
    out = jobs.run_available(metrics, shared_folder(spark))
    return rounded(out, ["error_rate", "hit_rate"], 6).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )


@query("stream_upsert", "raw_prices", sql=f"""
    , p as (select *, try_cast({J}(raw_data, '$.modal_price') as double) as modal_price from raw_prices),
    r as (select *, row_number() over (partition by crop, state, fetch_date order by id desc) as rn
          from p where modal_price is not null)
    select id, crop, state, fetch_date, modal_price from r where rn = 1""")
def stream_upsert(spark, sf):
    from furrow.sources.canonical import TABLES

    raw = spark.sql(TABLES["raw_prices"], events=stream(spark, sf, "events"))
    records = raw.select(
        "id", "crop", "state", "fetch_date",
        json_number(F.col("raw_data"), "modal_price").alias("modal_price"),
    )
    drain = jobs.stream_upsert(
        records, shared_folder(spark), ["crop", "state", "fetch_date"], "fetch_date", ["id"],
        {"modal_price": F.col("modal_price").isNotNull()},
    )
    return drain().select("id", "crop", "state", "fetch_date", "modal_price")
