"""Joins: equi, as-of, bounded look-back, grids and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import constants as K
from furrow.catalog.registry import q, qs, query
from furrow.operators import joins
from furrow.session import materialise
from furrow.sources.canonical import announcements_of, load, table

KEYS = ["crop", "mandi", "date"]


@query("subs_left_users", "subscriptions", "users", sql="""
    select s.*, u.phone as user_phone from subscriptions s left join users u on s.user_id = u.id""")
def subs_left_users(spark, sf):
    return joins.subscriptions_with_users(
        table(spark, sf, "subscriptions"), table(spark, sf, "users")
    )


@query("msp_asof", "daily_prices", "announcements", sql="""
    select d.crop, d.mandi, d.date,
      coalesce(d.date - a.announced_on, 0) as days_since_msp_announcement
    from daily_prices d asof left join announcements a
      on d.crop = a.crop and d.date >= a.announced_on""")
def msp_asof(spark, sf):
    daily = materialise(table(spark, sf, "daily_prices").select(*KEYS))
    out = joins.days_since_announcement(daily, announcements_of(daily))
    return out.select(*KEYS, "days_since_msp_announcement")


@query("msp_hike", "daily_prices", "announcements", sql=f"""
    , p as (select crop, mandi, date, msp + 10 * (extract(year from date) - 1990) as msp
            from daily_prices),
    l as (select *, lag(msp) over (partition by crop, mandi order by date) as prev from p)
    select l.crop, l.mandi, l.date, coalesce(case when a.crop is not null and prev > 0
      then {qs('(msp - prev) / prev * 100', 6)} end, 0) as msp_hike_pct
    from l left join announcements a on a.crop = l.crop and a.announced_on = l.date""")
def msp_hike(spark, sf):
    daily = materialise(table(spark, sf, "daily_prices").select(*KEYS, "msp"))
    stepped = daily.withColumn("msp", F.col("msp") + 10 * (F.year("date") - 1990))
    out = joins.floor_price_hike(stepped, announcements_of(daily))
    return out.select(*KEYS, q("msp_hike_pct", 6).alias("msp_hike_pct"))


@query("merge_price_weather", "raw_prices", "weather_obs", sql="""
    , p as (select event_id as id, cast(user_id as varchar) as mandi, cast(ts as date) as date,
              value as modal_price from events)
    select p.*, w.rainfall_mm, w.max_temp, w.min_temp, w.humidity, w.wind_speed
    from p left join weather_obs w on w.district = p.mandi and w.date = p.date + 1""")
def merge_price_weather(spark, sf):
    prices = load(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("mandi"),
        F.to_date("ts").alias("date"), F.col("value").alias("modal_price"),
    )
    # weather of the following day: some price rows stay without a match
    weather = table(spark, sf, "weather_obs").withColumn("date", F.date_sub("date", 1))
    return joins.merge_price_weather(prices, weather)


@query("experiment_grid", "daily_prices", sql="""
    select distinct d.crop, d.mandi, h.horizon, m.model_name
    from daily_prices d, (select unnest([30, 60, 90]) as horizon) h,
      (select unnest(['naive', 'trend-season', 'regression']) as model_name) m""")
def experiment_grid(spark, sf):
    return joins.experiment_grid(
        table(spark, sf, "daily_prices"), K.HORIZONS, ["naive", "trend-season", "regression"]
    )


@query("msp_lookup", sql="""
    with m(crop_key, msp) as (values """ + ", ".join(
        f"('{c}', {v}::double)" for c, v in K.SUPPORT_PRICE.items()) + """),
    c as (select o_orderkey, case o_orderkey % 5 when 0 then 'WHEAT' when 1 then 'rice'
      when 2 then 'Sugarcane' when 3 then 'Cotton' else 'Saffron' end as crop from orders)
    select c.o_orderkey, c.crop, m.msp from c left join m on m.crop_key = lower(c.crop)""")
def msp_lookup(spark, sf):
    names = F.array(*[F.lit(n) for n in ("WHEAT", "rice", "Sugarcane", "Cotton", "Saffron")])
    orders = load(spark, sf, "orders").select(
        "o_orderkey", F.get(names, (F.col("o_orderkey") % 5).cast("int")).alias("crop")
    )
    return joins.with_support_price(orders)


@query("selective_pairs", "daily_prices", "announcements", sql="""
    select distinct crop, mandi, horizon from daily_prices, (select unnest([30, 60, 90]) as horizon)
    where crop in (select crop from daily_prices group by crop having max(modal_price) >
                     (select avg(m) from (select max(modal_price) as m from daily_prices group by crop)))""")
def selective_pairs(spark, sf):
    prices = table(spark, sf, "daily_prices")
    peaks = prices.groupBy("crop").agg(F.max("modal_price").alias("peak"))
    listed = peaks.filter(F.col("peak") > peaks.agg(F.avg("peak")).scalar())
    grid = joins.experiment_grid(prices, K.HORIZONS, ["naive"]).drop("model_name")
    return joins.selective_pairs(grid, listed)


@query("ffill_weather", "weather_obs", sql="select district, date, " + ", ".join(
    f"coalesce({m}, last_value({m} ignore nulls) over w) as {m}" for m in joins.WEATHER_METRICS
) + """ from weather_obs window w as (partition by district order by (date - date '1970-01-01')
        range between 3 preceding and 1 preceding)""")
def ffill_weather(spark, sf):
    return joins.forward_fill_weather(table(spark, sf, "weather_obs"))


ATTR = """with attr as (
      select vec_id, label as sample, unnest(range(0, len(embedding))) as pos,
        cast(unnest(embedding) as double) as attribution from embeddings),
    names as (select unnest(range(0, 53)) as pos, unnest([""" + ", ".join(
        f"'{n}'" for n in K.FEATURE_NAMES) + """]) as feature),
    attributions as (select vec_id, sample, coalesce(n.feature, concat('dim_', a.pos)) as feature,
        attribution from attr a left join names n on n.pos = a.pos)"""


def attributions(spark, sf):
    """Embedding elements as attributions: sample = label, step = vector."""
    names = F.array(*[F.lit(n) for n in K.FEATURE_NAMES])
    long = load(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("sample"), F.posexplode("embedding").alias("pos", "a")
    )
    return long.select(
        "vec_id", "sample",
        F.coalesce(F.get(names, F.col("pos")), F.concat(F.lit("dim_"), F.col("pos"))).alias("feature"),
        F.col("a").cast("double").alias("attribution"),
    )


@query("importance_delta", sql=ATTR + f"""
    , imp as (select sample, feature, avg(abs(attribution)) as importance from attributions
              group by sample, feature),
    old as (select sample + 1 as sample, feature, importance as old from imp
            where feature not like 'dim%')
    select i.sample, i.feature, {qs('importance', 8)} as importance,
      {qs('importance - coalesce(old, 0)', 6)} as delta
    from imp i left join old o on o.sample = i.sample and o.feature = i.feature""")
def importance_delta(spark, sf):
    imp = attributions(spark, sf).groupBy("sample", "feature").agg(
        F.avg(F.abs("attribution")).alias("importance")
    )
    old = imp.filter(~F.col("feature").startswith("dim")).withColumn("sample", F.col("sample") + 1)
    out = joins.importance_delta(imp, old, ["sample"])
    return out.select(
        "sample", "feature", q("importance", 8).alias("importance"), q("delta", 6).alias("delta")
    )


@query("label_features", sql=ATTR + """
    , l as (select * from (values """ + ", ".join(
        "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in K.FEATURE_LABELS.items()
    ) + """) v(feature, label))
    select vec_id, a.feature, coalesce(l.label, a.feature) as label
    from attributions a left join l on l.feature = a.feature""")
def label_features(spark, sf):
    return joins.label_features(attributions(spark, sf)).select("vec_id", "feature", "label")

