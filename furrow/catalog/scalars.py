"""Projections, predicates and scalar expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from furrow import constants as K, schemas
from furrow.catalog.ingest import MARKET, duck_date, num
from furrow.catalog.registry import newest, q, qs, query
from furrow.functions import dates, numbers, text
from furrow.operators import features, series, windows
from furrow.operators.joins import subscriptions_with_users
from furrow.sources.canonical import load, table

KEYS = ["crop", "mandi", "date"]


@query("ci_match", sql="""
    select c_custkey, lower(c_mktsegment) = 'building' as same, c_mktsegment ilike 'm%y' as alike
    from customer""")
def ci_match(spark, sf):
    seg = F.col("c_mktsegment")
    return load(spark, sf, "customer").select(
        "c_custkey", text.same_text(seg, "Building").alias("same"),
        text.like_text(seg, "m%Y").alias("alike"),
    )


@query("market_contains", "raw_prices", sql=f"""
    select id from raw_prices where coalesce({MARKET}, '') = '' or lower({MARKET}) like '%m1%'""")
def market_contains(spark, sf):
    raw = table(spark, sf, "raw_prices")
    return raw.filter(text.market_contains(text.market_key(F.col("raw_data")), "M1")).select("id")


@query("market_key", "raw_prices", sql=f"select id, {MARKET} as market from raw_prices")
def market_key(spark, sf):
    return table(spark, sf, "raw_prices").select(
        "id", text.market_key(F.col("raw_data")).alias("market")
    )


@query("json_number", "raw_prices", sql=f"""
    select id, {num('modal_price')} as modal_price from raw_prices
    where {num('modal_price')} is not null""")
def json_number(spark, sf):
    rows = table(spark, sf, "raw_prices").select(
        "id", numbers.json_number(F.col("raw_data"), "modal_price").alias("modal_price")
    )
    return rows.filter(F.col("modal_price").isNotNull())


@query("date_window", sql="""
    with d as (select o_orderkey, cast(o_orderdate as date) as day,
                 (select cast(max(o_orderdate) as date) from orders) as e from orders)
    select o_orderkey, day, case when day >= e - 90 and day < e then 'recent' else 'prior' end as side
    from d where day >= e - 180 and day < e""")
def date_window(spark, sf):
    end = newest(spark, sf, "orders", "o_orderdate")
    day = F.col("day")
    recent = dates.between_days(day, end, 90, 0)
    return (
        load(spark, sf, "orders")
        .select("o_orderkey", F.to_date("o_orderdate").alias("day"))
        .filter(dates.between_days(day, end, 180, 0))
        .withColumn("side", F.when(recent, "recent").otherwise("prior"))
    )


@query("fill_defaults", "raw_prices", sql="select id, " + ", ".join(
    f"coalesce(try_cast(json_extract_string(raw_data, '$.{k}') as double), {v}) as {k}"
    for k, v in K.TRAINING_DEFAULTS.items()) + " from raw_prices")
def fill_defaults(spark, sf):
    parsed = table(spark, sf, "raw_prices").select(
        "id", F.from_json("raw_data", schemas.PRICE_PAYLOAD).alias("p")
    )
    picked = parsed.select("id", *[F.col(f"p.{c}").alias(c) for c in K.TRAINING_DEFAULTS])
    return numbers.fill_defaults(picked, K.TRAINING_DEFAULTS)


@query("fill_zero", "weather_obs", sql="""
    select district, date, coalesce(rainfall_mm, 0) as rainfall_mm, coalesce(max_temp, 0) as max_temp,
      coalesce(min_temp, 0) as min_temp, coalesce(humidity, 0) as humidity, wind_speed,
      cast(0 as double) as futures_price
    from weather_obs""")
def fill_zero(spark, sf):
    return numbers.fill_zero(table(spark, sf, "weather_obs"), ["max_temp", "futures_price"])


@query("parse_price", "feed_text", sql="""
    select id, try_cast(trim(modal_price) as double) as price from feed_text""")
def parse_price(spark, sf):
    return table(spark, sf, "feed_text").select(
        "id", numbers.parse_price(F.col("modal_price")).alias("price")
    )


@query("parse_date_multi", "feed_text", sql=f"""
    select id, coalesce({duck_date('arrival_date')},
      (select cast(max(o_orderdate) as date) from orders)) as fetch_date from feed_text""")
def parse_date_multi(spark, sf):
    as_of = newest(spark, sf, "orders", "o_orderdate")
    return table(spark, sf, "feed_text").select(
        "id", F.coalesce(dates.parse_feed_date(F.col("arrival_date")), as_of).alias("fetch_date")
    )


@query("season_flags", sql="""
    select o_orderkey,
      cast(extract(month from o_orderdate) in (10, 11, 12, 1, 2, 3) as int) as is_rabi,
      cast(extract(month from o_orderdate) in (6, 7, 8, 9) as int) as is_kharif from orders""")
def season_flags(spark, sf):
    day = F.col("o_orderdate")
    return load(spark, sf, "orders").select(
        "o_orderkey", dates.is_rabi(day).alias("is_rabi"), dates.is_kharif(day).alias("is_kharif")
    )


TWO_PI = repr(2 * math.pi)


@query("fourier_month", sql=f"""
    select o_orderkey, {qs(f'sin(extract(month from o_orderdate)*{TWO_PI}::double/12)', 8)} as month_sin,
      {qs(f'cos(extract(month from o_orderdate)*{TWO_PI}::double/12)', 8)} as month_cos from orders""")
def fourier_month(spark, sf):
    s, c = dates.month_cycle(F.col("o_orderdate"))
    return load(spark, sf, "orders").select(
        "o_orderkey", q(s, 8).alias("month_sin"), q(c, 8).alias("month_cos")
    )


@query("fourier_week", sql=f"""
    select o_orderkey, {qs(f'sin(extract(week from o_orderdate)*{TWO_PI}::double/52)', 8)} as week_sin,
      {qs(f'cos(extract(week from o_orderdate)*{TWO_PI}::double/52)', 8)} as week_cos from orders""")
def fourier_week(spark, sf):
    s, c = dates.week_cycle(F.col("o_orderdate"))
    return load(spark, sf, "orders").select(
        "o_orderkey", q(s, 8).alias("week_sin"), q(c, 8).alias("week_cos")
    )


@query("msp_gap", "daily_prices", sql="""
    select crop, mandi, date, modal_price - msp as msp_distance,
      (modal_price - msp) / msp * 100 as msp_pct from daily_prices""")
def msp_gap(spark, sf):
    price, msp = F.col("modal_price"), F.col("msp")
    return table(spark, sf, "daily_prices").select(
        *KEYS, numbers.floor_gap(price, msp).alias("msp_distance"),
        numbers.floor_gap_pct(price, msp).alias("msp_pct"),
    )


@query("price_shape", "daily_prices", sql="""
    select crop, mandi, date, max_price - min_price as price_spread,
      (max_price - min_price) / modal_price as price_volatility from daily_prices""")
def price_shape(spark, sf):
    high, low = F.col("max_price"), F.col("min_price")
    return table(spark, sf, "daily_prices").select(
        *KEYS, numbers.price_spread(high, low).alias("price_spread"),
        numbers.price_volatility(high, low, F.col("modal_price")).alias("price_volatility"),
    )


@query("futures_basis_signal", "daily_prices", sql="""
    select crop, mandi, date, modal_price - futures_price as futures_basis,
      case when futures_price > modal_price * 1.05::double then 1
           when futures_price < modal_price * 0.95::double then -1 else 0 end as futures_roll_signal
    from daily_prices""")
def futures_basis_signal(spark, sf):
    spot, futures = F.col("modal_price"), F.col("futures_price")
    return table(spark, sf, "daily_prices").select(
        *KEYS, (spot - futures).alias("futures_basis"),
        numbers.futures_signal(futures, spot).alias("futures_roll_signal"),
    )


@query("temp_shape", "daily_prices", sql="""
    select crop, mandi, date, max_temp - min_temp as temp_range,
      (max_temp + min_temp) / 2 as temp_mean from daily_prices""")
def temp_shape(spark, sf):
    high, low = F.col("max_temp"), F.col("min_temp")
    return table(spark, sf, "daily_prices").select(
        *KEYS, (high - low).alias("temp_range"), ((high + low) / 2).alias("temp_mean")
    )


@query("drought_flag", "daily_prices", sql=f"""
    , r as (select crop, mandi, date, sum(cast(rainfall_mm as decimal(14,2))) over w as s,
        count(*) over w as n from daily_prices
      window w as (partition by crop, mandi order by date rows between 9 preceding and current row))
    select crop, mandi, date, case when n = 10 and s < 1.0 then 1 else 0 end as drought_flag from r""")
def drought_flag(spark, sf):
    rolled = windows.rain_roll(table(spark, sf, "daily_prices"))
    return rolled.select(
        *KEYS, numbers.drought_flag(F.col("rainfall_roll_10d")).alias("drought_flag")
    )


@query("advice", "daily_prices", sql="""
    , f as (select crop, mandi, date, modal_price as average,
              case when crop = 'SMALL' then null else msp end as msp from daily_prices),
    g as (select *, cast(round_even(abs(average - msp) / msp * 100, 1) as double) as pct from f)
    select crop, mandi, date, case when average > msp then 'SELL' else 'HOLD' end as recommendation,
      case when msp is null then concat('No MSP data available for ', crop,
             '. Average predicted price: ₹', format('{:,.0f}', average))
           when average > msp then concat('Predicted avg price ₹', format('{:,.0f}', average), ' is ',
             cast(pct as varchar), '% above MSP ₹', format('{:,.0f}', msp))
           else concat('Predicted avg price ₹', format('{:,.0f}', average), ' is ',
             cast(pct as varchar), '% below MSP ₹', format('{:,.0f}', msp),
             ' — consider holding') end as reason
    from g""")
def advice(spark, sf):
    msp = F.when(F.col("crop") != "SMALL", F.col("msp"))
    rows = table(spark, sf, "daily_prices").select(
        *KEYS, F.col("modal_price").alias("average"), msp.alias("msp")
    )
    return rows.select(
        *KEYS, numbers.advice(F.col("average"), F.col("msp")).alias("recommendation"),
        numbers.advice_reason(F.col("crop"), F.col("average"), F.col("msp")).alias("reason"),
    )


@query("alert_trigger", "subscriptions", sql="""
    select id, threshold_price = 0 or cast(id as double) > threshold_price
      or 4000 > threshold_price as fires from subscriptions""")
def alert_trigger(spark, sf):
    fires = numbers.alert_trigger(F.col("threshold_price"), F.col("id").cast("double"), F.lit(4000.0))
    return table(spark, sf, "subscriptions").select("id", fires.alias("fires"))


@query("phone_normalise", "subscriptions", "users", sql="""
    , p as (select s.id, coalesce(nullif(s.phone_number, ''), nullif(u.phone, '')) as phone
      from subscriptions s left join users u on s.user_id = u.id)
    select id, case when starts_with(phone, 'whatsapp:') then phone
      when starts_with(phone, '+') then concat('whatsapp:', phone)
      else concat('whatsapp:+91', phone) end as phone from p where phone is not null""")
def phone_normalise(spark, sf):
    joined = subscriptions_with_users(table(spark, sf, "subscriptions"), table(spark, sf, "users"))
    phone = text.target_phone(F.col("phone_number"), F.col("user_phone"))
    return joined.select("id", phone.alias("phone")).filter(F.col("phone").isNotNull())


CLEAN = "substr(trim(regexp_replace({0}, '[^a-zA-Z0-9 \\-]', '', 'g')), 1, 50)"


@query("sanitise_text", sql=f"""
    select conv_id, turn, {CLEAN.format('text')} as clean from conversations""")
def sanitise_text(spark, sf):
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", text.sanitise(F.col("text")).alias("clean")
    )


COMMANDS = f"""
    , w0 as (select *, regexp_replace(lower(body), '^\\s+|\\s+$', '', 'g') as b from messages),
    w as (select conv_id, turn, sender,
            case when b = '' then [] else string_split_regex(b, '\\s+') end as t from w0),
    k as (select *, case
        when len(t) = 0 then 'help'
        when len(t) = 2 and t[1] = 'language'
             and t[2] in ('english', 'hindi', 'punjabi', 'telugu', 'marathi') then 'language'
        when len(t) = 1 and t[1] in ('help', 'hi', 'hello', 'मदद') then 'help'
        when t[1] in ('subscribe', 'history') and len(t) >= 3 then t[1]
        when len(t) >= 2 and t[1] not in ('subscribe', 'history', 'help', 'language') then 'forecast'
        else 'other' end as kind from w),
    a as (select conv_id, turn, sender, kind, t,
        case when kind in ('subscribe', 'history') then {CLEAN.format('t[2]')}
             when kind = 'forecast' then {CLEAN.format('t[1]')} end as c,
        case when kind in ('subscribe', 'history')
               then {CLEAN.format("array_to_string(t[3:], ' ')")}
             when kind = 'forecast' then {CLEAN.format("array_to_string(t[2:], ' ')")} end as m from k),
    cmd as (select conv_id, turn, sender,
        case when c = '' or m = '' then 'error' else kind end as command,
        case when c = '' or m = '' then null else c end as crop,
        case when c = '' or m = '' then null else m end as mandi,
        case when kind = 'language' then t[2] end as lang from a)"""


@query("classify_command", "messages", sql=COMMANDS + " select * exclude (sender) from cmd")
def classify_command(spark, sf):
    rows = table(spark, sf, "messages").select(
        "conv_id", "turn", text.classify(F.col("body")).alias("c")
    )
    return rows.select("conv_id", "turn", "c.*")


def duck_title(value: str) -> str:
    return (f"array_to_string(list_transform(string_split({value}, ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def template_sql(lang: str, templates: dict[str, str]) -> str:
    return f"case {lang} " + " ".join(f"when '{x}' then '{t}'" for x, t in templates.items()) + " end"


@query("language_reply", "messages", sql=COMMANDS + f"""
    select conv_id, turn, lang, replace({template_sql('lang', K.LANG_SWITCH_TEMPLATE)}, '{{lang}}', {duck_title('lang')}) as reply
    from cmd where command = 'language'""")
def language_reply(spark, sf):
    """Reply to a switch of language, in the new one."""
    said = table(spark, sf, "messages").select("conv_id", "turn", text.classify(F.col("body")).alias("c"))
    lang = F.col("c.lang")
    reply = text.render(text.template_for(lang, K.LANG_SWITCH_TEMPLATE), {"lang": text.title_case(lang)})
    return said.filter("c.command = 'language'").select("conv_id", "turn", lang.alias("lang"), reply.alias("reply"))


@query("render_template", "messages", sql=COMMANDS + f"""
    select conv_id, turn, replace(replace({template_sql('langs[conv_id % 5 + 1]', K.SUBSCRIBED_TEMPLATE)},
      '{{crop}}', {duck_title('crop')}), '{{mandi}}', {duck_title('mandi')}) as reply
    from cmd, (select {K.LANGUAGES} as langs) where command = 'subscribe'""")
def render_template(spark, sf):
    rows = table(spark, sf, "messages").select(
        "conv_id", "turn", text.classify(F.col("body")).alias("c")
    ).filter("c.command = 'subscribe'")
    names = F.array(*[F.lit(x.title()) for x in K.LANGUAGES])
    lang = F.get(names, (F.col("conv_id") % len(K.LANGUAGES)).cast("int"))
    slots = {"crop": text.title_case(F.col("c.crop")), "mandi": text.title_case(F.col("c.mandi"))}
    return rows.select(
        "conv_id", "turn",
        text.render(text.template_for(lang, K.SUBSCRIBED_TEMPLATE), slots).alias("reply"),
    )


@query("series_stem", sql="""
    select p_partkey, concat(lower(p_type), '_', replace(lower(p_name), ' ', '_')) as stem from part""")
def series_stem(spark, sf):
    return load(spark, sf, "part").select(
        "p_partkey", text.series_stem(F.col("p_type"), F.col("p_name")).alias("stem")
    )


@query("round_display", sql="""
    select l_orderkey, l_linenumber, l_partkey,
      cast(round_even(l_quantity / 8, 2) as double) as shown2,
      cast(round_even(l_quantity / 8, 1) as double) as shown1 from lineitem""")
def round_display(spark, sf):
    eighths = F.col("l_quantity") / 8
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        numbers.display_round(eighths).alias("shown2"),
        numbers.display_round(eighths, 1).alias("shown1"),
    )


@query("change_pct", "daily_prices", sql="""
    , l as (select crop, mandi, date, modal_price,
        lag(modal_price) over (partition by crop, mandi order by date) as prev from daily_prices)
    select crop, mandi, date, case when prev > 0 then (modal_price - prev) / prev * 100
      else 0 end as change_pct from l""")
def change_pct(spark, sf):
    before = F.lag("modal_price", 1).over(series.in_order())
    rows = table(spark, sf, "daily_prices").withColumn("prev", before)
    return rows.select(
        *KEYS, numbers.change_pct(F.col("modal_price"), F.col("prev")).alias("change_pct")
    )


@query("require_complete", "daily_prices", sql="""
    , l as (select crop, mandi, modal_price, msp,
        lag(modal_price, 7) over (partition by crop, mandi order by date) as price_lag_7,
        lag(modal_price, 90) over (partition by crop, mandi order by date) as price_lag_90
      from daily_prices)
    select * from l where price_lag_7 is not null and price_lag_90 is not null""")
def require_complete(spark, sf):
    lagged = windows.price_lags(table(spark, sf, "daily_prices")).select(
        "crop", "mandi", "date", "modal_price", "msp", "price_lag_7", "price_lag_90"
    )
    return features.require_complete(lagged).drop("date")


@query("min_rows_gate", "raw_prices", sql="""
    select id, crop, state, fetch_date from raw_prices where (crop, state, fetch_date) in (
      select (crop, state, fetch_date) from raw_prices group by crop, state, fetch_date
      having count(*) >= 14)""")
def min_rows_gate(spark, sf):
    raw = table(spark, sf, "raw_prices").select("id", "crop", "state", "fetch_date")
    return series.min_rows_gate(raw, 14, ["crop", "state", "fetch_date"])


@query("cast_iso_dates", "feed_text", sql="select id, order_date as date from feed_text")
def cast_iso_dates(spark, sf):
    rows = table(spark, sf, "feed_text").select("id", F.col("order_date").cast("string").alias("date"))
    return rows.withColumn("date", dates.iso_date(F.col("date")))


