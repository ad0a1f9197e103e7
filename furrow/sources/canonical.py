"""Canonical tables derived from the given ones.

Each canonical table is one portable SELECT (it runs unchanged on Spark and on
the checking engine).  ``{name}`` refers to a given table or to another
canonical table.  Everything is a lazy plan: only the columns a query touches
are read from Parquet.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    # one row per product, market and day: sums and extremes combine map-side,
    # so a busy day of a hot product reaches its reducer as one row per map task;
    # money is summed in whole cents, which is exact in any order
    "daily_prices": """
        select p.crop, concat('M', cast(l.l_suppkey % 3 as varchar(4))) as mandi,
          cast(l.l_shipdate as date) as date,
          floor(cast(sum(l.amount) as double)/100*100/(cast(sum(l.quantity) as double)/100))/100
            as modal_price,
          max(p.msp) as msp,
          floor(min(l_extendedprice/l_quantity)*100)/100 as min_price,
          ceil(max(l_extendedprice/l_quantity)*100)/100 as max_price,
          cast(sum(l.quantity) as double)/100 as arrivals_tonnes,
          cast(sum(l.discount) as double)/100 as rainfall_mm,
          20+100*max(l_tax) as max_temp, 10+100*min(l_tax) as min_temp,
          cast(90+count(*) as double) as freight_index,
          floor(cast(sum(l.amount*(100-l.discount)) as double)/10000*105
                /(cast(sum(l.quantity) as double)/100))/100 as futures_price
        from (
          select l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_tax,
            cast(floor(l_extendedprice*100+0.5) as bigint) as amount,
            cast(floor(l_quantity*100+0.5) as bigint) as quantity,
            cast(floor(l_discount*100+0.5) as bigint) as discount
          from {lineitem}) l join (
          select x.p_partkey, x.p_type as crop, f.msp from {part} x join (
            select p_type, floor(cast(sum(cast(p_retailprice as decimal(14,2))) as double)*100
                                 /count(*))/100 as msp
            from {part} group by p_type) f on x.p_type = f.p_type) p on l.l_partkey = p.p_partkey
        group by p.crop, concat('M', cast(l.l_suppkey % 3 as varchar(4))),
                 cast(l.l_shipdate as date)""",
    "announcements": """
        select crop, min(date) as announced_on
        from {daily_prices} group by crop, extract(year from date)""",
    # daily prices, and beside each series a random walk that steps by the parity of its prices
    "walk_prices": """
        select crop, mandi, date, modal_price from {daily_prices}
        union all
        select crop, concat(mandi, '-walk') as mandi, date,
          cast(1000 + sum(case when cast(floor(modal_price*100+0.5) as bigint) % 2 = 0 then 1 else -1 end)
            over (partition by crop, mandi order by date) as double) as modal_price
        from {daily_prices}""",
    "raw_prices": """
        select event_id as id, event_type as crop,
          concat('S', cast(user_id % 5 as varchar(4))) as state, cast(ts as date) as fetch_date,
          concat('{{"',
            case event_id % 4 when 0 then 'market_name' when 1 then 'mandi'
                              when 2 then 'market' else 'place' end,
            '":"M', cast(user_id % 3 as varchar(4)), '"',
            case when event_id % 7 = 0 or (event_type = 'error' and user_id % 5 = 4)
                   or (event_type = 'view' and user_id % 5 = 2) then ''
                 else concat(',"modal_price":',
                 cast(cast(value as decimal(12,2)) as varchar(20))) end,
            case when event_id % 5 = 0 then '' else concat(',"min_price":',
                 cast(cast(value - 0.25 as decimal(12,2)) as varchar(20))) end,
            ',"max_price":', cast(cast(value + 0.25 as decimal(12,2)) as varchar(20)),
            case when event_id % 3 = 0 then '' else concat(',"arrivals_tonnes":',
                 cast(user_id as varchar(20))) end,
            case when event_id % 4 = 1 then concat(',"msp":',
                 cast(1800 + 50 * (event_id % 9) as varchar(20))) else '' end,
            case when event_id % 6 = 1 then concat(',"rainfall_mm":',
                 cast(event_id % 30 as varchar(4)), '.5') else '' end,
            case when event_id % 4 = 2 then concat(',"max_temp":',
                 cast(30 + event_id % 13 as varchar(4))) else '' end,
            case when event_id % 5 = 2 then concat(',"min_temp":',
                 cast(10 + event_id % 11 as varchar(4))) else '' end,
            case when event_id % 9 = 4 then concat(',"freight_index":',
                 cast(95 + event_id % 17 as varchar(4))) else '' end,
            case when event_id % 8 = 3 then concat(',"futures_price":',
                 cast(cast(value + 2.25 as decimal(12,2)) as varchar(20))) else '' end,
            '}}') as raw_data,
          ts as created_at
        from {events}""",
    # newest price per day of few markets, as the live feed sees them
    "market_days": """
        select crop, mandi, date, modal_price from (
          select event_type as crop, concat('M', cast(user_id % 3 as varchar(4))) as mandi,
            cast(ts as date) as date, value as modal_price,
            row_number() over (partition by event_type, user_id % 3, cast(ts as date)
                               order by ts desc, event_id desc) as rn
          from {events}) x
        where rn = 1""",
    # newest price per day of many short series, most of them under 14 days
    "spot_prices": """
        select crop, mandi, date, modal_price from (
          select event_type as crop, concat('U', cast(user_id as varchar(20))) as mandi,
            cast(ts as date) as date, value as modal_price,
            row_number() over (partition by event_type, user_id, cast(ts as date)
                               order by event_id desc) as rn
          from {events}) x
        where rn = 1""",
    "weather_obs": """
        select cast(user_id as varchar(20)) as district, cast(ts as date) as date,
          case when (extract(day from cast(ts as date)) + user_id) % 3 = 0 then null
               else cast(count(*) as double) end as rainfall_mm,
          case when extract(day from cast(ts as date)) % 4 = 0 then null
               else max(value) end as max_temp,
          case when extract(day from cast(ts as date)) % 5 = 1 then null
               else min(value) end as min_temp,
          case when extract(day from cast(ts as date)) % 6 in (1, 2, 3, 4) then null
               else cast(max(event_id) as double) end as humidity,
          cast(min(event_id) as double) as wind_speed
        from {events} group by user_id, cast(ts as date)""",
    # one landed feed response per order: two text records inside
    "feed_responses": """
        select o_orderkey as response_id,
          case o_orderkey % 4 when 0 then 'Wheat' when 1 then 'Rice' when 2 then 'Maize'
                              else 'Tur' end as crop,
          concat('S', cast(o_custkey % 5 as varchar(4))) as state,
          concat('{{"records":[{{"market":"M', cast(o_custkey % 3 as varchar(4)),
            '","arrival_date":"', case o_orderkey % 4
               when 0 then dmy_slash when 1 then iso_text
               when 2 then dmy_dash else 'someday' end,
            '","modal_price":"', case when o_orderkey % 11 = 0 then 'n/a'
               else cast(cast(o_totalprice as decimal(14,2)) as varchar(20)) end,
            '","min_price":" ', cast(cast(o_totalprice - 10 as decimal(14,2)) as varchar(20)),
            '","arrivals":"', cast(o_custkey as varchar(20)),
            '"}},{{"commodity":"', o_orderpriority,
            '","state":"', o_orderstatus, '","district":"D1","market":"M9","modal_price":"7.5",',
            '"arrival_date":"', iso_text, '"}}]}}') as payload
        from (
          select *, cast(cast(o_orderdate as date) as varchar(10)) as iso_text,
            concat(cast(extract(day from o_orderdate) as varchar(4)), '/',
                   cast(extract(month from o_orderdate) as varchar(4)), '/',
                   cast(extract(year from o_orderdate) as varchar(4))) as dmy_slash,
            concat(cast(extract(day from o_orderdate) as varchar(4)), '-',
                   cast(extract(month from o_orderdate) as varchar(4)), '-',
                   cast(extract(year from o_orderdate) as varchar(4))) as dmy_dash
          from {orders}) o""",
    # the same orders as flat text columns
    "feed_text": """
        select o_orderkey as id,
          case o_orderkey % 4 when 0 then 'Wheat' when 1 then 'Rice' when 2 then 'Maize'
                              else 'Tur' end as crop,
          concat('S', cast(o_custkey % 5 as varchar(4))) as state,
          case o_orderkey % 5
            when 0 then concat(cast(extract(day from o_orderdate) as varchar(4)), '/',
                   cast(extract(month from o_orderdate) as varchar(4)), '/',
                   cast(extract(year from o_orderdate) as varchar(4)))
            when 1 then cast(cast(o_orderdate as date) as varchar(10))
            when 2 then concat(' ', cast(extract(day from o_orderdate) as varchar(4)), '-',
                   cast(extract(month from o_orderdate) as varchar(4)), '-',
                   cast(extract(year from o_orderdate) as varchar(4)), ' ')
            when 3 then 'not a date' else null end as arrival_date,
          case when o_orderkey % 11 = 0 then 'n/a' when o_orderkey % 13 = 0 then null
               else concat(' ', cast(cast(o_totalprice as decimal(14,2)) as varchar(20))) end
            as modal_price,
          cast(o_orderdate as date) as order_date, o_totalprice as total
        from {orders}""",
    "weather_responses": """
        select event_id as id, cast(user_id as varchar(20)) as district,
          cast(ts as date) as date,
          concat('{{"main":{{"temp_max":', cast(cast(value as decimal(12,2)) as varchar(20)),
            case when event_id % 3 = 0 then '' else concat(',"temp_min":',
                 cast(cast(value - 1 as decimal(12,2)) as varchar(20))) end,
            ',"humidity":', cast(user_id as varchar(20)), '}}',
            case when event_id % 4 = 0 then '' else concat(',"wind":{{"speed":',
                 cast(user_id % 30 as varchar(4)), '.5}}') end,
            case when event_id % 5 = 0 then concat(',"rain":{{"1h":',
                 cast(user_id % 7 as varchar(4)), '.25}}') else '' end, '}}') as payload
        from {events}""",
    "users": """
        select c_custkey as id,
          case when c_custkey % 5 = 0 then null
               when c_custkey % 7 = 0 then concat('+', cast(910000000000 + c_custkey as varchar(20)))
               else cast(9000000000 + c_custkey as varchar(20)) end as phone,
          c_name as full_name
        from {customer}""",
    "subscriptions": """
        select c_custkey as id, case when c_custkey % 8 = 0 then null else c_custkey end as user_id,
          case when c_custkey % 9 = 0 then concat('whatsapp:+91', cast(7000000000 + c_custkey as varchar(20)))
               when c_custkey % 3 = 0 then cast(8000000000 + c_custkey as varchar(20))
               when c_custkey % 10 = 1 then '' else null end as phone_number,
          case c_custkey % 5 when 0 then 'English' when 1 then 'Hindi' when 2 then 'Punjabi'
                             when 3 then 'Telugu' else 'Marathi' end as language,
          case c_custkey % 6 when 0 then 'STANDARD' when 1 then 'MEDIUM' when 2 then 'PROMO'
                             when 3 then 'LARGE' when 4 then 'SMALL' else 'ECONOMY' end as crop,
          concat('M', cast(c_nationkey % 4 as varchar(4))) as mandi,
          case when c_custkey % 4 = 0 then cast(0 as double) else c_acctbal end as threshold_price,
          c_custkey % 10 <> 3 as is_active
        from {customer}""",
    "messages": """
        select conv_id, turn, concat('whatsapp:+91', cast(9000000000 + conv_id as varchar(20))) as sender,
          case (conv_id + turn) % 9 when 0 then concat('Subscribe wheat ', text)
            when 1 then concat('history RICE  ', text) when 2 then ' Language Hindi'
            when 3 then '  HELP ' when 4 then '  ' when 5 then 'language klingon'
            when 6 then 'subscribe wheat' else text end as body
        from {conversations} where role = 'user'""",
    # three simple forecasters scored against the actual price
    "predictions": """
        select crop, mandi, date, model_name, actual, predicted,
               predicted * 0.95 as lower_bound, predicted * 1.05 as upper_bound
        from (
          select crop, mandi, date, 'lag1' as model_name, modal_price as actual,
            lag(modal_price, 1) over (partition by crop, mandi order by date) as predicted
          from {daily_prices}
          union all
          select crop, mandi, date, 'lag7' as model_name, modal_price as actual,
            lag(modal_price, 7) over (partition by crop, mandi order by date) as predicted
          from {daily_prices}
          union all
          select crop, mandi, date, 'mean7' as model_name, modal_price as actual,
            (lag(modal_price, 1) over (partition by crop, mandi order by date)
             + lag(modal_price, 2) over (partition by crop, mandi order by date)
             + lag(modal_price, 3) over (partition by crop, mandi order by date)
             + lag(modal_price, 4) over (partition by crop, mandi order by date)
             + lag(modal_price, 5) over (partition by crop, mandi order by date)
             + lag(modal_price, 6) over (partition by crop, mandi order by date)
             + lag(modal_price, 7) over (partition by crop, mandi order by date)) / 7 as predicted
          from {daily_prices}) x
        where predicted is not null""",
    "configs": """
        select p_partkey as id, lower(p_type) as crop,
          64 * cast(1 + p_partkey % 3 as int) as lstm_units,
          cast(1 + p_partkey % 3 as double) / 10 as dropout,
          case p_partkey % 3 when 0 then cast(0.0001 as double) when 1 then cast(0.001 as double)
                             else cast(0.01 as double) end as learning_rate,
          30 * cast(1 + p_size % 3 as int) as sequence_length,
          16 * cast(1 + p_size % 4 as int) as batch_size, p_retailprice as rmse
        from {part}""",
    "runs": """
        select p_partkey as id, p_type as crop, concat('M', cast(p_size % 3 as varchar(4))) as mandi,
          case when p_partkey % 5 = 0 or (p_type = 'PROMO' and p_size % 3 = 2) then null
               else p_retailprice end as rmse_before,
          case when p_partkey % 11 = 0 then null
               else p_retailprice * cast(90 + p_partkey % 20 as double) / 100 end as rmse_after,
          case when p_partkey % 11 = 0 then 'failed' else 'success' end as status
        from {part}""",
    "ops_events": """
        select event_id, ts, event_type as label, user_id, value / 100 as latency,
          case when event_type = 'error' then 500 when user_id % 10 = 0 then 404 else 200 end
            as status_code,
          user_id % 3 = 0 as cache_hit
        from {events}""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, straight from Parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _references(sql: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical table, or a given one when ``name`` is not canonical."""
    if name not in TABLES:
        return load(spark, sf_dir, name)
    sql = TABLES[name]
    inputs = {ref: table(spark, sf_dir, ref) for ref in _references(sql)}
    return spark.sql(sql, **inputs)


def announcements_of(daily: DataFrame) -> DataFrame:
    """Announcement days of a daily table that is already at hand."""
    return daily.sparkSession.sql(TABLES["announcements"], daily_prices=daily)


def with_clause(*names: str) -> str:
    """``WITH ...`` defining the named canonical tables for the SQL twins."""
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in done or name not in TABLES:
            return
        refs = _references(TABLES[name])
        for ref in refs:
            visit(ref)
        done[name] = TABLES[name].format(**{ref: ref for ref in refs})

    for name in names:
        visit(name)
    return "with " + ",\n".join(f"{n} as ({body})" for n, body in done.items())
