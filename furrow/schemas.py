"""Explicit schemas (DDL): nothing in the engine infers a schema from data."""

from __future__ import annotations

# payload of raw_prices.raw_data: the market name may sit under any of three keys
PRICE_PAYLOAD = (
    "commodity string, market_name string, mandi string, market string, state string, "
    "district string, arrival_date string, modal_price double, min_price double, "
    "max_price double, arrivals_tonnes double, rainfall_mm double, max_temp double, "
    "min_temp double, freight_index double, futures_price double, msp double"
)
# one landed response of the price feed: every record field is text
FEED_FIELDS = [
    "commodity", "market", "state", "district", "arrival_date",
    "min_price", "max_price", "modal_price", "arrivals",
]
FEED_PAYLOAD = "records array<struct<" + ",".join(f"{f}:string" for f in FEED_FIELDS) + ">>"
# one landed response of the weather feed
WEATHER_PAYLOAD = (
    "main struct<temp_max:double,temp_min:double,humidity:double>, wind struct<speed:double>, "
    "rain struct<`1h`:double>"
)
# one tuning trial document
TRIAL = (
    "trial_id string, hyperparameters struct<values:struct<lstm_units:int,dropout:double,"
    "learning_rate:double,sequence_length:int,batch_size:int>>, score double, status string"
)
