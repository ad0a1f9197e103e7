"""Chat replies about a market: its recent prices and its forecast, in every language."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from furrow import constants as K
from furrow.functions import text
from furrow.operators.series import SERIES


def market_replies(reports: DataFrame, history: DataFrame) -> DataFrame:
    """(crop, mandi, lang, command, reply) for each market and language.

    ``reports`` are forecast reports, ``history`` has the smallest, largest and
    mean price of the last 30 days; a market without recent prices gets only the
    forecast reply.
    """
    rows = reports.join(history, SERIES, "left").withColumn(
        "lang", F.explode(F.array(*[F.lit(x) for x in K.LANGUAGES]))
    )
    names = {"crop": text.title_case(F.col("crop")), "mandi": text.title_case(F.col("mandi"))}
    shown = {
        "min": F.col("min_price").cast("string"), "max": F.col("max_price").cast("string"),
        "avg": F.col("avg_price").cast("bigint").cast("string"),
    }
    floor = F.when(F.col("msp") > 0, F.col("msp").cast("string")).otherwise("N/A")
    expected = {
        "current": F.col("current_price").cast("string"), "msp": floor,
        "avg": F.col("avg_predicted_price").cast("string"), "rec": F.col("recommendation"),
        "reason": F.col("recommendation_reason"),
    }
    replies = F.array(
        F.struct(F.lit("history").alias("command"),
                 text.render(text.template_for(F.col("lang"), K.HISTORY_TEMPLATE), {**names, **shown}).alias("reply")),
        F.struct(F.lit("forecast").alias("command"),
                 text.render(text.template_for(F.col("lang"), K.FORECAST_TEMPLATE), {**names, **expected}).alias("reply")),
    )
    return rows.select(*SERIES, "lang", F.inline(replies)).filter(F.col("reply").isNotNull())
