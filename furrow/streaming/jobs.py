"""Live jobs on Structured Streaming.

All sources are file streams with an explicit schema. What a job must remember is
keyed state of the engine (``state``); every micro-batch gives its own rows,
stored under its batch id, so a replayed batch replaces its own and a restarted
job goes on where it ended. Rows that come late revise what was given: the newest
revision counts, so the answer does not depend on how the input falls into
micro-batches, and no row is lost.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from furrow import constants as K
from furrow.functions import numbers, text
from furrow.operators.series import SERIES, latest_per_key
from furrow.session import has_files, materialise
from furrow.sources import feed, sinks
from furrow.streaming.state import POLLED, PollState, SessionState, WindowState, latest_of_polls

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """Parquet files as a stream, a bounded number of files per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


@dataclass
class Job:
    """A stream with its keyed state, and what becomes of its rows.

    ``given`` are the rows that the state gives, ``emit`` makes of a batch of
    them what leaves the job, ``merge`` makes the answer of all that has left it.
    ``merge`` may also read a variable of the state, by ``state``. A job whose
    state expires (``expires``) has no last batch and runs until it is idle.
    """

    given: DataFrame
    emit: Callable[[DataFrame], DataFrame]
    merge: Callable[..., DataFrame]
    state: str | None = None
    state_schema: str = ""
    expires: bool = False


def read_parts(job: Job, folder: str) -> DataFrame:
    """The job's answer as it stands."""
    spark = job.given.sparkSession
    kept = job.emit(spark.createDataFrame([], job.given.schema)).schema
    left = spark.read.schema(kept).parquet(f"{folder}/log")
    if job.state is None:
        return job.merge(left)
    if not has_files(spark, f"{folder}/checkpoint/state/0"):
        return job.merge(left, spark.createDataFrame([], job.state_schema))
    stored = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", job.state)
    return job.merge(left, stored.load())


def batch_rows(job: Job, folder: str, batch: int) -> DataFrame:
    """What one micro-batch has given."""
    return job.given.sparkSession.read.parquet(f"{folder}/log/batch={batch}")


def run_available(job: Job, folder: str, timeout: int | None = None) -> DataFrame:
    """Process what is there and read the answer.

    A further call on the same folder goes on where this one ended. Without
    ``timeout`` (seconds) a drain takes as long as it takes.
    """
    spark = job.given.sparkSession
    # a part without rows, so that a job without input reads as empty
    job.emit(spark.createDataFrame([], job.given.schema)).write.mode("overwrite").parquet(f"{folder}/log/batch=-1")

    def keep(batch: DataFrame, batch_id: int) -> None:
        job.emit(batch).write.mode("overwrite").parquet(f"{folder}/log/batch={batch_id}")

    writer = job.given.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(processingTime="0 seconds") if job.expires else writer.trigger(availableNow=True)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = writer.start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    if job.expires:
        _until_idle(query, timeout)
    else:
        _finish(query, timeout)
    return read_parts(job, folder)


def run_until_idle(job: Job, folder: str, timeout: int | None = None) -> DataFrame:
    """As ``run_available``, the name for jobs whose state expires."""
    return run_available(job, folder, timeout)


def _finish(query, timeout: int | None) -> None:
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("stream did not drain in time")


def _until_idle(query, timeout: int | None) -> None:
    """Stop once a batch has found no new rows.

    The first batch of a restarted query may be one that was planned before, so
    only a later one tells that nothing is left.
    """
    ends = None if timeout is None else time.monotonic() + timeout
    try:
        while True:
            if query.exception() is not None:
                raise query.exception()
            seen = query.recentProgress
            if any(p["numInputRows"] == 0 and p["batchId"] > seen[0]["batchId"] for p in seen):
                return
            if ends is not None and time.monotonic() > ends:
                raise TimeoutError("stream did not drain in time")
            time.sleep(0.1)
    finally:
        query.stop()


def interval_micros(spark: SparkSession, interval: str) -> int:
    zero = "timestamp'1970-01-01 00:00:00Z'"
    return spark.range(1).select(F.expr(f"unix_micros({zero} + interval {interval})")).first()[0]


# --- price changes ------------------------------------------------------------

def polled(prices: DataFrame, poll: str) -> DataFrame:
    """New and revised polls of each market: crop, mandi, poll (its end), ts,
    price, id, before (the price of the poll before), was (the price the poll
    had until now), revision.

    A poll's row is that with the latest time, then the largest price and id.
    Rows without time or price are left out.
    """
    width = interval_micros(prices.sparkSession, poll)
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    number = F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)) if "id" in prices.columns else F.lit(NO_ID)
    priced = prices.where(F.col("price").isNotNull() & ~F.isnan("price") & F.col("ts").isNotNull()).select(
        *SERIES, ((F.floor(ts / width) + 1) * width).cast("long").alias("poll"), ts.alias("ts"),
        F.col("price").cast("double").alias("price"), number.alias("id"),
    )

    def first_reduce(batches):
        for rows in batches:
            yield latest_of_polls(rows, SERIES)

    keys = ", ".join(f"{k} string" for k in SERIES)
    reduced = priced.mapInPandas(first_reduce, f"{keys}, poll long, ts long, price double, id long")
    given = reduced.groupBy(*SERIES).transformWithStateInPandas(PollState(SERIES), f"{keys}, {POLLED}", "Update", "None")
    return given.withColumns({"poll": F.timestamp_micros("poll"), "ts": F.timestamp_micros("ts")})


NO_ID = -(1 << 63)


def _newest(log: DataFrame, keys: list[str]) -> DataFrame:
    return latest_per_key(log, keys, ["revision"])


def price_change_feed(prices: DataFrame, poll: str = "60 seconds", reports: DataFrame | None = None) -> Job:
    """Changed prices per market: (crop, mandi, ts, price) rows in, one row per
    change out, with the change in percent of the price before.

    Every micro-batch gives its own changes, with the current advice of their
    market if ``reports`` are given. A late row revises the poll it belongs to
    and the one after it: a change that is none any more is given again as such
    (``changed`` false).
    """

    def emit(batch: DataFrame) -> DataFrame:
        before = F.col("before")
        rows = batch.select(
            *SERIES, F.col("poll").alias("ts"), "price",
            F.when(before > 0, (F.col("price") - before) / before * 100).otherwise(0.0).alias("change_pct"),
            (before.isNull() | (before != F.col("price"))).alias("changed"), "revision",
        )
        return rows if reports is None else with_advice(rows, reports)

    def merge(log: DataFrame) -> DataFrame:
        return _newest(log, [*SERIES, "ts"]).where("changed").drop("changed", "revision", "batch")

    return Job(polled(prices, poll), emit, merge)


def with_advice(changes: DataFrame, reports: DataFrame) -> DataFrame:
    """Attach the current SELL/HOLD advice of each market (HOLD if unknown)."""
    return changes.join(reports.select(*SERIES, "recommendation"), SERIES, "left").withColumn(
        "recommendation", F.coalesce("recommendation", F.lit("HOLD"))
    )


# --- alerts ---------------------------------------------------------------------

#: Subscriptions of a market that lie together by threshold; a poll meets or misses them as one.
BLOCK = 256


def threshold_blocks(subscriptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active subscriptions in short runs by threshold, and the bounds of each run.

    Threshold 0 (a daily alert) comes first. Of a subscription that comes twice
    for a market the threshold that triggers first counts.
    """
    active = subscriptions.filter("is_active and threshold_price is not null").select(
        F.col("id").alias("subscription_id"), *SERIES, "threshold_price"
    )
    order = [F.col("threshold_price") != 0.0, F.col("threshold_price")]
    one = active.groupBy("subscription_id", *SERIES).agg(F.min_by("threshold_price", F.struct(*order)).alias("threshold_price"))
    held = materialise(one.orderBy(*SERIES, *order, "subscription_id").withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)))
    bounds = held.groupBy(*SERIES, "block").agg(
        F.max(F.col("threshold_price") == 0.0).alias("daily"), F.min("threshold_price").alias("lowest")
    )
    return held, materialise(bounds)


def stream_alerts(prices: DataFrame, subscriptions: DataFrame, poll: str = "60 seconds") -> Job:
    """Incoming prices that trigger a subscription.

    The new and revised polls of a micro-batch meet the subscriptions in it; one
    busy minute alerts a subscriber once. ``send`` says that the alert is to go
    out now: a poll that was due already, and a replayed batch, send nothing
    again. A poll that a late row has made not due is given with ``due`` false.

    A poll meets only the blocks of subscriptions that hold one it triggers or
    has triggered, so the work goes with the alerts, not with polls times
    subscriptions; polls and blocks are dealt over all tasks, not by market.
    """
    spark = prices.sparkSession
    subs, bounds = threshold_blocks(subscriptions)
    trigger = lambda price: F.coalesce(numbers.alert_trigger(F.col("threshold_price"), F.col(price), F.lit(None).cast("double")), F.lit(False))

    def emit(batch: DataFrame) -> DataFrame:
        reached = batch.join(bounds, SERIES).where(F.col("daily") | (F.greatest("price", "was") > F.col("lowest"))).drop("daily", "lowest")
        dealt = reached.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *SERIES, "poll", "block")
        met = dealt.join(subs, [*SERIES, "block"]).withColumns({"due": trigger("price"), "was_due": F.col("was").isNotNull() & trigger("was")})
        return met.where("due or was_due").select(
            "subscription_id", *SERIES, "poll", "ts", "price", F.nullif("id", F.lit(NO_ID)).alias("id"), "threshold_price",
            "due", (F.col("due") & ~F.col("was_due")).alias("send"), "revision", F.col("was").isNotNull().alias("revised"),
        )

    def merge(log: DataFrame) -> DataFrame:
        # only polls that were given again have more than one row for a subscription
        polls = [*SERIES, "poll"]
        again = materialise(log.where(F.coalesce("revised", F.lit(True))).select(*polls).distinct())
        if not again.isEmpty():
            newest = _newest(log.join(again, polls, "left_semi"), ["subscription_id", *polls])
            log = log.join(again, polls, "left_anti").unionByName(newest).select(log.columns)
        return log.where("due").drop("due", "send", "revision", "revised", "batch")

    return Job(polled(prices, poll), emit, merge)


# --- chat sessions ----------------------------------------------------------------

SESSION_DAYS = 30


def session_state(messages: DataFrame, days: float = SESSION_DAYS) -> Job:
    """Last language and last crop and market per sender: (sender, body, seq) rows in.

    The message with the largest ``seq`` of its kind counts, in whatever batch
    it came. A sender of whom nothing is written for ``days`` days of processing
    time leaves the state, and with it the disk.
    """
    life = int(days * 86_400_000)
    kind = F.when(F.col("_c.command") == "language", "language").when(
        F.col("_c.command").isin("subscribe", "forecast"), "market"
    )
    slim = messages.withColumn("_c", text.classify(F.col("body"))).select(
        "sender", F.col("seq").cast("long").alias("seq"), kind.alias("kind"), F.col("_c.lang").alias("lang"),
        F.col("_c.crop").alias("crop"), F.col("_c.mandi").alias("mandi"),
    ).filter("kind is not null and sender is not null and seq is not null")

    def last_of_kind(batches):
        for rows in batches:
            yield rows.sort_values("seq").drop_duplicates(["sender", "kind"], keep="last")

    reduced = slim.mapInPandas(last_of_kind, slim.schema)
    given = reduced.groupBy("sender").transformWithStateInPandas(
        SessionState(life), "sender string, lang string, crop string, mandi string", "Update", "ProcessingTime"
    )

    def merge(log: DataFrame, sessions: DataFrame) -> DataFrame:
        if "value" in sessions.columns:
            alive = sessions.where(F.col("value.ttlExpirationMs") > F.unix_millis(F.current_timestamp()))
            sessions = alive.select("key.sender", "value.value.*")
        return sessions.select("sender", F.coalesce("lang", F.lit("english")).alias("lang"), "crop", "mandi")

    return Job(given, lambda batch: batch, merge, "session", "sender string, lang string, crop string, mandi string", True)


# --- operational metrics -------------------------------------------------------------

def stream_metrics(events: DataFrame, width: str = "1 hour", delay: str | None = None) -> Job:
    """Tumbling counts, latency buckets, error rate and cache hit rate per label.

    ``events``: ts, label, latency, status_code, cache_hit. A window that ends
    ``delay`` (its own width by default) before the newest one of its label is
    finished, given once, and leaves the state; rows that come later are given
    as counts to be added to it. The answer has open windows as they stand.
    """
    spark = events.sparkSession
    size = interval_micros(spark, width)
    names = [f"le_{str(e).replace('.', '_')}" for e in K.LATENCY_EDGES]
    counters = [*names, "total", "errors", "n_events", "n_hits", "n_lookups"]
    start = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / size) * size).cast("long")
    flag = lambda condition: F.coalesce(condition.cast("long"), F.lit(0).cast("long"))
    marked = events.where(F.col("ts").isNotNull()).select(
        start.alias("window_start"), "label",
        *(flag(F.col("latency") <= e).alias(n) for n, e in zip(names, K.LATENCY_EDGES)),
        flag(F.col("latency").isNotNull()).alias("total"), flag(F.col("status_code") >= 400).alias("errors"),
        F.lit(1).cast("long").alias("n_events"), flag(F.col("cache_hit")).alias("n_hits"), flag(F.col("cache_hit").isNotNull()).alias("n_lookups"),
    )

    def add_up(batches):
        for rows in batches:
            yield rows.groupby(["window_start", "label"], dropna=False, as_index=False).sum()

    counts = ", ".join(f"{c} long" for c in counters)
    reduced = marked.mapInPandas(add_up, f"window_start long, label string, {counts}")
    given = reduced.groupBy("label").transformWithStateInPandas(
        WindowState(counters, size, size if delay is None else interval_micros(spark, delay)),
        f"window_start long, label string, {counts}, late boolean", "Update", "None",
    )

    def merge(log: DataFrame, windows: DataFrame) -> DataFrame:
        if "key" in windows.columns:
            windows = windows.select("user_map_key.window_start", "key.label", "user_map_value.*")
        both = log.select(windows.columns).unionByName(windows)
        counts = both.groupBy("window_start", "label").agg(*[F.sum(c).alias(c) for c in counters])
        return (
            counts.withColumn("window_start", F.timestamp_micros("window_start"))
            .withColumn("error_rate", F.try_divide("errors", "n_events"))
            .withColumn("hit_rate", F.try_divide("n_hits", "n_lookups"))
            .drop("n_events", "n_hits", "n_lookups")
        )

    return Job(given, lambda batch: batch, merge, "open", f"window_start long, label string, {counts}")


# --- upsert -------------------------------------------------------------------------------

def stream_upsert(
    records: DataFrame, folder: str, keys: list[str], partition: str, order: list[str],
    checks: dict[str, Column], dedupe_within: str | None = None,
    timeout: int | None = None,
) -> Callable[[], DataFrame]:
    """Upsert every micro-batch on ``keys`` and set failing rows aside.

    Returns a function that drains the stream and gives the current table.
    Both writes carry the batch id, so a replayed batch changes nothing, and the
    row with the largest ``order`` of a key stays, in whatever batch it came.
    """
    spark = records.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        good, bad = feed.quarantine(batch, checks)
        sinks.merge_partitions(good, f"{folder}/table", batch_id, keys, partition, order)
        bad.write.mode("overwrite").parquet(f"{folder}/errors/batch={batch_id}")
        batch.unpersist()

    if dedupe_within:
        records = records.withWatermark("ts", dedupe_within).dropDuplicatesWithinWatermark(keys)

    def drain() -> DataFrame:
        query = (
            records.writeStream.foreachBatch(merge)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        _finish(query, timeout)
        return sinks.current_rows(spark.read.parquet(f"{folder}/table"), partition)

    return drain
