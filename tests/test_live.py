"""Keyed state of the live jobs: revisions, restarts, expiry, finished windows."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import Window, functions as F

from furrow.streaming import jobs

PRICES = "id long, crop string, mandi string, ts timestamp, price double"
T0 = dt.datetime(2024, 1, 1)


class Landing:
    """A folder that gets one file at a time, older files first."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.seen = spark, str(path), schema, set()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        for f in sorted(os.listdir(self.path)):
            if f.endswith(".parquet") and f not in self.seen:
                self.seen.add(f)
                at = 1_700_000_000 + len(self.seen)
                os.utime(f"{self.path}/{f}", (at, at))

    def stream(self):
        schema = self.spark.createDataFrame([], self.schema).schema
        return jobs.file_stream(self.spark, self.path, schema, 1)


def random_prices(seed, n=300):
    rng = random.Random(seed)
    return [
        (i, rng.choice("wr"), rng.choice("mn"), T0 + dt.timedelta(minutes=rng.randrange(5 * 1440), seconds=rng.randrange(60)),
         rng.choice([None, 0.0, 1.0, 1.0, 2.0, 3.5]))
        for i in range(n)
    ]


def plain_changes(rows):
    """(crop, mandi, poll, price, percent) by plain loops."""
    latest = {}
    for i, crop, mandi, ts, price in rows:
        if price is not None:
            poll = ts.replace(second=0) + dt.timedelta(minutes=1)
            latest[crop, mandi, poll] = max(latest.get((crop, mandi, poll), (T0, -1.0, -1)), (ts, price, i))
    out, before = [], {}
    for (crop, mandi, poll), (_, price, _) in sorted(latest.items()):
        prev = before.get((crop, mandi))
        if prev is None or prev != price:
            out.append((crop, mandi, poll, price, (price - prev) / prev * 100 if prev else 0.0))
        before[crop, mandi] = price
    return out


def test_changes_over_days_in_any_order(spark, tmp_path):
    rows = random_prices(1)
    land = Landing(spark, tmp_path / "in", PRICES)
    folder = str(tmp_path / "run")
    random.Random(2).shuffle(rows)
    for part in (rows[:100], rows[100:101], rows[101:250]):
        land.add(part)
    feed = jobs.price_change_feed(land.stream())
    first = sorted(tuple(r) for r in jobs.run_available(feed, folder).collect())
    assert first == plain_changes(rows[:250])
    # one late row touches itself and the poll after it, whatever the history
    assert jobs.batch_rows(feed, folder, 1).count() <= 2
    land.add(rows[250:])  # the job is started again on its folder
    feed = jobs.price_change_feed(land.stream())
    assert sorted(tuple(r) for r in jobs.run_available(feed, folder).collect()) == plain_changes(rows)


def test_each_batch_gives_its_own_changes_with_advice(spark, tmp_path):
    land = Landing(spark, tmp_path / "in", PRICES)
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    land.add([(1, "w", "m", minute(0), 1.0), (2, "w", "m", minute(2), 2.0), (3, "r", "m", minute(2), 5.0)])
    land.add([(4, "w", "m", minute(1), 2.0)])  # late: the change of minute 2 is none any more
    reports = spark.createDataFrame([("w", "m", "SELL")], "crop string, mandi string, recommendation string")
    feed, folder = jobs.price_change_feed(land.stream(), reports=reports), str(tmp_path / "run")
    answer = {(r.crop, r.ts.minute): (r.change_pct, r.recommendation) for r in jobs.run_available(feed, folder).collect()}
    assert answer == {("w", 1): (0.0, "SELL"), ("w", 2): (100.0, "SELL"), ("r", 3): (0.0, "HOLD")}
    own = lambda i: sorted((r.crop, r.ts.minute, r.price, r.changed, r.recommendation) for r in jobs.batch_rows(feed, folder, i).collect())
    assert own(0) == [("r", 3, 5.0, True, "HOLD"), ("w", 1, 1.0, True, "SELL"), ("w", 3, 2.0, True, "SELL")]
    assert own(1) == [("w", 2, 2.0, True, "SELL"), ("w", 3, 2.0, False, "SELL")]


def test_no_alert_goes_out_twice_and_none_is_lost(spark, tmp_path):
    land, folder = Landing(spark, tmp_path / "in", PRICES), str(tmp_path / "run")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    subs = spark.createDataFrame(
        [(1, "w", "m", 2.0, True), (2, "w", "m", 0.0, True), (3, "w", "m", 0.0, False)],
        "id int, crop string, mandi string, threshold_price double, is_active boolean",
    )
    for rows in (
        [(1, "w", "m", at(5), 3.0)],  # due for both
        [(2, "w", "m", at(10), 4.0)],  # the same minute: nothing goes out again
        [(3, "w", "m", at(20), 1.0)],  # not due for the first any more
        [(4, "w", "m", at(30), 5.0)],  # due for it again
        [(5, "w", "m", at(1), 9.0)],  # older than what is known: no revision
    ):
        land.add(rows)
    alerts = jobs.stream_alerts(land.stream(), subs)
    answer = jobs.run_available(alerts, folder)
    assert sorted((r.subscription_id, r.id, r.price) for r in answer.collect()) == [(1, 4, 5.0), (2, 4, 5.0)]
    sent = [sorted((r.subscription_id, r.id) for r in jobs.batch_rows(alerts, folder, i).where("send").collect()) for i in range(5)]
    assert sent == [[(1, 1), (2, 1)], [], [], [(1, 4)], []]
    assert "send" not in answer.columns and "revision" not in answer.columns


def test_alerts_of_many_subscriptions_in_any_batches(spark, tmp_path):
    rng = random.Random(3)
    subs = [(i, rng.choice("wr"), rng.choice("mnx"), rng.choice([0.0, -1.0, None, 0.5, 1.0, 3.0, 3.5, 9.0, float("nan")]), rng.random() < 0.8) for i in range(3000)]
    subs += subs[:100] + [(1, "w", "m", 0.0, True), (1, "w", "m", 9.0, True)]  # some come twice
    table = spark.createDataFrame(subs, "id int, crop string, mandi string, threshold_price double, is_active boolean")
    rows = random_prices(5, 200) + [(900, "r", "n", T0, float("-inf")), (901, "w", "m", T0, float("inf"))]
    latest = {}
    for i, crop, mandi, ts, price in rows:
        if price is not None:
            at = (crop, mandi, ts.replace(second=0))
            latest[at] = max(latest.get(at, (T0, float("-inf"), -1)), (ts, price, i))
    want = sorted({(s, i, price) for (crop, mandi, _), (_, price, i) in latest.items() for s, c, m, t, on in subs if on and t is not None and (c, m) == (crop, mandi) and (t == 0 or price > t)})
    random.Random(4).shuffle(rows)
    for name, parts in (("one", [rows]), ("many", [rows[:120], rows[120:121], rows[121:]])):
        land = Landing(spark, tmp_path / name, PRICES)
        for part in parts:
            land.add(part)
        alerts = jobs.stream_alerts(land.stream(), table)
        answer = jobs.run_available(alerts, str(tmp_path / f"{name}-run"))
        assert sorted((r.subscription_id, r.id, r.price) for r in answer.collect()) == want
        plan = answer._jdf.queryExecution().executedPlan().toString()
        assert ("Window" in plan) == (name == "many")  # nothing was given again: no alert is shuffled


def test_a_poll_meets_only_the_subscriptions_it_may_trigger(spark, tmp_path):
    subs = spark.range(20_000).selectExpr("id", "'w' as crop", "'m' as mandi", "cast(id as double) as threshold_price", "true as is_active")
    held, bounds = jobs.threshold_blocks(subs.unionByName(subs))
    assert held.count() == 20_000 and held.groupBy("block").count().agg(F.max("count")).first()[0] <= jobs.BLOCK
    reached = bounds.where("daily or lowest < 300").select("block")
    assert held.join(reached, "block").count() <= 300 + 3 * jobs.BLOCK


def test_a_gone_sender_leaves_the_state(spark, tmp_path):
    land, folder = Landing(spark, tmp_path / "in", "sender string, seq int, body string"), str(tmp_path / "run")
    days = 8 / 86_400  # eight seconds
    land.add([("gone", 1, "language hindi"), ("stays", 1, "language hindi"), ("stays", 5, "wheat Karnal")])
    run = lambda: {r.sender: (r.lang, r.crop) for r in jobs.run_until_idle(jobs.session_state(land.stream(), days), folder, 60).collect()}
    assert set(run()) <= {"gone", "stays"}
    time.sleep(9)
    land.add([("stays", 4, "rice Indore"), ("new", 1, "wheat Agra")])  # an older message of a sender that is new again
    answer = run()
    state = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "session").load()
    assert "gone" not in answer and {r.key.sender for r in state.collect()} <= {"new", "stays"}
    assert answer.get("stays", ("english", "rice")) == ("english", "rice")


def test_sessions_without_messages(spark, tmp_path):
    land = Landing(spark, tmp_path / "in", "sender string, seq int, body string")
    land.add([])
    assert jobs.run_until_idle(jobs.session_state(land.stream()), str(tmp_path / "run"), 60).count() == 0


def test_finished_windows_are_given_once_and_late_rows_added(spark, tmp_path):
    schema = "ts timestamp, label string, latency double, status_code int, cache_hit boolean"
    land, folder = Landing(spark, tmp_path / "in", schema), str(tmp_path / "run")
    row = lambda hours, latency=0.2, label="a": (T0 + dt.timedelta(hours=hours), label, latency, 200, None)
    land.add([row(0.5), row(1.5), row(1.6, None)])
    land.add([row(4.5), row(0.6, 9.0), row(0.1, 0.1, "b")])  # 0 is finished before this batch, 1 with it
    land.add([row(1.7), row(4.6), (T0, None, 1.0, 500, True)])
    metrics = jobs.stream_metrics(land.stream())
    answer = {(r.window_start, r.label): (r.total, r.errors, r.error_rate, r.hit_rate) for r in jobs.run_available(metrics, folder).collect()}
    hour = lambda h: T0 + dt.timedelta(hours=h)
    assert answer == {
        (hour(0), "a"): (2, 0, 0.0, None), (hour(1), "a"): (2, 0, 0.0, None), (hour(4), "a"): (2, 0, 0.0, None),
        (hour(0), "b"): (1, 0, 0.0, None), (hour(0), None): (1, 1, 1.0, 1.0),
    }
    left = spark.read.parquet(f"{folder}/log").select("label", "window_start", "n_events", "late").collect()
    given = sorted((r.window_start // 3_600_000_000 % 24, r.n_events, r.late) for r in left if r.label == "a")
    assert given == [(0, 1, False), (0, 1, True), (1, 1, True), (1, 2, False)]
    state = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "open").load()
    assert state.count() == 3  # open windows only


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        path = str(tmp_path / "in")
        stamps = spark.range(6).select(
            F.lit("w").alias("crop"), F.lit("m").alias("mandi"),
            F.timestamp_seconds(F.lit(1_699_160_000) + F.col("id") * 1200).alias("ts"), F.col("id").cast("double").alias("price"),
        )
        stamps.coalesce(1).write.parquet(path)
        feed = jobs.price_change_feed(jobs.file_stream(spark, path, stamps.schema))
        got = [r[0] for r in jobs.run_available(feed, str(tmp_path / "run")).orderBy("ts").select(F.unix_seconds("ts")).collect()]
        assert got == [(1_699_160_000 + 1200 * i) // 60 * 60 + 60 for i in range(6)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_last_price_of_a_poll_matches_a_window_over_the_table(spark, tmp_path):
    rows = random_prices(7)
    land = Landing(spark, tmp_path / "in", PRICES)
    for i in range(3):
        land.add(rows[i::3])
    got = jobs.run_available(jobs.price_change_feed(land.stream(), "1 hour"), str(tmp_path / "run"))
    polls = spark.createDataFrame(rows, PRICES).where("price is not null")
    polls = polls.groupBy("crop", "mandi", F.window("ts", "1 hour")["end"].alias("at")).agg(F.max(F.struct("ts", "price", "id"))["price"].alias("price"))
    before = F.lag("price").over(Window.partitionBy("crop", "mandi").orderBy("at"))
    want = polls.withColumn("prev", before).where("prev is null or prev <> price").select("crop", "mandi", "at", "price")
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(tuple(r) for r in want.collect())
