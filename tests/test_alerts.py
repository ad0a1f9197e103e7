"""Phones, triggers, chat commands, templates, advice and live jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from furrow import constants as K
from furrow.functions import numbers, text
from furrow.operators import joins, ops, windows as W
from furrow.streaming import jobs


def test_phones(spark):
    df = spark.createDataFrame(
        [("+4412", "1"), ("98765", None), ("whatsapp:+1", None), (None, "555"), ("", "777"), (None, None)], "s string, u string"
    )
    got = [r[0] for r in df.select(text.target_phone(F.col("s"), F.col("u"))).collect()]
    assert got == ["whatsapp:+4412", "whatsapp:+9198765", "whatsapp:+1", "whatsapp:+91555", "whatsapp:+91777", None]


def test_trigger(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0), (5.0, 5.0, 5.0), (5.0, 6.0, 1.0), (5.0, 1.0, 6.0), (5.0, None, 6.0)], "t double, c double, f double")
    got = [r[0] for r in df.select(numbers.alert_trigger(F.col("t"), F.col("c"), F.col("f"))).collect()]
    assert got == [True, False, True, True, True]


@pytest.mark.parametrize("body,want", [
    ("wheat Amritsar", ("forecast", "wheat", "amritsar", None)),
    ("subscribe wheat Amritsar Mandi", ("subscribe", "wheat", "amritsar mandi", None)),
    ("history wheat Amritsar", ("history", "wheat", "amritsar", None)),
    ("  ", ("help", None, None, None)), ("HELP", ("help", None, None, None)),
    ("language hindi", ("language", None, None, "hindi")), ("language klingon", ("other", None, None, None)),
    ("subscribe wheat", ("other", None, None, None)), ("wheat", ("other", None, None, None)),
    ("subscribe $$$ delhi", ("error", None, None, None)),
    ("wheat " + "x" * 60, ("forecast", "wheat", "x" * 50, None)),
])
def test_commands(spark, body, want):
    row = spark.createDataFrame([(body,)], "b string").select(text.classify(F.col("b")).alias("c")).first().c
    assert tuple(row) == want


def test_templates(spark):
    df = spark.createDataFrame([("Hindi",), ("klingon",)], "lang string")
    shown = [r[0] for r in df.select(text.render(text.template_for(F.col("lang"), K.LANG_SWITCH_TEMPLATE), {"lang": F.lit("X")})).collect()]
    assert shown[0].startswith("भाषा X") and shown[1] == "Language set to X."


def test_alerts_due(spark):
    subs = spark.createDataFrame(
        [(1, 1, None, "English", "w", "m", 0.0, True), (2, 9, None, "English", "w", "m", 0.0, True),
         (3, None, "+1", "Hindi", "w", "m", 120.0, True), (4, None, "+2", "Hindi", "w", "m", 130.0, True),
         (5, None, "+3", "Hindi", "w", "m", 0.0, False)],
        "id int, user_id int, phone_number string, language string, crop string, mandi string, threshold_price double, is_active boolean")
    users = spark.createDataFrame([(1, "987")], "id int, phone string")
    prices = spark.createDataFrame([("w", "m", 110.0, 125.5)], "crop string, mandi string, current_price double, next_price double")
    out = {r.id: r for r in joins.alerts_due(subs, users, prices).collect()}
    assert set(out) == {1, 3}
    assert out[1].phone == "whatsapp:+91987" and out[1].title == "W @ M" and out[1].quote == "₹125.5/q"


def test_price_changes_skip_repeats(spark):
    rows = [("k", i, p) for i, p in enumerate([1.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "k string, t int, price double")
    assert [r.price for r in W.price_changes(df, ["k"], "t", "price").orderBy("t").collect()] == [1.0, 2.0]


def test_degradation_needs_an_hour(spark):
    t0 = dt.datetime(2024, 1, 1)
    values = [1.0] * 20 + [2.0] * 8
    gauge = spark.createDataFrame([("a", t0 + dt.timedelta(minutes=15 * i), v) for i, v in enumerate(values)], "label string, ts timestamp, rmse double")
    firing = [r.firing for r in W.rmse_degradation(gauge, ["label"]).orderBy("ts").collect()]
    assert firing.index(True) == 24 and all(firing[24:])


def test_bucket_quantiles(spark):
    df = spark.createDataFrame([("a", v) for v in (0.02, 0.07, 0.3, 9.0)], "label string, latency double")
    r = ops.latency_histogram(df, ["label"]).first()
    assert r.le_0_05 == 1 and r.le_0_1 == 2 and r.le_5_0 == 3 and r.total == 4
    assert r.est_p50 == pytest.approx(0.1) and r.est_p99 == 5.0 and r.p50 == pytest.approx(0.185)


def source(spark, tmp_path, name, rows, schema):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return jobs.file_stream(spark, path, spark.read.parquet(path).schema)


def test_change_feed_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("w", "m", t0 + dt.timedelta(minutes=i), p) for i, p in enumerate([1.0, 1.0, 2.0])]
    rows += [("other", "m", t0 + dt.timedelta(hours=5), 7.0)]  # the newest poll is given too
    feed = jobs.price_change_feed(source(spark, tmp_path, "p", rows, "crop string, mandi string, ts timestamp, price double"))
    out = jobs.run_available(feed, str(tmp_path / "run")).orderBy("ts").collect()
    assert [(r.crop, r.price, r.change_pct) for r in out] == [("w", 1.0, 0.0), ("w", 2.0, 100.0), ("other", 7.0, 0.0)]


def test_session_stream(spark, tmp_path):
    rows = [("s1", 1, "language hindi"), ("s1", 2, "wheat Karnal"), ("s1", 3, "rice Indore"), ("s2", 1, "help"), ("s3", 1, "wheat Agra")]
    said = source(spark, tmp_path, "m", rows, "sender string, seq int, body string")
    out = {r.sender: (r.lang, r.crop, r.mandi) for r in jobs.run_until_idle(jobs.session_state(said), str(tmp_path / "run")).collect()}
    assert out == {"s1": ("hindi", "rice", "indore"), "s3": ("english", "wheat", "agra")}


def test_upsert_stream(spark, tmp_path):
    rows = [(1, "a", dt.date(2024, 1, 1), 1.0), (2, "a", dt.date(2024, 1, 1), 2.0), (3, "b", dt.date(2024, 1, 1), None)]
    records = source(spark, tmp_path, "r", rows, "id int, crop string, day date, price double")
    folder = str(tmp_path / "run")
    drain = jobs.stream_upsert(records.withColumn("state", F.lit("s")), folder, ["crop", "day"], "day", ["id"], {"price": F.col("price").isNotNull()})
    assert [(r.id, r.price) for r in drain().collect()] == [(2, 2.0)]
    bad = spark.read.parquet(f"{folder}/errors").collect()
    assert [(r.id, r.error_message) for r in bad] == [(3, "price")]


def batched(spark, tmp_path, files, schema):
    """The same rows as one file, and as one file a micro-batch in reverse order."""
    import os

    for name, parts in (("one", [sum(files, [])]), ("many", files[::-1])):
        path = str(tmp_path / name)
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
            for f in os.listdir(path):
                if f.endswith(".parquet") and not os.path.exists(f"{path}/.seen-{f}"):
                    os.utime(f"{path}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
                    open(f"{path}/.seen-{f}", "w").close()
        yield name, jobs.file_stream(spark, path, spark.read.parquet(path).schema, 1)


def test_answers_do_not_depend_on_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        (i, "w" if i % 3 else "r", "m", t0 + dt.timedelta(minutes=7 * i), None if i % 11 == 0 else float(i % 5), 200 if i % 4 else 500, i % 2 == 0)
        for i in range(200)
    ]
    schema = "id int, crop string, mandi string, ts timestamp, price double, status_code int, cache_hit boolean"
    subs = spark.createDataFrame([(1, "w", "m", 2.0, True), (2, "r", "m", 0.0, True), (3, "r", "m", 1.0, False)], "id int, crop string, mandi string, threshold_price double, is_active boolean")
    answers = {}
    for name, source in batched(spark, tmp_path, [rows[i::4] for i in range(4)], schema):
        run = lambda job, kind: sorted(map(str, jobs.run_available(job, str(tmp_path / f"{name}-{kind}")).collect()))
        prices = source.select("id", "crop", "mandi", "ts", "price")
        events = source.select("ts", F.col("crop").alias("label"), F.col("price").alias("latency"), "status_code", "cache_hit")
        drain = jobs.stream_upsert(source.withColumns({"day": F.to_date("ts"), "state": F.lit("s")}), str(tmp_path / f"{name}-u"), ["crop", "day"], "day", ["id"], {"price": F.col("price").isNotNull()})
        answers[name] = (
            run(jobs.price_change_feed(prices.drop("id")), "c"), run(jobs.stream_metrics(events), "m"),
            run(jobs.stream_alerts(prices, subs), "a"), sorted(str((r.id, r.crop, r.day)) for r in drain().collect()),
        )
    assert answers["one"] == answers["many"]
    assert all(answers["one"])


def test_older_messages_in_later_batches_do_not_win(spark, tmp_path):
    files = [[("s1", 1, "language hindi"), ("s1", 2, "wheat Karnal")], [("s1", 3, "rice Indore"), ("s2", 1, "wheat Agra")]]
    answers = [
        sorted((r.sender, r.lang, r.crop, r.mandi) for r in jobs.run_available(jobs.session_state(s), str(tmp_path / f"run-{name}")).collect())
        for name, s in batched(spark, tmp_path, files, "sender string, seq int, body string")
    ]
    assert answers[0] == answers[1] == [("s1", "hindi", "rice", "indore"), ("s2", "english", "wheat", "agra")]


def test_scratch_folder_needs_a_shared_place(spark, monkeypatch):
    from types import SimpleNamespace

    from furrow import session

    conf = SimpleNamespace(get=lambda key, default: default)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_folder(far)
    assert session.shared_folder(far, "hdfs://shared/").startswith("hdfs://shared/furrow/")
    near = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))
    assert session.shared_root(near) == session.shared_root(near)
    set_to = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "file:///shared/x/"), sparkContext=far.sparkContext)
    assert session.shared_root(set_to) == "file:///shared/x"


def test_scratch_folder_is_released(spark):
    from furrow import session

    folder = session.shared_folder(spark)
    spark.range(3).write.parquet(folder)
    assert session.release(spark, folder) and session.release(spark, folder)
    with pytest.raises(Exception):
        spark.read.parquet(folder)
