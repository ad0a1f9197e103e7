"""Feeds, parsing, upserts, quarantine and the weather fill."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from furrow import schemas
from furrow.functions import dates, numbers, text
from furrow.operators import joins
from furrow.sources import feed, scans, sinks

D = dt.date


def test_parse_price_and_date(spark):
    df = spark.createDataFrame(
        [("12.5", "31/12/2024"), ("", "2024-12-31"), ("abc", " 31-12-2024 "), (None, "x"), ("7", "1/2/2024")],
        "p string, d string",
    )
    rows = df.select(numbers.parse_price(F.col("p")), dates.parse_feed_date(F.col("d"))).collect()
    assert [r[0] for r in rows] == [12.5, None, None, None, 7.0]
    assert [r[1] for r in rows] == [D(2024, 12, 31)] * 3 + [None, D(2024, 2, 1)]


def test_feed_files_and_projection(spark, tmp_path):
    docs = {"records": [
        {"market": "Azadpur", "arrival_date": "01/02/2024", "modal_price": "100", "arrivals": "5"},
        {"commodity": "Rice", "state": "Goa", "modal_price": "oops"},
    ]}
    (tmp_path / "one.json").write_text(json.dumps(docs))
    assert feed.read_feed(spark, str(tmp_path)).count() == 2
    landed = spark.createDataFrame([("Wheat", "Punjab", json.dumps(docs))], "crop string, state string, payload string")
    out = feed.project_feed(feed.explode_feed(landed), F.lit(D(2024, 5, 5)))
    first, second = sorted(out.collect(), key=lambda r: r.fetch_date)
    assert first.fetch_date == D(2024, 2, 1) and first.payload.commodity == "Wheat"
    assert first.payload.state == "Punjab" and first.payload.arrivals_tonnes == 5.0
    assert second.fetch_date == D(2024, 5, 5) and second.payload.commodity == "Rice"
    assert second.payload.state == "Goa" and second.payload.modal_price is None
    stored = json.loads(feed.payload_json(out).filter("fetch_date = '2024-02-01'").first().raw_data)
    assert stored["modal_price"] == 100.0 and stored["market"] == "Azadpur"


def test_empty_market_passes_the_filter(spark):
    df = spark.createDataFrame([("",), ("Azadpur",), ("azad",), ("Karnal",), (None,)], "m string")
    kept = df.filter(text.market_contains(F.col("m"), "AZADPUR")).collect()
    assert {r.m for r in kept} == {"", "Azadpur", None}


def test_history_range_is_checked(spark):
    raw = spark.createDataFrame([], "crop string, fetch_date date, raw_data string")
    with pytest.raises(ValueError):
        scans.price_history(raw, "wheat", "x", 0)
    with pytest.raises(ValueError):
        scans.price_history(raw, "wheat", "x", 3651)


def test_upsert_last_wins(spark):
    schema = "id int, crop string, state string, fetch_date date, raw_data string"
    old = spark.createDataFrame([(9, "w", "p", D(2024, 1, 1), "old"), (2, "w", "p", D(2024, 1, 2), "keep")], schema)
    new = spark.createDataFrame(
        [(3, "w", "p", D(2024, 1, 1), "m1"), (4, "w", "p", D(2024, 1, 1), "m2"), (5, "r", "p", D(2024, 1, 1), "new")], schema
    )
    got = {(r.crop, r.fetch_date.day): r.raw_data for r in sinks.upsert_prices(old, new).collect()}
    assert got == {("w", 1): "m2", ("w", 2): "keep", ("r", 1): "new"}


def test_versioned_merge_rewrites_only_touched_dates_and_is_repeatable(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "id int, k string, v int, day date"
    a = spark.createDataFrame([(1, "a", 1, D(2024, 1, 1)), (2, "b", 1, D(2024, 1, 2))], schema)
    b = spark.createDataFrame([(3, "a", 2, D(2024, 1, 1)), (4, "c", 2, D(2024, 1, 1))], schema)
    sinks.merge_partitions(a, folder, 0, ["k", "day"], "day", ["id"])
    for _ in range(2):  # a replayed batch changes nothing
        sinks.merge_partitions(b, folder, 1, ["k", "day"], "day", ["id"])
    rows = sinks.current_rows(spark.read.parquet(folder), "day").collect()
    assert {(r.k, r.v) for r in rows} == {("a", 2), ("b", 1), ("c", 2)}
    assert not (tmp_path / "t" / "day=2024-01-02" / "version=1").exists()


def test_quarantine_names_the_failed_checks(spark):
    df = spark.createDataFrame([("w", "p", "1"), ("w", "p", "x"), ("w", None, None)], "crop string, state string, v string")
    good, bad = feed.quarantine(
        df, {"bad v": numbers.parse_price(F.col("v")).isNotNull(), "no state": F.col("state").isNotNull()}
    )
    assert good.count() == 1
    assert sorted(r.error_message for r in bad.collect()) == ["bad v", "bad v; no state"]


def test_fill_looks_back_three_days_per_metric(spark):
    def row(day, rain, tmax):
        return ("d", D(2024, 1, day), rain, tmax, 1.0, 1.0, 1.0)

    schema = "district string, date date, rainfall_mm double, max_temp double, min_temp double, humidity double, wind_speed double"
    df = spark.createDataFrame(
        [row(1, 5.0, 30.0), row(3, 7.0, None), row(4, None, None), row(5, None, None), row(8, None, 40.0)], schema
    )
    out = {r.date.day: r for r in joins.forward_fill_weather(df).collect()}
    assert out[4].rainfall_mm == 7.0 and out[4].max_temp == 30.0  # nearest per metric; d-3 reached
    assert out[5].max_temp is None  # d-4 and d+3 are out of reach
    assert out[5].rainfall_mm == 7.0 and out[8].rainfall_mm is None


def test_keep_max_id(spark):
    df = spark.createDataFrame([(1, "a"), (3, "a"), (2, "b")], "id int, k string")
    assert {r.id for r in joins.keep_max_id(df, ["k"]).collect()} == {2, 3}


def test_log_takes_each_run_once(spark, tmp_path):
    from furrow.sources import sinks

    path = str(tmp_path / "log")
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id int, run_note string")
    schema = rows().schema
    assert sinks.read_log(spark, path, schema).count() == 0
    sinks.append_log(rows(1, 2), path, "monday")
    sinks.append_log(rows(3), path, "tuesday")
    sinks.append_log(rows(1, 2), path, "monday")  # repeated
    rows(9).write.parquet(f"{path}/_staged/wednesday")  # killed before it was published
    ids = lambda: sorted(r.id for r in sinks.read_log(spark, path, schema).collect())
    assert ids() == [1, 2, 3] and sinks.read_log(spark, path, schema).columns == ["id", "run_note"]
    sinks.append_log(rows(4), path, "wednesday")
    assert ids() == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        sinks.append_log(rows(5), path, "../elsewhere")


def test_documents_are_written_one_a_file_by_the_tasks(spark, tmp_path):
    texts = ["b", "a", "a", None, "é\nü"] + [f"t{i}" for i in range(95)]
    folder = str(tmp_path / "docs")
    sinks.write_documents(spark.createDataFrame([(t,) for t in texts], "value string"), folder)
    names = sorted(p.name for p in (tmp_path / "docs").iterdir())
    assert len(names) == 100 and len({n[:11] for n in names}) > 1  # several tasks, nothing beside the documents
    assert sorted((tmp_path / "docs" / n).read_bytes() for n in names) == sorted(((t or "") + "\n").encode() for t in texts)
    empty = str(tmp_path / "empty")
    sinks.write_documents(spark.createDataFrame([], "value string"), empty)
    assert scans.scan_trials(spark, empty).count() == 0


def test_many_small_trial_files_are_read_by_few_tasks(spark, tmp_path):
    doc = '{"trial_id":"%d","hyperparameters":{"values":{"lstm_units":64,"batch_size":16}},\n"score":0.5,"status":"COMPLETED"}'
    for i in range(700):
        (tmp_path / f"{i}.txt").write_text(doc % i)
    trials = scans.scan_trials(spark, str(tmp_path))
    assert trials.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(int(r.trial_id) for r in trials.where("score = 0.5 and lstm_units = 64").collect()) == list(range(700))


TRIAL = '{"trial_id":"%s","hyperparameters":{"values":{"lstm_units":64,"dropout":0.1}},\n"score":0.5,"status":"é"}'


def trial_ids(trials):
    return sorted(r.trial_id for r in trials.collect())


def test_the_driver_holds_no_entry_a_trial_file(spark, tmp_path):
    folder = str(tmp_path / "docs")
    ids = sorted(str(i) for i in range(100))
    sinks.write_documents(spark.createDataFrame([(TRIAL % i,) for i in ids], "value string"), folder, per_folder=10)
    folders = list((tmp_path / "docs").iterdir())
    assert len(folders) >= 10 and all(1 <= len(list(f.iterdir())) <= 10 for f in folders)
    for path in (folder, f"file://{folder}", f"{folder}/part=*", f"{folder}/*/*.txt"):
        trials = scans.scan_trials(spark, path)
        assert trials.inputFiles() == [] and trial_ids(trials) == ids


def test_trial_files_are_read_as_by_the_json_reader_of_spark(spark, tmp_path, monkeypatch):
    import bz2
    import gzip
    import zlib

    from pyspark.errors import AnalysisException

    plain = {f"{e}.json": (TRIAL % e).encode(e) for e in ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-32-be")}
    files = plain | {
        "empty": b"", "end": b"\n", "broken": b"{x", "null": b"null", "cut": (TRIAL % "cut").encode()[:60],
        "two": (TRIAL % "first" + TRIAL % "second").encode(), "list": f"[{TRIAL % 'a'},{TRIAL % 'b'}]".encode(),
        "field": b'{"trial_id":"field","score":"abc","hyperparameters":{"values":{"lstm_units":"q","dropout":0.2}}}',
        "bytes": b'{"trial_id":"x\xff","score":1}', "tail": (TRIAL % "tail").encode() + b"\xff", "nul": b'{"trial_id":"\0"}',
        "a.gz": gzip.compress((TRIAL % "gz").encode()), "B.GZ": gzip.compress((TRIAL % "GZ").encode()),
        "a.bz2": bz2.compress((TRIAL % "bz2").encode()), "a.deflate": zlib.compress((TRIAL % "deflate").encode()),
        "_hidden": (TRIAL % "no").encode(), ".dot": (TRIAL % "no").encode(), "x._COPYING_": (TRIAL % "no").encode(),
        "_k=v": (TRIAL % "kv").encode(), "sp ace%20": (TRIAL % "space").encode(), "sub/a": (TRIAL % "below").encode(),
    }
    keyed = {x: (TRIAL % x).encode() for x in ("k=1/a", "k=2/sub/b", "k=2/_no/c")}
    for base, contents in (("some files", files), ("keyed", keyed), ("under", {"sub/k=3/d": (TRIAL % "k3").encode()})):
        for name, raw in contents.items():
            (tmp_path / base / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / base / name).write_bytes(raw)

    def both(path):
        as_spark = spark.read.schema(schemas.TRIAL).option("multiLine", True).json(path)
        as_spark = as_spark.select("trial_id", "hyperparameters.values.*", "score", "status")
        trials = scans.scan_trials(spark, path)
        assert trials.schema == as_spark.schema
        assert sorted(map(repr, trials.collect())) == sorted(map(repr, as_spark.collect()))
        return trials

    paths = [f"{tmp_path}/{x}" for x in ("some files", "some files/*", "some files/utf-8.json", "some files/_hidden", "keyed", "under")]
    assert [both(p).inputFiles() for p in paths] == [[]] * len(paths)
    assert trial_ids(scans.scan_trials(spark, paths[4])) == ["k=1/a", "k=2/sub/b"]
    with pytest.raises(AnalysisException):
        scans.scan_trials(spark, f"{tmp_path}/none")

    def closed(uri):
        raise ValueError(uri)

    monkeypatch.setattr(sinks, "open_store", closed)  # a store that only Spark reaches
    assert len(both(paths[0]).inputFiles()) > 0
