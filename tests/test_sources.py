"""Files, feeds, streams and the end-to-end flows, on inputs the tests write themselves."""

import datetime as dt
import json

import pytest
from conftest import values
from pyspark.sql import functions as F

from aerolake import schema
from aerolake.lookups import CITY_ALIASES
from aerolake.operators import cities, models, standardize
from aerolake.operators.standardize import union_by_name
from aerolake.plans import ingestion, training
from aerolake.plans.service import AirQuality
from aerolake.session import shared_dir
from aerolake.sources import csv_tree, feeds, sinks
from aerolake.streaming import live


@pytest.fixture()
def tree(tmp_path):
    files = {
        "a/city_day.csv": "City,Date,PM2.5,AQI,AQI_Bucket\nDelhi,2020-01-01,80,300,Poor\nNCT,2020-01-01,NA,100,\nParis,2020-01-01,5,20,Good\n",
        "a/deep dir/station_hour.csv": "StationId,Datetime,PM2.5,AQI\nDL01,2020-01-02 01:00:00,10,50\nDL01,2020-01-02 02:00:00,30,150\nXX9,2020-01-02 02:00:00,1,1\n",
        "b/STATION_DAY_2.csv": '﻿station,date,pm25,aqi\n"DL01",2020-01-03,7,70\nDL01,bad,8,80\n',
        "b/stations.csv": "StationId,name,City,State,type\nDL01,Anand Vihar,New Delhi,Delhi,traffic\nDL01,Copy,Delhi,Delhi,x\n",
        "b/notes.csv": "x,y\n1,2\n",
        "b/only_header_city_day.csv": "City,Date\n",
        "b/empty.csv": "",
        "b/skip.txt": "City\nDelhi\n",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    (tmp_path / "b" / "city_day_latin.csv").write_bytes("City,Date,AQI\nMálaga,2020-01-01,9\nMumbai,2020-01-05,160\n".encode("latin-1"))
    return str(tmp_path)


def test_manifest(spark, tree):
    got = {r.file_name: (r.encoding, r.lines) for r in csv_tree.csv_manifest(spark, tree).collect()}
    assert "empty.csv" not in got and "skip.txt" not in got
    assert got["city_day_latin.csv"] == ("ISO-8859-1", 3)
    assert got["city_day.csv"] == ("UTF-8", 4)


def test_scan_reads_headers_and_encodings(spark, tree):
    frames = csv_tree.scan_csv_tree(spark, tree, "set")
    assert sorted(frames) == ["city_daily", "station_daily", "station_hourly", "station_metadata", "unknown"]
    assert len(frames["city_daily"]) == 2
    city = union_by_name(frames["city_daily"])
    assert [r.City for r in city.filter("AQI = '9'").collect()] == ["Málaga"]
    assert city.filter("City = 'NCT' AND `PM2.5` IS NULL").count() == 1
    assert frames["station_daily"][0].filter("station = 'DL01'").count() == 2
    assert {r.source_file for r in city.select("source_file").collect()} == {"city_day.csv", "city_day_latin.csv"}


def test_duplicate_headers_get_numbers():
    assert csv_tree._names("Date,date,x,,Date") == ["Date", "date#1", "x", "unnamed_3", "Date#2"]


def test_ingest(spark, tree):
    readings, dim = ingestion.ingest(spark, {"set": tree})
    got = {(r.city, r.station, r.date): r for r in readings.collect()}
    day = dt.date(2020, 1, 1)
    assert set(got) == {
        ("delhi", "Delhi_Central", day), ("delhi", "NCT_Central", day), ("delhi", "DL01", dt.date(2020, 1, 2)),
        ("delhi", "DL01", dt.date(2020, 1, 3)), ("mumbai", "Mumbai_Central", dt.date(2020, 1, 5)),
    }
    hour = got[("delhi", "DL01", dt.date(2020, 1, 2))]
    assert (hour.pm25, hour.aqi, hour.source_dataset, hour.city_original) == (20.0, 100.0, "set", "delhi")
    assert got[("delhi", "NCT_Central", day)].pm25 is None
    assert values(dim, "station_id", "station_name", "city", "station_type") == [("DL01", "Anand Vihar", "delhi", "traffic")]
    table = ingestion.preprocess(readings)
    assert "so2" not in table.columns and "aqi_category" in table.columns
    assert table.filter("city IS NULL OR aqi_bucket IS NULL").count() == 0
    published = schema.to_published_names(readings)
    assert {"PM2.5", "AQI", "City"} <= set(published.columns)
    path = shared_dir(spark, "readings")
    sinks.write_readings(readings, path)
    assert values(sinks.read_readings(spark, path), "city", "station", "date", "aqi") == values(readings, "city", "station", "date", "aqi")


def test_stations_without_station_file(spark):
    rows = spark.createDataFrame([("S1", "Delhi", "f"), ("S1", "Delhi", "f"), ("S2", "Pune", "f")], "station_id string, city string, source_file string")
    dim = ingestion.station_table({"station_daily": [rows]}, cities.alias_table(spark))
    assert values(dim, "station_id", "station_name", "city") == [("S1", "S1", "delhi"), ("S2", "S2", "pune")]


# ---- feeds ----


def test_feed_payloads(spark):
    payloads = [
        ("delhi", json.dumps({"status": "ok", "data": {"aqi": 180, "city": {"name": "ITO"}, "iaqi": {"pm25": {"v": 90.5}, "t": {"v": 20}}}})),
        ("pune", json.dumps({"status": "ok", "data": {"iaqi": {}}})),
        ("agra", json.dumps({"status": "error", "data": "over quota"})),
        ("bad", "not json"),
    ]
    out = feeds.parse_feed_iaqi(spark.createDataFrame(payloads, "city string, payload string"))
    assert values(out, "city", "station", "aqi", "pm25", "temperature", "o3") == [("delhi", "ITO", 180.0, 90.5, 20.0, 0.0), ("pune", "pune", 0.0, 0.0, 0.0, 0.0)]
    lists = [
        ("delhi", json.dumps({"list": [{"main": {"aqi": 4}, "components": {"pm2_5": 12.5}}, {"main": {"aqi": 1}}]})),
        ("pune", json.dumps({"list": []})), ("agra", "{}"),
    ]
    out = feeds.parse_feed_components(spark.createDataFrame(lists, "city string, payload string"))
    assert values(out, "city", "aqi", "pm25", "co") == [("delhi", 200.0, 12.5, 0.0)]


def test_source_priority(spark):
    rows = [("a", "second", 9, 1.0), ("a", "first", 1, 2.0), ("a", "first", 2, 3.0), ("b", "second", 1, 4.0), ("c", "other", 1, 5.0)]
    df = spark.createDataFrame(rows, "city string, source string, ts int, aqi double")
    assert values(feeds.feed_source_priority(df, ["first", "second"]), "city", "aqi") == [("a", 3.0), ("b", 4.0)]


def test_json_records(spark):
    df = spark.createDataFrame([(1, float("nan"), dt.date(2024, 1, 2), None)], "a int, b double, c date, d string")
    assert json.loads(sinks.to_json_records(df).collect()[0].json) == {"a": 1, "b": None, "c": "2024-01-02", "d": None}


# ---- streams ----


def test_stream_drops_late_rows_and_keeps_open_days(spark, tmp_path):
    def batch(name, rows):
        spark.createDataFrame(rows, "city string, ts timestamp, value double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    t = dt.datetime
    batch("one", [("a", t(2024, 1, 1, 1), 10.0), ("a", t(2024, 1, 1, 2), 20.0), ("a", t(2024, 1, 3, 0), 5.0)])
    source = live.read_stream(spark, str(tmp_path / "in"), "city string, ts timestamp, value double", "json", maxFilesPerTrigger="1")
    out = live.run_available(live.stream_daily(source, ["city"]), "late")
    assert values(out) == [("a", dt.date(2024, 1, 1), 15.0, 2)]


def test_stream_of_whole_folder(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(50)
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = live.read_stream(spark, str(tmp_path / "events.parquet"), events.schema)
    assert stream.isStreaming
    assert live.run_available(stream.select("event_id"), "folder").count() == 50


# ---- training and questions ----


@pytest.fixture()
def history(spark):
    rows = []
    for i in range(120):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i)
        for city, station, base in (("delhi", "D1", 200.0), ("delhi", "D2", 240.0), ("pune", "P1", 90.0)):
            rows.append((city, station, station, f"{station} name", day, base + i % 7, base / 2 + i % 7))
    return spark.createDataFrame(rows, "city string, station string, station_id string, station_name string, date date, aqi double, pm25 double")


def test_train_store_and_load(spark, history):
    small = {k: e for k, e in models.regressors(trees=5, rounds=3, random_forest=4).items() if k in ("linear_regression", "random_forest")}
    result = training.train(history, ["station", "date"], small)
    assert not result.failures and set(result.models) == set(small)
    assert "city_encoded" in result.features and "so2" not in result.features
    path = shared_dir(spark, "trained")
    training.store(result, path)
    again = sinks.load_model(f"{path}/random_forest")
    rows = training.training_table(history)
    assert values(models.score(rows, again), "station", "date", "predicted_aqi") == values(models.score(rows, result.models["random_forest"]), "station", "date", "predicted_aqi")
    unseen = models.score(rows.withColumn("city", F.lit("nowhere")), again)
    assert unseen.filter("predicted_aqi IS NULL").count() == 0
    assert spark.read.json(f"{path}/training_info").collect()[0].models == sorted(small)
    stored = spark.read.parquet(f"{path}/performance")
    assert stored.filter("metric = 'RMSE'").count() == 2
    importance = models.feature_importance(again, result.features, spark)
    assert importance.agg(F.sum("importance")).collect()[0][0] == pytest.approx(1.0)


def test_questions(spark, history):
    aliases = cities.alias_table(spark)
    live_rows = spark.createDataFrame([("delhi", 1, 250.0), ("delhi", 2, 210.0), ("pune", 1, 80.0), ("goa", 1, 10.0)], "city string, ts int, aqi double")
    dim = spark.createDataFrame([("delhi", "D1", "D1 name"), ("delhi", "D2", "D2 name"), ("pune", "P1", "P1 name")], "city string, station_id string, station_name string")
    q = AirQuality(history, live_rows, dim, aliases)
    assert q.city_list().count() == len(set(CITY_ALIASES.values()))
    assert values(q.current_aqi("2024-05-01"), "city", "current_aqi", "current_category") == [("delhi", 210.0, "Poor"), ("pune", 80.0, "Satisfactory")]
    assert [r.city for r in q.city_comparison("2024-05-01").collect()] == ["delhi", "pune"]
    assert values(q.realtime("2024-05-01"), "city", "trend_confidence")[0][0] == "delhi"
    asked = spark.createDataFrame([("New Delhi", dt.date(2024, 5, 1), "auto")], "city string, date date, model_type string")
    answer = q.predict(asked, "2024-05-01").collect()[0]
    assert (answer.city, answer.city_requested, answer.model_used) == ("delhi", "New Delhi", "simple")
    assert (answer.realtime_aqi, answer.realtime_category) == (210.0, "Poor")
    assert answer.difference == pytest.approx(answer.predicted_aqi - 210.0)
    later = q.predict(asked, "2024-04-30").collect()[0]
    assert later.realtime_aqi is None and later.accuracy is None
    future = q.future(["Delhi"], "2024-05-01", 3)
    assert future.count() == 9 and future.filter("station_id = 'CITY_AVG'").count() == 3
    assert q.station_summary(["Delhi"], "2024-05-01").collect()[0].worst_station.station_id == "D2"
    assert q.city_stations(["Poona"]).count() == 1
    assert q.model_performance().count() == 18
    assert q.available_models().filter("is_default").collect()[0].model == "random_forest"
    assert tuple(q.status().collect()[0]) == (360, 2, 3)
    assert q.city_profile().count() == 2
    with pytest.raises(Exception, match="city not supported"):
        q.future(["Atlantis"], "2024-05-01").collect()


def test_current_table_runs_continuously(spark, tmp_path):
    source, out = str(tmp_path / "in"), shared_dir(spark, "current")
    rows = "event_id bigint, ts timestamp, city string, value double"

    def send(*values_):
        stamped = [(i, dt.datetime(2024, 1, 1, hour), city, v) for i, hour, city, v in values_]
        spark.createDataFrame(stamped, rows).coalesce(1).write.mode("append").parquet(source)

    send((1, 1, "a", 1.0), (2, 2, "b", 2.0))
    latest = live.stream_latest_city(live.read_stream(spark, source, rows))
    running = live.start_live(latest, out, shared_dir(spark, "current-state"), "1 second", "update", keys=["city"])
    try:
        running.processAllAvailable()
        for n in range(4):
            send((10 + n, 3 + n, "a", 10.0 + n), (20 + n, 1, "b", 0.0), (30 + n, 1, f"c{n}", 5.0))
            running.processAllAvailable()
    finally:
        running.stop()
    got = {r.city: r.value for r in live.current_table(spark, out, latest.schema).collect()}
    assert got == {"a": 13.0, "b": 2.0, "c0": 5.0, "c1": 5.0, "c2": 5.0, "c3": 5.0}
    assert len(live._folders(spark, out)) <= 3
    with pytest.raises(ValueError, match="keys"):
        live.start_live(latest, out, out, mode="update")


def test_duplicate_aliases_do_not_multiply_events(spark):
    aliases = spark.createDataFrame([("delhi", "Delhi"), ("Delhi ", "Delhi"), ("delhi", "A"), (None, "x")], "alias string, canonical string")
    payload = '{"status":"ok","data":{"aqi":7,"iaqi":{}}}'
    events = spark.createDataFrame([(1, "DELHI", payload)], "event_id int, city string, payload string")
    assert live.stream_ingest(events, aliases).count() == 1
    assert cities.normalize_city(events, aliases).select("city").collect() == live.stream_ingest(events, aliases).select("city").collect()


def test_headers_that_differ_in_case_are_one_column(spark, tmp_path):
    (tmp_path / "city_day.csv").write_text("City,PM2.5,pm2.5\nDelhi,,7\nDelhi,3,4\n")
    frame = csv_tree.scan_csv_tree(spark, str(tmp_path), "set")["city_daily"][0]
    assert [r.pm25 for r in standardize.standardize_readings(frame).orderBy("pm25").collect()] == ["3", "7"]


def test_continuous_query(spark, sf_dir):
    schema_ = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = live.read_stream(spark, f"{sf_dir}/events.parquet", schema_).select("event_id")
    out = shared_dir(spark, "live")
    running = live.start_live(stream, out, shared_dir(spark, "live-state"), interval="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert spark.read.parquet(out).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
