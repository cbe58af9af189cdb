"""Life-time state, bucketed current tables, mergeable daily states, published forecasts, repeated ingestion and quoted line breaks."""

import datetime as dt
import os

import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from aerolake.operators import daily, daily_state
from aerolake.plans import incremental, ingestion
from aerolake.session import shared_dir
from aerolake.sources import csv_tree
from aerolake.streaming import current, live

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def send(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_first_answer_holds_for_its_life_time(spark):
    schema, path = "event_id bigint, ts timestamp, city string, value double", shared_dir(spark, "answers-in")
    send(spark, path, [(1, at(1), "a", 1.0), (2, at(4), "a", 2.0), (3, at(5.9), "a", 3.0), (4, at(6), "a", 4.0), (6, at(6), "a", 6.0), (5, at(2), "b", 5.0)], schema)
    out, state = shared_dir(spark, "answers-out"), shared_dir(spark, "answers-state")
    stream = live.stream_first_answer(live.read_stream(spark, path, schema), ["city"], delay="10 minutes")
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
    try:
        running.processAllAvailable()
        # State goes on over micro-batches: within five minutes of the answer at minute 6, and beyond.
        send(spark, path, [(10, at(8), "a", 8.0), (11, at(10.9), "a", 9.0)], schema)
        running.processAllAvailable()
        send(spark, path, [(12, at(11), "a", 10.0), (13, at(200), "b", 11.0)], schema)
        running.processAllAvailable()
        send(spark, path, [(14, at(201), "a", 12.0), (15, at(203), "b", 13.0)], schema)  # the timers have passed
        running.processAllAvailable()
    finally:
        running.stop()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 4, 5, 12, 13, 14]


@pytest.mark.parametrize("run_rows", [1, 7, 20_000])
def test_first_answer_holds_few_rows_at_once(spark, run_rows):
    """Rows of one key in any order, most of them set down in sorted runs and runs of runs, answer as if they were sorted at once."""
    schema, path = "event_id bigint, ts timestamp, city string, value double", shared_dir(spark, "many-in")
    minutes = [(i * 7919) % 1000 / 7 for i in range(1000)]
    rows = [(i, None if i == 500 else at(m), "a", float(i)) for i, m in enumerate(minutes)] + [(2000 + i, at(m), "a", 0.0) for i, m in enumerate(minutes[:50])]
    send(spark, path, rows, schema)
    found = live.run_available(live.stream_first_answer(live.read_stream(spark, path, schema), ["city"], run_rows=run_rows), "many")
    want, until = [], None
    for number, when, *_ in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        if until is None or when >= until:
            want.append(number)
            until = when + dt.timedelta(minutes=5)
    assert sorted(r.event_id for r in found.collect()) == sorted(want) and len(want) > 20


def test_a_batch_rewrites_only_its_buckets(spark):
    out, schema = shared_dir(spark, "buckets"), "k int, v string"

    def batch(*rows):
        return spark.createDataFrame(rows, schema)

    current.upsert(batch(*[(i, "old") for i in range(200)]), 0, out, ["k"], 16)
    before = current._entry(spark, current.versions(spark, out)[0])
    assert len(before) == 16
    current.upsert(batch((5, "new"), (1000, "more")), 1, out, ["k"], 16)
    after = current._entry(spark, current.versions(spark, out)[1])
    moved = [b for b in before if before[b] != after[b]]
    assert 1 <= len(moved) <= 2 and all(after[b].startswith("data/batch=1/") for b in moved)
    want = {i: "old" for i in range(200)} | {5: "new", 1000: "more"}
    assert dict(map(tuple, current.read(spark, out, schema).collect())) == want
    # A batch that runs again builds on the entry before it.
    current.upsert(batch((5, "again"), (1000, "more")), 1, out, ["k"], 16)
    assert dict(map(tuple, current.read(spark, out, schema).collect())) == want | {5: "again"}
    for n in range(2, 6):
        current.upsert(batch(*[(i, f"n{n}") for i in range(200)]), n, out, ["k"], 16)
    assert set(current.versions(spark, out)) == {4, 5}
    data = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/data")
    folders = [f.getPath().getName() for f in data.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(data)]
    assert sorted(folders) == ["batch=1", "batch=4", "batch=5"] or sorted(folders) == ["batch=4", "batch=5"]
    assert current.read(spark, shared_dir(spark, "none"), schema).count() == 0


def test_unfinished_entries_do_not_count(spark):
    out, schema = shared_dir(spark, "torn"), "k int, v string"
    current.upsert(spark.createDataFrame([(1, "a")], schema), 0, out, ["k"])
    spark.createDataFrame([("3", "data/none")], "bucket string, folder string").write.json(f"{out}/version=1")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/version=1/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    assert current.read(spark, out, schema).collect() == [("1", "a")] or current.read(spark, out, schema).collect()[0].v == "a"


def test_late_rows_join_their_day(spark):
    schema = "city string, date date, station_id string, aqi double, ts int"
    day = [dt.date(2024, 1, 30), dt.date(2024, 2, 1)]
    parts = [
        [("a", day[0], "S2", 10.0, 5), ("a", day[1], None, 40.0, 6), (None, day[0], "x", 1.0, 1)],
        [("a", day[0], "S1", 30.0, 2), ("b", day[1], "S9", None, 3)],
        [("a", day[0], None, float("nan"), 1), ("a", day[1], "S4", 20.0, 9)],
    ]
    keys, names, order = ["city", "date"], ["station_id"], ["ts"]
    out = shared_dir(spark, "states")
    frames = [spark.createDataFrame(p, schema) for p in parts]
    for number, frame in enumerate(frames):
        daily_state.add_readings(frame, number, out, keys, ["aqi"], names, order)
    daily_state.add_readings(frames[2], 2, out, keys, ["aqi"], names, order)  # the same batch once more
    got = values(daily_state.stored(spark, out, frames[0], keys, ["aqi"], names, order), "city", "date", "aqi", "station_id", "n")
    every = frames[0].unionByName(frames[1]).unionByName(frames[2]).withColumn("aqi", F.nanvl("aqi", F.lit(None)))
    assert [g[:4] for g in got] == values(daily.daily_aggregate(every, keys, ["aqi"], names, order), "city", "date", "aqi", "station_id")
    assert [g[4] for g in got] == [3, 2, 1]
    january = current._entry(spark, current.versions(spark, out)[2])["2024-01"]
    daily_state.add_readings(spark.createDataFrame([("a", day[1], "S0", 0.0, 0)], schema), 3, out, keys, ["aqi"], names, order)
    assert current._entry(spark, current.versions(spark, out)[3])["2024-01"] == january  # only the month of the row was written


def test_published_forecasts_meet_readings_or_leave_them_empty(spark):
    reading, said = "event_id bigint, ts timestamp, city string, value double", "city string, date date, predicted_aqi double, published timestamp"
    one, two = shared_dir(spark, "readings-in"), shared_dir(spark, "forecasts-in")
    send(spark, one, [(1, at(60), "a", 100.0), (2, at(60), "b", 50.0)], reading)
    send(spark, two, [("a", DAY.date(), 80.0, at(-300))], said)
    out, state = shared_dir(spark, "published-out"), shared_dir(spark, "published-state")
    joined = live.stream_compare_published(live.read_stream(spark, one, reading), live.read_stream(spark, two, said))
    running = joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
    try:
        running.processAllAvailable()
        send(spark, two, [("b", DAY.date(), 60.0, at(90))], said)  # published while the stream runs
        running.processAllAvailable()
        send(spark, one, [(3, at(100), "c", 7.0)], reading)
        running.processAllAvailable()
        for day in (4, 5, 6):
            send(spark, one, [(100 + day, at(1440 * day), "z", 1.0)], reading)
            send(spark, two, [("z", (DAY + dt.timedelta(days=day + 9)).date(), 1.0, at(1440 * day))], said)
            running.processAllAvailable()
    finally:
        running.stop()
    got = {r.event_id: (r.predicted_today, r.trend) for r in spark.read.parquet(out).filter("event_id < 100").collect()}
    assert got == {1: (80.0, "improving"), 2: (60.0, "worsening"), 3: (None, None)}


# ---- repeated ingestion ----


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_a_second_run_reads_new_files_only(spark, tmp_path, monkeypatch):
    tree, store = tmp_path / "tree", str(tmp_path / "store")
    write(tree / "city_day_1.csv", "City,Date,PM2.5,AQI\nDelhi,2020-01-01,10,100\nDelhi,2020-01-01,30,200\nMumbai,2020-02-01,5,50\n")
    opened = []
    manifest = csv_tree.csv_manifest
    monkeypatch.setattr(csv_tree, "csv_manifest", lambda s, p: (opened.extend(p if isinstance(p, list) else [p]), manifest(s, p))[1])

    def run():
        opened.clear()
        readings, counts = incremental.initialize(spark, {"set": str(tree)}, store)
        return values(readings, "city", "date", "pm25", "aqi"), counts, sorted({os.path.basename(p) for p in opened})

    def full():
        return values(ingestion.ingest(spark, {"set": str(tree)})[0], "city", "date", "pm25", "aqi")

    got, counts, _ = run()
    assert got == full() and counts == {"read": 1, "kept": 0, "rebuilt": 0} and len(got) == 2
    again, counts, names = run()
    assert again == got and counts == {"read": 0, "kept": 1, "rebuilt": 0} and names == []
    write(tree / "deep" / "city_day_2.csv", "City,Date,PM2.5,AQI\nDelhi,2020-01-01,50,300\nPune,2021-05-05,1,10\n")
    got, counts, names = run()
    assert got == full() and counts == {"read": 1, "kept": 1, "rebuilt": 0} and names == ["city_day_2.csv"] and len(got) == 3
    os.utime(tree / "city_day_1.csv", (1, 1))  # another time, the same content
    assert run()[1] == {"read": 0, "kept": 2, "rebuilt": 0}
    write(tree / "city_day_1.csv", "City,Date,PM2.5,AQI\nDelhi,2020-01-01,20,100\n")
    got, counts, _ = run()
    assert got == full() and counts == {"read": 2, "kept": 0, "rebuilt": 1}
    (tree / "deep" / "city_day_2.csv").write_text("City,Date,PM2.5,AQI\nPune,2021-05-05,1,10\n")
    assert run()[0] == full() == [("delhi", dt.date(2020, 1, 1), 20.0, 100.0), ("pune", dt.date(2021, 5, 5), 1.0, 10.0)]


QUOTED = 'City,Note,AQI\nDelhi,"first line\nsecond ""quoted"", line\n\nlast",100\nPune,plain,7\n"Agra","one\ntwo",\n'


def test_values_with_line_breaks_are_read_as_pandas_does(spark, tmp_path):
    write(tmp_path / "t" / "city_day.csv", QUOTED)
    write(tmp_path / "t" / "city_day_plain.csv", 'City,Note,AQI\nDelhi,"x ""y"", z",1\n')
    write(tmp_path / "t" / "city_day_stray.csv", 'City,Note,AQI\nGoa,5" pipe,2\n')
    frames = csv_tree.scan_csv_tree(spark, str(tmp_path / "t"), "set")["city_daily"]
    got = [(r.City, r.Note, r.AQI) for f in frames for r in f.collect()]
    theirs = pd.read_csv(tmp_path / "t" / "city_day.csv", dtype=str)
    want = [tuple(None if pd.isna(x) else x for x in r) for r in theirs.itertuples(index=False)]
    assert sorted(got, key=repr) == sorted([*want, ("Delhi", 'x "y", z', "1"), ("Goa", '5" pipe', "2")], key=repr)


@pytest.mark.parametrize("size", [7, 40, 200])
def test_records_cross_splits(spark, tmp_path, size):
    rows = "".join(f'c{i},"a{i}\n""b""\n{"x" * (i % 9)}",{i}\n' if i % 3 else f"c{i},plain{i},{i}\n" for i in range(60))
    write(tmp_path / "many.csv", "City,Note,AQI\n" + rows)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, str(size))
        shape = spark.createDataFrame([], "City string, Note string, AQI string").schema
        got = sorted(map(tuple, csv_tree.read_records(spark, [str(tmp_path / "many.csv")], "UTF-8", shape).collect()))
    finally:
        for n, b in zip(names, before, strict=True):
            spark.conf.set(n, b)
    theirs = pd.read_csv(tmp_path / "many.csv", dtype=str)
    assert got == sorted((*r, "many.csv") for r in theirs.itertuples(index=False))
