"""Properties of the operators on small in-memory frames."""

import datetime as dt
import random

import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from aerolake import lookups, schema
from aerolake.operators import cities, compare, daily, evaluate, features, forecast, models, prepare, quality, sets, standardize, stations, windows
from aerolake.plans import joins, training
from aerolake.plans.quantiles import exact_quantiles

DAY = dt.date(2024, 1, 1)


def series(spark, **lengths):
    """One row per city and day with value = day number."""
    rows = [(c, DAY + dt.timedelta(days=i), float(i)) for c, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "city string, date date, aqi double")


# ---- quantiles ----


@pytest.mark.parametrize("shape", ["uniform", "hot", "two", "constant"])
@pytest.mark.parametrize("limits", [(100_000, 1000), (50, 100), (5, 40)])
def test_exact_quantiles(spark, shape, limits):
    rng = random.Random(7)
    xs = {
        "uniform": [rng.random() * 1000 for _ in range(5000)],
        "hot": [3.0] * 2500 + [rng.random() * 10 for _ in range(2500)],
        "two": [1.0] * 2000 + [2.0] * 2000,
        "constant": [4.0] * 3000,
    }[shape]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df.repartition(5), ["x"], ps, *limits)["x"]
    assert got == pytest.approx(list(np.quantile(xs, ps)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    assert exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [None], "y": [1.5]}


# ---- joins ----


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_equals_broadcast(spark, how, null_safe):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else ("hot" if i % 3 == 0 else f"k{i % 50}")) for i in range(600)], "i int, k string")
    dim = spark.createDataFrame([(None, 0.5), ("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(40)], "k string, v double")
    small = joins.join_dimension(rows, dim, ["k"], how, null_safe)
    large = joins.join_dimension(rows, dim, ["k"], how, null_safe, max_rows=10, salts=8)
    assert values(small) == values(large)
    assert small.columns == large.columns


def test_hot_key_and_copies_are_split(spark, monkeypatch):
    """Identical rows of one key end up in several partitions of the salted join."""
    rows = spark.range(4000).select(F.lit("hot").alias("k")).repartition(16)
    dim = spark.createDataFrame([("hot", 1.0), ("cold", 2.0)], "k string, v double")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        out = joins.join_dimension(rows, dim, ["k"], max_rows=1, salts=32)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert sum(sizes) == 4000 and len(sizes) >= 4 and max(sizes) < 2500


def test_is_small(spark):
    df = spark.range(100)
    assert joins.is_small(df, 100) and not joins.is_small(df, 99)


# ---- cities and stations ----


def test_normalize_city(spark):
    a = cities.alias_table(spark)
    df = spark.createDataFrame([("Delhi",), (" NCT ",), ("Bombay",), ("Atlantis",), (None,)], "city string")
    once = cities.normalize_city(df, a)
    assert [r.city for r in once.collect()] == ["delhi", "delhi", "mumbai", None, None]
    twice = cities.normalize_city(once, a)
    assert values(twice) == values(once)
    assert [r.city for r in cities.normalize_city(df, a, policy="lower").collect()] == ["delhi", "delhi", "mumbai", "atlantis", None]
    assert [r.city for r in cities.normalize_city(df, a, policy="keep").collect()] == ["delhi", "delhi", "mumbai", "Atlantis", None]
    with pytest.raises(Exception, match="city not supported"):
        cities.normalize_city(df, a, policy="error").collect()
    assert [r.city_original for r in cities.unmapped_cities(df, a).collect()] == ["Atlantis"]


def test_display_names(spark):
    shown = cities.alias_table(spark, lookups.DISPLAY_CITY_NAMES)
    df = spark.createDataFrame([("NEW DELHI",), ("bengaluru",), ("Goa",)], "city string")
    assert [r.city for r in cities.normalize_city(df, shown, policy="keep", keep_original=False).collect()] == ["Delhi", "Bangalore", "Goa"]


def test_unseen_city_code(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "city string")
    codes = cities.city_codes(df)
    assert values(codes) == [("Unknown", 0), ("a", 1), ("b", 2)]
    asked = spark.createDataFrame([("b",), ("zz",)], "city string")
    assert values(cities.encode_city(asked, codes)) == [("b", 2), ("zz", 0)]


def test_enrich_null_keys(spark):
    r = spark.createDataFrame([("1", None), (None, None), ("9", "own")], "station_id string, city string")
    s = spark.createDataFrame([("1", "x", 0), ("1", "later", 1), (None, "n", 0)], "station_id string, city string, pos int")
    assert values(stations.enrich_station_metadata(r, s, ["pos"])) == [("1", "x"), ("9", "own"), (None, None)]
    assert values(stations.enrich_station_metadata(r, s, ["pos"], null_safe=True)) == [("1", "x"), ("9", "own"), (None, "n")]


def test_valid_stations_drops_unnamed(spark):
    s = spark.createDataFrame([("1", None, "c"), ("2", " NaN ", "c"), (None, "n", "c"), (None, None, "c")], "station_id string, station_name string, city string")
    assert values(stations.valid_stations(s), "station_id", "station_name", "state", "status") == [("1", "1", "Unknown", "Active"), ("n", "n", "Unknown", "Active")]


# ---- daily ----


def test_daily_aggregate_first_and_null_keys(spark):
    rows = [("a", "s", DAY, 1.0, None, 1), ("a", "s", DAY, 3.0, "second", 2), ("a", "s", DAY, None, "third", 3), (None, "s", DAY, 9.0, "x", 4)]
    df = spark.createDataFrame(rows, "city string, station string, date date, aqi double, aqi_bucket string, pos int")
    for parts in (1, 4):
        out = daily.daily_aggregate(df.repartition(parts), order=["pos"])
        assert values(out) == [("a", "s", DAY, 2.0, "second")]


def test_empty_frames(spark):
    empty = spark.createDataFrame([], schema.READINGS)
    assert daily.daily_aggregate(empty, order=["source_file"]).count() == 0
    assert quality.coverage_stats(empty).collect()[0]["records"] == 0
    assert windows.sequence_windows(empty.select("city", "date", "aqi"), ["city"], ["aqi"], ["aqi"]).count() == 0
    assert quality.cap_outliers(empty).count() == 0
    assert features.all_features(empty).count() == 0


def test_date_range_reaches_the_scan(spark):
    df = series(spark, a=10)
    assert daily.date_range(df, "2024-01-02", "2024-01-04").count() == 3
    stored = spark.read.schema(df.schema).parquet(_written(spark, df))
    plan = daily.date_range(stored, "2024-01-02", "2024-01-04")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "LessThanOrEqual(date" in plan


def _written(spark, df):
    from aerolake.session import shared_dir

    path = shared_dir(spark, "test")
    df.write.parquet(path)
    return path


# ---- quality and preparation ----


def test_caps_stay_in_bounds(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.gauss(0, 1) ** 3, 5.0, None) for _ in range(500)], "pm25 double, co double, o3 double")
    b = quality.IqrBounds.fit(df)
    assert set(b.table) == {"pm25"}
    _, _, low, high = b.table["pm25"]
    assert b.transform(df).filter((F.col("pm25") < low) | (F.col("pm25") > high)).count() == 0
    assert b.outlier_count(df).collect()[0]["outliers"] > 0


def test_scaling_round_trip(spark):
    df = spark.createDataFrame([(float(i), 2.0, None if i % 3 else i * 2.0) for i in range(50)], "a double, b double, c double")
    s = prepare.Scaler.fit(df, ["a", "b", "c"])
    filled = s.impute(df)
    back = s.inverse(s.transform(filled))
    for x, y in zip(filled.collect(), back.collect()):
        assert list(x) == pytest.approx(list(y))
    assert s.stats["b"][2] == 1.0
    assert s.stats["a"][2] == pytest.approx(np.std(range(50)))


def test_split_is_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = values(prepare.random_split(df, ["k"]).filter("split = 'test'"))
    b = values(prepare.random_split(df.repartition(7), ["k"]).filter("split = 'test'"))
    assert a == b and 350 < len(a) < 650


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "a int, b double, c string")
    assert standardize.drop_empty_columns(df).columns == ["a", "c"]


def test_union_of_mixed_types(spark):
    a = spark.createDataFrame([(1, "x")], "v int, s string")
    b = spark.createDataFrame([("2",)], "v string")
    assert values(standardize.union_by_name([a, b])) == [("1", "x"), ("2", None)]


# ---- windows ----


@pytest.mark.parametrize("n, expected", [(1, 0), (47, 0), (48, 0), (49, 1), (60, 6), (100, 26)])
def test_sequence_window_count(spark, n, expected):
    out = windows.sequence_windows(series(spark, a=n), ["city"], ["aqi"], ["aqi"], stride=2)
    assert out.count() == expected


def test_sequence_window_options(spark):
    df = series(spark, a=100)
    assert windows.sequence_windows(df, ["city"], ["aqi"], ["aqi"], include_last=True).count() == 53
    strided = windows.sequence_windows(df, ["city"], ["aqi"], ["aqi"], stride=3).collect()
    assert sorted(r.start for r in strided) == list(range(0, 52, 3))
    first = next(r for r in strided if r.start == 3)
    assert [x.aqi for x in first.history] == [float(i) for i in range(3, 27)]
    assert [x.aqi for x in first.target] == [float(i) for i in range(27, 51)]
    holes = df.withColumn("aqi", F.when(F.col("aqi") != 50, F.col("aqi")))
    assert all(r.start > 50 or r.start + 47 < 50 for r in windows.sequence_windows(holes, ["city"], ["aqi"], ["aqi"]).collect())


def test_lags_by_row_and_by_day(spark):
    df = series(spark, a=10).filter("aqi != 4")
    by_row = {r.aqi: r.aqi_lag_1 for r in windows.lag_features(df, ["city"], ["aqi"], (1,)).collect()}
    by_day = {r.aqi: r.aqi_lag_1 for r in windows.lag_features(df, ["city"], ["aqi"], (1,), calendar=True).collect()}
    assert by_row[5.0] == 3.0 and by_day[5.0] is None and by_day[6.0] == 5.0 and by_row[0.0] is None


def test_recent_window_padding(spark):
    out = windows.recent_window(series(spark, a=3, b=40), ["city"], ["aqi"]).collect()
    got = {r.city: (r.rows, [x.aqi for x in r.window]) for r in out}
    assert got["a"] == (3, [0.0, 1.0] + [2.0] * 22)
    assert got["b"] == (24, [float(i) for i in range(16, 40)])


def test_fill(spark):
    rows = [("a", DAY + dt.timedelta(days=i), x, None) for i, x in enumerate([None, 5.0, None, 7.0, None])]
    df = spark.createDataFrame(rows, "city string, date date, aqi double, temperature double")
    out = windows.fill_forward_backward(df, ["city"], ["aqi", "temperature"]).orderBy("date").collect()
    assert [r.aqi for r in out] == [5.0, 5.0, 5.0, 7.0, 7.0] and {r.temperature for r in out} == {25.0}


@pytest.mark.parametrize("n, falling, expected", [(30, True, 1.0), (31, True, 0.98), (31, False, 1.0)])
def test_trend_needs_more_than_thirty_days(spark, n, falling, expected):
    df = series(spark, a=n).withColumn("aqi", F.col("aqi") * (-1 if falling else 1))
    assert windows.trend_factor(windows.city_daily_mean(df)).collect()[0].trend_factor == expected
    assert forecast.pattern_stats(windows.city_daily_mean(df)).collect()[0].trend_factor == expected


def test_chrono_split_keeps_days_together(spark):
    df = series(spark, a=10, b=10)
    out = windows.chrono_split(df)
    assert out.groupBy("date").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert out.filter("split = 'train'").count() == 16
    three = windows.chrono_split(df, (0.6, 0.2, 0.2), ("train", "validation", "test"))
    assert {r.split: r["count"] for r in three.groupBy("split").count().collect()} == {"train": 12, "validation": 4, "test": 4}


def test_partitioning_does_not_matter(spark):
    df = series(spark, a=60, b=35)
    for op in (
        lambda x: windows.lag_features(x, ["city"], ["aqi"]),
        lambda x: windows.recent_window(x, ["city"], ["aqi"]),
        lambda x: windows.chrono_split(x),
        lambda x: sets.latest_row(x, ["city"], ["date"]),
    ):
        assert values(op(df.repartition(1))) == values(op(df.repartition(6)))


# ---- comparison and evaluation ----


def test_distribution_counts_everything(spark):
    df = series(spark, a=500).withColumn("category", F.when(F.col("aqi") > 400, "Severe").otherwise("Good"))
    out = {r.category: r["count"] for r in compare.category_distribution(df).collect()}
    assert out == {"Good": 401, "Satisfactory": 0, "Moderate": 0, "Poor": 0, "Very Poor": 0, "Severe": 99}


def test_metrics_of_constant_actuals(spark):
    df = spark.createDataFrame([("m", 5.0, 6.0), ("m", 5.0, 4.0), ("n", 1.0, 1.0), ("n", 3.0, 3.0)], "model string, actual double, predicted double")
    out = {r.model: r for r in evaluate.regression_metrics(df).collect()}
    assert (out["m"].R2, out["m"].RMSE, out["m"].MAE) == (0.0, 1.0, 1.0)
    assert out["n"].R2 == 1.0


def test_merge_prefer_newer(spark):
    left = spark.createDataFrame([("a", 1.0, "2"), ("b", None, "9"), ("c", 3.0, "5"), ("d", 4.0, "1")], "city string, aqi double, timestamp string")
    right = spark.createDataFrame([("A", 9.0, "1"), ("B", 8.0, "1"), ("C", 7.0, "6"), ("D", 0.0, "7"), ("E", None, "1")], "city string, aqi double, timestamp string")
    assert values(compare.merge_prefer_newer(left, right), "city", "aqi") == [("B", 8.0), ("C", 7.0), ("E", None), ("a", 1.0), ("d", 4.0)]


def test_quick_stats(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", None), ("c", float("nan")), ("d", 25.0)], "city string, aqi double")
    assert tuple(compare.quick_stats(df).collect()[0]) == (4, 17.5, "d")


# ---- forecasts ----


def test_fallback_cascade(spark):
    hist = series(spark, delhi=40)
    day = dt.date(2024, 3, 1)
    asked = spark.createDataFrame(
        [("delhi", day, "auto"), ("delhi", day, "nf_vae"), ("delhi", day, "simple"), ("delhi", day, "bogus"), ("agra", day, "auto")],
        "city string, date date, model_type string",
    )
    scored = spark.createDataFrame([("delhi", day, "random_forest", 123.456)], "city string, date date, model string, model_aqi double")
    out = forecast.predict_with_fallback(asked, hist, scored, ["random_forest", "nf_vae"], "random_forest")
    got = {(r.city, r.model_type): (r.model_used, r.model_loaded, r.predicted_aqi, r.confidence) for r in out.collect()}
    assert got[("delhi", "auto")] == ("random_forest", True, 123.46, 78)
    assert got[("delhi", "nf_vae")] == ("simple_fallback", False, 30.0, 60)
    assert got[("delhi", "simple")] == ("simple", True, 30.0, 65)
    assert got[("delhi", "bogus")] == ("emergency_fallback", False, 280.0, 50)
    assert got[("agra", "auto")] == ("simple_fallback", False, 240.0, 60)


def test_station_forecasts(spark):
    hist = series(spark, x=50).withColumn("aqi", F.lit(100.0))
    read = [(sid, name, "plain", DAY + dt.timedelta(days=i), 200.0) for sid, name, n in (("1", "one", 12), (None, "two", 120), ("3", "three", 5)) for i in range(n)]
    readings = spark.createDataFrame(read, "station_id string, station_name string, station string, date date, aqi double")
    dim = spark.createDataFrame([("x", "1", "one"), ("x", "2", "two"), ("x", "3", "three"), ("x", "4", "four")], "city string, station_id string, station_name string")
    asked = spark.createDataFrame([("x",), ("y",)], "city string")
    out = forecast.predict_stations(asked, dim, readings, hist, "2024-08-05", 1)
    got = {(r.city, r.station_id): r for r in out.filter("source != 'station_aggregation'").collect()}
    assert got[("x", "1")].predicted_aqi == 160.0 and got[("x", "1")].station_confidence == "medium"
    assert got[("x", "2")].station_confidence == "high" and got[("x", "2")].data_points_used == 120
    assert got[("x", "3")].predicted_aqi == 80.0 and got[("x", "3")].source == "city_level_data_with_station_context"
    assert got[("x", "4")].data_points_used == 0
    assert got[("y", "CITY_AVG")].predicted_aqi == 120.0
    city = out.filter("source = 'station_aggregation'").collect()
    assert [(r.city, r.predicted_aqi, r.min_station_aqi, r.max_station_aqi, r.stations_count) for r in city] == [("x", 120.0, 80.0, 160.0, 4)]
    apart = forecast.city_rollup_of_stations(out.filter("source != 'station_aggregation'").drop("min_station_aqi", "max_station_aqi", "stations_count"))
    assert values(apart) == values(out.filter("source = 'station_aggregation'"), *apart.columns)


def test_station_forecasts_of_a_model(spark):
    hist = series(spark, x=50).withColumn("aqi", F.lit(100.0))
    rows = hist.select("city", "date", "aqi", F.lit("1").alias("station_id"), F.lit("s").alias("station"), F.lit("one").alias("station_name"))
    dim = spark.createDataFrame([("x", "1", "one"), ("x", "2", "two")], "city string, station_id string, station_name string")
    scored = spark.createDataFrame([("1", dt.date(2024, 8, 5), "random_forest", 600.0)], "station_id string, date date, model string, model_aqi double")
    out = forecast.predict_stations(spark.createDataFrame([("x",)], "city string"), dim, rows, hist, "2024-08-05", 1, scored=scored)
    got = {r.station_id: (r.model_used, r.predicted_aqi) for r in out.collect()}
    assert got == {"1": ("random_forest", 500.0), "2": ("simple_fallback", 80.0), "CITY_AVG": ("city_average", 290.0)}


def test_nested_city_records(spark):
    rows = [("Delhi", (210.0, "Poor", 0.0), ((199.0,),), (94.8,), ("improving",))]
    nested = "city_requested string, realtime struct<aqi:double,category:string,pm25:double>, predictions struct<today:struct<predicted_aqi:double>>, accuracy struct<today:double>, trend_analysis struct<short_term:string>"
    out = compare.normalize_city_record(spark.createDataFrame(rows, nested)).collect()[0]
    assert tuple(out) == ("Delhi", 210.0, "Poor", None, None, None, 199.0, 94.8, "improving")
    flat = spark.createDataFrame([("Pune", 0.0)], "name string, aqi double")
    assert tuple(compare.normalize_city_record(flat).collect()[0])[:3] == ("Pune", 0.0, "Unknown")


def test_scoring_defaults(spark):
    latest = spark.createDataFrame([("a", 7.0, None)], "city string, pm25 double, o3 double")
    spine = spark.createDataFrame([("a", DAY), ("b", DAY)], "city string, date date")
    out = forecast.scoring_features(spine, latest, ["pm25", "o3", "pressure", "year", "lag"]).orderBy("city").collect()
    assert [tuple(r)[2:] for r in out] == [(7.0, 50.0, 1013.0, 2024.0, 0.0), (100.0, 50.0, 1013.0, 2024.0, 0.0)]


def test_sequence_model_horizons(spark):
    df = series(spark, a=200, b=200)
    model = models.SequenceModel.fit(df, ["city"], ["aqi"], horizon=3, stride=1)
    spine = forecast.forecast_spine(spark.createDataFrame([("a",), ("new",)], "city string"), "2024-08-01", 5)
    spine = spine.withColumn("day_offset", F.col("day_offset") - 1)
    simple = spine.select("city", "date", F.lit(42.0).alias("predicted_aqi"))
    rows = model.predict(df, spine, fallback=simple).collect()
    got = {(r.city, r.day_offset): (r.predicted_aqi, r.model_used) for r in rows}
    assert [got[("a", d)] for d in range(4)] == [(200.0, "nf_vae"), (201.0, "nf_vae"), (202.0, "nf_vae"), (202.0, "nf_vae")]
    assert got[("a", -1)] == got[("new", 0)] == (42.0, "simple_fallback")
    assert all(r.predicted_aqi is None and r.model_used is None for r in model.predict(df, spine).filter("city = 'new'").collect())


def test_sequence_model_is_least_squares_over_all_windows(spark):
    rng = np.random.default_rng(1)
    rows = [(c, float(rng.normal(100, 9)), float(rng.normal(5, 2))) for c in "ab" for _ in range(90)]
    start = dt.date(2024, 1, 1)
    days = [(c, start + dt.timedelta(days=i % 90), x, y) for i, (c, x, y) in enumerate(rows)]
    df = spark.createDataFrame(days, "city string, date date, aqi double, pm25 double")
    model = models.SequenceModel.fit(df, ["city"], ["aqi", "pm25"], ["pm25"], history=3, horizon=4, stride=1, include_last=True)
    x, y = [], []
    for c in "ab":
        v = np.array([[r[2], r[3]] for r in days if r[0] == c])
        for i in range(90 - 6):  # the newest window ends with the last day
            x.append([1, *v[i : i + 3].ravel()])
            y.append(v[i + 3 : i + 7, 1])
    want = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)[0]
    rows = model.evaluate(df.filter("city = 'a'")).orderBy("start", "step").collect()
    assert len(rows) == 84 * 4
    assert [r.predicted for r in rows] == pytest.approx((np.array(x)[:84] @ want).ravel().tolist(), abs=1e-6)


def test_sequence_model_without_windows(spark):
    model = models.SequenceModel.fit(series(spark, a=5), ["city"], ["aqi"], history=3, horizon=4)
    spine = forecast.forecast_spine(spark.createDataFrame([("a",)], "city string"), "2024-08-01", 2)
    assert [r.predicted_aqi for r in model.predict(series(spark, a=5), spine).collect()] == [2.0, 2.0]


def test_sequence_training_measures_later_days(spark):
    days = series(spark, a=300, b=300).withColumn("pm25", F.col("aqi") % 7)
    model, metrics = training.train_sequence(days, ["city"], ["aqi", "pm25"], ["aqi", "pm25"], horizon=2, stride=1)
    assert set(model.weights) == {("aqi", 1), ("aqi", 2), ("pm25", 1), ("pm25", 2)}
    # 480 training rows scale the data; validation rows are later days only.
    assert model.scaler.stats["aqi"][1] == pytest.approx(np.mean(range(240)))
    got = {(r.scope, r.metric): r.value for r in metrics.collect()}
    assert set(got) == {(s, m) for s in ("all_features", "aqi_only") for m in ("RMSE", "MAE", "R2", "MSE")}
    assert got[("aqi_only", "RMSE")] < 20
    rows = model.evaluate(days.filter("aqi < 100"))
    assert rows.filter("target = 'aqi' AND step = 2 AND abs(actual - (start + 25)) > 1e-6").count() == 0


def test_training_refuses_leaks_and_isolates_failures(spark):
    rows = [(float(i), 3.0 * i + 1, "train" if i % 5 else "test", i, f"c{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "x double, aqi double, split string, k int, city string")
    with pytest.raises(ValueError, match="derived"):
        models.train_all_evaluate(df, ["x", "aqi_category"], "aqi", {}, ["k"])

    class Broken:
        def fit(self, _):
            raise RuntimeError("no")

    est = {"broken": Broken(), "linear_regression": models.regressors()["linear_regression"]}
    out = models.train_all_evaluate(df, ["x", "city_encoded"], "aqi", est, ["k"])
    assert out.failures == {"broken": "no"} and list(out.models) == ["linear_regression"]
    clipped = out.metrics.collect()[0]
    assert clipped.R2 > 0.99
