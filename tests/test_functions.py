"""Boundary values of the column expressions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from aerolake.functions import aqi as A
from aerolake.functions import calendar as C
from aerolake.functions import ratios as R
from aerolake.functions import values as V

INF, NAN = float("inf"), float("nan")


def evaluate(spark, rows, schema, **exprs):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[e.alias(n) for n, e in exprs.items()]).collect()]


def column(spark, xs, expr, kind="double"):
    return [r["y"] for r in evaluate(spark, [(x,) for x in xs], f"x {kind}", y=expr)]


def test_category_bounds(spark):
    xs = [0.0, 50.0, 50.0001, 100.0, 150.0, 200.0, 300.0, 400.0, 401.0, None, NAN, INF]
    assert column(spark, xs, A.aqi_category("x")) == [
        "Good", "Good", "Satisfactory", "Satisfactory", "Moderate", "Moderate", "Poor", "Very Poor", "Severe", "Unknown", "Unknown", "Severe",
    ]
    assert column(spark, [0.0, 1.0], A.aqi_category("x", zero_is_unknown=True)) == ["Unknown", "Good"]
    assert column(spark, xs, A.aqi_severity("x")) == [0, 0, 1, 1, 2, 2, 3, 4, 5, 2, 2, 5]
    assert column(spark, xs, A.aqi_eval_level("x")) == [0, 0, 1, 1, 2, 3, 4, 5, 5, None, None, 5]


def test_bands(spark):
    rows = evaluate(spark, [(0.0,), (50.0,), (100.0,), (150.0,), (151.0,), (None,), (NAN,)], "x double", **A.aqi_bands("x"))
    assert [list(r.values()) for r in rows] == [
        [0, 0, 0, 0], [1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0], [0, 0, 0, 0],
    ]


def test_accuracy(spark):
    rows = [(100.0, 90.0), (100.0, 350.0), (0.0, 10.0), (10.0, 0.0), (None, 5.0), (200.0, 200.0)]
    got = evaluate(spark, rows, "a double, p double", y=A.prediction_accuracy("a", "p"), t=A.accuracy_tier(A.prediction_accuracy("a", "p")))
    assert [r["y"] for r in got] == [90.0, 0.0, 0.0, 0.0, 0.0, 100.0]
    assert [r["t"] for r in got] == ["Excellent", "Poor", "Poor", "Poor", "Poor", "Excellent"]


@pytest.mark.parametrize("names, offset", [
    (["Chembur East", "OKHLA phase 2"], 30.0), (["ITO", "Anand Vihar"], 20.0), (["Lodhi Road", "Rose Garden"], -15.0),
    (["DTU"], -10.0), (["Somewhere"], 0.0), (["Industrial garden"], 30.0),
])
def test_station_class(spark, names, offset):
    assert column(spark, names, A.station_class_adjustment("x"), "string") == [offset] * len(names)


def test_lookups(spark):
    assert column(spark, ["Good", "Severe", "else", None], A.health_advice("x"), "string") == [
        "Air quality is satisfactory. Enjoy your normal outdoor activities.",
        "Health warning of emergency conditions. The entire population is more likely to be affected.", "No data available.", "No data available.",
    ]
    assert column(spark, [1, 2, 3, 4, 5, 6, None], A.provider_aqi("x"), "int") == [50, 100, 150, 200, 300, 150, 150]
    assert column(spark, ["delhi", "kanpur", "nowhere", None], A.default_city_level("x"), "string") == [280, 290, 150, 150]
    assert column(spark, ["random_forest", "new", None], A.model_confidence("x"), "string") == [78, 70, 70]
    assert column(spark, [100, 101], A.station_confidence("x"), "int") == ["medium", "high"]


def test_missing_values(spark):
    assert column(spark, ["1.5", "x", "", "NaN", "inf", None, " 7 "], V.to_number("x"), "string") == [1.5, None, None, None, INF, None, 7.0]
    assert column(spark, [1.0, NAN, INF, -INF, None], V.finite_or_null("x")) == [1.0, None, None, None, None]
    assert column(spark, [NAN, INF, -INF, None, 2.0], V.bound_scaled("x")) == [0.0, 3.0, -3.0, 0.0, 2.0]
    assert column(spark, ["", "  ", " Unknown ", "unknown", None, " a "], V.blank_to_null("x"), "string") == [None, None, None, None, None, "a"]
    assert column(spark, [-5.0, 50.0, 700.0, None], V.clip("x", 0, 500)) == [0.0, 50.0, 500.0, None]
    assert column(spark, ["2024-02-29", "2023-02-29", "garbage", None, "2024-05-01 10:11:12"], V.to_date("x"), "string") == [
        dt.date(2024, 2, 29), None, None, None, dt.date(2024, 5, 1),
    ]


def test_other_date_formats(spark):
    xs = ["2020/3/4", "3/4/2020", "03-04-2020 05:06", "3/4/2020 5:06:07", "31/12/2020"]
    assert column(spark, xs, V.to_date("x"), "string") == [dt.date(2020, 3, 4)] * 4 + [None]
    assert column(spark, xs[3:4], V.to_timestamp("x"), "string") == [dt.datetime(2020, 3, 4, 5, 6, 7)]


def test_calendar(spark):
    days = [dt.date(2024, 2, 29), dt.date(2023, 12, 31), dt.date(2024, 1, 6), dt.date(2024, 1, 1), None]
    rows = evaluate(spark, [(x,) for x in days], "x date", **C.calendar_fields("x"))
    assert [r["dayofweek"] for r in rows] == [3, 6, 5, 0, None]
    assert [r["is_weekend"] for r in rows] == [0, 1, 1, 0, None]
    assert [r["dayofyear"] for r in rows] == [60, 365, 6, 1, None]
    cyc = evaluate(spark, [(x,) for x in days[:4]], "x date", **C.cyclical_fields("x"))
    assert cyc[3]["month_sin"] == pytest.approx(math.sin(2 * math.pi / 12))
    assert cyc[1]["dayofyear_cos"] == pytest.approx(math.cos(2 * math.pi * 365 / 365.25))
    assert column(spark, days[:4], C.seasonal_factor("x"), "date") == [1.4, 1.4, 1.4, 1.4]
    months = [dt.date(2024, m, 1) for m in (3, 4, 5, 7, 8, 10)]
    assert column(spark, months, C.seasonal_factor("x"), "date") == [1.2, 1.2, 0.9, 0.9, 0.8, 0.8]
    assert column(spark, days[:4], C.day_factor("x"), "date") == [1.0, 0.95, 0.95, 1.0]


def test_ratios(spark):
    got = evaluate(spark, [(1.0, 0.0), (2.0, 4.0), (None, 4.0), (INF, 1.0)], "a double, b double", y=R.pm_ratio("a", "b"))
    assert [round(r["y"], 4) for r in got] == [1e6, 0.5, 0.5, 0.5]
    zero = evaluate(spark, [(1.0, -1e-8)], "a double, b double", y=R.ratio("a", "b"))
    assert zero[0]["y"] is None


def test_trend_word(spark):
    rows = [(100.0, 90.0), (100.0, 100.0), (100.0, None), (None, 5.0)]
    got = evaluate(spark, rows, "c double, l double", y=A.trend_word("c", "l"))
    assert [r["y"] for r in got] == ["improving", "worsening", "improving", "worsening"]


def test_limit_status(spark):
    got = evaluate(spark, [("pm25", 60.0), ("pm25", 60.1), ("pm10", 100.0), ("co", 9.0)], "p string, v double", y=A.limit_status("p", "v"))
    assert [r["y"] for r in got] == ["Within Limit", "Above Limit", "Within Limit", None]


def test_no_python_in_plans(spark):
    df = spark.range(3).select(F.col("id").cast("double").alias("x"))
    plan = df.select(A.aqi_category("x"), A.aqi_severity("x"), V.clip("x", 0, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
