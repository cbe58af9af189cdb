"""Forecast queries."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from aerolake.catalog import views as v
from aerolake.catalog.q_joins import _CANON, canonical_stations
from aerolake.catalog.registry import query, rnd, sql_accuracy, sql_category, sql_confidence, sql_day, sql_rnd, sql_season
from aerolake.functions import aqi as A
from aerolake.operators import cities, compare, daily, forecast, models, sets, stations
from aerolake.plans.joins import settle
from aerolake.session import shared_dir
from aerolake.sources import sinks


def _sql_simple(base: str, date: str, trend: str) -> str:
    return f"least(greatest({base} * {sql_season(date)} * {sql_day(date)} * {trend}, 30), 500)"


@query("predict_simple", f"""
    WITH spine AS (SELECT city, cast(i AS INTEGER) AS day_offset, DATE '{v.AS_OF}' + cast(i AS INTEGER) AS date
                   FROM (SELECT DISTINCT canonical AS city FROM v_city_alias UNION ALL SELECT 'lucknow'), range(30) t(i))
    SELECT city, day_offset, date, round(raw, 2) AS predicted_aqi, {sql_category("raw")} AS category
    FROM (SELECT s.*, {_sql_simple("coalesce(base, CASE s.city WHEN 'lucknow' THEN 260 ELSE 150 END)", "date", "coalesce(trend_factor, 1.0::DOUBLE)")} AS raw
          FROM spine s LEFT JOIN v_pattern p ON p.city = s.city)""", ("v_pattern",))
def predict_simple(spark, d):
    known = cities.canonical_cities(v.city_alias(spark, d))
    asked = known.unionByName(spark.createDataFrame([("lucknow",)], "city string"))
    return forecast.predict_simple(forecast.forecast_spine(asked, v.AS_OF, 30), v.city_history(spark, d))


_REQ = f"""SELECT o_orderkey, city, DATE '{v.AS_OF}' + cast(o_orderkey % 20 AS INTEGER) AS date,
           CASE o_orderkey % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'random_forest' WHEN 2 THEN 'gradient_boosting' WHEN 3 THEN 'simple' ELSE 'other' END AS model_type
           FROM v_city_history"""
_MODEL = """SELECT city, round(avg(aqi) - 20, 3) AS model_aqi FROM v_city_history WHERE city <> 'city_2' GROUP BY city"""


@query("predict_with_fallback", f"""
    WITH r AS ({_REQ}), m AS ({_MODEL}),
    j AS (SELECT r.*, CASE model_type WHEN 'auto' THEN 'random_forest' ELSE model_type END AS model, base, trend_factor,
                 {_sql_simple("base", "date", "trend_factor")} AS raw, model_aqi
          FROM r JOIN v_pattern p ON p.city = r.city LEFT JOIN m ON m.city = r.city),
    u AS (SELECT *, CASE WHEN model = 'other' THEN 'emergency_fallback' WHEN model = 'simple' THEN 'simple'
                         WHEN model = 'random_forest' AND model_aqi IS NOT NULL THEN model ELSE 'simple_fallback' END AS model_used FROM j),
    w AS (SELECT *, CASE model_used WHEN 'emergency_fallback' THEN 150 WHEN 'random_forest' THEN round(model_aqi, 2) ELSE round(raw, 2) END AS predicted_aqi FROM u)
    SELECT o_orderkey, city, date, model_type, model_used, predicted_aqi, {sql_category("predicted_aqi")} AS category, model_used = model AS model_loaded,
           {sql_confidence("model_used")} AS confidence
    FROM w""", ("v_pattern", "v_city_history"))
def predict_with_fallback(spark, d):
    hist = v.city_history(spark, d)
    kinds = F.array(*[F.lit(m) for m in ("auto", "random_forest", "gradient_boosting", "simple", "other")])
    k = F.col("o_orderkey")
    asked = hist.select(
        "o_orderkey", "city", F.date_add(F.lit(v.AS_OF).cast("date"), (k % 20).cast("int")).alias("date"),
        F.element_at(kinds, (k % 5 + 1).cast("int")).alias("model_type"),
    )
    scored = hist.filter("city <> 'city_2'").groupBy("city").agg(F.round(F.avg("aqi") - 20, 3).alias("model_aqi"))
    scored = forecast.forecast_spine(scored, v.AS_OF, 20).join(scored, "city").withColumn("model", F.lit("random_forest"))
    return forecast.predict_with_fallback(asked, hist, scored, ["random_forest", "gradient_boosting"], "random_forest")


_ASKED_MODELS = ("auto", "linear_regression", "simple", "other")


@query("model_flow", f"""
    WITH line AS (SELECT regr_slope(aqi, date - DATE '1992-01-01') AS b, regr_intercept(aqi, date - DATE '1992-01-01') AS a FROM v_city_history),
    r AS (SELECT city, DATE '{v.AS_OF}' + cast(i AS INTEGER) AS date, model_type, CASE model_type WHEN 'auto' THEN 'linear_regression' ELSE model_type END AS model
          FROM (SELECT DISTINCT city FROM v_city_history), range(7) t(i), (VALUES {", ".join(f"('{m}')" for m in _ASKED_MODELS)}) k(model_type)),
    j AS (SELECT r.*, {_sql_simple("base", "date", "trend_factor")} AS raw,
                 CASE WHEN r.city <> 'city_2' THEN round(least(greatest(a + b * (date - DATE '1992-01-01'), 0), 500), 2) END AS model_aqi
          FROM r JOIN v_pattern p ON p.city = r.city, line),
    u AS (SELECT *, CASE WHEN model = 'other' THEN 'emergency_fallback' WHEN model = 'simple' THEN 'simple' WHEN model_aqi IS NOT NULL THEN model ELSE 'simple_fallback' END AS model_used FROM j),
    w AS (SELECT u.*, CASE model_used WHEN 'emergency_fallback' THEN 150 WHEN 'linear_regression' THEN model_aqi ELSE round(raw, 2) END AS predicted_aqi,
                 CASE WHEN date = DATE '{v.AS_OF}' THEN current_aqi END AS realtime_aqi FROM u LEFT JOIN v_current c ON c.city = u.city)
    SELECT city, date, model_type, model_used, predicted_aqi, {sql_category("predicted_aqi")} AS category, {sql_confidence("model_used")} AS confidence, realtime_aqi,
           CASE WHEN realtime_aqi IS NOT NULL THEN {sql_category("realtime_aqi")} END AS realtime_category,
           CASE WHEN realtime_aqi IS NOT NULL THEN {sql_accuracy("realtime_aqi", "predicted_aqi")} END AS accuracy, {sql_rnd("predicted_aqi - realtime_aqi", 2)} AS difference
    FROM w""", ("v_pattern", "v_city_history", "v_current"))
def model_flow(spark, d):
    """A line is fitted, stored and loaded, scores the days to come, falls back where it must, and meets the live values."""
    hist = v.city_history(spark, d)

    def with_day(df):
        return df.withColumn("x", F.date_diff("date", F.lit("1992-01-01").cast("date")).cast("double"))

    path = sinks.save_model(models.train_model(with_day(hist), ["x"], "aqi", LinearRegression()), shared_dir(spark, "model"))
    known = cities.canonical_cities(v.city_alias(spark, d)).join(hist.select("city").distinct(), "city", "left_semi")
    spine = settle(forecast.forecast_spine(known, v.AS_OF, 7).drop("day_offset"), "spine")
    scored = models.score(with_day(spine.filter("city <> 'city_2'")), sinks.load_model(path)).select(
        "city", "date", F.lit("linear_regression").alias("model"), F.col("predicted_aqi").alias("model_aqi")
    )
    asked = spine.withColumn("model_type", F.explode(F.array(*[F.lit(m) for m in _ASKED_MODELS])))
    out = forecast.predict_with_fallback(asked, hist, settle(scored, "scored"), ["linear_regression"], "linear_regression")
    out = compare.with_live_comparison(out, v.current(spark, d), v.AS_OF)
    return out.select("city", "date", "model_type", "model_used", "predicted_aqi", "category", "confidence", "realtime_aqi", "realtime_category", "accuracy",
                      rnd("difference", 2).alias("difference"))


_STATION = f"""
    WITH st AS ({_CANON}),
    h AS (SELECT station_id, date, sum(aqi) AS total, count(aqi) AS n, avg(aqi) AS aqi FROM v_readings
          WHERE cast(station_id AS BIGINT) % 6 <> 0 OR (l_orderkey % 97 = 0 AND l_linenumber = 1) GROUP BY station_id, date),
    own AS (SELECT station_id, sum(total) / nullif(sum(n), 0) AS base, cast(sum(n) AS BIGINT) AS points,
                   cast(CASE WHEN count(*) > 30 AND avg(aqi) FILTER (rn <= 15) < avg(aqi) FILTER (rn > 15 AND rn <= 30) THEN 0.98 ELSE 1.0 END AS DOUBLE) AS trend
            FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date DESC) AS rn FROM h) GROUP BY station_id),
    spine AS (SELECT c.city, coalesce(station_id, 'CITY_AVG') AS station_id, DATE '{v.AS_OF}' + cast(i AS INTEGER) AS date,
                     CASE WHEN station_id IS NULL THEN 'city_level' ELSE 'station_level' END AS prediction_type
              FROM (SELECT DISTINCT canonical AS city FROM v_city_alias) c LEFT JOIN st ON st.city = c.city, range(5) t(i)),
    j AS (SELECT s.*, coalesce(points, 0) AS points, coalesce(points, 0) > 10 AS own,
                 {_sql_simple("CASE WHEN coalesce(points, 0) > 10 THEN own.base ELSE p.base END", "s.date",
                              "CASE WHEN coalesce(points, 0) > 10 THEN own.trend ELSE p.trend_factor END")} AS raw
          FROM spine s LEFT JOIN own ON own.station_id = s.station_id JOIN v_pattern p ON p.city = s.city),
    rows AS (SELECT city, date, station_id, prediction_type, round(raw, 2) AS predicted_aqi, {sql_category("raw")} AS category, points AS data_points_used,
                    CASE WHEN prediction_type = 'station_level' THEN CASE WHEN points > 100 THEN 'high' ELSE 'medium' END END AS station_confidence,
                    CASE WHEN prediction_type = 'city_level' THEN 'city_fallback' WHEN own THEN 'station_specific_data'
                         ELSE 'city_level_data_with_station_context' END AS source FROM j)
    SELECT * REPLACE ({sql_rnd("predicted_aqi", 2)} AS predicted_aqi), NULL::BIGINT AS stations_count FROM rows
    UNION ALL
    SELECT city, date, 'CITY_AVG', 'city_level', {sql_rnd("avg(predicted_aqi)", 2)}, {sql_category("avg(predicted_aqi)")}, NULL, NULL,
           'station_aggregation', count(*) FROM rows WHERE prediction_type = 'station_level' GROUP BY city, date"""


@query("predict_stations", _STATION, ("v_readings", "v_stations", "v_pattern"))
def predict_stations(spark, d):
    sparse = (F.col("station_id").cast("bigint") % 6 != 0) | ((F.col("l_orderkey") % 97 == 0) & (F.col("l_linenumber") == 1))
    rows = v.readings(spark, d).filter(sparse).select(
        "station_id", F.lit(None).cast("string").alias("station"), F.lit(None).cast("string").alias("station_name"), "date", "aqi"
    )
    out = forecast.predict_stations(
        cities.canonical_cities(v.city_alias(spark, d)), canonical_stations(spark, d), rows, v.city_history(spark, d), v.AS_OF, 5
    )
    return out.select("city", "date", "station_id", "prediction_type", rnd("predicted_aqi", 2).alias("predicted_aqi"), "category",
                      "data_points_used", "station_confidence", "source", "stations_count")


_F = ["pm25", "pm10", "temperature", "year", "month_sin", "dayofweek", "city_encoded", "aqi_lag_1"]


@query("scoring_features", f"""
    WITH last AS (SELECT * FROM v_readings QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1),
         spine AS (SELECT cast(s_suppkey AS VARCHAR) AS city, DATE '{v.AS_OF}' + cast(i AS INTEGER) AS date FROM supplier, range(3) t(i))
    SELECT s.city, s.date, coalesce(pm25, 100) AS pm25, coalesce(pm10, 150) AS pm10, 25.0::DOUBLE AS temperature,
           cast(year(s.date) AS DOUBLE) AS year, {sql_rnd("sin(2 * pi() * month(s.date) / 12)")} AS month_sin, cast(isodow(s.date) - 1 AS DOUBLE) AS dayofweek,
           cast(coalesce(code, 0) AS DOUBLE) AS city_encoded, 0.0::DOUBLE AS aqi_lag_1
    FROM spine s LEFT JOIN (SELECT * FROM last WHERE cast(station_id AS BIGINT) % 8 <> 0) l ON l.station_id = s.city
         LEFT JOIN (SELECT station_id, dense_rank() OVER (ORDER BY station_id) - 1 AS code FROM (SELECT DISTINCT station_id FROM v_readings)) c
           ON c.station_id = s.city""", ("v_readings",))
def scoring_features(spark, d):
    rows = v.readings(spark, d).withColumnRenamed("station_id", "city")
    last = sets.latest_row(rows, ["city"], ["date", "l_orderkey", "l_linenumber", "l_partkey"]).filter(F.col("city").cast("bigint") % 8 != 0)
    asked = v.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("city"))
    spine = forecast.forecast_spine(asked, v.AS_OF, 3).drop("day_offset")
    out = forecast.scoring_features(spine, last, _F, cities.city_codes(rows))
    return out.withColumn("month_sin", rnd("month_sin"))


@query("airquality_overview", f"""
    WITH dim AS (SELECT DISTINCT ON (station_id) station_id, canonical AS city FROM v_stations JOIN v_city_alias ON lower(trim(city)) = alias
                 ORDER BY station_id, copy),
    day AS (SELECT city, r.station_id, date, avg(aqi) AS aqi FROM v_readings r JOIN dim ON dim.station_id = r.station_id
            WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY city, r.station_id, date)
    SELECT city, count(*) AS station_days, {sql_rnd("avg(aqi)")} AS mean_aqi, {sql_category("avg(aqi)")} AS category,
           count(*) FILTER (aqi <= 50) AS good_days, count(*) FILTER (aqi > 400) AS severe_days
    FROM day GROUP BY city""", ("v_readings", "v_stations", "v_city_alias"))
def airquality_overview(spark, d):
    """Readings, station enrichment, canonical cities, daily means, categories, ranked cities."""
    rows = daily.date_range(v.readings(spark, d), "1996-01-01", "2000-12-31").select("station_id", "date", "aqi")
    dim = cities.normalize_city(v.stations(spark, d), v.city_alias(spark, d), keep_original=False)
    named = stations.enrich_station_metadata(rows, dim, ["copy"])
    days = daily.daily_aggregate(named, ["city", "station_id", "date"], ["aqi"], ())
    out = days.withColumn("category", A.aqi_category("aqi")).groupBy("city").agg(
        F.count("*").alias("station_days"), F.avg("aqi").alias("mean"),
        F.count_if(F.col("category") == "Good").alias("good_days"), F.count_if(F.col("category") == "Severe").alias("severe_days"),
    )
    out = out.select("city", "station_days", rnd("mean").alias("mean_aqi"), A.aqi_category("mean").alias("category"), "good_days", "severe_days")
    return out.orderBy(F.desc("mean_aqi"), "city")
