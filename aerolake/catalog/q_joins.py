"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.catalog import views as v
from aerolake.catalog.registry import query, rnd, sql_accuracy, sql_advice, sql_category, sql_day, sql_rnd, sql_season
from aerolake.functions import aqi as A
from aerolake.operators import cities, compare, evaluate, forecast, sets, stations

KEY = ["l_orderkey", "l_linenumber"]

_DIM = """SELECT station_id, station_name, city, state FROM v_stations
          QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY copy) = 1"""


@query("enrich_station_metadata", f"""
    WITH dim AS ({_DIM})
    SELECT l_orderkey, l_linenumber, r.station_id, station_name, state,
           coalesce(CASE WHEN l_linenumber <= 2 THEN 'own' END, city) AS city
    FROM v_readings r LEFT JOIN dim ON r.station_id = dim.station_id""", ("v_readings", "v_stations"))
def enrich_station_metadata(spark, d):
    rows = v.readings(spark, d).select(*KEY, "station_id", F.when(F.col("l_linenumber") <= 2, "own").alias("city"))
    return stations.enrich_station_metadata(rows, v.stations(spark, d), ["copy"])


@query("enrich_station_metadata_null_safe", """
    WITH ids AS (SELECT *, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE station_id END AS id FROM v_stations),
         dim AS (SELECT id, station_name, state FROM ids QUALIFY row_number() OVER (PARTITION BY id ORDER BY copy, s_suppkey) = 1)
    SELECT l_orderkey, l_linenumber, id AS station_id, station_name, state
    FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN NULL ELSE station_id END AS rid FROM v_readings) r
    JOIN dim ON rid IS NOT DISTINCT FROM id
    UNION ALL
    SELECT l_orderkey, l_linenumber, rid, NULL, NULL
    FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN NULL ELSE station_id END AS rid FROM v_readings) r
    WHERE NOT EXISTS (SELECT 1 FROM dim WHERE rid IS NOT DISTINCT FROM id)""", ("v_readings", "v_stations"))
def enrich_station_metadata_null_safe(spark, d):
    rows = v.readings(spark, d).select(*KEY, F.when(F.col("l_linenumber") != 1, F.col("station_id")).alias("station_id"))
    dim = v.stations(spark, d).withColumn("station_id", F.when(F.col("s_suppkey") % 9 != 0, F.col("station_id"))).drop("city")
    return stations.enrich_station_metadata(rows, dim, ["copy", "s_suppkey"], null_safe=True)


@query("unmapped_cities", """
    SELECT DISTINCT city AS city_original FROM v_city_daily WHERE lower(city) NOT IN (SELECT alias FROM v_city_alias)""",
       ("v_city_daily", "v_city_alias"))
def unmapped_cities(spark, d):
    return cities.unmapped_cities(v.city_daily(spark, d), v.city_alias(spark, d))


def _forecast(spark, d, days):
    hist = v.city_history(spark, d).select("city", "date", "aqi")
    spine = forecast.forecast_spine(hist.select("city").distinct(), v.LIVE_AS_OF, days)
    return forecast.predict_simple(spine, hist)


def _sql_forecast(days: int) -> str:
    return f"""SELECT city, date, day_offset, round(raw, 2) AS predicted_aqi, {sql_category("raw")} AS category
        FROM (SELECT *, least(greatest(base * {sql_season("date")} * {sql_day("date")} * trend_factor, 30), 500) AS raw
              FROM (SELECT p.*, cast(i AS INTEGER) AS day_offset, DATE '{v.LIVE_AS_OF}' + cast(i AS INTEGER) AS date
                    FROM v_pattern p, range({days}) t(i)))"""


@query("status_with_forecast", f"""
    WITH f AS ({_sql_forecast(2)})
    SELECT c.city, current_aqi, {sql_category("current_aqi")} AS current_category, a.predicted_aqi AS predicted_today,
           a.category AS predicted_today_category, b.predicted_aqi AS predicted_tomorrow, b.category AS predicted_tomorrow_category,
           {sql_accuracy("current_aqi", "a.predicted_aqi")} AS accuracy
    FROM v_current c JOIN f a ON a.city = c.city AND a.day_offset = 0 JOIN f b ON b.city = c.city AND b.day_offset = 1""",
       ("v_pattern", "v_current"))
def status_with_forecast(spark, d):
    return compare.status_with_forecast(v.current(spark, d), _forecast(spark, d, 2), v.LIVE_AS_OF)


@query("city_comparison", f"""
    WITH f AS ({_sql_forecast(2)})
    SELECT c.city, current_aqi, {sql_category("current_aqi")} AS current_category, predicted_aqi AS predicted_tomorrow,
           category AS predicted_tomorrow_category, CASE WHEN predicted_aqi < current_aqi THEN 'improving' ELSE 'worsening' END AS trend,
           {sql_advice(sql_category("current_aqi").replace("CASE", "(CASE", 1) + ")")} AS health_advice
    FROM v_current c JOIN f ON f.city = c.city AND f.day_offset = 1""", ("v_pattern", "v_current"))
def city_comparison(spark, d):
    return compare.city_comparison(v.current(spark, d), _forecast(spark, d, 2), v.LIVE_AS_OF)


_RVF = f"""
    WITH f AS ({_sql_forecast(8)}),
    j AS (SELECT c.city, current_aqi, {sql_category("current_aqi")} AS category, a.predicted_aqi AS predicted_today,
           b.predicted_aqi AS predicted_tomorrow, w.predicted_aqi AS predicted_next_week,
           {sql_accuracy("current_aqi", "a.predicted_aqi")} AS accuracy_today,
           CASE WHEN b.predicted_aqi < current_aqi THEN 'improving' ELSE 'worsening' END AS short_term,
           CASE WHEN w.predicted_aqi < current_aqi THEN 'improving' ELSE 'worsening' END AS long_term
    FROM v_current c JOIN f a ON a.city = c.city AND a.day_offset = 0 JOIN f b ON b.city = c.city AND b.day_offset = 1
         JOIN f w ON w.city = c.city AND w.day_offset = 7)"""


@query("realtime_vs_forecast", _RVF + f"""
    SELECT *, CASE WHEN accuracy_today >= 90 THEN 'Excellent' WHEN accuracy_today >= 80 THEN 'Good' WHEN accuracy_today >= 70 THEN 'Fair'
           ELSE 'Poor' END AS accuracy_status, CASE WHEN short_term = long_term THEN 'high' ELSE 'medium' END AS trend_confidence,
           {sql_advice("category")} AS health_advice
    FROM j""", ("v_pattern", "v_current"))
def realtime_vs_forecast(spark, d):
    out = compare.realtime_vs_forecast(v.current(spark, d), _forecast(spark, d, 8), v.LIVE_AS_OF)
    return out.drop("predicted_today_category", "predicted_tomorrow_category", "predicted_next_week_category")


@query("realtime_trend", """
    SELECT event_id, CASE WHEN t < value THEN 'improving' ELSE 'worsening' END AS short_term,
           CASE WHEN w < value THEN 'improving' ELSE 'worsening' END AS long_term,
           CASE WHEN (t < value) = (w < value) THEN 'high' ELSE 'medium' END AS trend_confidence
    FROM (SELECT event_id, value, CASE WHEN event_id % 4 = 0 THEN value ELSE event_id % 300 END AS t,
                 CASE WHEN event_id % 3 = 0 THEN event_id % 200 ELSE CASE WHEN event_id % 4 = 0 THEN value ELSE event_id % 300 END END AS w
          FROM v_feed)""", ("v_feed",))
def realtime_trend(spark, d):
    e = F.col("event_id")
    rows = v.feed(spark, d).select(
        "event_id", F.col("value").alias("current_aqi"), F.lit(None).cast("double").alias("predicted_today"),
        F.when(e % 4 != 0, (e % 300).cast("double")).alias("predicted_tomorrow"),
        F.when(e % 3 == 0, (e % 200).cast("double")).alias("predicted_next_week"),
    )
    return compare.realtime_trend(rows).select("event_id", "short_term", "long_term", "trend_confidence")


def _latest_by(spark, d, pollutant):
    f = v.feed(spark, d).filter(F.col("pollutant") == pollutant).select("city", "event_id", "ts", "value")
    newest = sets.latest_row(f, ["city"], ["ts", "event_id"])
    return newest.select("city", F.col("value").alias("aqi"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


def _sql_latest_by(p: str) -> str:
    return f"""SELECT city, value AS aqi, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM v_feed WHERE pollutant = '{p}'
        QUALIFY row_number() OVER (PARTITION BY city ORDER BY ts DESC, event_id DESC) = 1"""


@query("merge_prefer_newer", f"""
    WITH l AS (SELECT * FROM ({_sql_latest_by("view")}) WHERE city <> 'city_3'),
         r AS (SELECT upper(city) AS city, CASE WHEN city = 'city_5' THEN NULL ELSE aqi END AS aqi, timestamp
               FROM ({_sql_latest_by("purchase")}) WHERE city <> 'city_4')
    SELECT CASE WHEN win THEN rc ELSE lc END AS city, CASE WHEN win THEN ra ELSE la END AS aqi, CASE WHEN win THEN rt ELSE lt END AS timestamp
    FROM (SELECT l.city AS lc, l.aqi AS la, l.timestamp AS lt, r.city AS rc, r.aqi AS ra, r.timestamp AS rt,
                 l.city IS NULL OR coalesce(r.aqi <> 0 AND (coalesce(l.aqi, 0) = 0 OR r.timestamp > l.timestamp), false) AS win
          FROM l FULL JOIN r ON lower(l.city) = lower(r.city))""", ("v_feed",))
def merge_prefer_newer(spark, d):
    left = _latest_by(spark, d, "view").filter("city <> 'city_3'")
    right = _latest_by(spark, d, "purchase").filter("city <> 'city_4'")
    right = right.withColumn("aqi", F.when(F.col("city") != "city_5", F.col("aqi"))).withColumn("city", F.upper("city"))
    return compare.merge_prefer_newer(left, right)


@query("merge_prefer_source", f"""
    WITH a AS (SELECT upper(city) AS city, CASE WHEN city = 'city_2' THEN 0 ELSE aqi END AS aqi FROM ({_sql_latest_by("view")}) WHERE city <> 'city_1'),
         b AS (SELECT city, aqi FROM ({_sql_latest_by("click")}))
    SELECT * FROM a WHERE aqi <> 0 UNION ALL SELECT * FROM b WHERE city NOT IN (SELECT lower(city) FROM a) AND aqi <> 0""", ("v_feed",))
def merge_prefer_source(spark, d):
    a = _latest_by(spark, d, "view").filter("city <> 'city_1'")
    a = a.select(F.upper("city").alias("city"), F.when(F.col("city") == "city_2", 0.0).otherwise(F.col("aqi")).alias("aqi"))
    return compare.merge_prefer_source(a, _latest_by(spark, d, "click").select("city", "aqi"))


@query("forecast_spine", f"""
    SELECT city, cast(i AS INTEGER) AS day_offset, DATE '{v.AS_OF}' + cast(i AS INTEGER) AS date
    FROM (SELECT DISTINCT city FROM v_city_daily), range(14) t(i)""", ("v_city_daily",))
def forecast_spine(spark, d):
    return forecast.forecast_spine(v.city_daily(spark, d).select("city").distinct(), v.AS_OF, 14)


_CANON = """SELECT DISTINCT ON (station_id) station_id, station_name, canonical AS city
            FROM v_stations JOIN v_city_alias ON lower(trim(city)) = alias ORDER BY station_id, copy"""


def canonical_stations(spark, d):
    dim = sets.dedupe_keep_first(v.stations(spark, d), ["station_id"], ["copy"])
    named = cities.normalize_city(dim, v.city_alias(spark, d), keep_original=False)
    return named.filter(F.col("city").isNotNull()).select("station_id", "station_name", "city")


@query("station_spine", f"""
    WITH st AS (SELECT * FROM ({_CANON}) WHERE city <> 'city_4')
    SELECT c.city, coalesce(station_id, 'CITY_AVG') AS station_id, coalesce(station_name, 'City Average') AS station_name,
           CASE WHEN station_id IS NULL THEN 'city_level' ELSE 'station_level' END AS prediction_type,
           cast(i AS INTEGER) AS day_offset, DATE '{v.AS_OF}' + cast(i AS INTEGER) AS date
    FROM (SELECT DISTINCT canonical AS city FROM v_city_alias) c LEFT JOIN st ON st.city = c.city, range(7) t(i)""",
       ("v_stations", "v_city_alias"))
def station_spine(spark, d):
    dim = canonical_stations(spark, d).filter("city <> 'city_4'")
    return forecast.station_spine(cities.canonical_cities(v.city_alias(spark, d)), dim, v.AS_OF, 7)


_MODELS = ["random_forest", "nf_vae", "simple"]


@query("model_matrix", """
    WITH p AS (SELECT city, CASE station WHEN 'BUILDING' THEN 'random_forest' ELSE 'simple' END AS model, max(aqi) AS predicted_aqi,
                      min(station) AS model_used FROM v_city_daily
               WHERE station IN ('BUILDING', 'MACHINERY') AND NOT (station = 'BUILDING' AND city < 'NATION_15') GROUP BY city, station),
         g AS (SELECT city, model FROM (SELECT DISTINCT city FROM v_city_daily), (VALUES ('random_forest'), ('nf_vae'), ('simple')) m(model))
    SELECT g.city, upper(g.model) AS model, cast(coalesce(round(predicted_aqi), 0) AS INTEGER) AS predicted_aqi,
           CASE WHEN predicted_aqi IS NULL THEN 'Error' ELSE 'Severe' END AS category, coalesce(model_used, 'failed') AS model_used,
           CASE WHEN predicted_aqi IS NULL THEN 'Failed' WHEN g.model = 'simple' THEN 'Success' ELSE 'Fallback' END AS status
    FROM g LEFT JOIN p ON p.city = g.city AND p.model = g.model""", ("v_city_daily",))
def model_matrix(spark, d):
    rows = v.city_daily(spark, d)
    picked = rows.filter(F.col("station").isin("BUILDING", "MACHINERY") & ~((F.col("station") == "BUILDING") & (F.col("city") < "NATION_15")))
    preds = picked.groupBy("city", "station").agg(F.max("aqi").alias("predicted_aqi")).select(
        "city", F.when(F.col("station") == "BUILDING", "random_forest").otherwise("simple").alias("model"), "predicted_aqi",
        F.lit("Severe").alias("category"), F.col("station").alias("model_used"), (F.col("station") != "BUILDING").alias("model_loaded"),
    )
    return forecast.model_matrix(rows.select("city").distinct(), preds, _MODELS)


_DEFAULTS = """(VALUES ('nf_vae', 45.2, 32.1, 0.782), ('random_forest', 48.7, 35.3, 0.745), ('gradient_boosting', 52.1, 38.7, 0.689),
    ('xgboost', 47.3, 33.8, 0.761), ('lightgbm', 49.1, 36.2, 0.738), ('simple', 65.3, 45.2, 0.512)) t(model, RMSE, MAE, R2)"""

SQL_MODEL_ROWS = """SELECT 'simple' AS model, aqi AS actual, avg(aqi) OVER (PARTITION BY city) AS predicted FROM v_city_daily
    UNION ALL SELECT 'random_forest', aqi, avg(aqi) OVER (PARTITION BY city, station) FROM v_city_daily"""


def model_rows(spark, d):
    """Two measured models: the city mean and the mean of city and station."""
    rows = v.city_daily(spark, d)
    city = rows.groupBy("city").agg(F.avg("aqi").alias("predicted"))
    both = rows.groupBy("city", "station").agg(F.avg("aqi").alias("predicted"))
    a = rows.join(city, "city").select(F.lit("simple").alias("model"), F.col("aqi").alias("actual"), "predicted")
    b = rows.join(both, ["city", "station"]).select(F.lit("random_forest").alias("model"), F.col("aqi").alias("actual"), "predicted")
    return a.unionByName(b)


SQL_METRICS = f"""SELECT model, sqrt(avg((predicted - actual) ** 2)) AS RMSE, avg(abs(predicted - actual)) AS MAE,
    CASE WHEN var_pop(actual) > 0 THEN 1 - avg((predicted - actual) ** 2) / var_pop(actual) ELSE 0 END AS R2,
    avg((predicted - actual) ** 2) AS MSE, count(*) AS rows
    FROM ({SQL_MODEL_ROWS}) GROUP BY model"""


def measured(spark, d):
    return evaluate.long_metrics(evaluate.regression_metrics(model_rows(spark, d)))


SQL_MERGED = f"""
    SELECT coalesce(m.model, t.model) AS model, coalesce(m.metric, t.metric) AS metric, coalesce(m.value, t.value) AS value,
           CASE WHEN m.value IS NOT NULL THEN 'measured' ELSE 'default' END AS origin
    FROM (UNPIVOT (SELECT model, RMSE, MAE, R2, MSE FROM ({SQL_METRICS})) ON RMSE, MAE, R2, MSE INTO NAME metric VALUE value) m
    FULL JOIN (SELECT model, metric, cast(value AS DOUBLE) AS value
               FROM (UNPIVOT (SELECT model, cast(RMSE AS DOUBLE) AS RMSE, cast(MAE AS DOUBLE) AS MAE, cast(R2 AS DOUBLE) AS R2 FROM {_DEFAULTS})
                     ON RMSE, MAE, R2 INTO NAME metric VALUE value)) t
      ON m.model = t.model AND m.metric = t.metric"""


@query("merge_performance_defaults", f"SELECT model, metric, {sql_rnd('value')} AS value, origin FROM ({SQL_MERGED})", ("v_city_daily",))
def merge_performance_defaults(spark, d):
    out = evaluate.merge_performance_defaults(measured(spark, d))
    return out.select("model", "metric", rnd("value").alias("value"), "origin")
