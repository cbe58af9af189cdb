"""Filter, set, order and limit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.catalog import views as v
from aerolake.catalog.registry import query, rnd, sql_rnd
from aerolake.operators import cities, compare, daily, forecast, sets, standardize, stations
from aerolake.plans.joins import join_dimension, settle

KEY = ["l_orderkey", "l_linenumber"]


@query("drop_null_dates", "SELECT l_orderkey, l_linenumber, date FROM v_readings WHERE l_linenumber <> 5", ("v_readings",))
def drop_null_dates(spark, d):
    rows = v.readings(spark, d).select(*KEY, F.when(F.col("l_linenumber") != 5, F.col("date")).alias("date"))
    return daily.drop_null_dates(rows)


@query("keep_known_cities", """
    SELECT o_orderkey, city, date, aqi FROM v_city_daily WHERE lower(city) IN (SELECT alias FROM v_city_alias)""",
       ("v_city_daily", "v_city_alias"))
def keep_known_cities(spark, d):
    known = v.city_alias(spark, d).select(F.upper("alias").alias("city"))
    return cities.keep_known_cities(v.city_daily(spark, d), known).select("o_orderkey", "city", "date", "aqi")


@query("date_range", """
    SELECT l_orderkey, l_linenumber, date, pm25 FROM v_readings WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""", ("v_readings",))
def date_range(spark, d):
    return daily.date_range(v.readings(spark, d), "1996-01-01", "2000-12-31").select(*KEY, "date", "pm25")


@query("drop_null_target", "SELECT l_orderkey, l_linenumber, aqi FROM v_readings WHERE aqi IS NOT NULL", ("v_readings",))
def drop_null_target(spark, d):
    return daily.drop_null_target(v.readings(spark, d)).select(*KEY, "aqi")


_ANY = """
    SELECT r.request_station, r.city, i.l_orderkey, i.l_linenumber, i.aqi
    FROM v_identified i JOIN (
        SELECT DISTINCT city, CASE WHEN cast(station_id AS BIGINT) % 3 = 0 THEN station_name ELSE station_id END AS request_station
        FROM v_requests) r
      ON i.city = r.city AND (i.station_id = r.request_station OR i.station = r.request_station OR i.station_name = r.request_station)"""


@query("station_match_any", _ANY, ("v_identified", "v_requests"))
def station_match_any(spark, d):
    req = v.station_requests(spark, d)
    asked = F.when(F.col("station_id").cast("bigint") % 3 == 0, F.col("station_name")).otherwise(F.col("station_id"))
    out = stations.match_station_any(v.identified_readings(spark, d), req.select("city", asked.alias("request_station")))
    return out.select("request_station", "city", "l_orderkey", "l_linenumber", "aqi")


_MATCH = """
    SELECT r.station_id AS request_id, r.station_name AS request_name, i.*,
           CASE WHEN i.station_id = r.station_id THEN 1 WHEN i.station_name = r.station_name THEN 2 WHEN i.station = r.station_name THEN 3 END AS match_rank
    FROM v_identified i JOIN v_requests r
      ON i.station_id = r.station_id OR i.station_name = r.station_name OR i.station = r.station_name"""


@query("station_match_cascade", f"""
    WITH m AS ({_MATCH})
    SELECT request_id, match_rank, l_orderkey, l_linenumber, aqi
    FROM (SELECT *, min(match_rank) OVER (PARTITION BY request_id) AS best FROM m) WHERE match_rank = best""", ("v_identified", "v_requests"))
def station_match_cascade(spark, d):
    rows, keys = stations.match_station_cascade(v.identified_readings(spark, d), v.station_requests(spark, d))
    # Names are unique in the requests, so putting the requests back repeats no row.
    per_request = keys.select(F.col("station_id").alias("request_id"), F.col("match_rank"), "match_key")
    out = join_dimension(rows, per_request, ["match_rank", "match_key"], "inner")
    return out.select("request_id", "match_rank", "l_orderkey", "l_linenumber", "aqi")


@query("valid_stations", """
    SELECT coalesce(id, name) AS station_id, coalesce(name, id) AS station_name, city, state, 'Unknown' AS station_type, 'Active' AS status
    FROM (SELECT CASE WHEN s_suppkey % 4 <> 1 THEN station_id END AS id,
                 CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN NULL ELSE station_name END AS name,
                 trim(city) AS city, CASE WHEN s_suppkey % 2 = 0 THEN state ELSE 'Unknown' END AS state FROM v_stations)
    WHERE coalesce(name, id) IS NOT NULL AND coalesce(name, id) <> 'unknown'""", ("v_stations",))
def valid_stations(spark, d):
    k = F.col("s_suppkey")
    raw = v.stations(spark, d).select(
        F.when(k % 4 != 1, F.col("station_id")).alias("station_id"),
        F.when(k % 5 == 1, "unknown").when(k % 5 == 2, "").when(k % 5 > 2, F.col("station_name")).alias("station_name"),
        F.trim("city").alias("city"), F.when(k % 2 == 0, F.col("state")).alias("state"),
    )
    return stations.valid_stations(raw).drop("latitude", "longitude")


@query("valid_status_rows", """
    SELECT event_id, city, value AS aqi FROM v_feed WHERE event_id % 7 NOT IN (0, 1, 2, 3) AND value <> 0""", ("v_feed",))
def valid_status_rows(spark, d):
    e = F.col("event_id") % 7
    raw = v.feed(spark, d).select(
        "event_id", F.when(e == 0, F.lit("")).when(e != 1, F.col("city")).alias("city"),
        F.when(e == 2, float("nan")).when(e == 3, 0.0).otherwise(F.col("value")).alias("aqi"),
    )
    return compare.valid_status_rows(raw)


@query("expected_range_check", """
    WITH ranges AS (SELECT city, avg(aqi) - 60 AS low, avg(aqi) + 90 AS high FROM v_city_daily GROUP BY city)
    SELECT o_orderkey, d.city, CASE WHEN aqi BETWEEN low AND high THEN 'REASONABLE' ELSE 'SUSPICIOUS' END AS status
    FROM v_city_daily d JOIN ranges USING (city)""", ("v_city_daily",))
def expected_range_check(spark, d):
    rows = v.city_daily(spark, d)
    ranges = rows.groupBy("city").agg((F.avg("aqi") - 60).alias("low"), (F.avg("aqi") + 90).alias("high"))
    ranges = settle(ranges, "ranges")
    return compare.expected_range_check(rows, ranges, "aqi").select("o_orderkey", "city", "status")


@query("forecast_horizon", """
    SELECT o_orderkey, date FROM v_city_daily WHERE date BETWEEN DATE '1998-05-01' AND DATE '1998-05-31'""", ("v_city_daily",))
def forecast_horizon(spark, d):
    return forecast.forecast_horizon(v.city_daily(spark, d), "1998-05-01", 30).select("o_orderkey", "date")


@query("sort_series", "SELECT o_orderkey, city, station, date, aqi FROM v_city_daily ORDER BY city, station, date, o_orderkey", ("v_city_daily",))
def sort_series(spark, d):
    return sets.sort_series(v.city_daily(spark, d), ["city", "station", "date", "o_orderkey"])


_MEANS = "SELECT city, avg(aqi) AS aqi, avg(aqi) FILTER (station = 'BUILDING') AS pm25 FROM v_city_daily GROUP BY city"


def _city_means(spark, d):
    rows = v.city_daily(spark, d)
    return rows.groupBy("city").agg(F.avg("aqi").alias("aqi"), F.avg(F.when(F.col("station") == "BUILDING", F.col("aqi"))).alias("pm25"))


@query("worst_cities", f"SELECT city, {sql_rnd('aqi')} AS aqi FROM ({_MEANS}) ORDER BY {'aqi'} DESC, city LIMIT 6", ("v_city_daily",))
def worst_cities(spark, d):
    return compare.worst_cities(_city_means(spark, d)).select("city", rnd("aqi").alias("aqi"))


@query("ranked_cities", f"""
    SELECT * FROM (SELECT 'pm25' AS sorted_by, city, {sql_rnd('aqi')} AS aqi FROM ({_MEANS}) ORDER BY coalesce(pm25, 0) DESC, city LIMIT 8)
    UNION ALL
    SELECT * FROM (SELECT 'city', city, {sql_rnd('aqi')} FROM ({_MEANS}) ORDER BY city LIMIT 8)
    UNION ALL
    SELECT 'selected', city, {sql_rnd('aqi')} FROM ({_MEANS}) WHERE city IN ('NATION_3', 'NATION_7')""", ("v_city_daily",))
def ranked_cities(spark, d):
    means = _city_means(spark, d)
    parts = [
        compare.ranked_cities(means, "pm25").withColumn("sorted_by", F.lit("pm25")),
        compare.ranked_cities(means, "city").withColumn("sorted_by", F.lit("city")),
        compare.ranked_cities(means, "aqi", ["NATION_3", "NATION_7"]).withColumn("sorted_by", F.lit("selected")),
    ]
    return standardize.union_by_name(parts).select("sorted_by", "city", rnd("aqi").alias("aqi"))


@query("sample_values", "SELECT DISTINCT station_name FROM v_stations ORDER BY station_name LIMIT 10", ("v_stations",))
def sample_values(spark, d):
    return sets.sample_values(v.stations(spark, d), "station_name", 10)


@query("union_by_name", """
    SELECT station_id, date, pm25, NULL::DOUBLE AS aqi, NULL::VARCHAR AS city FROM v_readings
    UNION ALL SELECT station, date, NULL, aqi, city FROM v_city_daily""", ("v_readings", "v_city_daily"))
def union_by_name(spark, d):
    a = v.readings(spark, d).select("station_id", "date", "pm25")
    b = v.city_daily(spark, d).select("aqi", "city", F.col("station").alias("station_id"), "date")
    return standardize.union_by_name({"station_daily": [a], "city_daily": [b], "unknown": [a]})


@query("distinct_rows", "SELECT DISTINCT station_id, station, station_name, city FROM v_identified", ("v_identified",))
def distinct_rows(spark, d):
    return sets.distinct_rows(v.identified_readings(spark, d), ["station_id", "station", "station_name", "city"])


@query("dedupe_keep_first", """
    SELECT city, station, date, o_orderkey, aqi FROM v_city_daily
    QUALIFY row_number() OVER (PARTITION BY city, station, date ORDER BY o_orderkey) = 1""", ("v_city_daily",))
def dedupe_keep_first(spark, d):
    rows = v.city_daily(spark, d).select("city", "station", "date", "o_orderkey", "aqi")
    return sets.dedupe_keep_first(rows, ["city", "station", "date"], ["o_orderkey"])
