"""Streaming queries: the events table as a file stream, drained and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.catalog import views as v
from aerolake.catalog.registry import query, rnd, sql_accuracy, sql_category, sql_day, sql_rnd, sql_season
from aerolake.operators import forecast
from aerolake.plans.joins import settle
from aerolake.session import shared_dir
from aerolake.streaming import live


def _feed(spark, d):
    schema = v.table(spark, d, "events").schema
    return v.shape_feed(live.read_stream(spark, f"{d}/events.parquet", schema))


@query("stream_ingest", """
    SELECT event_id, coalesce(canonical, raw) AS city, value AS aqi, CASE WHEN pollutant = 'view' THEN value ELSE 0 END AS pm25,
           raw AS station FROM (SELECT *, 'nation_' || cast(station_id % 25 AS VARCHAR) AS raw FROM v_feed) f
    LEFT JOIN v_city_alias ON alias = raw WHERE pollutant <> 'error'""", ("v_feed", "v_city_alias"))
def stream_ingest(spark, d):
    f = _feed(spark, d)
    city = F.concat(F.lit(" NATION_"), (F.col("station_id") % 25).cast("string"))
    measures = F.struct(F.when(F.col("pollutant") == "view", F.struct(F.col("value").alias("v"))).alias("pm25"))
    data = F.struct(F.col("value").alias("aqi"), measures.alias("iaqi"))
    status = F.when(F.col("pollutant") == "error", "error").otherwise("ok")
    raw = f.select("event_id", "ts", city.alias("city"), F.to_json(F.struct(status.alias("status"), data.alias("data"))).alias("payload"))
    aliases = v.city_alias(spark, d)  # every alias in two spellings, of which one counts
    aliases = aliases.unionByName(aliases.withColumn("alias", F.concat(F.upper("alias"), F.lit(" "))))
    out = live.run_available(live.stream_ingest(raw, aliases), "ingest")
    return out.select("event_id", "city", "aqi", "pm25", F.lower(F.trim("station")).alias("station"))


@query("stream_dedupe", "SELECT event_id, value FROM v_feed", ("v_feed",))
def stream_dedupe(spark, d):
    """Every event sent twice, kept once."""
    f = _feed(spark, d)
    return live.run_available(live.stream_dedupe(f.union(_feed(spark, d))), "dedupe").select("event_id", "value")


@query("stream_ttl_dedupe", """
    SELECT city, event_id, value FROM v_feed
    WHERE time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' <= (SELECT max(ts) FROM v_feed) - INTERVAL '1 hour'
    QUALIFY row_number() OVER (PARTITION BY city, time_bucket(INTERVAL '5 minutes', ts) ORDER BY ts DESC, event_id DESC) = 1""", ("v_feed",))
def stream_ttl_dedupe(spark, d):
    f = _feed(spark, d).select("event_id", "ts", "city", "value")
    return live.run_available(live.stream_ttl(f), "ttl").select("city", "event_id", "value")


@query("stream_latest_city", """
    SELECT city, event_id, value FROM v_feed QUALIFY row_number() OVER (PARTITION BY city ORDER BY ts DESC, event_id DESC) = 1""", ("v_feed",))
def stream_latest_city(spark, d):
    f = _feed(spark, d).select("event_id", "ts", "city", "value")
    return live.run_available(live.stream_latest_city(f), "latest", "update", ["city"]).select("city", "event_id", "value")


@query("stream_compare", f"""
    WITH f AS (SELECT city, date, round(least(greatest(base * {sql_season("date")} * {sql_day("date")} * trend_factor, 30), 500), 2) AS p
               FROM (SELECT v_pattern.*, DATE '2024-01-01' + cast(i AS INTEGER) AS date FROM v_pattern, range(31) t(i)))
    SELECT event_id, e.city, f.date, p AS predicted_today, {sql_accuracy("value", "p")} AS accuracy, {sql_category("value")} AS category,
           CASE WHEN p < value THEN 'improving' ELSE 'worsening' END AS trend
    FROM v_feed e JOIN f ON f.city = e.city AND f.date = cast(e.ts AS DATE)""", ("v_feed", "v_pattern"))
def stream_compare(spark, d):
    hist = v.city_history(spark, d)
    table = forecast.predict_simple(forecast.forecast_spine(hist.select("city").distinct(), "2024-01-01", 31), hist)
    # Written once, so that a micro-batch reads a small file instead of computing the forecast again.
    table = settle(table, "forecast")
    out = live.run_available(live.stream_compare(_feed(spark, d), table), "compare")
    return out.select("event_id", "city", "date", "predicted_today", "accuracy", "category", "trend")


@query("stream_compare_published", f"""
    WITH f AS (SELECT city, date, round(least(greatest(base * {sql_season("date")} * {sql_day("date")} * trend_factor, 30), 500), 2) AS p
               FROM (SELECT v_pattern.*, DATE '2024-01-01' + cast(i AS INTEGER) AS date FROM v_pattern, range(31) t(i)))
    SELECT event_id, e.city, f.date, p AS predicted_today, {sql_accuracy("value", "p")} AS accuracy, CASE WHEN p < value THEN 'improving' ELSE 'worsening' END AS trend
    FROM v_feed e JOIN f ON f.city = e.city AND f.date = cast(e.ts AS DATE)""", ("v_feed", "v_pattern"))
def stream_compare_published(spark, d):
    """The feed joined with a stream of forecasts, each published at noon of the day before; readings that met one."""
    hist = v.city_history(spark, d)
    table = forecast.predict_simple(forecast.forecast_spine(hist.select("city").distinct(), "2024-01-01", 31), hist)
    sent = shared_dir(spark, "published")
    noon = F.expr("cast(date AS timestamp) - INTERVAL 12 hours")
    table.select("city", "date", "predicted_aqi", noon.alias("published")).write.parquet(sent)
    schema = "city string, date date, predicted_aqi double, published timestamp"
    out = live.run_available(live.stream_compare_published(_feed(spark, d), live.read_stream(spark, sent, schema)), "published-compare")
    return out.filter("predicted_today IS NOT NULL").select("event_id", "city", "date", "predicted_today", "accuracy", "trend")


@query("stream_daily", f"""
    SELECT station_id, cast(ts AS DATE) AS date, {sql_rnd("avg(value)", 7)} AS value, count(*) AS n FROM v_feed
    WHERE date_trunc('day', ts) + INTERVAL '1 day' <= (SELECT max(ts) FROM v_feed) - INTERVAL '1 hour'
    GROUP BY station_id, cast(ts AS DATE)""", ("v_feed",))
def stream_daily(spark, d):
    f = _feed(spark, d).select("station_id", "ts", "value")
    return live.run_available(live.stream_daily(f, ["station_id"]), "daily").withColumn("value", rnd("value", 7))


@query("stream_first_answer", """
    WITH RECURSIVE t AS (SELECT DISTINCT city, ts FROM v_feed),
    hop AS MATERIALIZED (SELECT a.city, a.ts, b.ts AS nxt FROM t a ASOF JOIN t b ON a.city = b.city AND a.ts + INTERVAL '5 minutes' <= b.ts),
    said AS (SELECT city, min(ts) AS ts FROM t GROUP BY city UNION ALL SELECT hop.city, hop.nxt FROM said JOIN hop ON hop.city = said.city AND hop.ts = said.ts)
    SELECT city, event_id, value FROM v_feed JOIN said USING (city, ts) QUALIFY row_number() OVER (PARTITION BY city, ts ORDER BY event_id) = 1""", ("v_feed",))
def stream_first_answer(spark, d):
    """The first reading of a city answers for five minutes from its own time."""
    f = _feed(spark, d).select("event_id", "ts", "city", "value")
    return live.run_available(live.stream_first_answer(f), "answers").select("city", "event_id", "value")


@query("stream_daily_states", f"""
    SELECT station_id, cast(ts AS DATE) AS date, {sql_rnd("avg(value)", 7)} AS value, min_by(pollutant, (ts, event_id)) AS pollutant, count(*) AS n FROM v_feed
    GROUP BY station_id, cast(ts AS DATE)""", ("v_feed",))
def stream_daily_states(spark, d):
    """The feed sent in five files, whose rows of any day come early and late; the daily table is that of all rows."""
    rows = v.feed(spark, d).select("event_id", "ts", "station_id", "pollutant", "value").withColumn("date", F.to_date("ts"))
    sent = shared_dir(spark, "sent")
    rows.repartition(5, F.pmod(F.xxhash64("event_id"), F.lit(5))).write.parquet(sent)
    stream = live.read_stream(spark, sent, rows.schema, maxFilesPerTrigger="1")
    out = live.run_daily_states(stream, "daily", ["station_id", "date"], ["value"], ["pollutant"], ["ts", "event_id"])
    return out.select("station_id", "date", rnd("value", 7).alias("value"), "pollutant", "n")
