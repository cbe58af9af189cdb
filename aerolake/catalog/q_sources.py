"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.catalog import views as v
from aerolake.catalog.q_joins import SQL_METRICS, measured
from aerolake.catalog.registry import query, rnd, sql_category, sql_rnd
from aerolake.operators import standardize
from aerolake.plans import ingestion
from aerolake.session import shared_dir
from aerolake.sources import csv_tree, feeds, sinks


def _write_csv(df, path, encoding="UTF-8"):
    df.write.option("header", "true").option("encoding", encoding).csv(path)


@query("scan_csv_tree", """
    SELECT cast(l_orderkey AS BIGINT) AS row_id, cast(l_suppkey AS VARCHAR) AS station_id, cast(l_shipdate AS DATE) AS date, l_quantity AS pm25,
           CASE WHEN l_linenumber <= 3 THEN l_extendedprice END AS aqi, CASE WHEN l_linenumber > 3 THEN l_returnflag END AS city, 'tables' AS source_dataset,
           'unknown' AS file_type
    FROM lineitem""")
def scan_csv_tree(spark, d):
    """The line items written as two sets of CSV files with different headers, then scanned as one tree."""
    rows = v.table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    root = shared_dir(spark, "csv-tree")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    _write_csv(rows.filter(n <= 3).select(
        F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("station_id"), day.alias("date"), F.col("l_quantity").alias("PM2.5"),
        F.col("l_extendedprice").alias("AQI")), f"{root}/a")
    _write_csv(rows.filter(n > 3).select(
        F.col("l_returnflag").alias("City"), F.col("l_quantity").alias("pm25"), day.alias("Date"), F.col("l_suppkey").alias("StationId"),
        F.col("l_orderkey").alias("row_id")), f"{root}/deep/b")
    frames = csv_tree.scan_csv_tree(spark, root, "tables")
    parts = [standardize.standardize_readings(f, keep=["row_id", *standardize.PROVENANCE]) for f in frames["unknown"]]
    out = standardize.union_by_name(parts)
    out = standardize.coerce_numeric(standardize.coerce_dates(out))
    return out.select(F.col("row_id").cast("bigint").alias("row_id"), "station_id", "date", "pm25", "aqi", "city", "source_dataset", "file_type")


def _write_named(df, root, name):
    """CSV files whose names tell their type, as providers send them."""
    _write_csv(df, f"{root}/{name}")
    _rename_parts(df.sparkSession, f"{root}/{name}", name)


def _rename_parts(spark, path, name):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    for i, part in enumerate(parts):
        fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(folder, f"{name}_{i}.csv"))


@query("ingest_tree", f"""
    WITH r AS (SELECT cast(l_suppkey AS VARCHAR) AS station, cast(l_shipdate AS DATE) + 7305 AS date, l_quantity AS pm25, l_extendedprice / 200 AS aqi FROM lineitem),
         dim AS (SELECT station_id, canonical AS city FROM v_stations JOIN v_city_alias ON lower(trim(city)) = alias WHERE copy = 0)
    SELECT city, station, date, {sql_rnd("avg(pm25)", 9)} AS pm25, {sql_rnd("avg(aqi)", 9)} AS aqi FROM r JOIN dim ON station_id = station
    WHERE date BETWEEN DATE '2015-01-01' AND DATE '2024-12-31' GROUP BY city, station, date""", ("v_stations", "v_city_alias"))
def ingest_tree(spark, d):
    """From a tree of CSV files with mixed headers, some in two spellings, and a station file to the daily table."""
    rows, root, n = v.table(spark, d, "lineitem"), shared_dir(spark, "ingest"), F.col("l_linenumber")
    day = F.date_format(F.date_add(F.col("l_shipdate").cast("date"), 7305), "yyyy-MM-dd")
    pm, aqi, station = F.col("l_quantity"), (F.col("l_extendedprice") / 200).alias("AQI"), F.col("l_suppkey")
    two = rows.filter(n <= 4).select(
        station.alias("StationId"), day.alias("Date"), F.when(n % 2 == 1, pm).alias("PM2.5"), F.when(n % 2 == 0, pm).alias("pm2_5_copy"), aqi)
    # A data frame cannot hold both spellings: the second header is written as text.
    lines = two.select(F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in two.columns]).alias("StationId,Date,PM2.5,pm2.5,AQI"))
    lines.write.option("header", "true").option("sep", "\u0001").option("quote", "").csv(f"{root}/raw")
    _rename_parts(spark, f"{root}/raw", "station_day_a")
    _write_named(rows.filter(n > 4).select(station.alias("station_id"), pm.alias("pm25"), aqi, day.alias("date")), root, "station_day_b")
    named = v.stations(spark, d).filter("copy = 0")
    _write_named(named.select(F.col("station_id").alias("StationId"), F.col("station_name").alias("StationName"), F.col("city").alias("City"), F.col("state").alias("State")), root, "stations")
    aliases = v.city_alias(spark, d)
    aliases = aliases.unionByName(aliases.select(F.col("canonical").alias("alias"), "canonical").distinct())
    daily, _ = ingestion.ingest(spark, {"tables": root}, aliases)
    return daily.select("city", "station", "date", rnd("pm25", 9).alias("pm25"), rnd("aqi", 9).alias("aqi"))


@query("scan_csv_encoding", """
    SELECT o_orderkey, 'Málaga ' || o_orderpriority AS city, o_totalprice AS aqi FROM orders""")
def scan_csv_encoding(spark, d):
    """Half of the orders in UTF-8 files and half in Latin-1 files, read back as the same text."""
    rows = v.table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("Málaga "), F.col("o_orderpriority")).alias("City"), F.col("o_totalprice").alias("AQI")
    )
    root = shared_dir(spark, "csv-encoding")
    _write_csv(rows.filter(F.col("o_orderkey") % 2 == 0), f"{root}/utf8")
    _write_csv(rows.filter(F.col("o_orderkey") % 2 == 1), f"{root}/latin1", "ISO-8859-1")
    out = standardize.union_by_name(csv_tree.scan_csv_tree(spark, root, "tables")["unknown"])
    out = standardize.coerce_numeric(standardize.standardize_readings(out, keep=["o_orderkey"]))
    return out.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "city", "aqi")


# A name per file type, in the order of the types.
_PREFIXES = ["City_Day", "city_hour", "STATION_DAY", "station_hour", "stations", "aqi_data", "raw_data", "notes"]
_KINDS = ["city_daily", "city_hourly", "station_daily", "station_hourly", "station_metadata", "aqi_data", "general_data", "unknown"]


def _file_name():
    prefix = F.element_at(F.array(*[F.lit(p) for p in _PREFIXES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return F.concat(prefix, F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".csv"))


_KIND = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_PREFIX = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_PREFIXES)) + " END"


@query("classify_file_type", f"SELECT p_partkey, {_KIND} AS file_type FROM part")
def classify_file_type(spark, d):
    return v.table(spark, d, "part").select("p_partkey", standardize.classify_file_type(_file_name()).alias("file_type"))


@query("add_provenance", f"""
    SELECT p_partkey, p_brand AS source_dataset, {_PREFIX} || '_' || cast(p_partkey AS VARCHAR) || '.csv' AS source_file, {_KIND} AS file_type FROM part""")
def add_provenance(spark, d):
    return standardize.add_provenance(v.table(spark, d, "part"), "p_brand", _file_name()).select(
        "p_partkey", "source_dataset", "source_file", "file_type"
    )


def _iaqi(spark, d):
    """Live rows as nested-measure payloads; the event type decides which measures are present."""
    f = v.feed(spark, d)
    value = F.struct(F.col("value").alias("v"))

    def when(*kinds):
        return F.when(F.col("pollutant").isin(*kinds), value)

    data = F.struct(
        F.col("value").alias("aqi"),
        F.when(F.col("event_id") % 3 != 0, F.struct(F.concat(F.lit("st "), F.col("station_id").cast("string")).alias("name"))).alias("city"),
        F.struct(when("view", "click").alias("pm25"), when("click", "purchase").alias("no2"), when("signup").alias("t")).alias("iaqi"),
    )
    status = F.when(F.col("pollutant") == "error", "error").otherwise("ok")
    return f.select("event_id", "ts", "city", F.to_json(F.struct(status.alias("status"), data.alias("data"))).alias("payload"))


@query("parse_feed_iaqi", """
    SELECT event_id, city, value AS aqi, CASE WHEN pollutant IN ('view', 'click') THEN value ELSE 0 END AS pm25,
           CASE WHEN pollutant IN ('click', 'purchase') THEN value ELSE 0 END AS no2, CASE WHEN pollutant = 'signup' THEN value ELSE 0 END AS temperature,
           0.0::DOUBLE AS wind_speed, CASE WHEN event_id % 3 <> 0 THEN 'st ' || cast(station_id AS VARCHAR) ELSE city END AS station, 'waqi' AS source
    FROM v_feed WHERE pollutant <> 'error'""", ("v_feed",))
def parse_feed_iaqi(spark, d):
    out = feeds.parse_feed_iaqi(_iaqi(spark, d))
    return out.select("event_id", "city", "aqi", "pm25", "no2", "temperature", "wind_speed", "station", "source")


@query("parse_feed_variant", """
    SELECT event_id, city, CASE WHEN event_id % 11 = 0 THEN 0 ELSE value END AS aqi, CASE WHEN event_id % 11 <> 0 AND pollutant IN ('view', 'click') THEN value ELSE 0 END AS pm25,
           CASE WHEN event_id % 11 <> 0 AND event_id % 5 = 0 THEN value + 1 END AS radon, event_id % 11 = 0 AS malformed, event_id % 11 <> 0 AND pollutant <> 'error' AS usable
    FROM v_feed""", ("v_feed",))
def parse_feed_variant(spark, d):
    """Payloads of which every fifth has a measure nobody asked for and every eleventh is cut off."""
    e = F.col("event_id")
    raw = v.feed(spark, d).select("event_id", "value").join(_iaqi(spark, d), "event_id")
    extra = F.concat(F.lit('"iaqi":{"r":{"v":'), (F.col("value") + 1).cast("string"), F.lit('},"note":{"v":"low"},'))
    more = F.when(e % 5 == 0, F.replace(F.replace("payload", F.lit('"iaqi":{'), extra), F.lit(",}"), F.lit("}"))).otherwise(F.col("payload"))
    cut = F.when(e % 11 == 0, F.substring(more, 1, 25)).otherwise(more)
    out = feeds.parse_feed_variant(raw.withColumn("payload", cut))
    return out.select("event_id", "city", "aqi", "pm25", F.try_element_at("other_measures", F.lit("r")).alias("radon"), "malformed", "usable")


@query("parse_feed_components", """
    SELECT event_id, city, cast(CASE event_id % 7 WHEN 1 THEN 50 WHEN 2 THEN 100 WHEN 3 THEN 150 WHEN 4 THEN 200 WHEN 5 THEN 300 ELSE 150 END AS DOUBLE) AS aqi,
           value AS pm25, CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END AS o3, 0.0::DOUBLE AS co
    FROM v_feed WHERE pollutant <> 'error'""", ("v_feed",))
def parse_feed_components(spark, d):
    f = v.feed(spark, d)
    e = F.col("event_id")
    first = F.struct(
        F.struct((e % 7).alias("aqi")).alias("main"),
        F.struct(F.col("value").alias("pm2_5"), F.when(e % 2 == 0, F.col("value")).alias("o3")).alias("components"),
    )
    empty = F.expr("cast(array() AS array<struct<main:struct<aqi:bigint>,components:struct<pm2_5:double,o3:double>>>)")
    items = F.when(F.col("pollutant") == "error", empty).otherwise(F.array(first, first))
    raw = f.select("event_id", "city", F.to_json(F.struct(items.alias("list"))).alias("payload"))
    return feeds.parse_feed_components(raw).select("event_id", "city", "aqi", "pm25", "o3", "co")


@query("parse_props", """
    SELECT event_id, coalesce(cast(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM v_feed""", ("v_feed",))
def parse_props(spark, d):
    """Single measure out of the feed's JSON column, 0 when absent."""
    k = F.from_json("props", "k bigint")["k"]
    return v.feed(spark, d).select("event_id", F.coalesce(k, F.lit(0).cast("bigint")).alias("k"))


@query("feed_source_priority", """
    SELECT station_id, event_id, pollutant AS source, value FROM v_feed WHERE pollutant IN ('view', 'click')
    QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY CASE pollutant WHEN 'view' THEN 1 ELSE 2 END, ts DESC, event_id DESC) = 1""", ("v_feed",))
def feed_source_priority(spark, d):
    f = v.feed(spark, d).select("station_id", "event_id", F.col("pollutant").alias("source"), "ts", "value")
    return feeds.feed_source_priority(f, ["view", "click"], city="station_id").select("station_id", "event_id", "source", "value")


@query("write_performance", f"""
    SELECT model, 'test' AS scope, metric, {sql_rnd("value")} AS value
    FROM (UNPIVOT (SELECT model, RMSE, MAE, R2, MSE FROM ({SQL_METRICS})) ON RMSE, MAE, R2, MSE INTO NAME metric VALUE value)""", ("v_city_daily",))
def write_performance(spark, d):
    """Half of the metrics written with stale values, merged with the new ones, written and read back."""
    new = measured(spark, d)
    old = new.withColumn("value", F.lit(-1.0))
    path = shared_dir(spark, "performance")
    sinks.write_performance(sinks.merge_performance(old, new), path)
    return spark.read.parquet(path).select("model", "scope", "metric", rnd("value").alias("value"))


@query("to_json_records", """
    SELECT l_orderkey, l_linenumber, cast(date AS VARCHAR) AS date, CASE WHEN l_linenumber = 2 THEN NULL ELSE pm25 END AS pm25, 5 AS fields FROM v_readings""",
       ("v_readings",))
def to_json_records(spark, d):
    n = F.col("l_linenumber")
    rows = v.readings(spark, d).select("l_orderkey", "l_linenumber", "date", F.when(n == 2, float("nan")).otherwise(F.col("pm25")).alias("pm25"), "pm10")
    j = sinks.to_json_records(rows)
    back = F.from_json("json", "l_orderkey bigint, l_linenumber int, date string, pm25 double")
    return j.select(back.alias("r"), F.size(F.json_object_keys("json")).alias("fields")).select("r.*", "fields")


# ---- flows ---------------------------------------------------------------------------------

_ENHANCED = """
    SELECT a.canonical AS city, r.station_id AS station, r.date, avg(r.pm25) AS pm25, avg(r.pm10) AS pm10, avg(r.aqi) AS aqi
    FROM (SELECT *, 'nation_' || cast(cast(station_id AS BIGINT) % 25 AS VARCHAR) AS alias FROM v_readings) r JOIN v_city_alias a USING (alias)
    WHERE r.date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY a.canonical, r.station_id, r.date"""


def _enhanced(spark, d):
    k = F.col("station_id").cast("bigint")
    rows = v.readings(spark, d).select(
        F.concat(F.lit(" NATION_"), (k % 25).cast("string")).alias("city"), F.col("station_id").alias("station"), "date", "pm25", "pm10", "aqi",
        F.col("source_dataset"), "source_file", F.col("dt").cast("timestamp").alias("datetime"),
    )
    return ingestion.enhance(rows, v.city_alias(spark, d), "1996-01-01", "2000-12-31")


@query("enhance_readings", f"""
    SELECT city, station, date, {sql_rnd("pm25", 7)} AS pm25, {sql_rnd("pm10", 7)} AS pm10, {sql_rnd("aqi", 7)} AS aqi FROM ({_ENHANCED})""",
       ("v_readings", "v_city_alias"))
def enhance_readings(spark, d):
    """Canonical cities, known cities, date range and daily means in one flow."""
    return _enhanced(spark, d).select("city", "station", "date", *[rnd(c, 7).alias(c) for c in ("pm25", "pm10", "aqi")])


_CAP = " , ".join(
    f"(SELECT quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3 FROM e) b_{c}" for c in ("pm25", "aqi")
)


def _capped(c: str) -> str:
    return (
        f"CASE WHEN {c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) THEN {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) "
        f"WHEN {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1) THEN {c}_q3 + 1.5 * ({c}_q3 - {c}_q1) ELSE {c} END"
    )


@query("preprocess_readings", f"""
    WITH e AS ({_ENHANCED})
    SELECT city, station, date, {sql_rnd(_capped("pm25"), 7)} AS pm25, {sql_rnd(_capped("aqi"), 7)} AS aqi, {sql_category("aqi")} AS aqi_category,
           {sql_rnd("coalesce(pm25 / (pm10 + 0.000001::DOUBLE), 0.5)")} AS pm_ratio, {sql_rnd("sin(2 * pi() * month(date) / 12)")} AS month_sin,
           cast(month(date) IN (11,12,1,2) AS DOUBLE) AS is_winter
    FROM e, {_CAP}""", ("v_readings", "v_city_alias"))
def preprocess_readings(spark, d):
    """The daily table with features, capped outliers and clean categories."""
    out = ingestion.preprocess(_enhanced(spark, d))
    return out.select("city", "station", "date", rnd("pm25", 7).alias("pm25"), rnd("aqi", 7).alias("aqi"), "aqi_category",
                      rnd("pm_ratio").alias("pm_ratio"), rnd("month_sin").alias("month_sin"), "is_winter")
