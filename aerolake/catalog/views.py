"""Air-quality shapes over the given star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.operators.cities import normalize_city

AS_OF = "2001-08-01"
LIVE_AS_OF = "2024-01-31"
READING_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "station_id", "dt"]


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; its schema is inferred once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long history of readings."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        c("l_suppkey").cast("string").alias("station_id"),
        c("l_shipdate").alias("dt"), c("l_shipdate").cast("date").alias("date"),
        c("l_quantity").alias("pm25"),
        F.when(c("l_returnflag") != "R", c("l_extendedprice") / 1000).alias("pm10"),
        (c("l_discount") * 400).alias("no2"), (c("l_tax") * 500).alias("o3"),
        F.when(c("l_linenumber") != 7, c("l_extendedprice") / 200).alias("aqi"),
        (3 * c("l_quantity") + 200 * c("l_discount") + 50 * c("l_tax")).alias("label"),
        F.concat(F.lit("set_"), c("l_returnflag")).alias("source_dataset"),
        F.concat(F.lit("station_day_"), c("l_linestatus"), F.lit(".csv")).alias("source_file"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension with gaps, noisy city names and second copies; ``copy`` orders the copies."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    k = F.col("s_suppkey")
    noisy = F.when(k % 2 == 0, F.upper("n_name")).otherwise(F.lower("n_name"))
    padded = F.when(k % 3 == 0, F.concat(F.lit("  "), noisy, F.lit(" "))).otherwise(noisy)
    base = (
        s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).filter(k % 10 != 0)
        .select(
            k.cast("string").alias("station_id"), F.col("s_name").alias("station_name"), padded.alias("city"),
            F.col("r_name").alias("state"), k.alias("s_suppkey"),
            F.explode(F.when(k % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
    )
    return base.withColumn("station_name", F.when(F.col("copy") == 1, F.concat("station_name", F.lit(" bis"))).otherwise(F.col("station_name")))


def city_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").filter(k < 23).select(
        F.lower("n_name").alias("alias"), F.concat(F.lit("city_"), (k - k % 2).cast("string")).alias("canonical")
    )


def city_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .select(
            "o_orderkey", F.col("n_name").alias("city"), F.col("c_mktsegment").alias("station"),
            F.col("o_orderdate").cast("date").alias("date"), (F.col("o_totalprice") / 1000).alias("aqi"),
        )
    )


def city_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City history under canonical names, unmapped cities left out."""
    named = normalize_city(city_daily(spark, sf_dir), city_alias(spark, sf_dir), keep_original=False)
    return named.filter(F.col("city").isNotNull())


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_feed(table(spark, sf_dir, "events"))


def shape_feed(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("city_"), (F.col("user_id") % 10).cast("string")).alias("city"),
        F.col("user_id").alias("station_id"), F.col("event_type").alias("pollutant"), "value", "props",
    )


def identified_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings whose station is given by id, name or the plain station column."""
    k = F.col("station_id").cast("bigint")
    name = F.concat(F.lit("Supplier#"), F.lpad("station_id", 9, "0"))
    r = readings(spark, sf_dir)
    return r.select(
        "l_orderkey", "l_linenumber", "date", "aqi",
        F.concat(F.lit("city_"), (k % 5).cast("string")).alias("city"),
        F.when(k % 2 == 1, F.col("station_id")).alias("station_id"),
        F.when(k % 4 == 2, name).when(k % 2 == 1, F.col("station_id")).alias("station"),
        F.when((k % 4).isin(0, 3), name).alias("station_name"),
    )


def station_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("station_id"), F.col("s_name").alias("station_name"),
        F.concat(F.lit("city_"), (k % 5).cast("string")).alias("city"),
    )


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest live value per city."""
    from aerolake.operators.sets import latest_row

    newest = latest_row(feed(spark, sf_dir).select("city", "ts", "event_id", "value"), ["city"], ["ts", "event_id"])
    return newest.select("city", F.col("value").alias("current_aqi"))


_MOD = "l_suppkey % 4"

VIEWS = {
    "v_readings": """
        SELECT l_orderkey, l_linenumber, l_partkey, cast(l_suppkey AS VARCHAR) AS station_id, l_shipdate AS dt,
               cast(l_shipdate AS DATE) AS date, l_quantity AS pm25,
               CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 1000 END AS pm10,
               l_discount * 400 AS no2, l_tax * 500 AS o3,
               CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 200 END AS aqi,
               3 * l_quantity + 200 * l_discount + 50 * l_tax AS label,
               'set_' || l_returnflag AS source_dataset, 'station_day_' || l_linestatus || '.csv' AS source_file
        FROM lineitem""",
    "v_stations": """
        SELECT cast(s_suppkey AS VARCHAR) AS station_id,
               s_name || CASE WHEN copy = 1 THEN ' bis' ELSE '' END AS station_name,
               CASE WHEN s_suppkey % 3 = 0 THEN '  ' ELSE '' END
                 || CASE WHEN s_suppkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END
                 || CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE '' END AS city,
               r_name AS state, s_suppkey, copy
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
             (VALUES (0), (1)) copies(copy)
        WHERE s_suppkey % 10 <> 0 AND (copy = 0 OR s_suppkey % 7 = 0)""",
    "v_city_alias": """
        SELECT lower(n_name) AS alias, 'city_' || cast(n_nationkey - n_nationkey % 2 AS VARCHAR) AS canonical
        FROM nation WHERE n_nationkey < 23""",
    "v_city_daily": """
        SELECT o_orderkey, n_name AS city, c_mktsegment AS station, cast(o_orderdate AS DATE) AS date,
               o_totalprice / 1000 AS aqi
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "v_city_history": """
        SELECT o_orderkey, canonical AS city, station, date, aqi
        FROM v_city_daily JOIN v_city_alias ON lower(trim(city)) = alias""",
    "v_feed": """
        SELECT event_id, ts, 'city_' || cast(user_id % 10 AS VARCHAR) AS city, user_id AS station_id,
               event_type AS pollutant, value, props
        FROM events""",
    "v_identified": f"""
        SELECT l_orderkey, l_linenumber, cast(l_shipdate AS DATE) AS date,
               CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 200 END AS aqi,
               'city_' || cast(l_suppkey % 5 AS VARCHAR) AS city,
               CASE WHEN {_MOD} IN (1, 3) THEN cast(l_suppkey AS VARCHAR) END AS station_id,
               CASE WHEN {_MOD} = 2 THEN 'Supplier#' || lpad(cast(l_suppkey AS VARCHAR), 9, '0')
                    WHEN {_MOD} IN (1, 3) THEN cast(l_suppkey AS VARCHAR) END AS station,
               CASE WHEN {_MOD} IN (0, 3) THEN 'Supplier#' || lpad(cast(l_suppkey AS VARCHAR), 9, '0') END AS station_name
        FROM lineitem""",
    "v_requests": """
        SELECT cast(s_suppkey AS VARCHAR) AS station_id, s_name AS station_name,
               'city_' || cast(s_suppkey % 5 AS VARCHAR) AS city
        FROM supplier""",
    "v_current": """
        SELECT city, value AS current_aqi
        FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts DESC, event_id DESC) AS rn FROM v_feed)
        WHERE rn = 1""",
    "v_city_day": """
        SELECT city, date, sum(aqi) AS total, count(aqi) AS n, avg(aqi) AS aqi FROM v_city_history GROUP BY city, date""",
    "v_pattern": """
        SELECT city, sum(total) / sum(n) AS base, cast(sum(n) AS BIGINT) AS data_points,
               cast(CASE WHEN count(*) > 30 AND avg(aqi) FILTER (rn <= 15) < avg(aqi) FILTER (rn > 15 AND rn <= 30)
                    THEN 0.98 ELSE 1.0 END AS DOUBLE) AS trend_factor
        FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY date DESC) AS rn FROM v_city_day)
        GROUP BY city""",
}

# Views each view builds on.
NEEDS = {
    "v_city_history": ("v_city_daily", "v_city_alias"),
    "v_current": ("v_feed",),
    "v_city_day": ("v_city_history",),
    "v_pattern": ("v_city_day",),
}


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """Put the named views and those they build on before ``sql``, which may start with its own ``WITH``."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
