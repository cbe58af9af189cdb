"""Ordered queries over daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.catalog import views as v
from aerolake.catalog.registry import query, rnd, sql_rnd
from aerolake.operators import daily, sets, windows

_DAY = """SELECT station_id, date, avg(pm25) AS pm25, avg(pm10) AS pm10, avg(no2) AS no2, avg(aqi) AS aqi FROM v_readings GROUP BY station_id, date"""
_CITY = "SELECT city, date, avg(aqi) AS aqi, max(aqi) AS top FROM v_city_daily GROUP BY city, date"


def station_days(spark, d):
    return daily.daily_aggregate(v.readings(spark, d), ["station_id", "date"], ["pm25", "pm10", "no2", "aqi"], ())


def city_days(spark, d):
    return v.city_daily(spark, d).groupBy("city", "date").agg(F.avg("aqi").alias("aqi"), F.max("aqi").alias("top"))


_LAGS = ", ".join(f"{sql_rnd(f'lag({c}, {k}) OVER w', 7)} AS {c}_lag_{k}" for c in ("pm25", "aqi") for k in (1, 2, 7, 30))


@query("lag_features", f"SELECT station_id, date, {_LAGS} FROM ({_DAY}) WINDOW w AS (PARTITION BY station_id ORDER BY date)", ("v_readings",))
def lag_features(spark, d):
    out = windows.lag_features(station_days(spark, d), ["station_id"], ["pm25", "aqi"])
    return out.select("station_id", "date", *[rnd(c, 7).alias(c) for c in out.columns if "_lag_" in c])


_CAL = ", ".join(f"{sql_rnd(f'd{k}.top', 7)} AS top_lag_{k}" for k in (1, 2, 7, 30))
_CALJ = " ".join(f"LEFT JOIN d d{k} ON d{k}.city = d.city AND d{k}.date = d.date - {k}" for k in (1, 2, 7, 30))


@query("lag_features_calendar", f"WITH d AS ({_CITY}) SELECT d.city, d.date, {_CAL} FROM d {_CALJ}", ("v_city_daily",))
def lag_features_calendar(spark, d):
    out = windows.lag_features(city_days(spark, d), ["city"], ["top"], calendar=True)
    return out.select("city", "date", *[rnd(c, 7).alias(c) for c in out.columns if "_lag_" in c])


_KEPT = f"""SELECT * FROM ({_DAY}) WHERE cast(station_id AS BIGINT) % 9 <> 0 OR date < DATE '1995-02-10'"""


def _kept(spark, d):
    rows = station_days(spark, d)
    short = F.col("station_id").cast("bigint") % 9 == 0
    return rows.filter(~short | (F.col("date") < F.lit("1995-02-10").cast("date")))


_WINDOW = f"""SELECT station_id, cast(p.i AS INTEGER) AS position, date, pm25, pm10, aqi, n
    FROM (SELECT *, least(n, 24) - rn AS pos, least(n, 24) AS size
          FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY station_id) AS n
                FROM ({_KEPT})) WHERE rn <= 24) r
    JOIN range(24) p(i) ON p.i = pos OR (pos = size - 1 AND p.i >= size)"""


@query("recent_window", f"""
    SELECT station_id, position, date, {sql_rnd("pm25", 7)} AS pm25, {sql_rnd("pm10", 7)} AS pm10, {sql_rnd("aqi", 7)} AS aqi FROM ({_WINDOW})""",
       ("v_readings",))
def recent_window(spark, d):
    out = windows.explode_window(windows.recent_window(_kept(spark, d), ["station_id"], ["pm25", "pm10", "aqi"]), ["station_id"])
    return out.select("station_id", "position", "date", *[rnd(c, 7).alias(c) for c in ("pm25", "pm10", "aqi")])


@query("window_validity", f"""
    SELECT station_id, cast(least(any_value(n), 24) AS INTEGER) AS rows, cast(least(count(pm25), count(pm10), count(aqi)) AS INTEGER) AS valid_rows,
           least(count(pm25), count(pm10), count(aqi)) < 12 AS low_quality
    FROM ({_WINDOW}) GROUP BY station_id""", ("v_readings",))
def window_validity(spark, d):
    packed = windows.recent_window(_kept(spark, d), ["station_id"], ["pm25", "pm10", "aqi"])
    return windows.window_validity(packed, ["pm25", "pm10", "aqi"]).drop("window")


_GAPS = f"""SELECT station_id, date, CASE WHEN dayofmonth(date) % 3 = 0 THEN pm10 END AS pm10,
            CASE WHEN cast(station_id AS BIGINT) % 5 <> 0 AND dayofmonth(date) % 4 = 1 THEN aqi END AS aqi,
            CASE WHEN date > DATE '1998-01-01' AND dayofmonth(date) < 9 THEN no2 END AS no2 FROM ({_DAY})"""


def _fill(c: str, default: float) -> str:
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), {default})"
    )


@query("fill_forward_backward", f"""
    SELECT station_id, date, {sql_rnd(_fill("pm10", 100.0), 7)} AS pm10, {sql_rnd(_fill("aqi", 150.0), 7)} AS aqi, {sql_rnd(_fill("no2", 0.5), 7)} AS no2
    FROM ({_GAPS})""", ("v_readings",))
def fill_forward_backward(spark, d):
    day, k = F.dayofmonth("date"), F.col("station_id").cast("bigint")
    rows = station_days(spark, d).select(
        "station_id", "date", F.when(day % 3 == 0, F.col("pm10")).alias("pm10"),
        F.when((k % 5 != 0) & (day % 4 == 1), F.col("aqi")).alias("aqi"),
        F.when((F.col("date") > F.lit("1998-01-01").cast("date")) & (day < 9), F.col("no2")).alias("no2"),
    )
    out = windows.fill_forward_backward(rows, ["station_id"], ["pm10", "aqi", "no2"])
    return out.select("station_id", "date", *[rnd(c, 7).alias(c) for c in ("pm10", "aqi", "no2")])


@query("trend_factor", f"""
    SELECT city, cast(CASE WHEN count(*) > 30 AND avg(aqi) FILTER (rn <= 15) < avg(aqi) FILTER (rn > 15 AND rn <= 30) THEN 0.98 ELSE 1.0 END AS DOUBLE)
           AS trend_factor
    FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY date DESC) AS rn FROM ({_CITY}) WHERE city <> 'NATION_3' OR date < DATE '1995-01-20')
    GROUP BY city""", ("v_city_daily",))
def trend_factor(spark, d):
    rows = v.city_daily(spark, d).filter((F.col("city") != "NATION_3") | (F.col("date") < F.lit("1995-01-20").cast("date")))
    return windows.trend_factor(windows.city_daily_mean(rows))


@query("sequence_windows", f"""
    WITH d AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY city) AS n,
                      CASE WHEN top <= 499.5 THEN top END AS x FROM ({_CITY}))
    SELECT s.city, cast(s.i AS INTEGER) AS start, s.date AS start_date, {sql_rnd("sum(d.x) FILTER (d.i < s.i + 24)", 5)} AS history_sum,
           {sql_rnd("sum(d.x) FILTER (d.i >= s.i + 24)", 5)} AS target_sum, min(d.date) FILTER (d.i >= s.i + 24) AS target_date
    FROM d s JOIN d ON d.city = s.city AND d.i >= s.i AND d.i < s.i + 48
    WHERE s.i < s.n - 48 AND s.i % 2 = 0
    GROUP BY s.city, s.i, s.date HAVING count(d.x) = 48""", ("v_city_daily",))
def sequence_windows(spark, d):
    rows = city_days(spark, d).withColumn("top", F.when(F.col("top") <= 499.5, F.col("top")))
    out = windows.sequence_windows(rows, ["city"], ["top"], ["top"], 24, 24, stride=2)

    def total(c):
        return F.aggregate(F.transform(c, lambda x: x["top"]), F.lit(0.0), lambda a, x: a + x)

    return out.select("city", "start", "start_date", rnd(total("history"), 5).alias("history_sum"), rnd(total("target"), 5).alias("target_sum"),
                      F.col("target")[0]["date"].alias("target_date"))


@query("latest_row", """
    SELECT station_id, l_orderkey, l_linenumber, date, pm25 FROM v_readings
    QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1""", ("v_readings",))
def latest_row(spark, d):
    out = sets.latest_row(v.readings(spark, d), ["station_id"], ["date", "l_orderkey", "l_linenumber", "l_partkey"])
    return out.select("station_id", "l_orderkey", "l_linenumber", "date", "pm25")


@query("day_trend", f"""
    SELECT city, date, CASE WHEN aqi > lag(aqi) OVER w THEN 'up' WHEN aqi < lag(aqi) OVER w THEN 'down' ELSE 'flat' END AS trend
    FROM ({_CITY}) WINDOW w AS (PARTITION BY city ORDER BY date)""", ("v_city_daily",))
def day_trend(spark, d):
    return windows.day_trend(city_days(spark, d), ["city"], "aqi").select("city", "date", "trend")


_PER_DAY = """SELECT date, count(*) AS n, sum(count(*)) OVER (ORDER BY date) - count(*) AS before, sum(count(*)) OVER () AS total
              FROM v_city_daily GROUP BY date"""


def _cut(share: str) -> str:
    return f"(SELECT min(date) FROM ({_PER_DAY}) WHERE before >= floor(total * {share}))"


@query("chrono_split", f"""
    SELECT o_orderkey, CASE WHEN date < {_cut("0.8")} THEN 'train' ELSE 'validation' END AS split,
           CASE WHEN date < {_cut("0.6")} THEN 'train' WHEN date < {_cut("0.8")} THEN 'validation' ELSE 'test' END AS split3
    FROM v_city_daily""", ("v_city_daily",))
def chrono_split(spark, d):
    rows = windows.chrono_split(v.city_daily(spark, d), (0.6, 0.2, 0.2), ("train", "validation", "test")).withColumnRenamed("split", "split3")
    return windows.chrono_split(rows).select("o_orderkey", "split", "split3")
