"""Projection and standardisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.catalog import views as v
from aerolake.catalog.registry import query, rnd, sql_advice, sql_category, sql_confidence, sql_day, sql_rnd, sql_season
from aerolake.functions import aqi as A
from aerolake.functions import calendar as C
from aerolake.functions import values as V
from aerolake.operators import cities, compare, features, standardize

KEY = ["l_orderkey", "l_linenumber"]


def _lines(spark, d):
    return v.table(spark, d, "lineitem")


@query("standardize_readings", """
    SELECT coalesce(CASE WHEN l_suppkey % 3 = 0 THEN cast(l_suppkey AS VARCHAR) END,
                    CASE WHEN l_suppkey % 3 < 2 THEN 'site ' || cast(l_suppkey AS VARCHAR) END,
                    'loc ' || cast(l_suppkey AS VARCHAR)) AS station,
           l_linestatus AS city, cast(l_shipdate AS DATE) AS date, l_quantity AS pm25, l_discount AS no2, l_tax AS aqi,
           l_extendedprice AS temperature
    FROM lineitem""")
def standardize_readings(spark, d):
    k = F.col("l_suppkey")
    raw = _lines(spark, d).select(
        F.when(k % 3 == 0, k.cast("string")).alias("station"),
        F.when(k % 3 < 2, F.concat(F.lit("site "), k.cast("string"))).alias("site"),
        F.concat(F.lit("loc "), k.cast("string")).alias("location"),
        F.col("l_linestatus").alias("City"), F.col("l_shipdate").cast("date").alias("Date"),
        F.col("l_quantity").alias("PM2.5"), F.col("l_discount").alias("NO2"), F.col("l_tax").alias("AQI"),
        F.col("l_extendedprice").alias("Temperature"), F.col("l_partkey").alias("other"),
    )
    return standardize.standardize_readings(raw)


@query("standardize_stations", """
    SELECT cast(s_suppkey AS VARCHAR) AS station_id,
           coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN s_name END, 'st ' || cast(s_suppkey AS VARCHAR)) AS station_name,
           CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE n_name END AS city, 'st ' || cast(s_suppkey AS VARCHAR) AS station,
           n_name AS state
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def standardize_stations(spark, d):
    s, n = v.table(spark, d, "supplier"), v.table(spark, d, "nation")
    k = F.col("s_suppkey")
    raw = s.join(n, s.s_nationkey == n.n_nationkey).select(
        k.cast("string").alias("StationId"), F.when(k % 4 != 0, F.concat(F.lit(" "), F.col("s_name"))).alias("name"),
        F.concat(F.lit("st "), k.cast("string")).alias("Station"),
        F.when(k % 5 == 0, F.when(k % 2 == 0, " Unknown ").otherwise("")).otherwise(F.concat("n_name", F.lit("  "))).alias("city"),
        F.col("n_name").alias("State"),
    )
    return standardize.standardize_stations(raw)


@query("infer_station_id", """
    SELECT l_orderkey, l_linenumber, cast(l_suppkey AS VARCHAR) AS station, cast(l_suppkey AS VARCHAR) AS station_id,
           cast(NULL AS VARCHAR) AS station_name, 'S' || l_returnflag AS other_station, cast(NULL AS VARCHAR) AS other_id,
           'S' || l_returnflag AS other_name
    FROM lineitem""")
def infer_station_id(spark, d):
    rows = _lines(spark, d).select(
        *KEY, F.col("l_suppkey").cast("string").alias("station"), F.concat(F.lit("S"), F.col("l_returnflag")).alias("other_station")
    )
    named = standardize.infer_station_id(rows, "other_station")
    named = named.withColumnsRenamed({"station_id": "other_id", "station_name": "other_name"})
    return standardize.infer_station_id(named, "station")


@query("derive_station", """
    SELECT l_orderkey, l_linenumber,
           coalesce(CASE WHEN l_suppkey % 3 = 0 THEN cast(l_suppkey AS VARCHAR) END,
                    CASE WHEN l_suppkey % 3 = 1 THEN 'N' || cast(l_suppkey AS VARCHAR) END, l_returnflag || '_Central') AS station
    FROM lineitem""")
def derive_station(spark, d):
    k = F.col("l_suppkey")
    rows = _lines(spark, d).select(
        *KEY, F.when(k % 3 == 0, k.cast("string")).alias("station_id"),
        F.when(k % 3 == 1, F.concat(F.lit("N"), k.cast("string"))).alias("station_name"), F.col("l_returnflag").alias("city"),
    )
    return standardize.derive_station(rows).select(*KEY, "station")


@query("coerce_dates", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS datetime,
           CASE WHEN l_linenumber <> 3 THEN cast(l_shipdate AS DATE) END AS date
    FROM lineitem""")
def coerce_dates(spark, d):
    text = F.when(F.col("l_linenumber") == 3, "not a date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    out = standardize.coerce_dates(_lines(spark, d).select(*KEY, text.alias("datetime")))
    return out.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))


@query("coerce_numeric", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2, 3) THEN NULL ELSE l_quantity END AS pm25,
           CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS aqi
    FROM lineitem""")
def coerce_numeric(spark, d):
    n = F.col("l_linenumber")
    rows = _lines(spark, d).select(
        *KEY,
        F.when(n == 1, "NA").when(n == 2, "NaN").when(n == 3, "n/a 7").otherwise(F.col("l_quantity").cast("string")).alias("pm25"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_extendedprice").cast("string")).alias("aqi"),
    )
    return standardize.coerce_numeric(rows)


@query("blank_to_null", """
    SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE s_name END AS city
    FROM supplier""")
def blank_to_null(spark, d):
    k = F.col("s_suppkey") % 5
    raw = F.when(k == 0, "").when(k == 1, " Unknown ").when(k == 2, "unknown").when(k == 4, F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")))
    return standardize.blank_to_null(v.table(spark, d, "supplier").select("s_suppkey", raw.alias("city")), ["city"])


@query("normalize_city", """
    SELECT station_id, copy, s.city AS city_original, a.canonical AS city, coalesce(a.canonical, lower(trim(s.city))) AS city_lower,
           coalesce(a.canonical, s.city) AS city_kept
    FROM v_stations s LEFT JOIN v_city_alias a ON lower(trim(s.city)) = a.alias""", ("v_stations", "v_city_alias"))
def normalize_city(spark, d):
    a = v.city_alias(spark, d)
    s = v.stations(spark, d).select("station_id", "copy", "city").withColumns({"city_lower": F.col("city"), "city_kept": F.col("city")})
    s = cities.normalize_city(s, a)
    s = cities.normalize_city(s, a, "city_lower", policy="lower")
    return cities.normalize_city(s, a, "city_kept", policy="keep")


@query("fill_unknown_categories", """
    SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag <> 'R' THEN l_returnflag END, 'Unknown') AS city,
           coalesce(CASE WHEN l_linenumber <> 2 THEN l_linestatus END, 'Unknown') AS aqi_bucket,
           CASE WHEN l_linenumber <> 4 THEN l_quantity END AS pm25
    FROM lineitem""")
def fill_unknown_categories(spark, d):
    n = F.col("l_linenumber")
    rows = _lines(spark, d).select(
        *KEY, F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("city"),
        F.when(n != 2, F.col("l_linestatus")).alias("aqi_bucket"), F.when(n != 4, F.col("l_quantity")).alias("pm25"),
    )
    return standardize.fill_unknown_categories(rows)


@query("temporal_features", """
    SELECT l_orderkey, l_linenumber, date, cast(year(date) AS INTEGER) AS year, cast(month(date) AS INTEGER) AS month,
           cast(isodow(date) - 1 AS INTEGER) AS dayofweek, cast(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS DOUBLE) AS is_weekend,
           cast(dayofyear(date) AS INTEGER) AS dayofyear
    FROM v_readings""", ("v_readings",))
def temporal_features(spark, d):
    return features.temporal_features(v.readings(spark, d).select(*KEY, "date"))


_CYC = ", ".join(
    f"{sql_rnd(f'{fn}(2 * pi() * ({part}) / {period})')} AS {name}_{fn}"
    for name, part, period in (("month", "month(date)", 12), ("dayofweek", "isodow(date) - 1", 7), ("dayofyear", "dayofyear(date)", 365.25))
    for fn in ("sin", "cos")
)


@query("cyclical_features", f"SELECT l_orderkey, l_linenumber, {_CYC} FROM v_readings", ("v_readings",))
def cyclical_features(spark, d):
    return v.readings(spark, d).select(*KEY, *[rnd(c).alias(n) for n, c in C.cyclical_fields("date").items()])


@query("season_flags", """
    SELECT l_orderkey, l_linenumber, cast(month(date) IN (11,12,1,2) AS DOUBLE) AS is_winter,
           cast(month(date) IN (3,4,5,6) AS DOUBLE) AS is_summer, cast(month(date) IN (7,8,9,10) AS DOUBLE) AS is_monsoon
    FROM v_readings""", ("v_readings",))
def season_flags(spark, d):
    return features.season_flags(v.readings(spark, d).select(*KEY, "date")).drop("date")


@query("fill_temporal_nulls", """
    SELECT l_orderkey, l_linenumber, cast(CASE WHEN l_linenumber = 5 THEN 2020 ELSE year(date) END AS INTEGER) AS year,
           cast(CASE WHEN l_linenumber = 5 THEN 0 ELSE month(date) END AS INTEGER) AS month,
           cast(CASE WHEN l_linenumber = 5 THEN 0 ELSE dayofyear(date) END AS INTEGER) AS dayofyear,
           cast(CASE WHEN l_linenumber = 5 THEN 0 ELSE cast(month(date) IN (11,12,1,2) AS INTEGER) END AS DOUBLE) AS is_winter
    FROM v_readings""", ("v_readings",))
def fill_temporal_nulls(spark, d):
    rows = v.readings(spark, d).select(*KEY, F.when(F.col("l_linenumber") != 5, F.col("date")).alias("date"))
    out = features.fill_temporal_nulls(features.season_flags(features.temporal_features(rows)), year=2020)
    return out.select(*KEY, "year", "month", "dayofyear", "is_winter")


@query("pollutant_ratios", f"""
    SELECT l_orderkey, l_linenumber, {sql_rnd("coalesce(pm25 / (pm10 + 0.000001::DOUBLE), 0.5)")} AS pm_ratio,
           {sql_rnd("pm25 / (pm10 + 0.00000001::DOUBLE)")} AS pm25_pm10_ratio,
           {sql_rnd("no2 / (o3 + 0.00000001::DOUBLE)", 2)} AS no2_o3_ratio
    FROM v_readings""", ("v_readings",))
def pollutant_ratios(spark, d):
    out = features.pollutant_ratios(v.readings(spark, d))
    return out.select(*KEY, rnd("pm_ratio").alias("pm_ratio"), rnd("pm25_pm10_ratio").alias("pm25_pm10_ratio"),
                      rnd("no2_o3_ratio", 2).alias("no2_o3_ratio"))


@query("aqi_category", f"""
    SELECT l_orderkey, l_linenumber, aqi, {sql_category("aqi")} AS category,
           CASE WHEN no2 = 0 THEN 'Unknown' ELSE {sql_category("no2")} END AS no2_category
    FROM v_readings""", ("v_readings",))
def aqi_category(spark, d):
    return v.readings(spark, d).select(
        *KEY, "aqi", A.aqi_category("aqi").alias("category"), A.aqi_category("no2", zero_is_unknown=True).alias("no2_category")
    )


@query("aqi_severity", """
    SELECT l_orderkey, l_linenumber, CASE WHEN aqi IS NULL THEN 2 WHEN aqi <= 50 THEN 0 WHEN aqi <= 100 THEN 1 WHEN aqi <= 200 THEN 2
           WHEN aqi <= 300 THEN 3 WHEN aqi <= 400 THEN 4 ELSE 5 END AS severity
    FROM v_readings""", ("v_readings",))
def aqi_severity(spark, d):
    return v.readings(spark, d).select(*KEY, A.aqi_severity("aqi").alias("severity"))


@query("aqi_band_onehot", """
    SELECT l_orderkey, l_linenumber, cast(coalesce(aqi > 0 AND aqi <= 50, false) AS DOUBLE) AS aqi_good,
           cast(coalesce(aqi > 50 AND aqi <= 100, false) AS DOUBLE) AS aqi_moderate,
           cast(coalesce(aqi > 100 AND aqi <= 150, false) AS DOUBLE) AS aqi_unhealthy_sensitive,
           cast(coalesce(aqi > 150, false) AS DOUBLE) AS aqi_unhealthy
    FROM v_readings""", ("v_readings",))
def aqi_band_onehot(spark, d):
    return features.aqi_band_onehot(v.readings(spark, d).select(*KEY, "aqi")).drop("aqi")


@query("aqi_eval_level", """
    SELECT l_orderkey, l_linenumber, CASE WHEN aqi <= 50 THEN 0 WHEN aqi <= 100 THEN 1 WHEN aqi <= 150 THEN 2
           WHEN aqi <= 200 THEN 3 WHEN aqi <= 300 THEN 4 WHEN aqi > 300 THEN 5 END AS level
    FROM v_readings""", ("v_readings",))
def aqi_eval_level(spark, d):
    return v.readings(spark, d).select(*KEY, A.aqi_eval_level("aqi").alias("level"))


@query("temp_humidity_interaction", f"""
    SELECT l_orderkey, l_linenumber, {sql_rnd("pm25 * pm10 / 100", 8)} AS temp_humidity_interaction FROM v_readings""", ("v_readings",))
def temp_humidity_interaction(spark, d):
    rows = v.readings(spark, d).withColumnsRenamed({"pm25": "temperature", "pm10": "humidity"})
    out = features.temp_humidity_interaction(rows)
    return out.select(*KEY, rnd("temp_humidity_interaction", 8).alias("temp_humidity_interaction"))


@query("clean_infinite", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2, 3) THEN NULL ELSE pm25 END AS pm25, pm10 FROM v_readings""",
       ("v_readings",))
def clean_infinite(spark, d):
    n = F.col("l_linenumber")
    bad = F.when(n == 1, float("inf")).when(n == 2, float("-inf")).when(n == 3, float("nan")).otherwise(F.col("pm25"))
    return standardize.clean_infinite(v.readings(spark, d).select(*KEY, bad.alias("pm25"), "pm10"))


@query("drop_empty_columns", "SELECT l_orderkey, l_linenumber, pm10 FROM v_readings", ("v_readings",))
def drop_empty_columns(spark, d):
    rows = v.readings(spark, d)
    empty = F.when(F.col("l_linenumber") > 100, F.col("pm25"))
    return standardize.drop_empty_columns(rows.select(*KEY, "pm10", empty.alias("so2"), F.lit(None).cast("string").alias("note")))


@query("clip_range", """
    SELECT l_orderkey, l_linenumber, least(greatest(aqi, 0), 500) AS c500, least(greatest(aqi, 30), 500) AS c30,
           least(greatest(aqi, 50), 400) AS c50
    FROM (SELECT l_orderkey, l_linenumber, aqi - 20 AS aqi FROM v_readings WHERE aqi IS NOT NULL)
    UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL, NULL FROM v_readings WHERE aqi IS NULL""", ("v_readings",))
def clip_range(spark, d):
    x = F.col("aqi") - 20
    return v.readings(spark, d).select(
        *KEY, V.clip(x, 0, 500).alias("c500"), V.clip(x, 30, 500).alias("c30"), V.clip(x, 50, 400).alias("c50")
    )


@query("health_advice", f"SELECT l_orderkey, l_linenumber, {sql_advice('category')} AS advice FROM "
       f"(SELECT *, {sql_category('aqi')} AS category FROM v_readings)", ("v_readings",))
def health_advice(spark, d):
    return v.readings(spark, d).select(*KEY, A.health_advice(A.aqi_category("aqi")).alias("advice"))


@query("provider_aqi_scale", """
    SELECT l_orderkey, l_linenumber, cast(CASE l_linenumber WHEN 1 THEN 50 WHEN 2 THEN 100 WHEN 3 THEN 150 WHEN 4 THEN 200
           WHEN 5 THEN 300 ELSE 150 END AS DOUBLE) AS aqi FROM lineitem""")
def provider_aqi_scale(spark, d):
    return _lines(spark, d).select(*KEY, A.provider_aqi("l_linenumber").alias("aqi"))


@query("seasonal_factor", f"SELECT l_orderkey, l_linenumber, {sql_season('date')} AS seasonal_factor FROM v_readings", ("v_readings",))
def seasonal_factor(spark, d):
    return v.readings(spark, d).select(*KEY, C.seasonal_factor("date").alias("seasonal_factor"))


@query("day_factor", f"SELECT l_orderkey, l_linenumber, {sql_day('date')} AS day_factor FROM v_readings", ("v_readings",))
def day_factor(spark, d):
    return v.readings(spark, d).select(*KEY, C.day_factor("date").alias("day_factor"))


_NAMES = ["delhi", "lucknow", "patna", "elsewhere"]


@query("default_city_level", """
    SELECT l_orderkey, l_linenumber, cast(CASE l_suppkey % 4 WHEN 0 THEN 280 WHEN 1 THEN 260 WHEN 2 THEN 240 ELSE 150 END AS DOUBLE) AS level
    FROM lineitem""")
def default_city_level(spark, d):
    city = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return _lines(spark, d).select(*KEY, A.default_city_level(city).alias("level"))


@query("station_class_adjustment", """
    SELECT p_partkey, cast(CASE p_size % 5 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN -15 WHEN 3 THEN -10 ELSE 0 END AS DOUBLE) AS adjustment
    FROM part""")
def station_class_adjustment(spark, d):
    k = F.col("p_size") % 5
    name = F.concat(F.col("p_brand"), F.when(k == 0, " Okhla Industrial").when(k == 1, " ANAND VIHAR").when(k == 2, " Lodhi Road")
                    .when(k == 3, " DTU").otherwise(" plain"))
    return v.table(spark, d, "part").select("p_partkey", A.station_class_adjustment(name).alias("adjustment"))


@query("align_features", """
    SELECT l_orderkey, l_linenumber, coalesce(pm10, 0) AS pm10, 0.0::DOUBLE AS so2, coalesce(aqi, 0) AS aqi FROM v_readings""", ("v_readings",))
def align_features(spark, d):
    return standardize.align_features(v.readings(spark, d), ["pm10", "so2", "aqi"], keep=KEY)


@query("pollutant_limit_status", """
    SELECT l_orderkey, l_linenumber, 'pm25' AS pollutant, pm25 AS value, CASE WHEN pm25 > 60 THEN 'Above Limit' ELSE 'Within Limit' END AS status
    FROM v_readings WHERE pm25 IS NOT NULL
    UNION ALL
    SELECT l_orderkey, l_linenumber, 'pm10', pm10, CASE WHEN pm10 > 100 THEN 'Above Limit' ELSE 'Within Limit' END
    FROM v_readings WHERE pm10 IS NOT NULL""", ("v_readings",))
def pollutant_limit_status(spark, d):
    return features.pollutant_limit_status(v.readings(spark, d).select(*KEY, "pm25", "pm10", "no2"), KEY, ["pm25", "pm10", "no2"])


@query("normalize_city_record", f"""
    SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN city END, CASE WHEN event_id % 3 = 1 THEN upper(city) END, 'Unknown') AS city,
           CASE WHEN event_id % 5 <> 0 THEN value END AS aqi,
           coalesce(CASE WHEN event_id % 4 = 0 THEN pollutant END,
                    {sql_category("CASE WHEN event_id % 5 <> 0 THEN value END")}) AS category,
           nullif(CASE WHEN event_id % 2 = 0 THEN 0 ELSE value END, 0) AS pm25
    FROM v_feed""", ("v_feed",))
def normalize_city_record(spark, d):
    e = F.col("event_id")
    f = v.feed(spark, d)
    raw = f.select(
        F.when(e % 3 == 0, F.col("city")).alias("city"), F.when(e % 3 == 1, F.upper("city")).alias("name"),
        F.when(e % 5 != 0, F.col("value")).alias("aqi"), F.when(e % 4 == 0, F.col("pollutant")).alias("category"),
        F.when(e % 2 == 0, 0.0).otherwise(F.col("value")).alias("PM2.5"), e.cast("string").alias("timestamp"),
    )
    out = compare.normalize_city_record(raw)
    return out.select(F.col("timestamp").cast("bigint").alias("event_id"), "city", "aqi", "category", "pm25")


@query("model_confidence", f"""
    SELECT l_orderkey, l_linenumber, {sql_confidence("model")} AS confidence,
           CASE WHEN l_quantity * 4 > 100 THEN 'high' ELSE 'medium' END AS station_confidence,
           cast(CASE WHEN l_quantity * 4 > 100 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS weight
    FROM (SELECT *, CASE l_linenumber WHEN 1 THEN 'random_forest' WHEN 2 THEN 'xgboost' WHEN 3 THEN 'gradient_boosting' WHEN 4 THEN 'nf_vae'
                 WHEN 5 THEN 'simple' WHEN 6 THEN 'simple_fallback' ELSE 'other' END AS model FROM lineitem)""")
def model_confidence(spark, d):
    names = ["random_forest", "xgboost", "gradient_boosting", "nf_vae", "simple", "simple_fallback", "other"]
    model = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber"))
    level = A.station_confidence(F.col("l_quantity") * 4)
    return _lines(spark, d).select(
        *KEY, A.model_confidence(model).alias("confidence"), level.alias("station_confidence"), A.confidence_weight(level).alias("weight")
    )


_ACC = "CASE WHEN aqi <> 0 AND no2 <> 0 THEN round(greatest(0.0::DOUBLE, 100 - abs(aqi - no2) / aqi * 100), 1) ELSE 0.0::DOUBLE END"


@query("prediction_accuracy", f"""
    SELECT *, CASE WHEN accuracy >= 90 THEN 'Excellent' WHEN accuracy >= 80 THEN 'Good' WHEN accuracy >= 70 THEN 'Fair' ELSE 'Poor' END AS tier
    FROM (SELECT l_orderkey, l_linenumber, {_ACC} AS accuracy FROM v_readings)""", ("v_readings",))
def prediction_accuracy(spark, d):
    rows = v.readings(spark, d).select(*KEY, A.prediction_accuracy("aqi", "no2").alias("accuracy"))
    return rows.withColumn("tier", A.accuracy_tier("accuracy"))


@query("aqi_scale_percent", f"""
    SELECT l_orderkey, l_linenumber, {sql_rnd("CASE WHEN aqi IS NULL THEN 0 ELSE least(aqi / 5, 100) END", 8)} AS percent FROM v_readings""", ("v_readings",))
def aqi_scale_percent(spark, d):
    return v.readings(spark, d).select(*KEY, rnd(A.aqi_scale_percent("aqi"), 8).alias("percent"))


@query("forecast_error_rows", f"""
    SELECT o_orderkey, aqi AS actual, {sql_rnd("avg_aqi", 4)} AS predicted, {sql_rnd("avg_aqi - aqi", 2)} AS difference,
           {sql_rnd("abs(avg_aqi - aqi)", 4)} AS absolute_difference
    FROM (SELECT o_orderkey, aqi, avg(aqi) OVER (PARTITION BY city) AS avg_aqi FROM v_city_daily)""", ("v_city_daily",))
def forecast_error_rows(spark, d):
    rows = v.city_daily(spark, d)
    mean = rows.groupBy("city").agg(F.avg("aqi").alias("predicted"))
    out = compare.forecast_error_rows(rows.join(mean, "city").withColumnRenamed("aqi", "actual"))
    return out.select("o_orderkey", "actual", rnd("predicted", 4).alias("predicted"), rnd("difference", 2).alias("difference"),
                      rnd("absolute_difference", 4).alias("absolute_difference"))


@query("bound_scaled", f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0.0 WHEN l_linenumber = 2 THEN 3.0 WHEN l_linenumber = 3 THEN -3.0
           ELSE coalesce({sql_rnd("(pm10 - 50) / 10")}, 0.0) END AS z
    FROM v_readings""", ("v_readings",))
def bound_scaled(spark, d):
    n = F.col("l_linenumber")
    z = F.when(n == 1, float("nan")).when(n == 2, float("inf")).when(n == 3, float("-inf")).otherwise((F.col("pm10") - 50) / 10)
    return v.readings(spark, d).select(*KEY, rnd(V.bound_scaled(z)).alias("z"))
