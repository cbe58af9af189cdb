"""Aggregation and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.catalog import views as v
from aerolake.catalog.q_joins import SQL_MERGED, SQL_MODEL_ROWS, SQL_METRICS, canonical_stations, measured, model_rows
from aerolake.catalog.registry import query, rnd, sql_category, sql_confidence, sql_rnd
from aerolake.functions import aqi as A
from aerolake.operators import compare, daily, evaluate, forecast, prepare, quality, sketches
from aerolake.session import shared_dir

KEY = ["l_orderkey", "l_linenumber"]
_RKEY = "l_orderkey, l_linenumber, l_partkey, station_id, dt"
FEATURES = ["pm25", "pm10", "no2", "o3", "aqi"]


@query("daily_aggregate", f"""
    SELECT station_id, date, {sql_rnd("avg(pm25)", 7)} AS pm25, {sql_rnd("avg(pm10)", 7)} AS pm10, {sql_rnd("avg(aqi)", 7)} AS aqi,
           arg_min(source_dataset, ({_RKEY.replace(", station_id", "")})) FILTER (source_dataset <> 'set_R') AS source_dataset
    FROM v_readings GROUP BY station_id, date""", ("v_readings",))
def daily_aggregate(spark, d):
    rows = v.readings(spark, d)
    rows = rows.withColumn("source_dataset", F.when(F.col("source_dataset") != "set_R", F.col("source_dataset")))
    out = daily.daily_aggregate(rows, ["station_id", "date"], order=["l_orderkey", "l_linenumber", "l_partkey", "dt"])
    return out.select("station_id", "date", *[rnd(m, 7).alias(m) for m in ("pm25", "pm10", "aqi")], "source_dataset")


@query("dataset_summary", """
    SELECT CASE WHEN grouping(source_dataset) = 1 THEN 'total' WHEN grouping(source_file) = 1 THEN 'dataset' ELSE 'file' END AS level,
           source_dataset, source_file, count(*) AS records, count(DISTINCT source_dataset || source_file) AS files
    FROM v_readings GROUP BY ROLLUP (source_dataset, source_file)""", ("v_readings",))
def dataset_summary(spark, d):
    return quality.dataset_summary(v.readings(spark, d))


@query("coverage_stats", """
    SELECT count(*) AS records, count(DISTINCT city) AS cities, count(DISTINCT lower(city)) AS original_cities,
           count(DISTINCT station) AS stations, count(DISTINCT station) AS datasets, min(date) AS first_date, max(date) AS last_date,
           cast(max(date) - min(date) AS INTEGER) AS total_days
    FROM v_city_daily""", ("v_city_daily",))
def coverage_stats(spark, d):
    rows = v.city_daily(spark, d).withColumns({"city_original": F.lower("city"), "source_dataset": F.col("station")})
    return quality.coverage_stats(rows)


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS non_null, count(*) AS n FROM v_readings" for c in FEATURES)


@query("completeness", f'SELECT name AS "column", non_null, {sql_rnd("non_null * 100.0 / n", 4)} AS percent FROM ({_LONG})', ("v_readings",))
def completeness(spark, d):
    out = quality.completeness(v.readings(spark, d), FEATURES)
    return out.withColumn("percent", rnd("percent", 4))


@query("reliable_features", """
    SELECT 'pm25' AS feature, count(pm25) AS non_null FROM v_readings
    UNION ALL SELECT 'pm10', count(pm10) FROM v_readings
    UNION ALL SELECT 'no2', count(*) FILTER (l_linenumber <= 3) FROM v_readings""", ("v_readings",))
def reliable_features(spark, d):
    n = F.col("l_linenumber")
    rows = v.readings(spark, d).withColumns({
        "no2": F.when(n <= 3, F.col("no2")), "o3": F.when(n <= 1, F.col("o3")), "so2": F.when(n <= 2, F.col("o3")),
    })
    return quality.reliable_features(rows, ["pm25", "pm10", "no2", "so2", "o3"])


_Q = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM skewed" for c in ("pm25", "pm10", "aqi")
)
_SKEWED = """SELECT l_orderkey, l_linenumber, pm25 * CASE WHEN l_partkey % 17 = 0 THEN 9 ELSE 1 END AS pm25, pm10, aqi * aqi / 100 AS aqi, 7.0 AS co
             FROM v_readings"""
_BOUNDS = f"SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM ({_Q})"


def _skewed(spark, d):
    return v.readings(spark, d).select(
        *KEY, (F.col("pm25") * F.when(F.col("l_partkey") % 17 == 0, 9).otherwise(1)).alias("pm25"), "pm10",
        (F.col("aqi") * F.col("aqi") / 100).alias("aqi"), F.lit(7.0).alias("co"),
    )


@query("iqr_bounds", f"""
    WITH skewed AS ({_SKEWED})
    SELECT feature, {sql_rnd("q1", 9)} AS q1, {sql_rnd("q3", 9)} AS q3, {sql_rnd("lower", 9)} AS lower, {sql_rnd("upper", 9)} AS upper
    FROM ({_BOUNDS})""", ("v_readings",))
def iqr_bounds(spark, d):
    out = quality.IqrBounds.fit(_skewed(spark, d)).frame(spark)
    return out.select("feature", *[rnd(c, 9).alias(c) for c in ("q1", "q3", "lower", "upper")])


@query("cap_outliers", f"""
    WITH skewed AS ({_SKEWED}), b AS ({_BOUNDS})
    SELECT l_orderkey, l_linenumber, {sql_rnd("least(greatest(s.pm25, p.lower), p.upper)", 4)} AS pm25,
           CASE WHEN s.aqi IS NOT NULL THEN {sql_rnd("least(greatest(s.aqi, a.lower), a.upper)", 4)} END AS aqi
    FROM skewed s, (SELECT * FROM b WHERE feature = 'pm25') p, (SELECT * FROM b WHERE feature = 'aqi') a""", ("v_readings",))
def cap_outliers(spark, d):
    out = quality.cap_outliers(_skewed(spark, d), ["pm25", "aqi", "co"])
    return out.select(*KEY, rnd("pm25", 4).alias("pm25"), rnd("aqi", 4).alias("aqi"))


@query("outlier_count", f"""
    WITH skewed AS ({_SKEWED}), b AS ({_BOUNDS})
    SELECT feature, count(*) FILTER (CASE feature WHEN 'pm25' THEN s.pm25 WHEN 'pm10' THEN s.pm10 ELSE s.aqi END < lower
                                  OR CASE feature WHEN 'pm25' THEN s.pm25 WHEN 'pm10' THEN s.pm10 ELSE s.aqi END > upper) AS outliers
    FROM skewed s, b GROUP BY feature""", ("v_readings",))
def outlier_count(spark, d):
    rows = _skewed(spark, d)
    return quality.IqrBounds.fit(rows).outlier_count(rows)


@query("city_average", f"""
    SELECT s_suppkey, n_name AS city, {sql_rnd("coalesce(mean_aqi, 150)")} AS mean_aqi
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
         LEFT JOIN (SELECT city, avg(aqi) AS mean_aqi FROM v_city_daily WHERE city > 'NATION_15' GROUP BY city) ON city = n_name""",
       ("v_city_daily",))
def city_average(spark, d):
    s, n = v.table(spark, d, "supplier"), v.table(spark, d, "nation")
    asked = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("city"))
    out = forecast.city_average(v.city_daily(spark, d).filter(F.col("city") > "NATION_15"), asked)
    return out.select("s_suppkey", "city", rnd("mean_aqi").alias("mean_aqi"))


def _station_predictions(spark, d):
    """Station means of the city series per day, shaped like station forecasts."""
    rows = v.city_daily(spark, d)
    mean = rows.groupBy("city", "date", "station").agg(F.avg("aqi").alias("raw"))
    return mean.select(
        "city", "date", F.col("station").alias("station_id"), F.col("station").alias("station_name"),
        F.lit("station_level").alias("prediction_type"), F.round("raw", 7).alias("predicted_aqi"), A.aqi_category("raw").alias("category"),
    )


# Halves are rounded up in Spark; the billionth has DuckDB do so too.
_SP = f"""SELECT city, date, station AS station_id, round(avg(aqi), 7) AS predicted_aqi, {sql_category("avg(aqi)")} AS category
          FROM v_city_daily GROUP BY city, date, station"""


@query("city_rollup_of_stations", f"""
    SELECT city, date, 'CITY_AVG' AS station_id, count(*) AS stations_count, round(avg(predicted_aqi) + 1e-9, 2) AS predicted_aqi,
           round(min(predicted_aqi) + 1e-9, 2) AS min_station_aqi, round(max(predicted_aqi) + 1e-9, 2) AS max_station_aqi
    FROM ({_SP}) GROUP BY city, date""", ("v_city_daily",))
def city_rollup_of_stations(spark, d):
    out = forecast.city_rollup_of_stations(_station_predictions(spark, d))
    return out.select("city", "date", "station_id", "stations_count", "predicted_aqi", "min_station_aqi", "max_station_aqi")


@query("prediction_summary", f"""
    WITH p AS ({_SP}), h AS (SELECT city, date, string_agg(category || ':' || cast(n AS VARCHAR), ',' ORDER BY category) AS histogram
                             FROM (SELECT city, date, category, count(*) AS n FROM p GROUP BY city, date, category) GROUP BY city, date)
    SELECT p.city, p.date, count(*) AS stations, any_value(histogram) AS histogram,
           arg_min(station_id, (-predicted_aqi, station_id)) AS worst_station, arg_min(station_id, (predicted_aqi, station_id)) AS best_station,
           round(avg(predicted_aqi) + 1e-9, 2) AS average_aqi, round(min(predicted_aqi) + 1e-9, 2) AS min_aqi, round(max(predicted_aqi) + 1e-9, 2) AS max_aqi,
           arg_min(category, (-predicted_aqi, station_id)) AS worst_category, arg_min(category, (predicted_aqi, station_id)) AS best_category
    FROM p JOIN h ON p.city = h.city AND p.date = h.date GROUP BY p.city, p.date""", ("v_city_daily",))
def prediction_summary(spark, d):
    out = compare.prediction_summary(_station_predictions(spark, d))
    entries = F.array_sort(F.transform(F.map_entries("category_distribution"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    stations = F.aggregate(F.map_values("category_distribution"), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("stations")
    return out.select(
        "city", "date", stations, F.array_join(entries, ",").alias("histogram"),
        F.col("worst_station.station_id").alias("worst_station"), F.col("best_station.station_id").alias("best_station"),
        "average_aqi", "min_aqi", "max_aqi", F.col("worst_station.category").alias("worst_category"), F.col("best_station.category").alias("best_category"),
    )


@query("quick_stats", """
    SELECT count(*) AS cities, round(avg(current_aqi), 1) AS average_aqi, arg_min(city, (-current_aqi, city)) AS worst_city FROM v_current""",
       ("v_current",))
def quick_stats(spark, d):
    return compare.quick_stats(v.current(spark, d).withColumnRenamed("current_aqi", "aqi"))


@query("category_distribution", f"""
    SELECT city, c.category, count(d.category) AS count
    FROM (SELECT DISTINCT city FROM v_city_daily) x
         CROSS JOIN (VALUES ('Good'), ('Satisfactory'), ('Moderate'), ('Poor'), ('Very Poor'), ('Severe')) c(category)
         LEFT JOIN (SELECT city, {sql_category("aqi")} AS category FROM v_city_daily) d USING (city, category)
    GROUP BY city, c.category""", ("v_city_daily",))
def category_distribution(spark, d):
    rows = v.city_daily(spark, d).withColumn("category", A.aqi_category("aqi"))
    return compare.category_distribution(rows, keys=["city"])


_M = ", ".join(f"{sql_rnd(m)} AS {m}" for m in ("RMSE", "MAE", "R2", "MSE"))


@query("regression_metrics", f"SELECT model, {_M}, rows FROM ({SQL_METRICS})", ("v_city_daily",))
def regression_metrics(spark, d):
    out = evaluate.regression_metrics(model_rows(spark, d))
    return out.select("model", *[rnd(m).alias(m) for m in evaluate.METRICS], "rows")


def _sql_level(x: str) -> str:
    return f"CASE WHEN {x} <= 50 THEN 0 WHEN {x} <= 100 THEN 1 WHEN {x} <= 150 THEN 2 WHEN {x} <= 200 THEN 3 WHEN {x} <= 300 THEN 4 ELSE 5 END"


@query("category_accuracy", f"""
    SELECT model, {sql_rnd(f"avg(CASE WHEN {_sql_level('actual')} = {_sql_level('predicted')} THEN 1.0 ELSE 0.0 END)")} AS category_accuracy,
           count(*) AS rows FROM ({SQL_MODEL_ROWS}) GROUP BY model""", ("v_city_daily",))
def category_accuracy(spark, d):
    out = evaluate.category_accuracy(model_rows(spark, d), keys=["model"])
    return out.withColumn("category_accuracy", rnd("category_accuracy"))


@query("prediction_statistics", f"""
    SELECT model, {sql_rnd("avg(predicted - 250)", 4)} AS mean, {sql_rnd("stddev_pop(predicted - 250)", 4)} AS std,
           {sql_rnd("min(predicted - 250)", 4)} AS min, {sql_rnd("max(predicted - 250)", 4)} AS max,
           count(*) FILTER (predicted < 250) AS negatives, stddev_pop(predicted) < 10 AS low_variance
    FROM ({SQL_MODEL_ROWS}) GROUP BY model""", ("v_city_daily",))
def prediction_statistics(spark, d):
    rows = model_rows(spark, d).withColumn("predicted", F.col("predicted") - 250)
    out = evaluate.prediction_statistics(rows, keys=["model"])
    return out.select("model", *[rnd(c, 4).alias(c) for c in ("mean", "std", "min", "max")], "negatives", "low_variance")


@query("city_profile", """
    SELECT d.city, count(*) AS records, min(date) AS first_date, max(date) AS last_date, count(DISTINCT station) AS stations,
           any_value(s.sample) AS sample
    FROM v_city_daily d JOIN (
        SELECT city, string_agg(cast(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS sample
        FROM (SELECT city, o_orderkey, row_number() OVER (PARTITION BY city ORDER BY station, date, o_orderkey) AS rn FROM v_city_daily)
        WHERE rn <= 3 GROUP BY city) s ON s.city = d.city
    GROUP BY d.city""", ("v_city_daily",))
def city_profile(spark, d):
    out = quality.city_profile(v.city_daily(spark, d), ["station", "date", "o_orderkey"])
    sample = F.array_join(F.transform("sample", lambda r: r["o_orderkey"].cast("string")), ",")
    return out.withColumn("sample", sample)


@query("system_counts", """
    SELECT count(*) AS records, count(DISTINCT city) AS cities_available, (SELECT count(DISTINCT city) FROM v_feed) AS realtime_cities
    FROM v_city_daily""", ("v_city_daily", "v_feed"))
def system_counts(spark, d):
    return quality.system_counts(v.city_daily(spark, d), v.feed(spark, d))


# ---- imputation, scaling, split ------------------------------------------------------------

_TRAIN = "date < DATE '2000-07-01'"


def _split(spark, d):
    rows = v.readings(spark, d)
    return rows, rows.filter(F.col("date") < F.lit("2000-07-01").cast("date"))


@query("median_impute", f"""
    SELECT l_orderkey, l_linenumber, {sql_rnd(f"coalesce(pm10, (SELECT median(pm10) FROM v_readings WHERE {_TRAIN}))", 8)} AS pm10,
           {sql_rnd(f"coalesce(aqi, (SELECT median(aqi) FROM v_readings WHERE {_TRAIN}))", 8)} AS aqi
    FROM v_readings""", ("v_readings",))
def median_impute(spark, d):
    rows, train = _split(spark, d)
    out = prepare.median_impute(train, rows, ["pm10", "aqi"])
    return out.select(*KEY, rnd("pm10", 8).alias("pm10"), rnd("aqi", 8).alias("aqi"))


_STATS = f"""SELECT (SELECT median(pm10) FROM v_readings WHERE {_TRAIN}) AS med, avg(x) AS mean, stddev_pop(x) AS std
             FROM (SELECT coalesce(pm10, (SELECT median(pm10) FROM v_readings WHERE {_TRAIN})) AS x FROM v_readings WHERE {_TRAIN})"""


@query("standard_scale", f"""
    WITH s AS ({_STATS})
    SELECT l_orderkey, l_linenumber, {sql_rnd("(coalesce(pm10, med) - mean) / std")} AS pm10,
           {sql_rnd(f"(pm25 - (SELECT avg(pm25) FROM v_readings WHERE {_TRAIN})) / (SELECT stddev_pop(pm25) FROM v_readings WHERE {_TRAIN})")} AS pm25
    FROM v_readings, s""", ("v_readings",))
def standard_scale(spark, d):
    rows, train = _split(spark, d)
    scaler = prepare.Scaler.fit(train, ["pm10", "pm25"])
    out = scaler.transform(scaler.impute(rows))
    return out.select(*KEY, rnd("pm10").alias("pm10"), rnd("pm25").alias("pm25"))


@query("inverse_scale", f"""
    WITH s AS ({_STATS})
    SELECT l_orderkey, l_linenumber, {sql_rnd("coalesce(pm10, med)", 8)} AS pm10,
           {sql_rnd(f"(pm25 - (SELECT avg(pm25) FROM v_readings WHERE {_TRAIN})) / (SELECT stddev_pop(pm25) FROM v_readings WHERE {_TRAIN})")} AS pm25
    FROM v_readings, s""", ("v_readings",))
def inverse_scale(spark, d):
    rows, train = _split(spark, d)
    scaler = prepare.Scaler.fit(train, ["pm10", "pm25"])
    out = scaler.inverse(scaler.transform(scaler.impute(rows)), ["pm10"])
    return out.select(*KEY, rnd("pm10", 8).alias("pm10"), rnd("pm25").alias("pm25"))


@query("encode_city", """
    SELECT o_orderkey, cast(dense_rank() OVER (ORDER BY city) - 1 AS INTEGER) AS city_encoded FROM v_city_daily""", ("v_city_daily",))
def encode_city(spark, d):
    from aerolake.operators.cities import encode_city as encode

    return encode(v.city_daily(spark, d)).select("o_orderkey", "city_encoded")


@query("random_split", """
    SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(cast(o_orderkey AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0
                                < 0.1 THEN 'test' ELSE 'train' END AS split
    FROM orders""")
def random_split(spark, d):
    return prepare.random_split(v.table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "split")


@query("ensemble_mean", f"""
    SELECT city, month, {sql_rnd("avg(predicted)")} AS predicted, count(*) AS samples
    FROM (SELECT city, cast(month(date) AS INTEGER) AS month, o_orderkey % 5 AS sample_id, sqrt(avg(aqi * aqi)) AS predicted FROM v_city_daily GROUP BY ALL)
    GROUP BY city, month""", ("v_city_daily",))
def ensemble_mean(spark, d):
    rows = v.city_daily(spark, d)
    samples = rows.groupBy("city", F.month("date").alias("month"), (F.col("o_orderkey") % 5).alias("sample_id")).agg(
        F.sqrt(F.avg(F.col("aqi") * F.col("aqi"))).alias("predicted")
    )
    return forecast.ensemble_mean(samples, ["city", "month"]).withColumn("predicted", rnd("predicted"))


# ---- model tables --------------------------------------------------------------------------


@query("best_model", f"SELECT arg_min(model, RMSE) AS model, {sql_rnd('min(RMSE)')} AS rmse FROM ({SQL_METRICS})", ("v_city_daily",))
def best_model(spark, d):
    return evaluate.best_model(measured(spark, d)).select("model", rnd("rmse").alias("rmse"))


@query("default_model", f"SELECT CASE WHEN count(*) FILTER (model = 'random_forest') > 0 THEN 'random_forest' ELSE 'simple' END AS model "
       f"FROM ({SQL_METRICS})", ("v_city_daily",))
def default_model(spark, d):
    return evaluate.default_model(evaluate.regression_metrics(model_rows(spark, d)).select("model"))


@query("model_registry", f"""
    SELECT model, CASE model WHEN 'nf_vae' THEN 'Normalizing Flow Variational Autoencoder (Primary)' WHEN 'random_forest' THEN 'Random Forest Regressor'
             WHEN 'gradient_boosting' THEN 'Gradient Boosting Regressor' WHEN 'simple' THEN 'Simple Pattern-based Prediction' ELSE model END AS description,
           {sql_rnd("max(value) FILTER (metric = 'RMSE')")} AS RMSE, {sql_rnd("max(value) FILTER (metric = 'MAE')")} AS MAE,
           {sql_rnd("max(value) FILTER (metric = 'R2') * 100")} AS R2, {sql_confidence("model")} AS confidence,
           model = 'random_forest' AS is_default
    FROM ({SQL_MERGED}) GROUP BY model""", ("v_city_daily",))
def model_registry(spark, d):
    out = evaluate.model_registry(evaluate.merge_performance_defaults(measured(spark, d)))
    return out.select("model", "description", *[rnd(m).alias(m) for m in ("RMSE", "MAE", "R2")], "confidence", "is_default")


@query("station_fallback", f"""
    WITH st AS (SELECT DISTINCT ON (station_id) station_id, station_name, canonical AS city
                FROM v_stations JOIN v_city_alias ON lower(trim(city)) = alias ORDER BY station_id, copy),
         m AS (SELECT city, avg(aqi) AS mean_aqi FROM v_city_history GROUP BY city)
    SELECT st.city, station_id, round(least(greatest(coalesce(mean_aqi, 150) + adj, 0), 500), 2) AS predicted_aqi, adj AS station_variation
    FROM (SELECT *, cast(CASE WHEN cast(station_id AS BIGINT) % 3 = 0 THEN 20 ELSE 0 END AS DOUBLE) AS adj FROM st) st LEFT JOIN m ON m.city = st.city""",
       ("v_stations", "v_city_history"))
def station_fallback(spark, d):
    named = canonical_stations(spark, d)
    name = F.when(F.col("station_id").cast("bigint") % 3 == 0, F.concat("station_name", F.lit(" Traffic"))).otherwise(F.col("station_name"))
    averages = v.city_history(spark, d).groupBy("city").agg(F.avg("aqi").alias("mean_aqi"))
    out = forecast.station_fallback(named.withColumn("station_name", name), averages)
    return out.select("city", "station_id", "predicted_aqi", "station_variation")


# ---- stored sketches -----------------------------------------------------------------------


def _in_parts(rows, key, out, names, measures):
    """Three batches merged into the profile stored at ``out``, each with rows of every month."""
    for number in range(3):
        sketches.add_rows(rows.filter(F.pmod(F.xxhash64(key), F.lit(3)) == number), number, out, names, measures)
    return sketches.stored(rows.sparkSession, out, names, measures)


@query("coverage_sketches", """
    SELECT count(*) AS records, count(DISTINCT city) AS city, count(DISTINCT station) AS station, min(date) AS first_date, max(date) AS last_date,
           cast(max(date) - min(date) AS INTEGER) AS total_days FROM v_city_daily""", ("v_city_daily",))
def coverage_sketches(spark, d):
    """Coverage from sketches of each month, stored and merged batch by batch; so few names are counted exactly."""
    stored = _in_parts(v.city_daily(spark, d), "o_orderkey", shared_dir(spark, "coverage"), ["city", "station"], [])
    return sketches.coverage(stored).select("records", "city", "station", "first_date", "last_date", "total_days")


@query("cities_in_both", """
    WITH h AS (SELECT DISTINCT city FROM v_city_history), l AS (SELECT DISTINCT city FROM v_feed)
    SELECT (SELECT count(*) FROM (SELECT city FROM h UNION SELECT city FROM l)) AS either, (SELECT count(*) FROM h JOIN l USING (city)) AS both,
           (SELECT count(*) FROM h ANTI JOIN l USING (city)) AS first_only""", ("v_city_history", "v_feed"))
def cities_in_both(spark, d):
    """Cities of the history that are live as well, from the sketches of both."""
    live = v.feed(spark, d).withColumn("date", F.to_date("ts"))
    return sketches.in_both(sketches.profile(v.city_history(spark, d), ["city"], []), sketches.profile(live, ["city"], []), "city")


@query("quantiles_from_sketches", """
    SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, TRUE AS near
    FROM (SELECT 'pm25' AS feature, pm25 AS x FROM v_readings UNION ALL SELECT 'aqi', aqi FROM v_readings) GROUP BY feature""", ("v_readings",))
def quantiles_from_sketches(spark, d):
    """Exact quartiles whose brackets come from stored sketches, and whether the sketches alone come within 3 % of the rows of them."""
    rows, names = v.readings(spark, d), ["pm25", "aqi"]
    stored = _in_parts(rows, "l_orderkey", shared_dir(spark, "kll"), [], names)
    exact = sketches.exact_quantiles(rows, stored, names, [0.25, 0.75])
    about = sketches.approximate_quantiles(stored, names, [0.22, 0.28, 0.72, 0.78])
    found = [(n, *exact[n], about[n][0] <= exact[n][0] <= about[n][1] and about[n][2] <= exact[n][1] <= about[n][3]) for n in names]
    return spark.createDataFrame(found, "feature string, q1 double, q3 double, near boolean")
