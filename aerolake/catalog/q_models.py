"""Training and scoring queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from aerolake.catalog import views as v
from aerolake.catalog.registry import query, rnd, sql_category, sql_day, sql_rnd, sql_season
from aerolake.functions import aqi as A
from aerolake.operators import daily, forecast, models, prepare, sets
from aerolake.plans import training
from aerolake.plans.joins import settle
from aerolake.session import shared_dir
from aerolake.sources import sinks

KEY = ["l_orderkey", "l_linenumber"]
FEATURES = ["pm25", "pm10", "no2", "o3", "month_sin", "month_cos", "dayofyear_sin", "dayofyear_cos"]

_OLS = """SELECT l_orderkey, l_linenumber, round(regr_intercept(label, pm25) OVER () + regr_slope(label, pm25) OVER () * pm25, 4) AS predicted
          FROM v_readings"""


def _score_line(model, rows):
    return model.transform(rows).select(*KEY, rnd("prediction", 4).alias("predicted"))


@query("train_linear", _OLS, ("v_readings",))
def train_linear(spark, d):
    rows = v.readings(spark, d).select(*KEY, "pm25", "label")
    return _score_line(models.train_model(rows, ["pm25"], "label", LinearRegression()), rows)


def _stored(spark, d):
    rows = v.readings(spark, d).select(*KEY, "pm25", "label")
    return rows, sinks.save_model(models.train_model(rows, ["pm25"], "label", LinearRegression()), shared_dir(spark, "model"))


@query("save_model", """
    SELECT round(regr_intercept(label, pm25), 6) + 0.0 AS intercept, round(regr_slope(label, pm25), 6) + 0.0 AS slope FROM v_readings""", ("v_readings",))
def save_model(spark, d):
    """The stored files of a fitted model, read as a plain table."""
    _, path = _stored(spark, d)
    parts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{path}/stages")
    return parts.filter("coefficients IS NOT NULL").select(
        rnd("intercept").alias("intercept"), rnd(vector_to_array("coefficients")[0]).alias("slope")
    )


@query("load_model", _OLS, ("v_readings",))
def load_model(spark, d):
    """A fitted model written to the shared folder, read back and used for scoring."""
    rows, path = _stored(spark, d)
    return _score_line(sinks.load_model(path), rows)


def station_days(spark, d):
    """Daily rows per station with the learnable target and calendar features."""
    rows = v.readings(spark, d).withColumnRenamed("station_id", "city")
    days = daily.daily_aggregate(rows, ["city", "date"], ["pm25", "pm10", "no2", "o3", "label"], ())
    return training.training_table(days.withColumnRenamed("label", "aqi"))


def _splits(spark, d):
    return prepare.random_split(station_days(spark, d), ["city", "date"])


@query("training_table", f"""
    WITH days AS (SELECT station_id AS city, date, avg(pm25) AS pm25, avg(pm10) AS pm10, avg(label) AS aqi FROM v_readings GROUP BY station_id, date)
    SELECT city, date, {sql_rnd("pm25", 7)} AS pm25, {sql_rnd("pm10", 7)} AS pm10, {sql_rnd("aqi", 7)} AS aqi, cast(year(date) AS INTEGER) AS year,
           {sql_rnd("sin(2 * pi() * month(date) / 12)")} AS month_sin, {sql_rnd("cos(2 * pi() * dayofyear(date) / 365.25)")} AS dayofyear_cos,
           CASE WHEN ('0x' || substr(md5(city || '|' || cast(date AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0
                     < 0.1 THEN 'test' ELSE 'train' END AS split
    FROM days""", ("v_readings",))
def training_table(spark, d):
    """The rows every trained model sees, with their split."""
    out = _splits(spark, d)
    return out.select("city", "date", *[rnd(c, 7).alias(c) for c in ("pm25", "pm10", "aqi")], "year",
                      *[rnd(c).alias(c) for c in ("month_sin", "dayofyear_cos")], "split")


def _trained(spark, d, *names, **sizes):
    """Models of smaller size than the defaults, which take many minutes for a query; see the README."""
    estimators = {n: e for n, e in models.regressors(**sizes).items() if not names or n in names}
    return models.train_all_evaluate(_splits(spark, d), FEATURES, "aqi", estimators, keep=["city", "date"])


# The label is a linear function of the inputs: a line finds it exactly, trees come near it.
_TESTS = """SELECT count(*) AS n FROM (SELECT DISTINCT station_id, date FROM v_readings)
            WHERE ('0x' || substr(md5(station_id || '|' || cast(date AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 < 0.1"""


def _judged(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS model, n AS rows, TRUE AS accurate, {'TRUE' if m == 'linear_regression' else 'FALSE'} AS exact, TRUE AS consistent FROM ({_TESTS})" for m in names)


def _metrics(result):
    """Number of test rows, and what must hold for the errors."""
    return result.metrics.select(
        "model", "rows", (F.col("R2") > 0.5).alias("accurate"), ((F.col("RMSE") < 1e-6) & (F.col("R2") > 1 - 1e-9)).alias("exact"),
        ((F.abs(F.col("RMSE") * F.col("RMSE") - F.col("MSE")) < 1e-6) & (F.col("MAE") <= F.col("RMSE"))).alias("consistent"),
    )


@query("train_random_forest", _judged("random_forest"), ("v_readings",))
def train_random_forest(spark, d):
    return _metrics(_trained(spark, d, "random_forest", trees=20, random_forest=10))


@query("train_gbt", _judged("gradient_boosting"), ("v_readings",))
def train_gbt(spark, d):
    return _metrics(_trained(spark, d, "gradient_boosting", rounds=10))


@query("train_all_evaluate", _judged("linear_regression", "random_forest", "gradient_boosting", "xgboost", "lightgbm"), ("v_readings",))
def train_all_evaluate(spark, d):
    return _metrics(_trained(spark, d, trees=10, rounds=5, random_forest=8, lightgbm=7))


@query("feature_importance", "SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature, TRUE AS in_range, TRUE AS sums_to_one, TRUE AS informed")
def feature_importance(spark, d):
    """Every feature once; the importances of a forest add up to one, and most of it falls to a column the label depends on."""
    found = models.feature_importance(_trained(spark, d, "random_forest", trees=10, random_forest=8).models["random_forest"], FEATURES, spark)
    total = found.agg(F.sum("importance").alias("s"), F.max_by("feature", "importance").alias("top"))
    return found.crossJoin(F.broadcast(total)).select(
        "feature", F.col("importance").between(0, 1).alias("in_range"), (F.abs(F.col("s") - 1) < 1e-9).alias("sums_to_one"), (F.col("top") == "pm25").alias("informed")
    )


_TRUTHS = "TRUE AS in_range, TRUE AS category_agrees"


def _plausible(out):
    return [F.col("predicted_aqi").between(0, 600).alias("in_range"), (A.aqi_category("predicted_aqi") == F.col("category")).alias("category_agrees")]


@query("predict_batch", f"""
    SELECT city, DATE '{v.AS_OF}' + cast(i AS INTEGER) AS date, {_TRUTHS} FROM (SELECT DISTINCT station_id AS city FROM v_readings), range(14) t(i)""", ("v_readings",))
def predict_batch(spark, d):
    """Every station for fourteen days, scored by one boosted model over prepared scoring features."""
    days = settle(station_days(spark, d), "station-days")
    inputs = [*FEATURES, "city_encoded"]
    model = models.train_model(days, inputs, "aqi", models.regressors(rounds=5)["gradient_boosting"])
    last = sets.latest_row(days.select("city", "date", "pm25", "pm10", "no2", "o3"), ["city"], ["date"])
    spine = forecast.forecast_spine(days.select("city").distinct(), v.AS_OF, 14)
    rows = forecast.scoring_features(spine, last, FEATURES, None)
    out = models.score(rows, model)
    return out.select("city", "date", *_plausible(out))


_DAYS = """
    day AS (SELECT city, date, avg(aqi) AS aqi, sum(aqi) AS total, count(aqi) AS n FROM v_city_daily GROUP BY city, date),
    d AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY city) AS c,
                 row_number() OVER (PARTITION BY city ORDER BY date DESC) AS rn FROM day),
    pattern AS (SELECT city, sum(total) / sum(n) AS base, cast(CASE WHEN count(*) > 30 AND avg(aqi) FILTER (rn <= 15) < avg(aqi) FILTER (rn > 15 AND rn <= 30)
                THEN 0.98 ELSE 1.0 END AS DOUBLE) AS trend FROM d GROUP BY city),
    asked AS (SELECT DISTINCT city FROM day UNION ALL SELECT 'lucknow'),
    spine AS (SELECT city, cast(k - 3 AS INTEGER) AS day_offset, DATE '%s' + cast(k - 3 AS INTEGER) AS date FROM asked, range(33) t(k))""" % v.AS_OF


def _lines(rows: str) -> str:
    """Least squares of the value h rows later on the value now, over every second row of a series with 25 rows to come."""
    return f"""SELECT h, regr_slope(t.aqi, s.aqi) AS b, regr_intercept(t.aqi, s.aqi) AS a FROM {rows} s, range(1, 25) r(h), {rows} t
               WHERE t.city = s.city AND t.i = s.i + h AND s.i % 2 = 0 AND s.i < s.c - 25 GROUP BY h"""


def _asked_days(spark, rows):
    """Three past days and thirty to come, also for a city without history."""
    names = rows.select("city").distinct().unionByName(spark.createDataFrame([("lucknow",)], "city string"))
    spine = forecast.forecast_spine(names, v.AS_OF, 33)
    return spine.withColumns({"day_offset": F.col("day_offset") - 3, "date": F.date_sub("date", 3)})


def _forecast(spark, d, features, **shape):
    rows = v.city_daily(spark, d)
    days = settle(rows.groupBy("city", "date").agg(F.avg("aqi").alias("aqi"), F.max("aqi").alias("top")), "city-days")
    model = models.SequenceModel.fit(days, ["city"], features, "aqi", **shape)
    spine = _asked_days(spark, days)
    return model.predict(days, spine, fallback=forecast.predict_simple(spine, rows))


@query("sequence_forecast", f"""
    WITH {_DAYS}, line AS ({_lines("d")}),
    x AS (SELECT s.city, s.date, s.day_offset, CASE WHEN s.day_offset >= 0 AND l.city IS NOT NULL THEN least(greatest(a + b * l.aqi, 0), 600) END AS raw,
                 round(least(greatest(coalesce(base, CASE s.city WHEN 'lucknow' THEN 260 ELSE 150 END) * {sql_season("s.date")} * {sql_day("s.date")} * coalesce(trend, 1.0::DOUBLE), 30), 500), 2) AS simple
          FROM spine s LEFT JOIN line ON h = least(s.day_offset + 1, 24) LEFT JOIN (SELECT * FROM d WHERE rn = 1) l ON l.city = s.city LEFT JOIN pattern p ON p.city = s.city)
    SELECT city, date, day_offset, round(coalesce(raw, simple), 2) AS predicted_aqi, {sql_category("coalesce(raw, simple)")} AS category,
           CASE WHEN raw IS NULL THEN 'simple_fallback' ELSE 'nf_vae' END AS model_used FROM x""", ("v_city_daily",))
def sequence_forecast(spark, d):
    """All 24 steps from the last day of each city; past days and unknown cities take the pattern forecast."""
    return _forecast(spark, d, ["aqi"], history=1).select("city", "date", "day_offset", "predicted_aqi", "category", "model_used")


@query("sequence_forecast_window", f"""
    WITH {_DAYS} SELECT s.city, s.date, s.day_offset, CASE WHEN s.day_offset >= 0 AND s.city <> 'lucknow' THEN 'nf_vae' ELSE 'simple_fallback' END AS model_used, {_TRUTHS}
    FROM spine s""", ("v_city_daily",))
def sequence_forecast_window(spark, d):
    """All 24 steps from two measures of the last 24 days of each city."""
    out = _forecast(spark, d, ["aqi", "top"])
    return out.select("city", "date", "day_offset", "model_used", *_plausible(out))


_CUT = """(SELECT min(date) FROM (SELECT date, sum(count(*)) OVER (ORDER BY date) - count(*) AS before, sum(count(*)) OVER () AS total FROM day GROUP BY date)
           WHERE before >= floor(total * 0.8))"""


@query("sequence_metrics", f"""
    WITH day AS (SELECT station AS city, date, avg(aqi) AS aqi FROM v_city_daily GROUP BY station, date),
    early AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY city) AS c FROM day WHERE date < {_CUT}),
    late AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY city) AS c FROM day WHERE date >= {_CUT}),
    line AS ({_lines("early")}),
    e AS (SELECT t.aqi AS y, a + b * s.aqi - t.aqi AS e FROM late s, line, late t WHERE t.city = s.city AND t.i = s.i + h AND s.i % 2 = 0 AND s.i < s.c - 25),
    m AS (SELECT sqrt(avg(e * e)) AS "RMSE", avg(abs(e)) AS "MAE", 1 - avg(e * e) / var_pop(y) AS "R2", avg(e * e) AS "MSE" FROM e)
    SELECT 'nf_vae' AS model, scope, metric, round(value, 4) + 0.0 AS value FROM (UNPIVOT m ON "RMSE", "MAE", "R2", "MSE" INTO NAME metric VALUE value),
           (VALUES ('all_features'), ('aqi_only')) s(scope)""", ("v_city_daily",))
def sequence_metrics(spark, d):
    """Window forecasts per station, fitted on the first days and measured on the last ones."""
    rows = v.city_daily(spark, d)
    days = settle(rows.groupBy("station", "date").agg(F.avg("aqi").alias("aqi")), "station-days")
    _, metrics = training.train_sequence(days, ["station"], ["aqi"], ["aqi"], history=1)
    return metrics.select("model", "scope", "metric", rnd("value", 4).alias("value"))
