"""Forecast spines, pattern forecasts and fallbacks, for all cities, stations and days at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake import lookups
from aerolake.functions import aqi as A
from aerolake.functions import calendar as C
from aerolake.functions.values import as_col, clip
from aerolake.operators.stations import IDENTIFIERS, offered_keys
from aerolake.operators.windows import city_daily_mean
from aerolake.plans.joins import join_dimension, settle


def _day(as_of) -> Column:
    return F.lit(as_of).cast("date") if isinstance(as_of, str) else as_col(as_of)


def forecast_spine(cities: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """One row per city and day from ``as_of`` on, with the day's offset."""
    offsets = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day_offset")
    out = cities.select("city", offsets)
    return out.withColumn("date", F.date_add(_day(as_of), F.col("day_offset")))


def station_spine(cities: DataFrame, stations: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """One row per city, station and day; a city without stations gets one ``CITY_AVG`` row per day."""
    asked = cities.select("city").distinct()
    named = join_dimension(stations.select("city", "station_id", "station_name"), asked, ["city"], "inner", bound=cities)
    named = named.withColumn("prediction_type", F.lit("station_level"))
    bare = asked.join(stations.select("city").distinct(), "city", "left_anti").select(
        "city", F.lit("CITY_AVG").alias("station_id"), F.lit("City Average").alias("station_name"),
        F.lit("city_level").alias("prediction_type"),
    )
    named = named.unionByName(bare)
    out = named.withColumn("day_offset", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    return out.withColumn("date", F.date_add(_day(as_of), F.col("day_offset")))


def forecast_horizon(df: DataFrame, as_of: str, days: int = 30, column: str = "date") -> DataFrame:
    """Requests from ``as_of`` to ``as_of + days``."""
    return df.filter(F.col(column).between(_day(as_of), F.date_add(_day(as_of), days)))


def city_average(history: DataFrame, requests: DataFrame, keys: list[str] = ("city",), value: str = "aqi") -> DataFrame:
    """Mean per requested key, with the city's default level where there is no history."""
    means = history.groupBy(*keys).agg(F.avg(value).alias("mean_aqi"))
    return join_dimension(requests, settle(means, "means"), list(keys)).withColumn(
        "mean_aqi", F.coalesce("mean_aqi", A.default_city_level("city"))
    )


def pattern_stats(daily: DataFrame, keys: list[str] = ("city",), value: str = "aqi", span: int = 30) -> DataFrame:
    """Base level, trend factor and row count per key from daily sums.

    ``daily`` comes from :func:`city_daily_mean`; level and trend share its shuffle on the key.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("date"))
    rn, half = F.col("__rn"), span // 2
    ranked = daily.withColumn("__rn", F.row_number().over(w))
    stats = ranked.groupBy(*keys).agg(
        (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("base"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("data_points"),
        F.count("*").alias("days"),
        F.avg(F.when(rn <= half, F.col(value))).alias("recent"),
        F.avg(F.when((rn > half) & (rn <= span), F.col(value))).alias("older"),
    )
    falling = (F.col("days") > span) & (F.col("recent") < F.col("older"))
    return stats.select(*keys, "base", "data_points", F.when(falling, 0.98).otherwise(1.0).alias("trend_factor"))


def pattern_forecast(base: Column, date: Column, trend: Column) -> Column:
    """level x season x weekday x trend, clamped to [30, 500]."""
    return clip(base * C.seasonal_factor(date) * C.day_factor(date) * trend, 30, 500)


def predict_simple(spine: DataFrame, history: DataFrame) -> DataFrame:
    """Pattern forecast per (city, date) of the spine from the city's history."""
    stats = pattern_stats(city_daily_mean(history))
    return _with_pattern(spine.join(stats, "city", "left"))


def _with_pattern(joined: DataFrame) -> DataFrame:
    raw = pattern_forecast(
        F.coalesce("base", A.default_city_level("city")), F.col("date"), F.coalesce("trend_factor", F.lit(1.0))
    )
    return joined.withColumn("__raw", raw).withColumns({
        "predicted_aqi": F.round("__raw", 2), "category": A.aqi_category("__raw"),
    }).drop("__raw", "base", "data_points", "trend_factor")


def predict_with_fallback(
    requests: DataFrame, history: DataFrame, model_predictions: DataFrame, models: list[str], default_model: str = "simple"
) -> DataFrame:
    """Requested model, else the pattern forecast, else the city's default level.

    ``requests`` holds (city, date, model_type); ``model_predictions`` holds
    (city, date, model, model_aqi) for the models that were scored. ``auto``
    means ``default_model``. A model not in ``models`` gets the default level.
    """
    model = F.when(F.col("model_type") == "auto", F.lit(default_model)).otherwise(F.col("model_type"))
    req = requests.withColumn("model", model)
    scored = model_predictions.select("city", "date", "model", "model_aqi")
    stats = settle(pattern_stats(city_daily_mean(history)), "pattern-stats")
    joined = join_dimension(join_dimension(req, scored, ["city", "date", "model"]), stats, ["city"])
    joined = _with_pattern(joined).withColumnRenamed("predicted_aqi", "simple_aqi").drop("category")
    known = F.col("model").isin(*models, "simple")
    direct = F.when(F.col("model") == "simple", F.col("simple_aqi")).otherwise(F.round("model_aqi", 2))
    emergency = F.round(clip(A.default_city_level("city"), 50, 400), 2)
    used = (
        F.when(~known, "emergency_fallback")
        .when(direct.isNotNull(), F.col("model"))
        .when(F.col("simple_aqi").isNotNull(), "simple_fallback")
        .otherwise("emergency_fallback")
    )
    value = F.when(~known, emergency).otherwise(F.coalesce(direct, F.col("simple_aqi"), emergency))
    out = joined.withColumns({"model_used": used, "predicted_aqi": value})
    return out.withColumns({
        "model_loaded": F.col("model_used") == F.col("model"),
        "category": A.aqi_category("predicted_aqi"),
        "confidence": A.model_confidence("model_used"),
    }).drop("model", "model_aqi", "simple_aqi")


def station_statistics(readings: DataFrame, stations: DataFrame, value: str = "aqi") -> DataFrame:
    """Pattern statistics per station, matched by id, else by name, else by the station column.

    Readings are summed per identifier and day, the sums are offered under each
    identifier and reduced to one row of statistics per identifier; a station
    then takes the row of its first identifier that has one.
    """
    daily = city_daily_mean(readings, [*IDENTIFIERS], value)
    offered = daily.select("date", "total", "n", offered_keys(1)).select("date", "total", "n", "offer.*")
    per_day = offered.groupBy("match_rank", "match_key", "date").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    per_day = per_day.withColumn(value, F.try_divide(F.col("total"), F.col("n")))
    stats = pattern_stats(per_day, ["match_rank", "match_key"], value)
    wanted = stations.select(F.col("station_id").alias("request_id"), offered_keys(2)).select("request_id", "offer.*")
    found = wanted.join(stats, ["match_rank", "match_key"])
    best = F.min_by(F.struct("base", "data_points", "trend_factor"), F.struct("match_rank", "match_key")).alias("best")
    return found.groupBy(F.col("request_id").alias("station_id")).agg(best).select("station_id", "best.*")


def predict_stations(
    cities: DataFrame, stations: DataFrame, readings: DataFrame, history: DataFrame, as_of: str, days: int = 7, min_rows: int = 10,
    scored: DataFrame | None = None,
) -> DataFrame:
    """Forecast per station and day plus one city row per day.

    A model's value in ``scored`` (station_id, date, model, model_aqi) is taken
    where there is one, else the pattern forecast. For the latter a station
    with more than ``min_rows`` rows uses its own statistics, any other one
    those of its city.
    """
    spine = station_spine(cities, stations, as_of, days)
    city = pattern_stats(city_daily_mean(history)).select(
        "city", F.col("base").alias("city_base"), F.col("trend_factor").alias("city_trend")
    )
    joined = spine.join(station_statistics(readings, stations), "station_id", "left").join(city, "city", "left")
    rows = F.coalesce("data_points", F.lit(0))
    own = rows > min_rows
    level = F.coalesce(F.when(own, F.col("base")), F.col("city_base"), A.default_city_level("city"))
    trend = F.coalesce(F.when(own, F.col("trend_factor")).otherwise(F.col("city_trend")), F.lit(1.0))
    at_city = F.col("prediction_type") == "city_level"
    joined = joined.withColumn("__raw", pattern_forecast(level, F.col("date"), trend))
    model = F.lit("simple")
    if scored is not None:
        one = scored.select("station_id", "date", F.col("model").alias("__model"), clip("model_aqi", 0, 500).alias("__scored"))
        joined = joined.join(one, ["station_id", "date"], "left").withColumn("__raw", F.coalesce("__scored", "__raw"))
        model = F.when(F.col("__scored").isNotNull(), F.col("__model")).otherwise("simple_fallback")
    out = joined.select(
        "city", "date", "station_id", "station_name", "prediction_type",
        F.round("__raw", 2).alias("predicted_aqi"),
        A.aqi_category("__raw").alias("category"),
        model.alias("model_used"),
        rows.cast("bigint").alias("data_points_used"),
        F.when(~at_city, F.when(own, A.station_confidence(rows)).otherwise("medium")).alias("station_confidence"),
        F.when(at_city, "city_fallback").when(own, "station_specific_data")
        .otherwise("city_level_data_with_station_context").alias("source"),
    )
    return with_city_rollup(out)


def with_city_rollup(predictions: DataFrame) -> DataFrame:
    """Station forecasts and their city rows from one aggregation over two grouping sets.

    A union with the roll-up would compute the forecasts twice.
    """
    leaf = predictions.columns
    value = F.when(F.col("prediction_type") == "station_level", F.col("predicted_aqi"))
    both = predictions.groupingSets([leaf, ["city", "date"]], *leaf).agg(
        F.avg(value).alias("__mean"), F.min(value).alias("min_station_aqi"), F.max(value).alias("max_station_aqi"),
        F.count(value).alias("stations_count"), F.grouping("station_id").alias("__city"),
    )
    city = F.col("__city") == 1
    fixed = {
        "station_id": F.lit("CITY_AVG"), "station_name": F.lit("City Average"), "prediction_type": F.lit("city_level"),
        "predicted_aqi": F.round("__mean", 2), "category": A.aqi_category("__mean"), "model_used": F.lit("city_average"),
        "source": F.lit("station_aggregation"),
    }
    out = both.filter(~city | (F.col("stations_count") > 0))
    return out.select(
        *[F.when(city, fixed[c]).otherwise(F.col(c)).alias(c) if c in fixed else F.col(c) for c in leaf],
        *[F.when(city, F.round(c, 2)).alias(c) for c in ("min_station_aqi", "max_station_aqi")],
        F.when(city, F.col("stations_count")).alias("stations_count"),
    )


def city_rollup_of_stations(predictions: DataFrame) -> DataFrame:
    """``CITY_AVG`` rows: mean, smallest, largest and number of station forecasts per city and day."""
    per_city = predictions.filter(F.col("prediction_type") == "station_level").groupBy("city", "date").agg(
        F.avg("predicted_aqi").alias("mean_aqi"), F.min("predicted_aqi").alias("min_station_aqi"),
        F.max("predicted_aqi").alias("max_station_aqi"), F.count("*").alias("stations_count"),
    )
    return per_city.select(
        "city", "date", F.lit("CITY_AVG").alias("station_id"), F.lit("City Average").alias("station_name"),
        F.lit("city_level").alias("prediction_type"), F.round("mean_aqi", 2).alias("predicted_aqi"),
        A.aqi_category("mean_aqi").alias("category"), F.lit("city_average").alias("model_used"),
        F.lit("station_aggregation").alias("source"), "stations_count",
        F.round("min_station_aqi", 2).alias("min_station_aqi"), F.round("max_station_aqi", 2).alias("max_station_aqi"),
    )


def station_fallback(stations: DataFrame, averages: DataFrame) -> DataFrame:
    """City mean plus the station's class offset, clamped to [0, 500], for stations that could not be scored."""
    joined = stations.join(averages.select("city", "mean_aqi"), "city", "left")
    offset = A.station_class_adjustment("station_name")
    joined = joined.withColumn("station_variation", offset)
    joined = joined.withColumn("__raw", clip(F.coalesce("mean_aqi", A.default_city_level("city")) + F.col("station_variation"), 0, 500))
    return joined.select(
        "city", "station_id", "station_name", "station_variation", F.round("__raw", 2).alias("predicted_aqi"),
        A.aqi_category("__raw").alias("category"), F.lit("low").alias("station_confidence"), F.lit("fallback_model").alias("source"),
    )


def scoring_features(
    spine: DataFrame, latest: DataFrame, features: list[str], codes: DataFrame | None = None, key: str = "city"
) -> DataFrame:
    """Model inputs per row of the spine: calendar from its date, measures from the latest row of its ``key``.

    A measure without a reading takes its default, any other feature 0.
    """
    calendar = {**C.calendar_fields("date"), **C.cyclical_fields("date")}
    measured = [f for f in features if f not in calendar and f != "city_encoded" and f in latest.columns]
    joined = spine.join(latest.select(key, *[F.col(f).alias(f"__m_{f}") for f in measured]), key, "left")
    if codes is not None:
        joined = joined.join(codes, "city", "left")
    cols = []
    for f in features:
        if f in calendar:
            c = calendar[f]
        elif f == "city_encoded":
            c = F.col("city_encoded") if codes is not None else F.lit(0)
        else:
            seen = F.col(f"__m_{f}") if f in measured else F.lit(None).cast("double")
            c = F.coalesce(seen, F.lit(lookups.SCORING_DEFAULTS.get(f, 0.0)))
        cols.append(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f))
    return joined.select(*spine.columns, *cols)


def model_matrix(cities: DataFrame, predictions: DataFrame, models: list[str]) -> DataFrame:
    """One row per city and model; a model without a prediction is Failed."""
    grid = cities.select("city", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    joined = grid.join(predictions, ["city", "model"], "left")
    missing = F.col("predicted_aqi").isNull()
    return joined.select(
        "city", F.upper("model").alias("model"),
        F.when(missing, F.lit(0)).otherwise(F.round("predicted_aqi")).cast("int").alias("predicted_aqi"),
        F.when(missing, "Error").otherwise(F.col("category")).alias("category"),
        F.when(missing, "failed").otherwise(F.col("model_used")).alias("model_used"),
        F.when(missing, "Failed").when(~F.col("model_loaded"), "Fallback").otherwise("Success").alias("status"),
    )


def ensemble_mean(samples: DataFrame, keys: list[str], value: str = "predicted") -> DataFrame:
    """Mean over the samples of each key."""
    return samples.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("samples"))
