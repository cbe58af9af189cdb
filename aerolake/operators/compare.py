"""Live readings against forecasts, merged city lists and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake import lookups
from aerolake.functions import aqi as A
from aerolake.functions.values import prefer
from aerolake.plans.joins import join_dimension


def _offsets(forecast: DataFrame, as_of: str, names: dict[str, int]) -> DataFrame:
    """Forecast days as columns: one row per city with the value and category at each offset."""
    offset = F.datediff("date", F.lit(as_of).cast("date"))
    wanted = forecast.filter(offset.isin(*names.values()))
    aggs = []
    for name, days in names.items():
        aggs += [
            F.max(F.when(offset == days, F.col("predicted_aqi"))).alias(f"predicted_{name}"),
            F.max(F.when(offset == days, F.col("category"))).alias(f"predicted_{name}_category"),
        ]
    return wanted.groupBy("city").agg(*aggs)


def status_with_forecast(current: DataFrame, forecast: DataFrame, as_of: str) -> DataFrame:
    """Current value per city with today's and tomorrow's forecast and accuracy; cities without forecast drop out.

    ``current`` holds (city, current_aqi, ...), one row per city.
    """
    days = _offsets(forecast, as_of, {"today": 0, "tomorrow": 1})
    return current.join(days, "city").withColumns({
        "current_category": A.aqi_category("current_aqi"),
        "accuracy": A.prediction_accuracy("current_aqi", "predicted_today"),
    })


def city_comparison(current: DataFrame, forecast: DataFrame, as_of: str) -> DataFrame:
    """Current value against tomorrow's forecast, with direction and advice, worst first."""
    days = _offsets(forecast, as_of, {"tomorrow": 1})
    category = A.aqi_category("current_aqi")
    out = current.join(days, "city").withColumns({
        "current_category": category,
        "trend": A.trend_word("current_aqi", "predicted_tomorrow"),
        "health_advice": A.health_advice(category),
    })
    return out.orderBy(F.desc("current_aqi"), "city")


def realtime_vs_forecast(current: DataFrame, forecast: DataFrame, as_of: str) -> DataFrame:
    """Current value against the forecasts for today, tomorrow and next week, with accuracy and trend block."""
    days = _offsets(forecast, as_of, {"today": 0, "tomorrow": 1, "next_week": 7})
    out = current.join(days, "city").withColumns({
        "category": A.aqi_category("current_aqi"),
        "accuracy_today": A.prediction_accuracy("current_aqi", "predicted_today"),
    })
    return realtime_trend(out).withColumns({
        "accuracy_status": A.accuracy_tier("accuracy_today"), "health_advice": A.health_advice("category"),
    })


def realtime_trend(df: DataFrame) -> DataFrame:
    """Short and long trend of current against tomorrow and next week; high confidence when they agree."""
    tomorrow = F.coalesce("predicted_tomorrow", "predicted_today", "current_aqi")
    week = F.coalesce(F.col("predicted_next_week"), tomorrow)
    df = df.withColumns({
        "short_term": A.trend_word("current_aqi", tomorrow), "long_term": A.trend_word("current_aqi", week),
    })
    agree = F.col("short_term") == F.col("long_term")
    return df.withColumn("trend_confidence", F.when(agree, "high").otherwise("medium"))


def with_live_comparison(predictions: DataFrame, current: DataFrame, as_of: str) -> DataFrame:
    """Predictions for ``as_of`` with the live value, its category, the accuracy and the signed difference.

    Other days, and cities without a live row, keep nulls.
    """
    today = F.col("date") == F.lit(as_of).cast("date")
    live = current.select("city", F.col("current_aqi").alias("__live"))
    joined = join_dimension(predictions, live, ["city"]).withColumn("realtime_aqi", F.when(today, F.col("__live"))).drop("__live")
    seen = F.col("realtime_aqi").isNotNull()
    return joined.withColumns({
        "realtime_category": F.when(seen, A.aqi_category("realtime_aqi")),
        "accuracy": F.when(seen, A.prediction_accuracy("realtime_aqi", "predicted_aqi")),
        "difference": F.round(F.col("predicted_aqi") - F.col("realtime_aqi"), 2),
    })


def forecast_error_rows(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    diff = F.col(predicted) - F.col(actual)
    return df.withColumns({"difference": F.round(diff, 2), "absolute_difference": F.abs(diff)})


def _has(schema: T.StructType, path: str) -> bool:
    """True when the possibly nested field exists."""
    head, _, rest = path.partition(".")
    if head not in schema.names:
        return False
    inner = schema[head].dataType
    return not rest or (isinstance(inner, T.StructType) and _has(inner, rest))


def normalize_city_record(df: DataFrame) -> DataFrame:
    """One flat shape for city records of different answers.

    Fields are taken from their alternative names, flat or nested below
    ``realtime``, ``predictions``, ``accuracy`` and ``trend_analysis``. A zero
    pm25, pm10, forecast or accuracy counts as missing.
    """

    def fields(names: tuple[str, ...], kind: str) -> list[Column]:
        out = []
        for n in names:
            if n in df.columns:
                if not isinstance(df.schema[n].dataType, T.StructType):
                    out.append(F.col(f"`{n}`").cast(kind))
            elif _has(df.schema, n):
                out.append(F.col(n).cast(kind))
        return out

    def first(*names: str, kind: str) -> Column:
        cs = fields(names, kind)
        return F.coalesce(*cs) if cs else F.lit(None).cast(kind)

    def first_nonzero(*names: str) -> Column:
        cs = fields(names, "double")
        return prefer(*cs) if cs else F.lit(None).cast("double")

    aqi = first("aqi", "aqi_value", "realtime.aqi", kind="double")
    category = first("category", "category_name", "realtime.category", kind="string")
    return df.select(
        F.coalesce(first("city", "name", "city_name", "city_requested", kind="string"), F.lit("Unknown")).alias("city"),
        aqi.alias("aqi"),
        F.coalesce(category, A.aqi_category(aqi, zero_is_unknown=True)).alias("category"),
        first_nonzero("pm25", "PM2.5", "realtime.pm25").alias("pm25"),
        first_nonzero("pm10", "realtime.pm10").alias("pm10"),
        first("timestamp", "realtime.timestamp", kind="string").alias("timestamp"),
        first_nonzero("predicted_aqi", "predictions.today.predicted_aqi").alias("predicted_aqi"),
        first_nonzero("accuracy", "accuracy.today").alias("accuracy"),
        first("trend", "trend_analysis.short_term", kind="string").alias("trend"),
    )


def _usable(c: Column) -> Column:
    """Present, a number and not 0; never null itself."""
    return c.isNotNull() & ~F.isnan(c) & (c != 0)


def merge_prefer_newer(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two city lists; the right row wins if it has a value and the left one lacks it or is older.

    Both hold (city, aqi, timestamp, ...); cities compare in lower case, and of
    several rows of one city on one side the newest counts.
    """
    cols = left.columns
    both = left.withColumn("__side", F.lit(0)).unionByName(right.select(*cols).withColumn("__side", F.lit(1)))
    row, order = F.struct(*cols), F.struct("timestamp", "aqi", "city")

    def newest(side: int) -> Column:
        return F.max_by(row, F.when(F.col("__side") == side, order))

    merged = both.groupBy(F.lower("city").alias("__key")).agg(newest(0).alias("l"), newest(1).alias("r"))
    newer = _usable(F.col("r.aqi")) & (~_usable(F.col("l.aqi")) | (F.col("r.timestamp") > F.col("l.timestamp")))
    take_right = F.col("l").isNull() | F.coalesce(newer, F.lit(False))
    return merged.select(F.when(take_right, F.col("r")).otherwise(F.col("l")).alias("row")).select("row.*")


def merge_prefer_source(direct: DataFrame, context: DataFrame) -> DataFrame:
    """Union of two city lists, direct rows first, without rows lacking a value, worst first."""
    both = direct.withColumn("__p", F.lit(0)).unionByName(context.withColumn("__p", F.lit(1)))
    both = both.filter(F.col("city").isNotNull() & (F.col("city") != ""))
    cols = direct.columns
    best = both.groupBy(F.lower("city").alias("__key")).agg(
        F.min_by(F.struct(*cols), F.struct("__p", F.col("city"))).alias("row")
    )
    out = best.select("row.*")
    return out.filter(_usable(F.col("aqi"))).orderBy(F.desc("aqi"), "city")


def valid_status_rows(df: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    """Rows with a city and a finite AQI, by default also not 0."""
    test = F.col("city").isNotNull() & (F.col("city") != "") & F.col("aqi").isNotNull() & (F.abs("aqi") < float("inf"))
    return df.filter(test & (F.col("aqi") != 0) if zero_is_missing else test)


def expected_range_check(df: DataFrame, ranges: DataFrame, value: str = "predicted_aqi") -> DataFrame:
    """Flag values outside their city's plausible range (city, low, high)."""
    joined = join_dimension(df, ranges.select("city", "low", "high"), ["city"], "inner")
    inside = F.col(value).between(F.col("low"), F.col("high"))
    return joined.withColumn("status", F.when(inside, "REASONABLE").otherwise("SUSPICIOUS"))


def expected_ranges(spark) -> DataFrame:
    rows = [(c, lo, hi) for c, (lo, hi) in lookups.EXPECTED_RANGES.items()]
    return spark.createDataFrame(rows, "city string, low double, high double")


def category_distribution(df: DataFrame, category: str = "category", keys: list[str] = ()) -> DataFrame:
    """Rows per category including empty categories, one long row each.

    Counts are conditional sums, so that a category without rows needs no join.
    """
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(category) == c).alias(c) for c in lookups.CATEGORIES])
    return counts.unpivot(list(keys), lookups.CATEGORIES, "category", "count")


def prediction_summary(predictions: DataFrame, keys: list[str] = ("city", "date")) -> DataFrame:
    """Mean, range, category counts, worst and best station of the station forecasts per key."""
    rows = predictions.filter(F.col("prediction_type") == "station_level")
    station = F.struct("station_id", "predicted_aqi", "category")
    per_category = rows.groupBy(*keys, "category").agg(
        F.count("*").alias("n"), F.sum("predicted_aqi").alias("total"), F.min("predicted_aqi").alias("lo"),
        F.max("predicted_aqi").alias("hi"),
        F.min_by(station, F.struct(-F.col("predicted_aqi"), F.col("station_id"))).alias("worst"),
        F.min_by(station, F.struct(F.col("predicted_aqi"), F.col("station_id"))).alias("best"),
    )
    out = per_category.groupBy(*keys).agg(
        F.round(F.sum("total") / F.sum("n"), 2).alias("average_aqi"),
        F.round(F.min("lo"), 2).alias("min_aqi"), F.round(F.max("hi"), 2).alias("max_aqi"),
        F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("category_distribution"),
        F.min_by("worst", F.struct(-F.col("worst.predicted_aqi"), F.col("worst.station_id"))).alias("worst_station"),
        F.min_by("best", F.struct(F.col("best.predicted_aqi"), F.col("best.station_id"))).alias("best_station"),
    )
    return out


def quick_stats(df: DataFrame) -> DataFrame:
    """Rows, mean valid AQI to one decimal and the worst city, in one row."""
    valid = F.when(~F.isnan("aqi"), F.col("aqi"))
    worst = F.min_by("city", F.struct(-F.coalesce(valid, F.lit(0.0)), F.col("city")))
    return df.agg(F.count("*").alias("cities"), F.round(F.avg(valid), 1).alias("average_aqi"), worst.alias("worst_city"))


def worst_cities(df: DataFrame, k: int = 6, value: str = "aqi") -> DataFrame:
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value)).orderBy(F.desc(value), "city").limit(k)


def ranked_cities(df: DataFrame, by: str = "aqi", selected: list[str] = (), k: int = 8) -> DataFrame:
    """Cities ordered by aqi, city or pm25; the selected ones, or the first ``k``."""
    order = {
        "aqi": [F.desc(F.coalesce("aqi", F.lit(0.0))), F.col("city")],
        "city": [F.col("city")],
        "pm25": [F.desc(F.coalesce("pm25", F.lit(0.0))), F.col("city")],
    }[by]
    if selected:
        return df.filter(F.col("city").isin(*selected)).orderBy(*order)
    return df.orderBy(*order).limit(k)
