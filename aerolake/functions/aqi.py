"""AQI categories, levels, advice and forecast quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolake import lookups
from aerolake.functions.values import ColumnOrName, as_col, choose, ladder


def _missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def aqi_category(c: ColumnOrName, zero_is_unknown: bool = False) -> Column:
    """Category name; missing is Unknown, and so is 0 when ``zero_is_unknown``."""
    c = as_col(c)
    unknown = _missing(c) | (c == 0) if zero_is_unknown else _missing(c)
    return F.when(unknown, F.lit("Unknown")).otherwise(ladder(c, lookups.CATEGORY_BOUNDS, "Severe"))


def aqi_severity(c: ColumnOrName) -> Column:
    """Category as 0..5; missing counts as Moderate (2)."""
    c = as_col(c)
    steps = [(bound, i) for i, (bound, _) in enumerate(lookups.CATEGORY_BOUNDS)]
    return F.when(_missing(c), F.lit(2)).otherwise(ladder(c, steps, len(steps)))


def aqi_eval_level(c: ColumnOrName) -> Column:
    """Level 0..5 used when judging forecasts; missing stays null."""
    c = as_col(c)
    steps = [(bound, i) for i, bound in enumerate(lookups.EVALUATION_BOUNDS)]
    return F.when(~_missing(c), ladder(c, steps, len(steps)))


def aqi_bands(c: ColumnOrName) -> dict[str, Column]:
    """0/1 indicator columns of four AQI bands; missing is 0 in all."""
    c = as_col(c)
    c = F.when(~_missing(c), c)

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("double")

    return {
        "aqi_good": flag((c > 0) & (c <= 50)),
        "aqi_moderate": flag((c > 50) & (c <= 100)),
        "aqi_unhealthy_sensitive": flag((c > 100) & (c <= 150)),
        "aqi_unhealthy": flag(c > 150),
    }


def health_advice(category: ColumnOrName) -> Column:
    return choose(category, lookups.HEALTH_ADVICE, lookups.DEFAULT_ADVICE)


def provider_aqi(index: ColumnOrName) -> Column:
    """Five-point provider index on the AQI scale."""
    return choose(as_col(index).cast("int"), lookups.PROVIDER_SCALE, lookups.DEFAULT_PROVIDER_AQI)


def default_city_level(city: ColumnOrName) -> Column:
    levels = {k: float(v) for k, v in lookups.CITY_DEFAULT_LEVELS.items()}
    return choose(city, levels, lookups.DEFAULT_CITY_LEVEL)


def aqi_scale_percent(c: ColumnOrName) -> Column:
    """Share of the 0..500 scale in percent, at most 100; missing is 0."""
    c = as_col(c)
    return F.when(_missing(c), F.lit(0.0)).otherwise(F.least(c / F.lit(5.0), F.lit(100.0)))


def prediction_accuracy(actual: ColumnOrName, predicted: ColumnOrName) -> Column:
    """100 minus the relative error in percent, one decimal; 0 when either side is 0 or missing."""
    a, p = as_col(actual), as_col(predicted)
    error = F.try_divide(F.abs(a - p), a) * 100
    valid = (a != 0) & (p != 0)
    return F.when(valid, F.round(F.greatest(F.lit(0.0), 100 - error), 1)).otherwise(F.lit(0.0))


def accuracy_tier(accuracy: ColumnOrName) -> Column:
    a = as_col(accuracy)
    return F.when(a >= 90, "Excellent").when(a >= 80, "Good").when(a >= 70, "Fair").otherwise("Poor")


def model_confidence(model: ColumnOrName) -> Column:
    return choose(model, lookups.MODEL_CONFIDENCE, lookups.DEFAULT_CONFIDENCE)


def station_confidence(rows: ColumnOrName) -> Column:
    """high above 100 own rows, else medium."""
    return F.when(as_col(rows) > 100, "high").otherwise("medium")


def confidence_weight(confidence: ColumnOrName) -> Column:
    return F.when(as_col(confidence) == "high", 0.9).otherwise(0.7)


def station_class_adjustment(name: ColumnOrName) -> Column:
    """AQI offset of the first keyword class found in a station name."""
    n = F.lower(as_col(name))
    out = None
    for words, offset in lookups.STATION_CLASSES:
        test = F.lit(False)
        for word in words:
            test = test | n.contains(word)
        out = F.when(test, F.lit(offset)) if out is None else out.when(test, F.lit(offset))
    return out.otherwise(F.lit(0.0))


def limit_status(pollutant: ColumnOrName, value: ColumnOrName) -> Column:
    """Above Limit / Within Limit; null for a pollutant without a limit."""
    limit = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in lookups.POLLUTANT_LIMITS.items() for x in kv]), as_col(pollutant)
    )
    return F.when(limit.isNotNull(), F.when(as_col(value) > limit, "Above Limit").otherwise("Within Limit"))


def trend_word(current: ColumnOrName, later: ColumnOrName) -> Column:
    """improving when the later value is lower; missing values count as 0."""
    cur, nxt = F.coalesce(as_col(current), F.lit(0.0)), F.coalesce(as_col(later), F.lit(0.0))
    return F.when(nxt < cur, "improving").otherwise("worsening")
