"""Forecast quality and the tables of model metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake import lookups
from aerolake.functions import aqi as A

METRICS = ["RMSE", "MAE", "R2", "MSE"]


def regression_metrics(df: DataFrame, keys: list[str] = ("model",), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """RMSE, MAE, R2 and MSE per key in one aggregate; R2 is 0 when the actual values do not vary."""
    a, p = F.col(actual), F.col(predicted)
    both = df.filter(a.isNotNull() & p.isNotNull())
    mse = F.avg((p - a) * (p - a))
    variance = F.var_pop(a)
    r2 = F.when(variance > 0, 1 - mse / variance).otherwise(F.lit(0.0))
    return both.groupBy(*keys).agg(
        F.sqrt(mse).alias("RMSE"), F.avg(F.abs(p - a)).alias("MAE"), r2.alias("R2"), mse.alias("MSE"), F.count("*").alias("rows")
    )


def long_metrics(wide: DataFrame, scope: str = "test") -> DataFrame:
    """(model, scope, metric, value) rows."""
    return wide.withColumn("scope", F.lit(scope)).unpivot(["model", "scope"], METRICS, "metric", "value")


def category_accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted", keys: list[str] = ()) -> DataFrame:
    """Share of rows whose predicted level equals the actual one."""
    hit = A.aqi_eval_level(predicted) == A.aqi_eval_level(actual)
    return df.groupBy(*keys).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("category_accuracy"), F.count("*").alias("rows"))


def prediction_statistics(df: DataFrame, column: str = "predicted", keys: list[str] = ()) -> DataFrame:
    """Mean, population deviation, range, negatives and a low-variance flag."""
    c = F.col(column)
    return df.groupBy(*keys).agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.count_if(c < 0).alias("negatives"), (F.stddev_pop(c) < 10).alias("low_variance"),
    )


def default_performance(spark) -> DataFrame:
    """Assumed metrics in long form (model, metric, default_value) and status."""
    rows = []
    for model, rmse, mae, r2, _ in lookups.DEFAULT_PERFORMANCE:
        rows += [(model, "RMSE", rmse), (model, "MAE", mae), (model, "R2", r2)]
    return spark.createDataFrame(rows, "model string, metric string, default_value double")


def merge_performance_defaults(measured: DataFrame, spark=None) -> DataFrame:
    """Measured (model, metric, value) rows, completed by the assumed ones."""
    defaults = default_performance(spark or measured.sparkSession)
    joined = measured.select("model", "metric", "value").join(defaults, ["model", "metric"], "full_outer")
    return joined.select(
        "model", "metric", F.coalesce("value", "default_value").alias("value"),
        F.when(F.col("value").isNotNull(), "measured").otherwise("default").alias("origin"),
    )


def best_model(metrics: DataFrame) -> DataFrame:
    """Model with the smallest RMSE; equal ones by name."""
    rmse = metrics.filter(F.col("metric") == "RMSE")
    return rmse.agg(F.min_by("model", F.struct("value", "model")).alias("model"), F.min("value").alias("rmse"))


def default_model(available: DataFrame) -> DataFrame:
    """First available model in the order of preference."""
    rank = F.array_position(F.array(*[F.lit(m) for m in lookups.MODEL_PRIORITY]), F.col("model"))
    return available.filter(rank > 0).agg(F.min_by("model", rank).alias("model"))


def model_registry(metrics: DataFrame) -> DataFrame:
    """One row per model: description, metrics with R2 in percent, confidence, and whether it is the default."""
    wide = metrics.groupBy("model").pivot("metric", ["RMSE", "MAE", "R2"]).agg(F.max("value"))
    default = default_model(wide).scalar()
    text = F.try_element_at(F.create_map(*[F.lit(x) for kv in lookups.MODEL_DESCRIPTIONS.items() for x in kv]), F.col("model"))
    return wide.select(
        "model", F.coalesce(text, F.col("model")).alias("description"), F.coalesce("RMSE", F.lit(0.0)).alias("RMSE"),
        F.coalesce("MAE", F.lit(0.0)).alias("MAE"), (F.coalesce("R2", F.lit(0.0)) * 100).alias("R2"),
        A.model_confidence("model").alias("confidence"), (F.col("model") == default).alias("is_default"),
    )
