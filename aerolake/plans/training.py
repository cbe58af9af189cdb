"""From the daily table to fitted, measured and stored models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake import lookups
from aerolake.operators import daily, features, prepare, quality, windows
from aerolake.operators.evaluate import long_metrics, regression_metrics
from aerolake.operators.models import SEQUENCE_NAME, SequenceModel, TrainingResult, regressors, train_all_evaluate
from aerolake.plans.joins import materialized
from aerolake.sources import sinks


def training_table(df: DataFrame) -> DataFrame:
    """Calendar and cyclical features (missing year 2020), rows without target left out."""
    out = features.cyclical_features(features.temporal_features(df))
    out = features.fill_temporal_nulls(out, year=2020)
    return daily.drop_null_target(out.fillna("Unknown", subset=["city"]))


def usable_features(df: DataFrame, candidates: list[str] | None = None) -> list[str]:
    """Names of the candidate features with enough values, in candidate order."""
    candidates = candidates or lookups.CORE_FEATURES + lookups.ADDITIONAL_FEATURES
    have = [c for c in candidates if c in df.columns]
    found = {r["feature"] for r in quality.reliable_features(df, have).collect()}
    return [c for c in candidates if c in found or (c == "city_encoded" and "city" in df.columns)]


def train(df: DataFrame, keys: list[str], estimators: dict | None = None, target: str = "aqi") -> TrainingResult:
    """Split by key hash, fit every model and measure it on the held-out rows."""
    table = materialized(training_table(df), "training-table")
    names = usable_features(table)
    split = prepare.random_split(table, keys)
    return train_all_evaluate(split, names, target, estimators or regressors(), keep=keys)


def train_sequence(
    daily_means: DataFrame, keys: list[str], inputs: list[str], targets: list[str], target: str = "aqi", **options
) -> tuple[SequenceModel, DataFrame]:
    """Fit the window forecasts on the first 80 % of the days and measure them on the rest.

    Metrics come in two scopes: all targets together and ``target`` only.
    """
    split = windows.chrono_split(daily_means)
    model = SequenceModel.fit(split.filter("split = 'train'"), keys, inputs, targets, **options)
    rows = model.evaluate(split.filter("split = 'validation'")).withColumn("model", F.lit(SEQUENCE_NAME))
    every = long_metrics(regression_metrics(rows), "all_features")
    single = long_metrics(regression_metrics(rows.filter(F.col("target") == target)), "aqi_only")
    return model, every.unionByName(single)


def store(result: TrainingResult, path: str) -> None:
    """Every model under its name, and beside them the long metrics table and what was trained on what."""
    for name, model in result.models.items():
        sinks.save_model(model, f"{path}/{name}")
    if result.metrics is not None:
        sinks.write_performance(long_metrics(result.metrics), f"{path}/performance")
        spark = result.metrics.sparkSession
        info = [(sorted(result.models), result.features, sorted(result.failures.items()))]
        spark.createDataFrame(info, "models array<string>, features array<string>, failures array<struct<model:string,reason:string>>").write.mode(
            "overwrite"
        ).json(f"{path}/training_info")
