"""Models, metric tables, JSON records and clustered tables on storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.functions.values import finite_or_null
from aerolake.operators.sets import sorted_for_write


def save_model(model: PipelineModel, path: str) -> str:
    """Preparation and model in one folder, so that neither can be present without the other."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_performance(metrics: DataFrame, path: str, mode: str = "overwrite", kind: str = "parquet") -> None:
    """Long metrics table (model, scope, metric, value)."""
    metrics.write.mode(mode).format(kind).save(path)


def merge_performance(old: DataFrame, new: DataFrame) -> DataFrame:
    """New metrics replace old ones of the same model, scope and metric."""
    keys = ["model", "scope", "metric"]
    joined = old.select(*keys, F.col("value").alias("old")).join(new.select(*keys, F.col("value").alias("new")), keys, "full_outer")
    return joined.select(*keys, F.coalesce("new", "old").alias("value"))


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row; non-finite numbers become null, dates are ISO text, nulls are kept."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append((finite_or_null(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c).alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def write_readings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Daily readings as Parquet, one folder per year, clustered by series and date inside."""
    yearly = df.withColumn("year", F.year("date"))
    sorted_for_write(yearly, ["year", "city", "station", "date"]).write.mode(mode).partitionBy("year").parquet(path)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("year")
