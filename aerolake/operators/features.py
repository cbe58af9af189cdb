"""Feature columns of the analysis-ready table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.functions import aqi as A
from aerolake.functions import calendar as C
from aerolake.functions import ratios as R

TEMPORAL = ["year", "month", "dayofweek", "is_weekend", "dayofyear"]


def temporal_features(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(C.calendar_fields(date))


def cyclical_features(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(C.cyclical_fields(date))


def season_flags(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(C.season_flags(date))


def fill_temporal_nulls(df: DataFrame, year: int = 0) -> DataFrame:
    """Calendar features of rows without a date: 0, and ``year`` for the year (2020 for training)."""
    names = TEMPORAL + [f"{n}_{f}" for n in C.PERIODS for f in ("sin", "cos")] + ["is_winter", "is_summer", "is_monsoon"]
    values = {n: (year if n == "year" else 0) for n in names if n in df.columns}
    return df.fillna(values) if values else df


def pollutant_ratios(df: DataFrame) -> DataFrame:
    cols = {}
    if {"pm25", "pm10"} <= set(df.columns):
        cols["pm_ratio"] = R.pm_ratio("pm25", "pm10")
        cols["pm25_pm10_ratio"] = R.ratio("pm25", "pm10")
    if {"no2", "o3"} <= set(df.columns):
        cols["no2_o3_ratio"] = R.ratio("no2", "o3")
    return df.withColumns(cols) if cols else df


def aqi_labels(df: DataFrame) -> DataFrame:
    if "aqi" not in df.columns:
        return df
    return df.withColumns({"aqi_category": A.aqi_category("aqi"), "aqi_severity": A.aqi_severity("aqi")})


def aqi_band_onehot(df: DataFrame, column: str = "aqi") -> DataFrame:
    return df.withColumns(A.aqi_bands(column))


def temp_humidity_interaction(df: DataFrame) -> DataFrame:
    if {"temperature", "humidity"} <= set(df.columns):
        return df.withColumn("temp_humidity_interaction", R.heat_moisture("temperature", "humidity"))
    return df


def all_features(df: DataFrame) -> DataFrame:
    """Calendar, season, ratio, label and interaction columns in one projection chain."""
    for step in (temporal_features, cyclical_features, season_flags, fill_temporal_nulls, pollutant_ratios, aqi_labels,
                 temp_humidity_interaction):
        df = df.transform(step)
    return df


def pollutant_limit_status(df: DataFrame, keys: list[str], pollutants: list[str]) -> DataFrame:
    """One row per key and pollutant with its limit status; pollutants without limit are left out."""
    long = df.unpivot(keys, pollutants, "pollutant", "value")
    long = long.filter(F.col("value").isNotNull()).withColumn("status", A.limit_status("pollutant", "value"))
    return long.filter(F.col("status").isNotNull())
