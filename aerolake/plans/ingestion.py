"""Files to the analysis-ready daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake import schema
from aerolake.operators import cities, daily, features, quality, sets, standardize, stations
from aerolake.plans.joins import materialized
from aerolake.sources.csv_tree import scan_csv_tree

READING_TYPES = ["station_daily", "station_hourly", "city_daily", "city_hourly"]


def standardize_file(df: DataFrame, file_type: str) -> DataFrame:
    """Headers, station identity, dates and numbers of one file type."""
    if file_type == "station_metadata":
        out = standardize.standardize_stations(df)
    elif file_type in READING_TYPES or file_type == "aqi_data":
        out = standardize.standardize_readings(df)
        if "station_id" not in out.columns and "station" in out.columns:
            out = standardize.infer_station_id(out)
        out = standardize.derive_station(out)
    else:
        out = df
    return standardize.coerce_numeric(standardize.coerce_dates(out))


def load_tree(spark: SparkSession, path: str, dataset: str) -> dict[str, list[DataFrame]]:
    """Standardised frames per file type of one directory tree; files of equal header are treated as one."""
    return {kind: [standardize_file(f, kind) for f in frames] for kind, frames in scan_csv_tree(spark, path, dataset).items()}


def station_table(frames: dict[str, list[DataFrame]], aliases: DataFrame) -> DataFrame | None:
    """Station dimension from the station files, else from the station columns of the readings."""
    files = frames.get("station_metadata", [])
    order = ["source_file", "station_name", "city"]
    if files:
        both = schema.conform(standardize.union_by_name(files), schema.STATIONS).withColumn("source_file", F.lit(""))
        dim = stations.station_dimension(both, order)
    else:
        sources = frames.get("station_daily", []) + frames.get("station_hourly", [])
        if not sources:
            return None
        wanted = ["station_id", "station", "station_name", "city", "state", "latitude", "longitude"]
        parts = [sets.distinct_rows(f, [c for c in wanted if c in f.columns]) for f in sources]
        both = schema.conform(standardize.union_by_name(parts), schema.STATIONS)
        both = both.withColumn("station_name", F.coalesce("station_name", "station", "station_id"))
        dim = sets.dedupe_keep_first(both, ["station_id"], ["station_name", "city"])
    return cities.normalize_city(dim, aliases).drop("city_original", "source_file")


def merge_readings(frames: dict[str, list[DataFrame]], station_dim: DataFrame | None) -> DataFrame:
    """Station rows enriched from the dimension, united with the city rows."""
    station_rows = standardize.union_by_name(frames, READING_TYPES[:2])
    city_rows = standardize.union_by_name(frames, READING_TYPES[2:])
    if station_rows is not None and station_dim is not None:
        station_rows = schema.conform(station_rows, schema.READINGS)
        station_rows = stations.enrich_station_metadata(station_rows, station_dim, ["station_name"])
        station_rows = station_rows.withColumn("state", F.coalesce("state", "state_meta")).drop("state_meta", "station_name_meta")
    parts = [schema.conform(p, schema.READINGS).drop("city_original") for p in (station_rows, city_rows) if p is not None]
    return standardize.union_by_name(parts)


def named_readings(readings: DataFrame, aliases: DataFrame, low: str = "2015-01-01", high: str = "2024-12-31") -> DataFrame:
    """Readings of known cities under their canonical names, within the date range."""
    named = cities.normalize_city(readings, aliases)
    return daily.date_range(daily.drop_null_dates(named.filter(F.col("city").isNotNull())), low, high)


def enhance(
    readings: DataFrame, aliases: DataFrame, low: str = "2015-01-01", high: str = "2024-12-31",
    order: tuple[str, ...] = ("source_dataset", "source_file", "datetime"),
) -> DataFrame:
    """Canonical cities, one row per (city, station, date), known cities and the date range only.

    City and date conditions are on grouping keys and applied before the
    aggregation, so rows outside them are not shuffled.
    """
    kept = named_readings(readings, aliases, low, high)
    return daily.daily_aggregate(kept, order=[c for c in order if c in kept.columns])


def preprocess(df: DataFrame, for_training: bool = True) -> DataFrame:
    """Feature table: categories filled, calendar and ratio features, outliers capped for training, clean-up.

    Outlier limits and empty columns are found by jobs over the whole table, so
    a table that is still to be computed is written first.
    """
    df = materialized(df, "daily-readings")
    out = standardize.fill_unknown_categories(df, ["city", "station", "aqi_bucket", "aqi_category"])
    out = features.all_features(out)
    if for_training:
        out = quality.cap_outliers(out)
    out = standardize.clean_infinite(out)
    out = standardize.fill_unknown_categories(out)
    return standardize.drop_empty_columns(out)


def ingest(spark: SparkSession, trees: dict[str, str], aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(daily readings, station dimension) of several ``dataset -> path`` trees."""
    aliases = aliases if aliases is not None else cities.alias_table(spark)
    frames: dict[str, list[DataFrame]] = {}
    for dataset, path in trees.items():
        for kind, parts in load_tree(spark, path, dataset).items():
            frames.setdefault(kind, []).extend(parts)
    dim = station_table(frames, aliases)
    return enhance(merge_readings(frames, dim), aliases), dim
