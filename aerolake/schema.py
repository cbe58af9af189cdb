"""Canonical column names and target schemas.

Inside the library the measures use lower-case names without dots; the
published header names are restored with :func:`to_published_names`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 17 measures averaged per day.
MEASURES = [
    "pm25", "pm10", "no", "no2", "nox", "nh3", "co", "so2", "o3", "benzene", "toluene", "xylene",
    "aqi", "temperature", "humidity", "pressure", "wind_speed",
]
# Attributes kept from the first non-null row of a day.
ATTRIBUTES = ["station_id", "station_name", "aqi_bucket", "source_dataset", "city_original"]
# All columns coerced to numbers on ingestion.
NUMERIC_COLUMNS = MEASURES + ["latitude", "longitude"]
PRIMARY_POLLUTANTS = ["pm25", "pm10", "no2", "so2", "co", "o3", "aqi"]
CAPPED_COLUMNS = [
    "pm25", "pm10", "no2", "so2", "co", "o3", "aqi", "temperature", "humidity", "pressure", "wind_speed",
]
SERIES_KEY = ["city", "station"]

READINGS = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("city_original", T.StringType()),
        T.StructField("station", T.StringType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("station_name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("datetime", T.TimestampType()),
        T.StructField("date", T.DateType()),
        *[T.StructField(m, T.DoubleType()) for m in MEASURES],
        T.StructField("aqi_bucket", T.StringType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("file_type", T.StringType()),
    ]
)

STATIONS = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("station", T.StringType()),
        T.StructField("station_name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("station_type", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

# Published header of each internal column.
PUBLISHED_NAMES = {
    "station_id": "StationId", "station": "Station", "station_name": "StationName", "city": "City",
    "city_original": "City_Original", "state": "State", "date": "Date", "datetime": "Datetime",
    "pm25": "PM2.5", "pm10": "PM10", "no": "NO", "no2": "NO2", "nox": "NOx", "nh3": "NH3", "co": "CO",
    "so2": "SO2", "o3": "O3", "benzene": "Benzene", "toluene": "Toluene", "xylene": "Xylene",
    "aqi": "AQI", "aqi_bucket": "AQI_Bucket", "temperature": "Temperature", "humidity": "Humidity",
    "pressure": "Pressure", "wind_speed": "Wind_Speed", "latitude": "Latitude", "longitude": "Longitude",
    "station_type": "Station_Type", "status": "Status", "source_dataset": "Source_Dataset",
    "source_file": "Source_File", "file_type": "File_Type",
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema``: absent columns become typed nulls, extra ones are dropped."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def to_published_names(df: DataFrame) -> DataFrame:
    """Rename internal columns to the published headers (``pm25`` → ``PM2.5``)."""
    return df.withColumnsRenamed({c: PUBLISHED_NAMES[c] for c in df.columns if c in PUBLISHED_NAMES})
