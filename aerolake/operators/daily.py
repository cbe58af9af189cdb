"""Reduction of raw readings to one row per series and day.

All ordered windows of the library run on these daily rows: a series then has
at most one row per day of the date range, whatever its share of the readings.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake import schema


def drop_null_dates(df: DataFrame, column: str = "date") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def date_range(df: DataFrame, low: str = "2015-01-01", high: str = "2024-12-31", column: str = "date") -> DataFrame:
    """Inclusive date filter on the raw column, so that it reaches the file scan."""
    return df.filter(F.col(column).between(F.lit(low).cast("date"), F.lit(high).cast("date")))


def drop_null_target(df: DataFrame, target: str = "aqi") -> DataFrame:
    return df.filter(F.col(target).isNotNull() & ~F.isnan(target))


def daily_aggregate(
    df: DataFrame,
    keys: Iterable[str] = ("city", "station", "date"),
    measures: Iterable[str] = tuple(schema.MEASURES),
    attributes: Iterable[str] = tuple(schema.ATTRIBUTES),
    order: Iterable[str] = (),
) -> DataFrame:
    """Mean of the measures and first non-null attribute per key; rows with a null key are left out.

    ``order`` fixes which row is first. Without attributes the aggregation
    state is numeric only and Spark uses its hash aggregate.
    """
    keys = list(keys)
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    aggs = [F.avg(m).alias(m) for m in measures if m in df.columns]
    rank = F.struct(*order) if order else None
    for a in attributes:
        if a in df.columns and a not in keys:
            if rank is None:
                aggs.append(F.min(a).alias(a))
            else:
                aggs.append(F.min_by(F.col(a), F.when(F.col(a).isNotNull(), rank)).alias(a))
    return df.groupBy(*keys).agg(*aggs)
