"""Duplicates and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in ``order``.

    An aggregate with a partial step: a key with very many copies is reduced
    before the shuffle instead of being sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(first).select(*[c if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def latest_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key in ``order``, by the same kind of aggregate."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(last).select(*[c if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def sort_series(df: DataFrame, order: list[str] = ("city", "station", "date")) -> DataFrame:
    """Global order; range partitioning on all columns splits a large city over tasks."""
    return df.orderBy(*order)


def sorted_for_write(df: DataFrame, order: list[str] = ("city", "station", "date")) -> DataFrame:
    """Range partition by the full key and sort inside partitions, for clustered files."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def sample_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k smallest distinct values."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(k)
