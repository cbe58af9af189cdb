"""Ratios and products of measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolake.functions.values import ColumnOrName, as_col, finite_or_null

# Terms added to denominators and the ratio assumed when it is undefined.
PM_EPSILON = 1e-6
RATIO_EPSILON = 1e-8
DEFAULT_RATIO = 0.5


def ratio(a: ColumnOrName, b: ColumnOrName, epsilon: float = RATIO_EPSILON) -> Column:
    return F.try_divide(as_col(a), as_col(b) + F.lit(epsilon))


def pm_ratio(pm25: ColumnOrName, pm10: ColumnOrName) -> Column:
    return F.coalesce(finite_or_null(ratio(pm25, pm10, PM_EPSILON)), F.lit(DEFAULT_RATIO))


def heat_moisture(temperature: ColumnOrName, humidity: ColumnOrName) -> Column:
    return as_col(temperature) * as_col(humidity) / 100
