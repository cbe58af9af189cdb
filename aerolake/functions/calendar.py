"""Calendar features and calendar-driven factors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolake.functions.values import ColumnOrName, as_col

# Periods of the cyclical encodings (days in a year with leap share).
PERIODS = {"month": 12.0, "dayofweek": 7.0, "dayofyear": 365.25}


def calendar_fields(date: ColumnOrName) -> dict[str, Column]:
    """Year, month, weekday (Monday 0), weekend flag and day of year."""
    d = as_col(date)
    weekday = F.weekday(d)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "dayofweek": weekday,
        "is_weekend": (weekday >= 5).cast("double"),
        "dayofyear": F.dayofyear(d),
    }


def cyclical(value: ColumnOrName, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * as_col(value) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def cyclical_fields(date: ColumnOrName) -> dict[str, Column]:
    fields = calendar_fields(date)
    out = {}
    for name, period in PERIODS.items():
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclical(fields[name], period)
    return out


def season_flags(date: ColumnOrName) -> dict[str, Column]:
    m = F.month(as_col(date))
    return {
        "is_winter": m.isin(11, 12, 1, 2).cast("double"),
        "is_summer": m.isin(3, 4, 5, 6).cast("double"),
        "is_monsoon": m.isin(7, 8, 9, 10).cast("double"),
    }


def seasonal_factor(date: ColumnOrName) -> Column:
    m = F.month(as_col(date))
    return F.when(m.isin(11, 12, 1, 2), 1.4).when(m.isin(3, 4), 1.2).when(m.isin(5, 6, 7), 0.9).otherwise(0.8)


def day_factor(date: ColumnOrName) -> Column:
    return F.when(F.weekday(as_col(date)) >= 5, 0.95).otherwise(1.0)
