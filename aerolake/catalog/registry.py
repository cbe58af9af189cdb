"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.catalog.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``sql`` may use the named views."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return register


def rnd(c, digits: int = 6) -> Column:
    """Rounded, without a negative zero; the SQL counterpart is :func:`sql_rnd`."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def sql_rnd(x: str, digits: int = 6) -> str:
    return f"(round(cast({x} AS DOUBLE), {digits}) + 0.0)"


def sql_category(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'Unknown' WHEN {x} <= 50 THEN 'Good' WHEN {x} <= 100 THEN 'Satisfactory' "
        f"WHEN {x} <= 200 THEN 'Moderate' WHEN {x} <= 300 THEN 'Poor' WHEN {x} <= 400 THEN 'Very Poor' ELSE 'Severe' END"
    )


def sql_season(d: str) -> str:
    return (
        f"cast(CASE WHEN month({d}) IN (11,12,1,2) THEN 1.4 WHEN month({d}) IN (3,4) THEN 1.2 "
        f"WHEN month({d}) IN (5,6,7) THEN 0.9 ELSE 0.8 END AS DOUBLE)"
    )


def sql_day(d: str) -> str:
    return f"cast(CASE WHEN isodow({d}) >= 6 THEN 0.95 ELSE 1.0 END AS DOUBLE)"


def sql_accuracy(a: str, p: str) -> str:
    return (
        f"CASE WHEN {a} <> 0 AND {p} <> 0 THEN round(greatest(0.0::DOUBLE, 100 - abs({a} - {p}) / {a} * 100), 1) "
        f"ELSE 0.0::DOUBLE END"
    )


def sql_confidence(m: str) -> str:
    return (
        f"CASE {m} WHEN 'random_forest' THEN 78 WHEN 'xgboost' THEN 76 WHEN 'lightgbm' THEN 76 WHEN 'gradient_boosting' THEN 74 "
        f"WHEN 'nf_vae' THEN 45 WHEN 'simple' THEN 65 WHEN 'simple_fallback' THEN 60 WHEN 'emergency_fallback' THEN 50 ELSE 70 END"
    )


def sql_advice(c: str) -> str:
    return (
        f"CASE {c} WHEN 'Good' THEN 'Air quality is satisfactory. Enjoy your normal outdoor activities.' "
        f"WHEN 'Satisfactory' THEN 'Air quality is acceptable. Unusually sensitive people should consider reducing prolonged "
        f"outdoor exertion.' WHEN 'Moderate' THEN 'Members of sensitive groups may experience health effects. General public is "
        f"less likely to be affected.' WHEN 'Poor' THEN 'Everyone may begin to experience health effects. Members of sensitive "
        f"groups may experience more serious health effects.' WHEN 'Very Poor' THEN 'Health alert: everyone may experience more "
        f"serious health effects.' WHEN 'Severe' THEN 'Health warning of emergency conditions. The entire population is more "
        f"likely to be affected.' ELSE 'No data available.' END"
    )
