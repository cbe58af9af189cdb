"""Registered queries over the given tables, each with the SQL that must give the same result."""

from aerolake.catalog import (  # noqa: F401 - importing registers the queries
    q_aggregates, q_columns, q_filters, q_forecast, q_joins, q_learning, q_models, q_sources, q_streaming, q_windows,
)
from aerolake.catalog.registry import ORACLES, QUERIES  # noqa: F401
