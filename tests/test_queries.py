"""Every registered query against its SQL counterpart, or for rows and a stable schema where SQL cannot express it."""

import pytest
from check import compare, connect

from aerolake.catalog import ORACLES, QUERIES
from aerolake.plans import joins


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and not any(v is None for r in rows for v in r)


JOINING = [
    "airquality_overview", "encode_city", "enrich_station_metadata", "enrich_station_metadata_null_safe", "expected_range_check",
    "keep_known_cities", "normalize_city", "predict_with_fallback", "station_match_any", "station_match_cascade", "station_spine",
    "unmapped_cities",
]


@pytest.mark.parametrize("name", JOINING)
def test_same_result_when_dimensions_are_too_large_to_broadcast(spark, sf_dir, con, monkeypatch, name):
    monkeypatch.setattr(joins, "is_small", lambda *_: False)
    df = QUERIES[name](spark, sf_dir)
    assert "__salt" in df._jdf.queryExecution().toString()
    assert compare(df, con, ORACLES[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
