"""Shape of the physical plans of all registered queries."""

import pytest

from aerolake.catalog import QUERIES

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"]
STREAMED = {n for n in QUERIES if n.startswith("stream_")}
FITTED = {"train_random_forest", "train_gbt", "train_all_evaluate", "feature_importance", "predict_batch"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED - FITTED))
def test_no_cross_joins_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert [f for f in FORBIDDEN if f in text] == []


@pytest.mark.parametrize("name", ["recent_window", "window_validity", "trend_factor", "city_profile"])
def test_row_limits_apply_before_the_shuffle(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert text.count("WindowGroupLimit") >= 2


def test_windows_of_one_series_share_a_shuffle(spark, sf_dir):
    for name in ("lag_features", "fill_forward_backward"):
        # One shuffle for the daily aggregation and one for all windows of the series.
        assert plan(QUERIES[name](spark, sf_dir)).count("Exchange hashpartitioning") == 2


def test_projections_do_not_shuffle(spark, sf_dir):
    for name in ("temporal_features", "cyclical_features", "aqi_category", "pollutant_ratios", "health_advice", "parse_feed_iaqi", "to_json_records"):
        assert "Exchange" not in plan(QUERIES[name](spark, sf_dir))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["date_range"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_shipdate:timestamp_ntz>" in text.replace("\n", "")
    assert "DataFilters: [isnotnull(l_shipdate" in text
