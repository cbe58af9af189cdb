"""Boosted trees against a plain version that follows the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake.operators import models
from aerolake.operators.boosting import PRESETS, BoostedTrees
from aerolake.sources import sinks


def plain(x, y, cuts, growth, rounds, rate, max_depth, max_leaves, l2, min_rows):
    """Predictions of boosted trees, each split found by trying every feature and cut on the node's own rows."""
    bins = np.stack([np.where(np.isnan(c), len(q) + 1, np.searchsorted(q, c, side="right")) for c, q in zip(x.T, cuts, strict=True)], axis=1)
    m = np.full(len(y), y.mean())
    counts = []

    def best(rows, g):
        found = None
        for f in range(x.shape[1]):
            for b in range(bins.max() + 1):
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                if len(left) < min_rows or len(right) < min_rows:
                    continue
                gain = g[left].sum() ** 2 / (len(left) + l2) + g[right].sum() ** 2 / (len(right) + l2) - g[rows].sum() ** 2 / (len(rows) + l2)
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, left, right)
        return found

    for _ in range(rounds):
        g = m - y
        leaves = [(np.arange(len(y)), 0)]
        if growth == "level":
            for _ in range(max_depth):
                new = []
                for rows, depth in leaves:
                    s = best(rows, g)
                    new += [(rows, depth)] if s is None else [(s[1], depth + 1), (s[2], depth + 1)]
                leaves = new
        else:
            while len(leaves) < max_leaves:
                tried = [(s[0], i, s) for i, (rows, depth) in enumerate(leaves) if depth < max_depth and (s := best(rows, g))]
                if not tried:
                    break
                _, i, s = max(tried, key=lambda t: t[0])
                depth = leaves.pop(i)[1]
                leaves += [(s[1], depth + 1), (s[2], depth + 1)]
        counts.append(len(leaves))
        for rows, _ in leaves:
            m[rows] -= rate * g[rows].sum() / (len(rows) + l2)
    return m, counts


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3)).round(2)
    x[::17, 1] = np.nan
    y = np.sin(2 * x[:, 0]) * 10 + np.nan_to_num(x[:, 1], nan=3.0) * x[:, 2] + rng.normal(size=500)
    rows = [(i, float(a), None if np.isnan(b) else float(b), float(c), float(t)) for i, ((a, b, c), t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, label double"), x, y


SHAPES = [
    {"growth": "level", "max_depth": 3, "max_leaves": None, "l2": 1.0, "min_rows": 1},
    {"growth": "leaf", "max_depth": 5, "max_leaves": 7, "l2": 0.0, "min_rows": 20},
    {"growth": "leaf", "max_depth": 2, "max_leaves": 31, "l2": 0.5, "min_rows": 5},
]


@pytest.mark.parametrize("shape", SHAPES)
def test_equals_the_plain_version(table, shape):
    df, x, y = table
    trees = BoostedTrees(rounds=4, rate=0.3, max_bins=12, exact=True, **shape)
    model = trees.fit(df, ["a", "b", "c"])
    want, counts = plain(x, y, model.cuts, rounds=4, rate=0.3, **shape)
    got = model.stage("p").transform(df).orderBy("id").toPandas()["p"].to_numpy()
    assert np.allclose(got, want, atol=1e-9)
    assert [len(t.weights) for t in model.trees] == counts
    importance = {r.feature: r.importance for r in model.importance(df.sparkSession).collect()}
    assert abs(sum(importance.values()) - 1) < 1e-9 and importance["a"] > 0.5


def test_presets_differ_in_growth():
    level, leaf = PRESETS["xgboost"], PRESETS["lightgbm"]
    assert (level.growth, leaf.growth) == ("level", "leaf") and leaf.max_leaves == 31 and level.rounds == leaf.rounds == 100


def test_approximate_bins_learn(table):
    df, _, y = table
    model = BoostedTrees(rounds=10, rate=0.5, max_depth=4).fit(df, ["a", "b", "c"])
    assert all(len(c) > 50 for c in model.cuts)
    error = model.stage().transform(df).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]
    assert error < 0.2 * y.var()


def test_edges(spark):
    schema = "a double, b double, label double"
    none = BoostedTrees(rounds=3).fit(spark.createDataFrame([(1.0, 2.0, None)], schema), ["a", "b"])
    assert none.stage().transform(spark.createDataFrame([(1.0, None, None)], schema)).first().prediction == 0.0
    same = spark.createDataFrame([(1.0, None, 4.0)] * 5 + [(1.0, 7.0, 8.0)] * 5 + [(float("nan"), 7.0, None)], schema)
    model = BoostedTrees(rounds=12, rate=0.9, l2=0.0).fit(same, ["a", "b"])
    got = {r.b: r.prediction for r in model.stage().transform(same).collect()}
    assert got[None] == pytest.approx(4, abs=1e-6) and got[7.0] == pytest.approx(8, abs=1e-6)  # a missing value is a value of its own
    constant = BoostedTrees(rounds=5).fit(spark.createDataFrame([(1.0, 1.0, 3.0)] * 4, schema), ["a", "b"])
    assert constant.base == 3.0 and len(constant.trees) == 1


def test_trained_stored_and_loaded_with_the_other_models(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"c{i % 4}", float(a), float(b), float(3 * a + (i % 4) * 5 + b), "test" if i % 5 == 0 else "train") for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "city string, pm25 double, no2 double, aqi double, split string")
    chosen = {n: e for n, e in models.regressors(rounds=6, lightgbm=4, xgboost=3).items() if n in ("linear_regression", "xgboost", "lightgbm")}
    result = models.train_all_evaluate(df, ["pm25", "no2", "city_encoded"], "aqi", chosen, keep=["city"])
    r2 = {r.model: r.R2 for r in result.metrics.collect()}
    assert set(r2) == set(chosen) and min(r2.values()) > 0.3 and not result.failures
    assert set(result.boosted) == {"xgboost", "lightgbm"}
    path = sinks.save_model(result.models["lightgbm"], str(tmp_path / "m"))
    one, two = (models.score(df, m).toPandas() for m in (result.models["lightgbm"], sinks.load_model(path)))
    assert one.equals(two)
    assert models.feature_importance(result.boosted["xgboost"], ["pm25", "no2", "city_encoded"], spark).count() == 3


@pytest.mark.parametrize("growth", ["level", "leaf"])
def test_only_the_smaller_child_is_summed(spark, table, monkeypatch, growth):
    df, _, _ = table
    asked, sums = [], BoostedTrees._sums
    monkeypatch.setattr(BoostedTrees, "_sums", lambda self, rows, tree, nodes, *a: asked.append(set(nodes)) or sums(self, rows, tree, nodes, *a))
    model = BoostedTrees(growth=growth, rounds=1, max_depth=4, max_leaves=9 if growth == "leaf" else None, max_bins=16, exact=True).fit(df, ["a", "b", "c"])
    assert len(model.trees[0].splits) > 4
    assert all(n ^ 1 not in nodes for nodes in asked for n in nodes) and asked[0] == {1}
