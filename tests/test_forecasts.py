"""Curved window forecasts and bootstrap ensembles against numpy, and sketches against full scans."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from aerolake.operators import models, sketches, windows
from aerolake.plans import training
from aerolake.plans.joins import settle
from aerolake.plans.quantiles import exact_quantiles
from aerolake.session import shared_dir

START = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def curved(spark):
    """Three series in which tomorrow is a bent function of today."""
    rows = []
    for c in range(3):
        x = 0.2 + 0.1 * c
        for i in range(300):
            x = 3.8 * x * (1 - x)
            rows.append((f"c{c}", START + dt.timedelta(days=i), 400 * x))
    return settle(spark.createDataFrame(rows, "city string, date date, aqi double"), "curved")


def scaled_windows(df, history, horizon, stride):
    """City, first date, inputs and outputs of each window, from plain lists."""
    rows = df.orderBy("city", "date").collect()
    every = np.array([r.aqi for r in rows])
    mean, std = every.mean(), every.std()
    out = []
    for city in sorted({r.city for r in rows}):
        mine = [r for r in rows if r.city == city]
        z = [(r.aqi - mean) / std for r in mine]
        for s in range(0, len(z) - history - horizon, stride):
            out.append((city, mine[s].date, z[s : s + history], z[s + history : s + history + horizon]))
    return out, mean, std


def test_weights_equal_those_of_numpy(curved):
    model = models.SequenceModel.fit(curved, ["city"], ["aqi"], history=3, horizon=2, fourier=8, ridge=0.5, width=0.7)
    found, _, _ = scaled_windows(curved, 3, 2, 2)
    w, b = np.array(model.fourier.frequencies), np.array(model.fourier.shifts)
    x = np.array([f[2] for f in found])
    phi = np.hstack([np.ones((len(x), 1)), x, np.sqrt(2 / 8) * np.cos(x @ w.T + b)])
    y = np.array([f[3] for f in found])
    ridge = 0.5 * np.eye(phi.shape[1])
    ridge[0, 0] = 0
    want = np.linalg.solve(phi.T @ phi + ridge, phi.T @ y)
    assert np.allclose(np.array([model.weights["aqi", h] for h in (1, 2)]).T, want, atol=1e-8)


def test_a_curve_has_smaller_errors_on_later_days_than_the_line(curved):
    shape = {"history": 2, "horizon": 1, "stride": 1}
    error = {}
    for name, options in {"line": {}, "curve": {"fourier": 60, "ridge": 0.01}}.items():
        _, metrics = training.train_sequence(curved, ["city"], ["aqi"], ["aqi"], **shape, **options)
        error[name] = metrics.filter("metric = 'RMSE' AND scope = 'aqi_only'").first().value
    assert error["curve"] < 0.25 * error["line"]


def test_bootstrap_equals_numpy_and_does_not_depend_on_partitions(curved):
    spark = curved.sparkSession
    samples, ridge = 6, 0.5
    ensemble = models.BootstrapForecast.fit(curved.repartition(7), ["city"], ["aqi"], samples=samples, history=3, horizon=2, ridge=ridge)
    found, mean, std = scaled_windows(curved, 3, 2, 2)
    phi = np.array([[1.0, *f[2]] for f in found])
    y = np.array([f[3] for f in found])
    penalty = ridge * np.diag([0, 1, 1, 1])
    solved = []
    for s in range(samples):
        u = [int(hashlib.md5(f"{c}|{d}|{s}".encode()).hexdigest()[:8], 16) / 2**32 for c, d, _, _ in found]
        n = np.array([sum(x >= p for p in models._POISSON) for x in u])
        assert 0.7 < n.mean() < 1.3
        solved.append(np.linalg.solve((phi * n[:, None]).T @ phi + penalty, (phi * n[:, None]).T @ y))
        assert np.allclose(np.array([ensemble.members[s].weights["aqi", h] for h in (1, 2)]).T, solved[-1], atol=1e-8)
    spine = spark.createDataFrame([("c0", START, 0), ("c0", START, 5), ("c0", START, -1), ("none", START, 0)], "city string, date date, day_offset int")
    got = {(r.city, r.day_offset): r for r in ensemble.predict(curved, spine, level=0.5).collect()}
    last = [1.0, *[(r.aqi - mean) / std for r in curved.filter("city = 'c0'").orderBy(F.desc("date")).limit(3).collect()][::-1]]
    for offset, h in ((0, 0), (5, 1)):
        raw = np.array([np.dot(last, w[:, h]) for w in solved]) * std + mean
        r = got["c0", offset]
        assert r.predicted_aqi == pytest.approx(np.clip(raw.mean(), 0, 600), abs=0.006) and r.spread == pytest.approx(raw.std(), abs=1e-6)
        assert (r.low, r.high) == pytest.approx(tuple(np.quantile(raw, [0.25, 0.75])), abs=0.006)
    assert got["c0", -1].predicted_aqi is None and got["none", 0].predicted_aqi is None


def test_windows_of_a_series_can_be_limited(curved):
    every = windows.sequence_windows(curved, ["city"], ["aqi"], ["aqi"], 3, 2, stride=2)
    some = windows.sequence_windows(curved, ["city"], ["aqi"], ["aqi"], 3, 2, stride=2, most=5)
    assert values(some, "city", "start") == [(f"c{c}", s) for c in range(3) for s in range(0, 10, 2)] and every.count() > some.count()


def test_profiles_merge_into_that_of_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{int(i)}", f"s{int(i * 7 % 50)}", START + dt.timedelta(days=int(i % 90)), None if i % 10 == 0 else float(x)) for i, x in enumerate(rng.normal(size=6000))]
    df = settle(spark.createDataFrame([(c[:3], s, d, x) for c, s, d, x in rows], "city string, station string, date date, aqi double"), "profiled")
    out, names, measures = shared_dir(spark, "profile"), ["city", "station"], ["aqi"]
    for n in range(3):
        sketches.add_rows(df.filter(F.pmod(F.hash("date", "aqi"), F.lit(3)) == n), n, out, names, measures)
    stored = sketches.stored(spark, out, names, measures)
    assert stored.count() == 3
    got = sketches.coverage(stored).first()
    assert (got.records, got.city, got.station, got.total_days) == (6000, df.select("city").distinct().count(), df.select("station").distinct().count(), 89)
    shares = [0.1, 0.5, 0.9]
    about = sketches.approximate_quantiles(stored, measures, shares)["aqi"]
    known = np.sort([x for _, _, _, x in rows if x is not None])
    assert all(abs(np.searchsorted(known, a) / len(known) - p) < 0.02 for a, p in zip(about, shares, strict=True))
    assert sketches.exact_quantiles(df, stored, measures, shares) == exact_quantiles(df, measures, shares)
    wrong = {"aqi": [(50.0, 60.0)] * 3}  # edges that miss change nothing but the work
    assert exact_quantiles(df, measures, shares, sort_limit=100, edges=wrong) == exact_quantiles(df, measures, shares)
    other = sketches.profile(df.filter("station < 's2'"), names, measures)
    both = sketches.in_both(stored, other, "station").first()
    few = df.filter("station < 's2'").select("station").distinct().count()
    assert (both.either, both.both, both.first_only) == (got.station, few, got.station - few)
    assert sketches.approximate_quantiles(sketches.profile(df.limit(0), names, measures), measures, [0.5]) == {"aqi": [None]}
