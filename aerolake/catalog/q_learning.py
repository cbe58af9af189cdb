"""Boosted trees, window forecasts beyond lines, and bootstrap ensembles, each against the same formula in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.catalog import views as v
from aerolake.catalog.registry import query, rnd
from aerolake.operators import boosting, daily, forecast, models
from aerolake.plans.joins import settle

# ---- boosted trees -------------------------------------------------------------------------

INPUTS = ["pm25", "no2", "o3"]
BINS, ROUNDS, RATE = 16, 3, 0.3


def _trees_sql(growth: str, depth: int, leaves: int, l2: float, min_rows: int) -> str:
    """Boosting step by step: sums by (node, feature, bin), running sums over the bins, the best split of each node, new nodes."""
    shares = "[" + ", ".join(str(i / BINS) for i in range(1, BINS)) + "]"
    steps = [
        f"days AS MATERIALIZED (SELECT station_id AS city, date, {', '.join(f'avg({c}) AS {c}' for c in INPUTS)}, avg(label) AS y FROM v_readings GROUP BY station_id, date)",
        "cuts AS MATERIALIZED (SELECT " + ", ".join(f"list_distinct(quantile_cont({c}, {shares})) AS {c}" for c in INPUTS) + " FROM days)",
        "t0 AS MATERIALIZED (SELECT city, date, y, (SELECT avg(y) FROM days) AS m, "
        + ", ".join(f"len(list_filter(cuts.{c}, lambda x: x <= days.{c})) AS b{i}" for i, c in enumerate(INPUTS)) + " FROM days, cuts)",
    ]
    places = ", ".join(f"b{i}" for i in range(len(INPUTS)))
    numbers = ", ".join(str(i) for i in range(len(INPUTS)))
    picked = "CASE f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(len(INPUTS))) + " END"
    for r in range(ROUNDS):
        steps.append(f"s{r}_0 AS MATERIALIZED (SELECT *, 1 AS node FROM t{r})")
        n_steps = depth if growth == "level" else leaves - 1
        for k in range(n_steps):
            one = "PARTITION BY node ORDER BY gain DESC, f, b" if growth == "level" else "ORDER BY gain DESC, node, f, b"
            open_ = f"node >= {1 << k}" if growth == "level" else f"node < {1 << depth}"
            steps.append(f"""h{r}_{k} AS (
  SELECT node, f, b, sum(g) AS g, count(*) AS h FROM (SELECT node, m - y AS g, unnest([{numbers}]) AS f, unnest([{places}]) AS b FROM s{r}_{k} WHERE {open_}) GROUP BY node, f, b
), c{r}_{k} AS (
  SELECT *, gt - gl AS gr, ht - hl AS hr FROM (
    SELECT node, f, b, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY node, f) AS gt, sum(h) OVER (PARTITION BY node, f) AS ht
    FROM h{r}_{k} WINDOW w AS (PARTITION BY node, f ORDER BY b))
), p{r}_{k} AS MATERIALIZED (
  SELECT node, f, b AS edge FROM (SELECT *, gl * gl / (hl + {l2}) + gr * gr / (hr + {l2}) - gt * gt / (ht + {l2}) AS gain FROM c{r}_{k} WHERE hl >= {min_rows} AND hr >= {min_rows})
  WHERE gain > 1e-9 QUALIFY row_number() OVER ({one}) = 1
), s{r}_{k + 1} AS MATERIALIZED (
  SELECT s.* REPLACE (CASE WHEN f IS NULL THEN s.node ELSE 2 * s.node + ({picked} > edge)::INTEGER END AS node) FROM s{r}_{k} s LEFT JOIN p{r}_{k} p ON p.node = s.node
)""")
        steps.append(f"""t{r + 1} AS MATERIALIZED (
  SELECT city, date, y, m - {RATE} * sum(m - y) OVER (PARTITION BY node) / (count(*) OVER (PARTITION BY node) + {l2}) AS m, {places} FROM s{r}_{n_steps}
)""")
    return "WITH " + ", ".join(steps) + f" SELECT city, date, round(m, 5) + 0.0 AS predicted FROM t{ROUNDS}"


def _boosted(spark, d, **shape):
    """A few rounds over all station days, cut at exact quantiles; the stored form of the model scores the raw values."""
    rows = v.readings(spark, d).withColumnRenamed("station_id", "city")
    days = settle(daily.daily_aggregate(rows, ["city", "date"], [*INPUTS, "label"], ()), "boosting-days")
    trees = boosting.BoostedTrees(rounds=ROUNDS, rate=RATE, max_bins=BINS, exact=True, **shape)
    return trees.fit(days, INPUTS).stage().transform(days).select("city", "date", rnd("prediction", 5).alias("predicted"))


@query("train_boosted_level", _trees_sql("level", 3, 8, 1.0, 1), ("v_readings",))
def train_boosted_level(spark, d):
    return _boosted(spark, d, growth="level", max_depth=3, l2=1.0, min_rows=1)


@query("train_boosted_leaf", _trees_sql("leaf", 4, 6, 0.5, 20), ("v_readings",))
def train_boosted_leaf(spark, d):
    return _boosted(spark, d, growth="leaf", max_depth=4, max_leaves=6, l2=0.5, min_rows=20)


# ---- forecasts from windows ----------------------------------------------------------------

HISTORY, HORIZON = 24, 24


def _windows_sql(expanded: str) -> str:
    """Scaled series of each city, its windows and its last window; ``expanded`` turns window ``x`` into a regression's inputs."""
    return f"""
    day AS (SELECT city, date, avg(aqi) AS aqi FROM v_city_daily GROUP BY city, date),
    scale AS (SELECT avg(aqi) AS mean, stddev_pop(aqi) AS std FROM day),
    series AS MATERIALIZED (SELECT city, list((aqi - mean) / std ORDER BY date) AS z, list(date ORDER BY date) AS dates, count(*) AS c FROM day, scale GROUP BY city),
    win AS MATERIALIZED (
      SELECT city, start_date, list_concat({expanded}, y) AS p FROM (
        SELECT city, dates[s + 1] AS start_date, z[s + 1 : s + {HISTORY}] AS x, z[s + {HISTORY + 1} : s + {HISTORY + HORIZON}] AS y
        FROM series, range(100000) r(s) WHERE s % 2 = 0 AND s < c - {HISTORY + HORIZON})),
    final AS MATERIALIZED (SELECT city, {expanded} AS p FROM (SELECT city, z[c - {HISTORY - 1} : c] AS x FROM series))"""


def _solved_sql(products: str, inputs: int, ridge: float) -> str:
    """Ridge regressions of all samples by elimination; ``products`` has sample, i, j and v, places from 1."""
    return f"""
    products AS ({products}),
    start AS (SELECT sample, list(row ORDER BY i) AS m FROM (
      SELECT sample, i, list(v + CASE WHEN i = j AND i > 1 THEN {ridge} ELSE 0 END ORDER BY j) AS row FROM products GROUP BY sample, i) GROUP BY sample),
    step AS (
      SELECT sample, 1 AS k, m FROM start
      UNION ALL
      SELECT sample, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda x: x / m[k][k])
                                                                  ELSE list_transform(row, lambda x, j: x - row[k] * m[k][j] / m[k][k]) END) FROM step WHERE k <= {inputs}
    ),
    line AS (SELECT sample, h, list_transform(m, lambda row: row[{inputs} + h]) AS w FROM step, range(1, {HORIZON + 1}) r(h) WHERE k = {inputs + 1}),
    spine AS (SELECT city, cast(k AS INTEGER) AS day_offset, DATE '{v.AS_OF}' + cast(k AS INTEGER) AS date FROM series, range(30) t(k)),
    said AS (SELECT sample, s.city, s.date, s.day_offset, list_inner_product(w, p) * std + mean AS raw
             FROM spine s JOIN line ON h = least(s.day_offset + 1, {HORIZON}) JOIN final f ON f.city = s.city, scale)"""


def _plain_products(inputs: int) -> str:
    return f"SELECT 0 AS sample, i, j, sum(p[i] * p[j]) AS v FROM win, range(1, {inputs + 1}) a(i), range(1, {inputs + HORIZON + 1}) b(j) GROUP BY i, j"


FOURIER, RIDGE, SAMPLES = 16, 1.0, 10
_DRAWN = models.Fourier.draw(HISTORY, FOURIER)
_COSINES = "[" + ", ".join(f"sqrt(2 / {FOURIER}) * cos({b} + list_inner_product({w}::DOUBLE[], x))" for w, b in zip(_DRAWN.frequencies, _DRAWN.shifts, strict=True)) + "]"
_CURVE = 1 + HISTORY + FOURIER
_LINE = 1 + HISTORY


def _days(spark, d):
    return settle(v.city_daily(spark, d).groupBy("city", "date").agg(F.avg("aqi").alias("aqi")), "city-days")


@query("sequence_forecast_fourier", f"""
    WITH RECURSIVE {_windows_sql(f"list_concat([1.0::DOUBLE], x, {_COSINES})")}, {_solved_sql(_plain_products(_CURVE), _CURVE, RIDGE)}
    SELECT city, date, day_offset, round(least(greatest(raw, 0), 600), 2) + 0.0 AS predicted_aqi FROM said""", ("v_city_daily",))
def sequence_forecast_fourier(spark, d):
    """All 24 steps from the last 24 days of each city by a ridge over the window and its random cosine features."""
    days = _days(spark, d)
    model = models.SequenceModel.fit(days, ["city"], ["aqi"], fourier=FOURIER, ridge=RIDGE)
    spine = forecast.forecast_spine(days.select("city").distinct(), v.AS_OF, 30)
    return model.predict(days, spine).select("city", "date", "day_offset", rnd("predicted_aqi", 2).alias("predicted_aqi"))


_POISSON = "[" + ", ".join(repr(p) for p in models._POISSON) + "]"


@query("ensemble_forecast", f"""
    WITH RECURSIVE {_windows_sql("list_concat([1.0::DOUBLE], x)")},
    counted AS MATERIALIZED (
      SELECT sample, p, len(list_filter({_POISSON}, lambda t: ('0x' || substr(md5(city || '|' || cast(start_date AS VARCHAR) || '|' || cast(sample AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 >= t)) AS n
      FROM win, range({SAMPLES}) r(sample)),
    {_solved_sql(f"SELECT sample, i, j, sum(n * p[i] * p[j]) AS v FROM counted, range(1, {_LINE + 1}) a(i), range(1, {_LINE + HORIZON + 1}) b(j) GROUP BY sample, i, j", _LINE, RIDGE)}
    SELECT city, date, day_offset, round(least(greatest(avg(raw), 0), 600), 2) + 0.0 AS predicted_aqi, round(stddev_pop(raw), 4) + 0.0 AS spread,
           round(least(greatest(quantile_cont(raw, 0.05), 0), 600), 2) + 0.0 AS low, round(least(greatest(quantile_cont(raw, 0.95), 0), 600), 2) + 0.0 AS high
    FROM said GROUP BY city, date, day_offset""", ("v_city_daily",))
def ensemble_forecast(spark, d):
    """Mean and range of forecasts by regressions on Poisson resamples of the windows, for each city and day."""
    days = _days(spark, d)
    ensemble = models.BootstrapForecast.fit(days, ["city"], ["aqi"], samples=SAMPLES, ridge=RIDGE)
    spine = forecast.forecast_spine(days.select("city").distinct(), v.AS_OF, 30)
    out = ensemble.predict(days, spine)
    return out.select("city", "date", "day_offset", *[rnd(c, 2).alias(c) for c in ("predicted_aqi", "low", "high")], rnd("spread", 4).alias("spread"))
