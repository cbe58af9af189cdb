"""Regressors: training, evaluation, importance, scoring, multi-horizon forecasts, bootstrap ensembles."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import aqi as A
from aerolake.functions.values import clip
from aerolake.operators.boosting import PRESETS, BoostedModel, BoostedTrees
from aerolake.operators.evaluate import regression_metrics
from aerolake.operators.prepare import Scaler
from aerolake.operators.windows import explode_window, fill_forward_backward, recent_window, sequence_windows
from aerolake.plans.joins import materialized, settle
from aerolake.plans.quantiles import exact_quantiles

SEED = 42
#: Fixed value: the key under which clients know the window forecasts.
SEQUENCE_NAME = "nf_vae"


def regressors(trees: int = 100, rounds: int = 100, max_bins: int = 128, **depths: int) -> dict[str, Estimator | BoostedTrees]:
    """The trainable models; ``depths`` overrides the depth of those named.

    Of the boosted ones, ``gradient_boosting`` fits residuals by MLlib's trees, ``xgboost`` grows second-order trees by level and
    ``lightgbm`` by leaf, see :mod:`aerolake.operators.boosting`.
    """
    depth = {"random_forest": 20, "gradient_boosting": 5, **{n: p.max_depth for n, p in PRESETS.items()}, **depths}
    common = {"featuresCol": "features", "seed": SEED, "maxBins": max_bins, "maxMemoryInMB": 1024}
    return {
        "linear_regression": LinearRegression(featuresCol="features"),
        "random_forest": RandomForestRegressor(numTrees=trees, maxDepth=depth["random_forest"], **common),
        "gradient_boosting": GBTRegressor(maxIter=rounds, stepSize=0.1, maxDepth=depth["gradient_boosting"], **common),
        **{n: p.with_(rounds=rounds, max_depth=depth[n]) for n, p in PRESETS.items()},
    }


@dataclass
class FeatureStages:
    """Fitted city encoder, exact median imputation and vector assembly, ready to be put before a model."""

    stages: list
    features: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    #: The columns that are assembled.
    inputs: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, train: DataFrame, features: list[str], city: str | None = "city") -> "FeatureStages":
        stages, medians = [], {}
        numeric = [f for f in features if f != "city_encoded"]
        if "city_encoded" in features:
            indexer = StringIndexer(
                inputCol=city, outputCol="__city_index", stringOrderType="alphabetAsc", handleInvalid="keep"
            ).fit(train)
            # Cities not seen in training get the code 0.
            known = len(indexer.labels)
            code = f"CASE WHEN `__city_index` >= {known} THEN 0.0D ELSE `__city_index` END AS city_encoded"
            stages += [indexer, SQLTransformer(statement=f"SELECT *, {code} FROM __THIS__")]
        if numeric:
            quantiles = exact_quantiles(train, numeric, [0.5])
            medians = {f: (q[0] if q[0] is not None else 0.0) for f, q in quantiles.items()}
        filled = ", ".join(f"coalesce(cast(`{f}` AS double), {medians[f]!r}D) AS `__in_{f}`" for f in numeric)
        if filled:
            stages.append(SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"))
        inputs = [f"__in_{f}" if f in numeric else f for f in features]
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
        return cls(stages, list(features), medians, inputs)

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            df = s.transform(df)
        return df

    def with_model(self, model) -> PipelineModel:
        """One savable unit of preparation and model."""
        return PipelineModel([*self.stages, model.stage() if isinstance(model, BoostedModel) else model])

    def fit_model(self, regressor: Estimator | BoostedTrees, prepared: DataFrame, target: str):
        """A model of the transformed rows; boosted trees read the single columns, the others the vector."""
        if isinstance(regressor, BoostedTrees):
            return regressor.fit(prepared, self.inputs, target)
        if isinstance(regressor, Estimator):
            regressor = regressor.copy({regressor.labelCol: target})
        return regressor.fit(prepared)


def train_model(train: DataFrame, features: list[str], target: str, regressor: Estimator | BoostedTrees, city: str = "city") -> PipelineModel:
    stages = FeatureStages.fit(train, features, city)
    return stages.with_model(stages.fit_model(regressor, stages.transform(train), target))


def score(df: DataFrame, model: PipelineModel, low: float = 0.0, high: float = 500.0, out: str = "predicted_aqi") -> DataFrame:
    """Prediction clamped to [low, high] and rounded to two decimals, with its category."""
    scored = model.transform(df)
    raw = clip("prediction", low, high)
    extra = [c for c in scored.columns if c not in df.columns]
    return scored.withColumns({out: F.round(raw, 2), "category": A.aqi_category(raw)}).drop(*extra)


@dataclass
class TrainingResult:
    models: dict[str, PipelineModel]
    metrics: DataFrame | None
    failures: dict[str, str]
    features: list[str]
    #: The boosted trees behind the stages of ``models``.
    boosted: dict[str, BoostedModel] = field(default_factory=dict)


def train_all_evaluate(
    df: DataFrame, features: list[str], target: str, estimators: dict[str, Estimator | BoostedTrees], keep: list[str], city: str = "city"
) -> TrainingResult:
    """Fit every estimator on the ``train`` rows of ``split`` and measure it on the ``test`` rows.

    Columns derived from the target must not be among ``features``. The split table and the
    prepared training rows are written once for all models; all models score the test rows in one pass.
    A model that fails is recorded and left out.
    """
    leaks = [f for f in features if f == target or f.startswith(f"{target}_")]
    if leaks:
        raise ValueError(f"features derived from the target: {leaks}")
    df = materialized(df, "training-rows")
    train = df.filter(F.col("split") == "train")
    stages = FeatureStages.fit(train, features, city)
    columns = {"features": None} | {c: None for c in stages.inputs if any(isinstance(e, BoostedTrees) for e in estimators.values())}
    prepared = settle(stages.transform(train).select(*columns, F.col(target).cast("double").alias("label")), "training-features")
    models, failures, boosted = {}, {}, {}
    scored, parts = stages.transform(df.filter(F.col("split") == "test")), []
    for i, (name, estimator) in enumerate(estimators.items()):
        try:
            model = stages.fit_model(estimator, prepared, "label")
        except Exception as e:  # noqa: BLE001 - one model's failure must not stop the others
            failures[name] = str(e)
            continue
        models[name] = stages.with_model(model)
        if isinstance(model, BoostedModel):
            boosted[name] = model
            scored = model.stage(f"__p{i}").transform(scored)
        else:
            scored = model.copy({model.predictionCol: f"__p{i}"}).transform(scored)
        parts.append(F.struct(F.lit(name).alias("model"), clip(f"__p{i}", 0, 600).alias("predicted")))
    metrics = None
    if parts:
        scored = scored.select(*keep, F.col(target).cast("double").alias("actual"), F.explode(F.array(*parts)).alias("r"))
        metrics = regression_metrics(scored.select(*keep, "actual", "r.*"))
    return TrainingResult(models, metrics, failures, list(features), boosted)


def feature_importance(model: PipelineModel | BoostedModel, features: list[str], spark) -> DataFrame:
    """(feature, importance): the share of the gains for boosted trees, absolute coefficients for a linear model."""
    if isinstance(model, BoostedModel):
        return model.importance(spark, features)
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else [abs(x) for x in last.coefficients]
    rows = [(f, float(values[i])) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double")


# ---- multi-horizon forecasts from windows -------------------------------------------------


@dataclass
class Fourier:
    """Random cosine features of a window, ``sqrt(2 / n) * cos(w.x + b)``, which turn a line into a smooth curve; drawn once from a seed."""

    frequencies: list[list[float]]
    shifts: list[float]

    @classmethod
    def draw(cls, inputs: int, size: int, width: float = 1.0, seed: int = SEED) -> "Fourier":
        """``width`` is the distance between windows, relative to their usual size, over which forecasts change."""
        rng = np.random.default_rng(seed)
        frequencies = np.round(rng.normal(size=(size, inputs)) / (width * np.sqrt(inputs)), 6)
        return cls(frequencies.tolist(), np.round(rng.uniform(0, 2 * np.pi, size), 6).tolist())

    def expand(self, column: str) -> Column:
        # One literal, read at planning time, for thousands of numbers.
        text = json.dumps([{"w": w, "b": b} for w, b in zip(self.frequencies, self.shifts, strict=True)])
        drawn = F.from_json(F.lit(text), "array<struct<w:array<double>,b:double>>")
        scale = F.lit(float(np.sqrt(2 / len(self.shifts))))
        return F.transform(drawn, lambda k: scale * F.cos(F.aggregate(F.zip_with(k["w"], F.col(column), lambda a, x: a * x), k["b"], lambda a, x: a + x)))


@dataclass
class SequenceModel:
    """One regression per (target, forecast step) over the flattened, scaled history window.

    A line, or with ``fourier`` a line over the window and its random cosine features, fitted with a ridge. All regressions
    share the products of their inputs, so one pass over the windows fits every target and step.
    """

    keys: list[str]
    features: list[str]
    targets: list[str]
    shape: dict[str, int]
    scaler: Scaler
    #: (target, step) -> intercept and one weight per window value
    weights: dict[tuple[str, int], list[float]]
    fourier: Fourier | None = None

    @classmethod
    def fit(
        cls, daily: DataFrame, keys: list[str], features: list[str], targets: list[str] | str = "aqi",
        history: int = 24, horizon: int = 24, stride: int = 2, include_last: bool = False,
        most: int | None = None, fourier: int = 0, width: float = 1.0, ridge: float = 0.0, seed: int = SEED,
    ) -> "SequenceModel":
        """Scaling is fitted on ``daily`` only, so pass the training part. Targets must be among the features.

        Least squares; inputs that depend on each other share their weight (least norm). ``ridge`` is added to the products of each input but
        the intercept. Without any window every forecast is the training mean. ``most`` limits the windows of a series, by default all count.
        """
        self = cls._shaped(daily, keys, features, targets, history, horizon, stride, include_last, most, fourier, width, seed)
        rows = self._rows(daily).select(array_to_vector("row").alias("row"))
        self._solve(self._products(rows, self._sizes[0] + self._sizes[1]), ridge)
        return self

    @classmethod
    def _shaped(cls, daily, keys, features, targets, history, horizon, stride, include_last, most, fourier, width, seed) -> "SequenceModel":
        targets = [targets] if isinstance(targets, str) else list(targets)
        shape = {"history": history, "horizon": horizon, "stride": stride, "include_last": include_last, "most": most}
        drawn = Fourier.draw(history * len(features), fourier, width, seed) if fourier else None
        return cls(list(keys), list(features), targets, shape, Scaler.fit(daily, features), {}, drawn)

    @property
    def _sizes(self) -> tuple[int, int]:
        """Number of inputs with the intercept, and of outputs."""
        inputs = 1 + self.shape["history"] * len(self.features) + (len(self.fourier.shifts) if self.fourier else 0)
        return inputs, len(self.targets) * self.shape["horizon"]

    def _rows(self, daily: DataFrame) -> DataFrame:
        """Windows with ``row``: intercept, inputs and all outputs."""
        ahead = F.concat(*[F.transform("target", _field(t)) for t in self.targets])
        return self._windows(daily).withColumn("row", F.concat(self._expanded(), ahead))

    def _solve(self, products: np.ndarray, ridge: float) -> None:
        n = self._sizes[0]
        left, right = products[:n, :n].copy(), products[:n, n:]
        left[range(1, n), range(1, n)] += ridge
        solved = np.linalg.lstsq(left, right, rcond=1e-10)[0]
        outputs = [(t, h) for t in self.targets for h in range(1, self.shape["horizon"] + 1)]
        self.weights = {o: solved[:, i].tolist() for i, o in enumerate(outputs)}

    @staticmethod
    def _products(rows: DataFrame, size: int) -> np.ndarray:
        """Sums of products of all pairs of columns, from partial sums of fixed size."""
        if not rows.limit(1).count():
            return np.zeros((size, size))
        return RowMatrix(MLUtils.convertVectorColumnsFromML(rows)).computeGramianMatrix().toArray()

    def _inputs(self, column: str) -> Column:
        return F.flatten(F.transform(column, lambda x: F.array(*[x[f] for f in self.features])))

    def _expanded(self) -> Column:
        """What the weights of a regression belong to: intercept, window values, cosine features."""
        parts = [F.array(F.lit(1.0)), F.col("inputs")]
        return F.concat(*parts, self.fourier.expand("inputs")) if self.fourier else F.concat(*parts)

    def _windows(self, daily: DataFrame) -> DataFrame:
        scaled = self.scaler.transform(self.scaler.impute(daily))
        return sequence_windows(scaled, self.keys, self.features, self.targets, **self.shape).withColumn("inputs", self._inputs("history"))

    def _lines(self, spark, targets: list[str]) -> DataFrame:
        """(target, step, line): at most targets x steps rows."""
        rows = [(t, h, w) for (t, h), w in self.weights.items() if t in targets]
        return spark.createDataFrame(rows, "target_name string, step int, line array<double>")

    @staticmethod
    def _predicted() -> Column:
        products = F.zip_with("expanded", "line", lambda x, w: x * w)
        return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)

    def _unscaled(self, column: Column, target: Column) -> Column:
        """Back to the units of a target named by a column."""
        out = F.lit(None).cast("double")
        for t in self.targets:
            _, mean, std = self.scaler.stats[t]
            out = F.when(target == t, column * F.lit(std) + F.lit(mean)).otherwise(out)
        return out

    def evaluate(self, daily: DataFrame) -> DataFrame:
        """(keys, start, target, step, actual, predicted) over the windows of ``daily``, in original units."""
        steps = F.explode(F.sequence(F.lit(1), F.lit(self.shape["horizon"])))
        actual = F.element_at("target", F.col("step"))
        rows = self._windows(daily).withColumn("expanded", self._expanded()).withColumn("step", steps)
        rows = rows.withColumn("r", F.explode(F.array(*[F.struct(F.lit(t).alias("target_name"), actual[t].alias("y")) for t in self.targets])))
        rows = rows.select(*self.keys, "start", "step", "expanded", "r.*")
        joined = rows.join(F.broadcast(self._lines(daily.sparkSession, self.targets)), ["target_name", "step"])
        name = F.col("target_name")
        return joined.select(
            *self.keys, "start", name.alias("target"), "step", self._unscaled(F.col("y"), name).alias("actual"),
            self._unscaled(self._predicted(), name).alias("predicted"),
        )

    def _asked(self, daily: DataFrame, spine: DataFrame) -> DataFrame:
        """``spine`` with the ``step`` of each row and the ``expanded`` last window of its keys, null without history."""
        windows = explode_window(recent_window(daily, self.keys, self.features, self.shape["history"]), self.keys)
        filled = fill_forward_backward(windows, self.keys, self.features, order="position")
        scaled = self.scaler.transform(filled, bounded=True)
        packed = scaled.groupBy(*self.keys).agg(
            F.sort_array(F.collect_list(F.struct("position", *self.features))).alias("window")
        )
        known = packed.select(*self.keys, self._inputs("window").alias("inputs")).select(*self.keys, self._expanded().alias("expanded"))
        step = F.least(F.col("day_offset") + 1, F.lit(self.shape["horizon"])).cast("int")
        return spine.withColumn("step", step).join(known, self.keys, "left")

    def predict(self, daily: DataFrame, spine: DataFrame, target: str | None = None, fallback: DataFrame | None = None) -> DataFrame:
        """Forecast per row of ``spine`` (keys, date, day_offset).

        Offset d is step d + 1, offsets beyond the last step use the last. Days before the first (negative offsets) and
        keys without history take ``predicted_aqi`` from ``fallback`` (keys, date) and the tag ``simple_fallback``; without a
        fallback they stay empty.
        """
        target = target or self.targets[0]
        joined = self._asked(daily, spine).join(F.broadcast(self._lines(spine.sparkSession, [target]).drop("target_name")), "step", "left")
        usable = F.col("expanded").isNotNull() & F.col("line").isNotNull()
        raw = F.when(usable, clip(self._unscaled(self._predicted(), F.lit(target)), 0, 600))
        model, value = F.when(usable, F.lit(SEQUENCE_NAME)), raw
        out = joined.withColumns({"__raw": value, "model_used": model})
        if fallback is not None:
            simple = fallback.select(*self.keys, "date", F.col("predicted_aqi").alias("__simple"))
            out = out.join(simple, [*self.keys, "date"], "left").withColumns({
                "model_used": F.when(F.col("__raw").isNull() & F.col("__simple").isNotNull(), "simple_fallback").otherwise(F.col("model_used")),
                "__raw": F.coalesce("__raw", "__simple"),
            }).drop("__simple")
        return out.withColumns({"predicted_aqi": F.round("__raw", 2), "category": A.aqi_category("__raw")}).drop("__raw", "step", "expanded", "line")


def _field(name: str):
    return lambda x: x[name]


#: A uniform number at or above the k-th of these means a weight of at least k + 1: the Poisson distribution of mean one.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


@dataclass
class BootstrapForecast:
    """Forecasts of many resampled fits: their mean and the range most of them fall in.

    Every window counts in every sample as often as a Poisson variable of mean one says, which a hash of window and sample number draws, so
    that reruns and partitionings agree. One pass sums all samples' weighted products by (row, column) of the matrix; what
    reaches the driver does not depend on the number of windows.
    """

    members: list[SequenceModel]

    @classmethod
    def fit(
        cls, daily: DataFrame, keys: list[str], features: list[str], targets: list[str] | str = "aqi", samples: int = 20,
        history: int = 24, horizon: int = 24, stride: int = 2, include_last: bool = False,
        most: int | None = None, fourier: int = 0, width: float = 1.0, ridge: float = 1.0, seed: int = SEED,
    ) -> "BootstrapForecast":
        """Options as for :meth:`SequenceModel.fit`."""
        first = SequenceModel._shaped(daily, keys, features, targets, history, horizon, stride, include_last, most, fourier, width, seed)
        inputs, outputs = first._sizes
        size = inputs + outputs

        def counted(sample: int) -> Column:
            text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("start_date").cast("string"), F.lit(str(sample)))
            u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
            return F.size(F.filter(F.lit(_POISSON), lambda p: u >= p))

        places = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(inputs - 1)), lambda i: F.transform(
            F.sequence(i, F.lit(size - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get("row", i) * F.get("row", j)).alias("v")),
        )))
        rows = first._rows(daily).select("row", *[counted(s).alias(f"n{s}") for s in range(samples)])
        pairs = rows.select(*[f"n{s}" for s in range(samples)], F.inline(places))
        found = pairs.groupBy("i", "j").agg(*[F.sum(F.col("v") * F.col(f"n{s}")).alias(f"s{s}") for s in range(samples)]).toArrow()
        i, j = found["i"].to_numpy(), found["j"].to_numpy()
        members = []
        for s in range(samples):
            products = np.zeros((size, size))
            products[i, j] = found[f"s{s}"].to_numpy()
            below = np.tril_indices(inputs, -1)
            products[below] = products.T[below]
            member = replace(first, weights={})
            member._solve(products, ridge)
            members.append(member)
        return cls(members)

    def predict(self, daily: DataFrame, spine: DataFrame, target: str | None = None, level: float = 0.9) -> DataFrame:
        """``spine`` with ``predicted_aqi`` (mean), ``spread`` (population deviation), ``low`` and ``high`` (the range that holds ``level`` of the samples).

        Rows with a negative offset or without history stay empty.
        """
        first = self.members[0]
        target = target or first.targets[0]
        rows = [(h, w) for m in self.members for (t, h), w in m.weights.items() if t == target]
        lines = spine.sparkSession.createDataFrame(rows, "step int, line array<double>")  # samples x steps rows
        joined = first._asked(daily, spine).join(F.broadcast(lines), "step", "left")
        value = first._unscaled(first._predicted(), F.lit(target))
        edges = F.percentile("__v", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
        out = joined.select(*spine.columns, value.alias("__v")).groupBy(*spine.columns).agg(
            F.avg("__v").alias("__mean"), F.stddev_pop("__v").alias("spread"), edges.alias("__edges"),
        )
        mean = clip("__mean", 0, 600)
        return out.withColumns({
            "predicted_aqi": F.round(mean, 2), "category": A.aqi_category(mean), "low": F.round(clip(F.get("__edges", F.lit(0)), 0, 600), 2),
            "high": F.round(clip(F.get("__edges", F.lit(1)), 0, 600), 2),
        }).drop("__mean", "__edges")
