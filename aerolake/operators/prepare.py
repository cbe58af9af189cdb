"""Leak-free preparation: stable split, median imputation, standard scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions.values import as_col, bound_scaled
from aerolake.plans.quantiles import exact_quantiles


def hash_fraction(keys: list[str]) -> Column:
    """Uniform number in [0, 1) from the row key; the same on every run and partitioning."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def random_split(df: DataFrame, keys: list[str], share: float = 0.1, max_rows: int | None = None) -> DataFrame:
    """Mark rows ``test`` with probability ``share``, else ``train``; with ``max_rows`` at most about so many are tests."""
    limit = F.lit(share)
    if max_rows is not None:
        limit = F.least(limit, F.try_divide(F.lit(float(max_rows)), df.agg(F.count("*")).scalar()))
    return df.withColumn("split", F.when(hash_fraction(keys) < limit, "test").otherwise("train"))


@dataclass
class Scaler:
    """Median, mean and population deviation per feature, fitted on the training rows."""

    stats: dict[str, tuple[float, float, float]]

    @classmethod
    def fit(cls, train: DataFrame, features: list[str], impute: bool = True) -> "Scaler":
        medians = {f: 0.0 for f in features}
        if impute:
            medians = {f: q[0] if q[0] is not None else 0.0 for f, q in exact_quantiles(train, features, [0.5]).items()}
        filled = {f: F.coalesce(F.nanvl(as_col(f).cast("double"), F.lit(None)), F.lit(medians[f])) for f in features}
        aggs = []
        for f in features:
            aggs += [F.avg(filled[f]).alias(f"{f}__mean"), F.stddev_pop(filled[f]).alias(f"{f}__std")]
        row = train.agg(*aggs).collect()[0]
        stats = {}
        for f in features:
            std = row[f"{f}__std"]
            stats[f] = (medians[f], row[f"{f}__mean"] or 0.0, std if std else 1.0)
        return cls(stats)

    def frame(self, spark) -> DataFrame:
        rows = [(f, *[float(x) for x in s]) for f, s in self.stats.items()]
        return spark.createDataFrame(rows, "feature string, median double, mean double, std double")

    def impute(self, df: DataFrame) -> DataFrame:
        """Missing values to the training median."""
        return df.withColumns(
            {f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(s[0])) for f, s in self.stats.items() if f in df.columns}
        )

    def transform(self, df: DataFrame, bounded: bool = False) -> DataFrame:
        """(x - mean) / std of imputed columns, with non-finite results bounded on request."""
        cols = {}
        for f, (_, mean, std) in self.stats.items():
            if f in df.columns:
                z = (F.col(f) - F.lit(mean)) / F.lit(std)
                cols[f] = bound_scaled(z) if bounded else z
        return df.withColumns(cols)

    def inverse(self, df: DataFrame, features: list[str] | None = None) -> DataFrame:
        """x * std + mean, for all fitted columns or a subset."""
        chosen = [f for f in (features or self.stats) if f in df.columns]
        return df.withColumns({f: F.col(f) * F.lit(self.stats[f][2]) + F.lit(self.stats[f][1]) for f in chosen})


def median_impute(train: DataFrame, df: DataFrame, features: list[str]) -> DataFrame:
    """Fill missing values of ``df`` with medians of ``train``."""
    medians = exact_quantiles(train, features, [0.5])
    return df.fillna({f: q[0] for f, q in medians.items() if q[0] is not None})
