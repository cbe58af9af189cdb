"""Profiles of growing tables from stored sketches: distinct counts by theta sketches, quantiles by KLL sketches.

A profile row holds, for one month, the rows, the first and last date, a theta sketch of each name column and a KLL sketch of each measure. Rows of
any parts merge into the row of all of them, so new readings change the months they fall into and nothing is scanned again.
Theta sketches also intersect: cities that are live *and* in the history. They are exact up to about 4096 different values
(``2 ** lg``), and the error of a KLL rank is about 1 % of the rows at the default size; both have a bounded size whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.plans import quantiles
from aerolake.streaming import current

LG = 12
KLL_SIZE = 400


def month(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


def profile(df: DataFrame, names: list[str], measures: list[str], date: str = "date") -> DataFrame:
    """One profile row for each month; rows without a date belong to the month null."""
    aggs = [F.count("*").alias("records"), F.min(date).alias("first_date"), F.max(date).alias("last_date")]
    aggs += [F.theta_sketch_agg(n, LG).alias(f"{n}__theta") for n in names]
    clean = {m: F.nanvl(F.col(m).cast("double"), F.lit(None)) for m in measures}
    aggs += [F.kll_sketch_agg_double(clean[m], KLL_SIZE).alias(f"{m}__kll") for m in measures]
    return df.groupBy(month(date).alias("month")).agg(*aggs)


def merge_profiles(rows: DataFrame, by: str | None = "month") -> DataFrame:
    """One profile from several of each month, or of all with ``by`` None."""
    aggs = [F.sum("records").alias("records"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")]
    aggs += [F.theta_union_agg(c, LG).alias(c) for c in rows.columns if c.endswith("__theta")]
    aggs += [F.kll_merge_agg_double(c, KLL_SIZE).alias(c) for c in rows.columns if c.endswith("__kll")]
    return rows.groupBy(by).agg(*aggs) if by else rows.agg(*aggs)


def add_rows(df: DataFrame, number: int, out: str, names: list[str], measures: list[str], date: str = "date") -> None:
    """Merges the profile of new rows into the one stored at ``out``; a batch of one number counts once."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if old is None else merge_profiles(old.unionByName(new))

    current.rewrite(profile(df, names, measures, date), number, out, F.coalesce(F.col("month"), F.lit("none")), merge)


def stored(spark: SparkSession, out: str, names: list[str], measures: list[str]) -> DataFrame:
    columns = [f"`{n}__theta` binary" for n in names] + [f"`{m}__kll` binary" for m in measures]
    return current.read(spark, out, ", ".join(["month string", "records bigint", "first_date date", "last_date date", *columns]))


def coverage(rows: DataFrame) -> DataFrame:
    """Records, distinct values of each name column and the span of days, in one row."""
    whole = merge_profiles(rows, None)
    counts = [F.theta_sketch_estimate(c).alias(c[: -len("__theta")]) for c in whole.columns if c.endswith("__theta")]
    return whole.select("records", *counts, "first_date", "last_date", F.datediff("last_date", "first_date").alias("total_days"))


def in_both(one: DataFrame, other: DataFrame, name: str, other_name: str | None = None) -> DataFrame:
    """Distinct values of a column in either profile, in both, and only in the first, in one row."""
    a = one.agg(F.theta_union_agg(f"{name}__theta", LG).alias("a")).scalar()
    b = other.agg(F.theta_union_agg(f"{other_name or name}__theta", LG).alias("b")).scalar()
    both = one.limit(1).select(a.alias("a"), b.alias("b"))
    return both.select(
        F.theta_sketch_estimate(F.theta_union("a", "b", F.lit(LG))).alias("either"), F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("both"),
        F.theta_sketch_estimate(F.theta_difference("a", "b")).alias("first_only"),
    )


def approximate_quantiles(rows: DataFrame, measures: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Quantiles of the rows behind a profile, without reading them; null for a column without values."""
    whole = merge_profiles(rows, None)
    exprs = [F.kll_sketch_get_n_double(f"{m}__kll").alias(f"n{i}") for i, m in enumerate(measures)]
    n = whole.select(*exprs).first()
    full = [m for i, m in enumerate(measures) if n is not None and n[f"n{i}"]]
    out: dict[str, list[float | None]] = {m: [None] * len(probabilities) for m in measures}
    if full:
        row = whole.select(*[F.kll_sketch_get_quantile_double(f"{m}__kll", F.lit(float(p))) for m in full for p in probabilities]).first()
        out |= {m: list(row[i * len(probabilities) : (i + 1) * len(probabilities)]) for i, m in enumerate(full)}
    return out


def exact_quantiles(df: DataFrame, rows: DataFrame, measures: list[str], probabilities: list[float], margin: float = 0.02) -> dict[str, list[float | None]]:
    """Exact quantiles of ``df``, whose profile is ``rows``: the stored sketches bracket them, so the first pass already counts within narrow brackets."""
    edges = {}
    for m in measures:
        low = approximate_quantiles(rows, [m], [max(0.0, p - margin) for p in probabilities])[m]
        high = approximate_quantiles(rows, [m], [min(1.0, p + margin) for p in probabilities])[m]
        edges[m] = list(zip(low, high, strict=True))
    return quantiles.exact_quantiles(df, measures, probabilities, edges=edges)
