"""Profiles, completeness and outlier bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake import lookups, schema
from aerolake.functions.values import as_col
from aerolake.operators.sets import latest_row
from aerolake.plans.quantiles import exact_quantiles


def dataset_summary(df: DataFrame) -> DataFrame:
    """Records and files per file, per dataset and in total."""
    per_file = df.groupBy("source_dataset", "source_file").agg(F.count("*").alias("records"))
    return (
        per_file.rollup("source_dataset", "source_file")
        .agg(F.sum("records").alias("records"), F.count("*").alias("files"), F.grouping_id().alias("g"))
        .select(
            F.when(F.col("g") == 0, "file").when(F.col("g") == 1, "dataset").otherwise("total").alias("level"),
            "source_dataset", "source_file", "records", "files",
        )
    )


def coverage_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct cities, original cities, stations, datasets and the date span, in one row.

    The rows are first reduced to distinct combinations, so that the exact
    distinct counts run on the dimension members only.
    """
    names = ["city", "city_original", "station", "source_dataset"]
    combos = df.groupBy(*names).agg(
        F.count("*").alias("records"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    distinct = F.approx_count_distinct if approx else F.count_distinct
    out = combos.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        distinct("city").alias("cities"),
        distinct("city_original").alias("original_cities"),
        distinct("station").alias("stations"),
        distinct("source_dataset").alias("datasets"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    return out.withColumn("total_days", F.datediff("last_date", "first_date"))


def completeness(df: DataFrame, columns: list[str] = tuple(schema.PRIMARY_POLLUTANTS)) -> DataFrame:
    """Non-null count and percent per column, one row each."""
    have = [c for c in columns if c in df.columns]
    counted = df.agg(*[F.count(c).alias(c) for c in have], F.count("*").alias("__n"))
    long = counted.unpivot(["__n"], have, "column", "non_null")
    percent = F.round(F.try_divide(F.col("non_null") * 100.0, F.col("__n")), 4)
    return long.select("column", "non_null", F.coalesce(percent, F.lit(0.0)).alias("percent"))


def reliable_features(
    df: DataFrame,
    candidates: list[str] = tuple(lookups.CORE_FEATURES + lookups.ADDITIONAL_FEATURES),
    share: float = lookups.RELIABLE_SHARE,
) -> DataFrame:
    """Candidate columns with more than ``share`` of their values present."""
    have = [c for c in candidates if c in df.columns]
    counted = df.agg(*[F.count(c).alias(c) for c in have], F.count("*").alias("__n"))
    long = counted.unpivot(["__n"], have, "feature", "non_null")
    return long.filter(F.col("non_null") > F.col("__n") * share).select("feature", "non_null")


class IqrBounds:
    """Interquartile limits per column, fitted on whole columns."""

    def __init__(self, table: dict[str, tuple[float, float, float, float]]):
        self.table = table

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] = tuple(schema.CAPPED_COLUMNS), approx: bool = False) -> "IqrBounds":
        have = [c for c in columns if c in df.columns]
        if approx:
            row = df.agg(*[F.percentile_approx(c, [0.25, 0.75], 10_000).alias(c) for c in have]).collect()[0]
            quartiles = {c: row[c] or [None, None] for c in have}
        else:
            quartiles = exact_quantiles(df, have, [0.25, 0.75])
        table = {}
        for c, (q1, q3) in quartiles.items():
            if q1 is not None and q3 - q1 != 0:
                table[c] = (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        return cls(table)

    def frame(self, spark) -> DataFrame:
        rows = [(c, *v) for c, v in self.table.items()]
        return spark.createDataFrame(rows, "feature string, q1 double, q3 double, lower double, upper double")

    def capped(self, name: str, c: Column | str | None = None) -> Column:
        c = as_col(c if c is not None else name)
        if name not in self.table:
            return c
        _, _, low, high = self.table[name]
        return F.when(c < low, low).when(c > high, high).otherwise(c)

    def transform(self, df: DataFrame) -> DataFrame:
        """Clamp every fitted column to its limits."""
        cols = {c: self.capped(c) for c in self.table if c in df.columns}
        return df.withColumns(cols) if cols else df

    def outlier_count(self, df: DataFrame) -> DataFrame:
        """Rows outside the limits per column."""
        have = [c for c in self.table if c in df.columns]
        counted = df.agg(*[F.count_if((F.col(c) < self.table[c][2]) | (F.col(c) > self.table[c][3])).alias(c) for c in have])
        return counted.unpivot([], have, "feature", "outliers")


def cap_outliers(df: DataFrame, columns: list[str] = tuple(schema.CAPPED_COLUMNS), approx: bool = False) -> DataFrame:
    return IqrBounds.fit(df, columns, approx).transform(df)


def city_profile(df: DataFrame, sample_order: list[str] = ("station", "date"), samples: int = 3) -> DataFrame:
    """Records, date span, stations and the first sample rows per city.

    Only the sample rows pass a window, and Spark cuts each map task to
    ``samples`` rows per city before shuffling them.
    """
    per_station = df.groupBy("city", "station").agg(
        F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    stats = per_station.groupBy("city").agg(
        F.sum("n").alias("records"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"),
        F.count("station").alias("stations"),
    )
    order = Window.partitionBy("city").orderBy(*sample_order)
    head = df.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= samples)
    rest = [c for c in df.columns if c != "city"]
    head = head.groupBy("city").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__rn", F.struct(*rest).alias("row")))), lambda x: x["row"]).alias("sample")
    )
    return stats.join(head, "city")


def system_counts(history: DataFrame, live: DataFrame) -> DataFrame:
    """Records and cities of the history and cities of the live table, in one row."""
    per_city = history.groupBy("city").agg(F.count("*").alias("n"))
    live_cities = live.select("city").distinct().agg(F.count("city")).scalar()
    return per_city.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("city").alias("cities_available")
    ).withColumn("realtime_cities", live_cities)


def latest_per_city(df: DataFrame, order: list[str]) -> DataFrame:
    return latest_row(df, ["city"], order)
