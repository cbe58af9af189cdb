"""City names: canonical form, unmapped names, known cities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolake import lookups
from aerolake.functions.values import lookup_key
from aerolake.plans.joins import join_dimension, settle

POLICIES = ("null", "error", "lower", "keep")


def alias_table(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    """(alias, canonical) rows of a fixed mapping."""
    rows = list((mapping or lookups.CITY_ALIASES).items())
    return spark.createDataFrame(rows, "alias string, canonical string")


def city_coordinates(spark: SparkSession) -> DataFrame:
    rows = [(c, lat, lon) for c, (lat, lon) in lookups.CITY_COORDINATES.items()]
    return spark.createDataFrame(rows, "city string, latitude double, longitude double")


def canonical_cities(aliases: DataFrame) -> DataFrame:
    return aliases.select(F.col("canonical").alias("city")).distinct()


def alias_keys(aliases: DataFrame) -> DataFrame:
    """(__alias, canonical): one row per look-up key; of several names for one key the first by alias and name."""
    keyed = aliases.select(lookup_key("alias").alias("__alias"), "alias", "canonical").filter("__alias IS NOT NULL")
    return keyed.groupBy("__alias").agg(F.min_by("canonical", F.struct("alias", "canonical")).alias("canonical"))


def normalize_city(
    df: DataFrame, aliases: DataFrame, column: str = "city", policy: str = "null", keep_original: bool = True
) -> DataFrame:
    """Replace ``column`` by its canonical name.

    An unmapped name becomes null, fails the query (``error``), becomes its
    lower-case form (``lower``) or stays as it is (``keep``).
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    raw = F.col(column)
    if keep_original and "city_original" not in df.columns:
        df = df.withColumn("city_original", raw)
    joined = join_dimension(df.withColumn("__alias", lookup_key(column)), alias_keys(aliases), ["__alias"], bound=aliases)
    found = F.col("canonical")
    name = {
        "null": found,
        "error": F.when(found.isNull(), F.raise_error(F.concat(F.lit("city not supported: "), F.coalesce(raw, F.lit("null")))))
        .otherwise(found),
        "lower": F.coalesce(found, lookup_key(column)),
        "keep": F.coalesce(found, raw),
    }[policy]
    return joined.withColumn(column, name.cast("string")).drop("__alias", "canonical")


def unmapped_cities(df: DataFrame, aliases: DataFrame, column: str = "city") -> DataFrame:
    """Distinct names without an alias, leaving out empty and unknown ones."""
    names = df.select(F.col(column).alias("city_original")).distinct()
    names = names.withColumn("__alias", lookup_key("city_original"))
    names = names.filter(F.col("__alias").isNotNull() & ~F.col("__alias").isin("", "nan", "unknown"))
    dim = aliases.select(lookup_key("alias").alias("__alias"))
    return join_dimension(names, dim, ["__alias"], "left_anti").drop("__alias")


def keep_known_cities(df: DataFrame, cities: DataFrame) -> DataFrame:
    """Rows whose city is in ``cities``."""
    return join_dimension(df, cities.select("city").distinct(), ["city"], "left_semi", bound=cities)


def encode_city(df: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Alphabetical integer code per city as ``city_encoded``; unseen cities get 0."""
    codes = settle(city_codes(df), "city-codes") if codes is None else codes
    joined = join_dimension(df.withColumn("__city", F.coalesce("city", F.lit("Unknown"))),
                            codes.withColumnRenamed("city", "__city"), ["__city"])
    return joined.withColumn("city_encoded", F.coalesce("city_encoded", F.lit(0))).drop("__city")


def city_codes(df: DataFrame) -> DataFrame:
    """(city, city_encoded) over the distinct cities; the ordered window sees one row per city."""
    cities = df.select(F.coalesce("city", F.lit("Unknown")).alias("city")).distinct()
    return cities.withColumn("city_encoded", F.row_number().over(Window.orderBy("city")) - 1)
