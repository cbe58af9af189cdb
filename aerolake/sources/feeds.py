"""Provider JSON payloads to canonical live rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import aqi as A
from aerolake.functions.values import as_col

# Measure codes of the nested feed and the columns they fill.
IAQI_CODES = {
    "pm25": "pm25", "pm10": "pm10", "no2": "no2", "so2": "so2", "co": "co", "o3": "o3",
    "t": "temperature", "h": "humidity", "p": "pressure", "w": "wind_speed",
}
COMPONENTS = {"pm2_5": "pm25", "pm10": "pm10", "no2": "no2", "so2": "so2", "co": "co", "o3": "o3"}

IAQI_SCHEMA = (
    "status string, data struct<aqi:double, city:struct<name:string>, iaqi:struct<"
    + ", ".join(f"{code}:struct<v:double>" for code in IAQI_CODES)
    + ">>"
)
COMPONENT_SCHEMA = (
    "list array<struct<main:struct<aqi:int>, components:struct<"
    + ", ".join(f"{c}:double" for c in COMPONENTS)
    + ">>>"
)


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def parse_feed_iaqi(df: DataFrame, payload: str = "payload", city: str = "city") -> DataFrame:
    """Nested-measure payloads with status ok; absent measures are 0, the station is the named city."""
    parsed = df.withColumn("__p", F.from_json(payload, IAQI_SCHEMA)).filter(F.col("__p.status") == "ok")
    measures = {name: _or_zero(F.col(f"__p.data.iaqi.{code}.v")) for code, name in IAQI_CODES.items()}
    return parsed.withColumns({
        "aqi": _or_zero(F.col("__p.data.aqi")), **measures,
        "station": F.coalesce(F.col("__p.data.city.name"), F.col(city)), "source": F.lit("waqi"),
    }).drop("__p", payload)


def parse_feed_variant(df: DataFrame, payload: str = "payload", city: str = "city") -> DataFrame:
    """Nested-measure payloads of any shape, each row kept: what :func:`parse_feed_iaqi` gives, and what it would lose.

    ``other_measures`` maps the codes of measures without a column of their own to their values, ``malformed`` marks payloads that are no
    JSON, ``usable`` those with status ok. Values of another type than expected are null there and 0 in the measures.
    """
    parsed = df.withColumn("__v", F.try_parse_json(payload))
    node = F.col("__v")

    def number(path: str) -> Column:
        return _or_zero(F.try_variant_get(node, path, "double"))

    codes = F.lit(list(IAQI_CODES))
    every = F.try_variant_get(node, "$.data.iaqi", "map<string,variant>")
    other = F.transform_values(F.map_filter(every, lambda k, _: ~F.array_contains(codes, k)), lambda _, x: F.try_variant_get(x, "$.v", "double"))
    return parsed.withColumns({
        "aqi": number("$.data.aqi"), **{name: number(f"$.data.iaqi.{code}.v") for code, name in IAQI_CODES.items()},
        "station": F.coalesce(F.try_variant_get(node, "$.data.city.name", "string"), F.col(city)), "source": F.lit("waqi"),
        "other_measures": F.when(F.size(other) > 0, other), "malformed": node.isNull() & F.col(payload).isNotNull(),
        "usable": F.coalesce(F.try_variant_get(node, "$.status", "string") == "ok", F.lit(False)),
    }).drop("__v", payload)


def feed_shape(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The schema that covers all payloads, in one row (``shape``), to see what providers have added."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(payload)).alias("shape"))


def parse_feed_components(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Component-list payloads: the first element; payloads with an empty list are skipped."""
    parsed = df.withColumn("__p", F.from_json(payload, COMPONENT_SCHEMA)).filter(F.size("__p.list") > 0)
    first = F.try_element_at(F.col("__p.list"), F.lit(1))
    measures = {name: _or_zero(first["components"][code]) for code, name in COMPONENTS.items()}
    return parsed.withColumns({
        "aqi": A.provider_aqi(first["main"]["aqi"]), **measures, "source": F.lit("openweather"),
    }).drop("__p", payload)


def feed_source_priority(feeds: DataFrame, sources: list[str], city: str = "city", source: str = "source", ts: str = "ts") -> DataFrame:
    """One row per city: the newest row of the first source, in the order given, that has any."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]), as_col(source))
    rest = [c for c in feeds.columns if c != city]
    known = feeds.filter(rank > 0)
    best = known.groupBy(city).agg(F.max_by(F.struct(*rest), F.struct(-rank, F.col(ts), *rest)).alias("row"))
    return best.select(city, "row.*")
