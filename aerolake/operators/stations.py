"""Station metadata: enrichment, valid stations and identifier matching.

A row is offered under each of its identifiers and matched by one equi-join on
the identifier, which replaces a join condition with OR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.operators.sets import dedupe_keep_first
from aerolake.plans.joins import join_dimension, settle

IDENTIFIERS = ["station_id", "station", "station_name"]


def station_dimension(stations: DataFrame, order: list[str]) -> DataFrame:
    """One row per station: keyed by the id, else the name, else the station column."""
    key = next(c for c in ("station_id", "station_name", "station") if c in stations.columns)
    return dedupe_keep_first(stations, [key], order)


def enrich_station_metadata(readings: DataFrame, stations: DataFrame, order: list[str], null_safe: bool = False) -> DataFrame:
    """Left join readings with the station dimension on ``station_id``.

    City is filled from the dimension where it is null; other columns present
    on both sides get the suffix ``_meta``. Null ids match nothing unless ``null_safe``.
    """
    wanted = [c for c in ("city", "state", "station_name") if c in stations.columns]
    dim = dedupe_keep_first(stations, ["station_id"], order).select("station_id", *wanted)
    both = [c for c in wanted if c in readings.columns]
    out = join_dimension(
        readings, dim.withColumnsRenamed({c: f"{c}_meta" for c in both}), ["station_id"], null_safe=null_safe, bound=stations
    )
    if "city" in both:
        out = out.withColumn("city", F.coalesce("city", "city_meta")).drop("city_meta")
    return out


def valid_stations(stations: DataFrame) -> DataFrame:
    """Stations with a usable name; id and name stand in for each other, defaults for the rest."""

    def col(name: str):
        return F.nullif(F.col(name), F.lit("")) if name in stations.columns else F.lit(None).cast("string")

    name0 = F.coalesce(col("station_name"), col("station"))
    id0 = F.coalesce(col("station_id"), col("station"))

    def plain(c: str, kind: str):
        return (F.col(c) if c in stations.columns else F.lit(None)).cast(kind)

    out = stations.select(
        F.coalesce(id0, name0).alias("station_id"),
        F.coalesce(name0, id0).alias("station_name"),
        "city",
        F.coalesce(plain("state", "string"), F.lit("Unknown")).alias("state"),
        F.coalesce(plain("station_type", "string"), F.lit("Unknown")).alias("station_type"),
        plain("latitude", "double").alias("latitude"),
        plain("longitude", "double").alias("longitude"),
        F.coalesce(plain("status", "string"), F.lit("Active")).alias("status"),
    )
    bad = F.lower(F.trim("station_name")).isin("unknown", "nan", "")
    return out.filter(F.col("station_name").isNotNull() & ~bad)


def match_station_any(readings: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of each requested (city, request_station), matched on any of the three identifiers.

    A row is offered once under each of its distinct identifiers, which leaves one equi-join.
    """
    offered = readings.withColumn("request_station", F.explode(F.array_distinct(F.array_compact(F.array(*IDENTIFIERS)))))
    wanted = requests.select("city", "request_station").distinct()
    return join_dimension(offered, wanted, ["city", "request_station"], "inner", bound=requests)


# Order in which identifiers are tried: the reading's column and the request's column.
CASCADE = [(1, "station_id", "station_id"), (2, "station_name", "station_name"), (3, "station", "station_name")]


def offered_keys(side: int) -> Column:
    """One (match_rank, match_key) per identifier, of readings (side 1) or requests (side 2)."""
    pairs = [F.struct(F.lit(step[0]).alias("match_rank"), F.col(step[side]).alias("match_key")) for step in CASCADE]
    return F.explode(F.filter(F.array(*pairs), lambda p: p["match_key"].isNotNull())).alias("offer")


def cascade_keys(present: DataFrame, requests: DataFrame) -> DataFrame:
    """(station_id, match_rank, match_key): the first identifier of each request among the present keys."""
    wanted = requests.select(F.col("station_id").alias("request_id"), offered_keys(2)).select("request_id", "offer.*")
    found = wanted.join(present.select("match_rank", "match_key"), ["match_rank", "match_key"])
    best = F.min(F.struct("match_rank", "match_key")).alias("best")
    return found.groupBy(F.col("request_id").alias("station_id")).agg(best).select("station_id", "best.*")


def match_station_cascade(readings: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match by id, else by name, else by the station column.

    Returns (rows tagged with match_rank and match_key, request -> key).
    Requests that share a name share its rows, so the rows are not repeated per request.
    """
    ids = readings.select(*IDENTIFIERS).distinct()
    present = ids.select(offered_keys(1)).select("offer.*").distinct()
    keys = settle(cascade_keys(present, requests), "station-requests")
    offered = readings.select("*", offered_keys(1)).select(*readings.columns, "offer.*")
    chosen = keys.select("match_rank", "match_key").distinct()
    return join_dimension(offered, chosen, ["match_rank", "match_key"], "inner", bound=keys), keys
