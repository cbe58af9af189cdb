"""Daily means as stored partial states that late rows can still join.

A state holds for each key and day the sum and count of every measure and, for every attribute, the first value with its order.
States of any parts of the readings, in any order, merge into that of all of them, so a late row changes its day instead of
being dropped, and only the months it falls into are read and written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.streaming import current


def partial_states(df: DataFrame, keys: list[str], measures: list[str], attributes: list[str] = (), order: list[str] = ()) -> DataFrame:
    """One state for each key; rows with a null key are left out. ``order`` says which row's attribute is first and is needed with attributes."""
    if attributes and not order:
        raise ValueError("attributes need an order")
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    aggs = []
    for m in measures:
        value = F.nanvl(F.col(m).cast("double"), F.lit(None))
        aggs += [F.sum(value).alias(f"{m}__sum"), F.count(value).alias(f"{m}__n")]
    for a in attributes:
        first = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(a).alias("value"))
        aggs.append(F.min(F.when(F.col(a).isNotNull(), first)).alias(f"{a}__first"))
    return df.groupBy(*keys).agg(*aggs, F.count("*").alias("n"))


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """One state for each key from several of it."""
    aggs = [F.min(c).alias(c) if c.endswith("__first") else F.sum(c).alias(c) for c in states.columns if c not in keys]
    return states.groupBy(*keys).agg(*aggs)


def finish(states: DataFrame, keys: list[str]) -> DataFrame:
    """Means, first attributes and the number of rows ``n``."""
    out = [F.try_divide(c, f"{c[:-5]}__n").alias(c[:-5]) for c in states.columns if c.endswith("__sum")]
    out += [F.col(c)["value"].alias(c[:-7]) for c in states.columns if c.endswith("__first")]
    return states.select(*keys, *out, "n")


def month(date: str = "date"):
    """What a stored table of states is divided by."""
    return F.date_format(date, "yyyy-MM")


def add_readings(rows: DataFrame, number: int, out: str, keys: list[str], measures: list[str], attributes: list[str] = (), order: list[str] = (), date: str = "date") -> None:
    """Merges readings, early or late, into the states stored at ``out``; ``keys`` include ``date``. A batch of one number counts once however often it runs."""
    new = partial_states(rows, keys, measures, attributes, order)

    def merge(old: DataFrame | None, states: DataFrame) -> DataFrame:
        return merge_states(states if old is None else old.unionByName(states), keys)

    current.rewrite(new, number, out, month(date), merge)


def stored(spark: SparkSession, out: str, example: DataFrame, keys: list[str], measures: list[str], attributes: list[str] = (), order: list[str] = ()) -> DataFrame:
    """The daily table from the states at ``out``; ``example`` has the readings' schema."""
    shape = partial_states(example, keys, measures, attributes, order).schema
    return finish(current.read(spark, out, shape), keys)
