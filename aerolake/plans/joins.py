"""Joins of large tables with dimensions.

A dimension is broadcast only after its row count was checked against a
bound. Two tables that both have one row per city or station are joined
plainly; Spark then decides by their measured sizes. Beyond the bound the dimension is repeated over a few salt values and
the large side gets one salt per row, so that a key holding a large share of
the rows is spread over ``salts`` tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.session import shared_dir

BROADCAST_ROWS = 200_000
SALTS = 32


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    A bound Spark can prove from the plan (a local relation, a limit) is taken
    as it is; otherwise at most ``max_rows + 1`` rows are counted.
    """
    proven = df._jdf.queryExecution().optimizedPlan().maxRows()
    if proven.isDefined():
        return proven.get() <= max_rows
    return df.select(F.lit(1).alias("one")).limit(max_rows + 1).count() <= max_rows


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    For a table that is computed from many more rows than it has and is then
    used more than once: it is computed once, and its size is known to the planner.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes what :func:`settle` wrote; for a table that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def derived(df: DataFrame) -> bool:
    """True when ``df`` is more than a scan with projections and filters, so that reading it twice is costly."""

    def names(node):
        yield node.nodeName()
        children = node.children()
        for i in range(children.size()):
            yield from names(children.apply(i))

    return any(n in ("Aggregate", "Join", "Window", "Sort", "Generate", "Union") for n in names(df._jdf.queryExecution().optimizedPlan()))


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` itself when it only scans, else written once to the shared folder; for tables read by several jobs."""
    return settle(df, purpose) if derived(df) else df


def join_dimension(
    rows: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    null_safe: bool = False,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` with a dimension on equally named keys; the keys are kept once.

    ``how`` is left, inner, left_semi or left_anti. With ``null_safe`` null keys match null keys.
    ``bound`` is a table with at least as many rows that is cheaper to count than ``dim``.
    """
    keys = {k: f"__dim_{k}" for k in on}
    right = dim.withColumnsRenamed(keys)
    condition = None
    for k, renamed in keys.items():
        test = F.col(k).eqNullSafe(F.col(renamed)) if null_safe else F.col(k) == F.col(renamed)
        condition = test if condition is None else condition & test
    if is_small(dim if bound is None else bound, max_rows):
        return rows.join(F.broadcast(right), condition, how).drop(*keys.values())
    # The salt depends on the row and its input partition only, so a re-run task repeats it, and
    # copies of one row from different partitions still get different salts.
    row = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*row, F.spark_partition_id()), F.lit(salts).cast("bigint")))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    right = right.withColumn("__dim_salt", F.explode(every))
    joined = salted.join(right, condition & (F.col("__salt") == F.col("__dim_salt")), how)
    return joined.drop("__salt", "__dim_salt", *keys.values())
