"""What the vector searches share.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without an id or vectors of another length than most have (equal counts: the longer
one). Equal rows count once. A query never finds rows of its own id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.plans.joins import settle


def usable(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int, int]:
    """``vec_id`` and ``vector`` (doubles) written to the shared folder, their number and their length."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    rows = settle(rows.filter((F.size("vector") > 0) & F.coalesce(finite, F.lit(False))).distinct(), "vectors")
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return rows, 0, 0
    return rows.filter(F.size("vector") == common.d), common["count"], common.d


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dim))
