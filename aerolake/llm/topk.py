"""Exact top-k inner products by no-random-access aggregation.

Rows are dealt to blocks. A block keeps one list for each dimension, its rows sorted by that
component; a query reads a list from the end that its own component favours. All lists
are read to the same depth, in steps. What has been read gives every row a lower bound
(unread components at the worst value of their list) and an upper bound (unread components
at the value last read). Reading stops when the rows whose upper bound reaches the
k-th lower bound are few: no outsider can qualify, and only their final scores are
resolved. The bounds of all queries of a block are matrix products over the entries
read so far. Results of the blocks are merged. Integer scores, no rounding.

See ``vectors`` for rows that take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.llm.common import on_workers
from aerolake.llm.vectors import matrix, usable

STEPS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0)


class Lists:
    """The sorted lists of a block of integer vectors, read from both ends."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x.astype(np.float64)
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)
        n, d = x.shape
        # Column j: list j from the top, for queries with a positive component; column d + j: from the bottom.
        self.worst = np.concatenate([self.sorted[0], self.sorted[-1]])
        self.seen = np.zeros((n, 2 * d))
        self.read = np.zeros((n, 2 * d))
        self.depth = 0
        self.last = np.concatenate([self.sorted[-1], self.sorted[0]])

    def advance(self, share: float) -> None:
        """Reads all lists on to this share of their length."""
        n, d = self.x.shape
        to = max(self.depth, min(n, int(np.ceil(share * n))))
        for ids, at in ((self.order[n - to : n - self.depth], 0), (self.order[self.depth : to], d)):
            columns = np.arange(d) + at
            self.seen[ids, columns] = 1.0
            values = self.sorted[n - to : n - self.depth] if not at else self.sorted[self.depth : to]
            self.read[ids, columns] = values
        self.depth = to
        self.last = np.concatenate([self.sorted[n - to], self.sorted[to - 1]])

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, a row for each row of the block and a column for each query."""
        w = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        low = (self.read - self.seen * self.worst) @ w.T + w @ self.worst
        high = (self.read - self.seen * self.last) @ w.T + w @ self.last
        return low, high


def block_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, few: float = 1 / 16, steps: tuple[float, ...] = STEPS) -> pd.DataFrame:
    """The k best rows of a block for each query, ties to smaller ids; ``depth`` is the share of the lists read."""
    lists, out = Lists(x), []
    most = max(4 * k, int(few * len(x)))
    waiting = np.arange(len(q))
    for share in steps:
        lists.advance(share)
        left = []
        for at in range(0, len(waiting), 128):
            part = waiting[at : at + 128]
            low, high = lists.bounds(q[part])
            own = ids[:, None] == query_ids[part][None, :]
            low[own], high[own] = -np.inf, -np.inf
            kth = np.partition(low, len(x) - k, axis=0)[len(x) - k] if len(x) > k else np.full(len(part), -np.inf)
            inside = (high >= kth) & ~own
            done = (inside.sum(axis=0) <= most) | (share >= 1)
            for column in np.flatnonzero(done):
                rows = np.flatnonzero(inside[:, column])
                scores = x[rows] @ q[part[column]]
                best = np.lexsort((ids[rows], -scores))[:k]
                out.append(pd.DataFrame({"query_id": query_ids[part[column]], "vec_id": ids[rows][best], "score": scores[best].astype(np.int64), "depth": share}))
            left.append(part[~done])
        waiting = np.concatenate(left) if left else waiting[:0]
        if not len(waiting):
            break
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "depth": []})


def search(table: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` and ``depth``; ``is_query`` is a condition on ``vec_id``. Components become floor(scale * x)."""
    on_workers(table.sparkSession)
    rows, n, dim = usable(table)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("double")))
    schema = "query_id bigint, vec_id bigint, score bigint, depth double"
    blocks = max(1, -(-n // block_rows))
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    query_blocks = max(1, -(-queries.count() // query_rows))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    # Blocks of rows and blocks of queries of bounded size meet in pairs.
    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")).withColumn("query_block", every(query_blocks))
    right = queries.withColumn("query_block", F.pmod(F.xxhash64("query_id", "query"), F.lit(query_blocks)).cast("int")).withColumn("block", every(blocks))

    def run(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "depth": []})
        x, q = matrix(mine["vector"], dim).astype(np.int64), matrix(asked["query"], dim).astype(np.int64)
        return block_top(mine["vec_id"].to_numpy(), x, asked["query_id"].to_numpy(), q, k)

    found = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInPandas(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")
