"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors are searched as one, with the ``k + 1`` smallest ids that have it; a query's list is filled with
these ids, so copies are found exactly. Each curve projects the vectors to a few random orthonormal directions, scales them by the
projections' quantiles, so that a crowded place gets as many cells as it has vectors, shifts the grid, and orders all vectors by their Hilbert
key, range-partitioned by Spark; equal keys are ordered by a hash that differs from curve to curve. A query's candidates on a curve
are the vectors whose place differs from its own by at most ``share / 2`` of all; those of all curves are scored in double precision and merged.

With vectors that have no structure in many dimensions, a fixed window finds a falling
share of the neighbours as the table grows, so the window is a share of it: the work grows with
queries times rows, at ``curves * share`` of brute force. It is done in tiles of bounded
size. ``least`` vectors to either side are always seen, so small tables are searched exactly.

See ``vectors`` for rows that take no part; zero vectors do neither. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.llm.common import mixed, on_workers, unit
from aerolake.llm.vectors import usable
from aerolake.plans.joins import join_dimension, settle

#: Bits of each axis in one key; a second key has as many finer ones.
BITS, AXES = 5, 12
#: The grid is shifted by up to one of so many parts of an axis.
SHIFT = 16
#: Vectors that set the quantiles, and the quantiles kept of each projection.
SAMPLE, KNOTS = 16_384, 1025


def hilbert_keys(cells: np.ndarray, bits: int, words: int = 1) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid cells; bits * axes must be below 64. With more ``words``, of cells of ``words * bits`` bits, a row of keys for each, the highest first.

    The recursive rotations and reflections of the curve are undone bit by bit from the highest one, then the Gray code.
    """
    x = [c.copy() for c in cells.astype(np.uint64).T]
    one = np.uint64(1)
    for bit in range(words * bits - 1, 0, -1):
        high, below = one << np.uint64(bit), (one << np.uint64(bit)) - one
        for i in range(len(x)):
            turned = (x[i] & high) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = x[0] ^ np.where(turned, below, swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(words * bits - 1, 0, -1):
        high = one << np.uint64(bit)
        flip = np.where((x[-1] & high) != 0, flip ^ (high - one), flip)
    keys = np.zeros((words, len(flip)), np.uint64)
    for bit in range(words * bits - 1, -1, -1):
        key = keys[words - 1 - bit // bits]
        for c in x:
            key[:] = (key << one) | (((c ^ flip) >> np.uint64(bit)) & one)
    return (keys if words > 1 else keys[0]).astype(np.int64)


class Curves:
    """Random projections, their quantiles, and grid shifts of all curves."""

    def __init__(self, dim: int, curves: int, axes: int = AXES, seed: int = 23) -> None:
        rng = np.random.default_rng(seed)
        self.axes = min(axes, dim)
        self.directions = np.concatenate([np.linalg.qr(rng.normal(size=(dim, self.axes)))[0] for _ in range(curves)], axis=1)
        self.shift = rng.random(curves * self.axes) / SHIFT
        self.curves, self.knots = curves, np.zeros((KNOTS, curves * self.axes))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Coarse and fine keys of each row for each curve."""
        z, at = x @ self.directions, np.linspace(0, 1 - 1 / SHIFT, KNOTS)
        share = np.stack([np.interp(z[:, j], self.knots[:, j], at) for j in range(z.shape[1])], axis=1) + self.shift
        cells = np.floor(share * (1 << 2 * BITS))
        return np.stack([hilbert_keys(cells[:, c * self.axes : (c + 1) * self.axes], BITS, 2) for c in range(self.curves)])


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def fit(vectors: DataFrame, n: int, dim: int, curves: int) -> Curves:
    """Quantiles of every projection over about ``SAMPLE`` of the ``n`` different vectors (``group``, ``packed``), by a hash of their number."""
    model = Curves(dim, curves)
    some = vectors.filter(unit(F.lit(29), F.col("group")) < SAMPLE / max(n, 1)).select("packed").toArrow()
    if len(some):
        model.knots = np.quantile(vectors_of(some["packed"], dim) @ model.directions, np.linspace(0, 1, KNOTS), axis=0)
    return model


def tile_best(ids: list[np.ndarray], place: np.ndarray, x: np.ndarray, own: list[int | None], query_place: np.ndarray, q: np.ndarray, reach: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best rows in reach for each query, by score and then by id, without rows of its ``own`` id. Scores are summed alike wherever a pair is met."""
    out = []
    first = np.array([i[0] for i in ids])
    second = np.array([i[1] if len(i) > 1 else i[0] for i in ids])
    for at in range(0, len(q), 256):
        scores = q[at : at + 256] @ x.T
        far = np.abs(query_place[at : at + 256, None] - place[None, :]) > reach
        for i, mine in enumerate(own[at : at + 256]):
            if mine is not None:
                far[i] |= (first == mine) & (second == mine)
        scores[far] = -np.inf
        kth = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(scores), -np.inf)
        for i, row in enumerate(scores):
            near = np.flatnonzero((row >= kth[i] - 1e-9 * (1 + abs(kth[i]))) & (row > -np.inf) if np.isfinite(kth[i]) else row > -np.inf)
            exact = (x[near] * q[at + i]).sum(axis=1)
            mine = own[at + i]
            lead = first[near] if mine is None else np.where(first[near] == mine, second[near], first[near])
            best = np.lexsort((lead, -exact))[:k]
            # A row is among the k best only if its vector is among the k best vectors by score and smallest id.
            rows = np.concatenate([ids[near[b]] for b in best]) if len(best) else np.zeros(0, np.int64)
            score = np.repeat(exact[best], [len(ids[near[b]]) for b in best])
            if mine is not None:
                rows, score = rows[rows != mine], score[rows != mine]
            best = np.lexsort((rows, -score))[:k]
            out.append((rows[best], score[best]))
    return out


def numbered(rows: DataFrame, order: list[str], ranged: list[str], purpose: str, alike: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the partition ``part`` of the range order and the place ``at`` in it, and the place at which each partition starts.

    With ``alike``, also ``copy``: the number of rows before with the same value, in the partition; and ``carried`` by
    each partition, the number in those before. Rows alike must be next to each other in the order.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last, begun = 0, None, 0
        for batch in batches:
            at = np.arange(seen, seen + batch.num_rows)
            batch = batch.append_column("at", pa.array(at, pa.int64()))
            if alike is not None:
                copy = np.zeros(batch.num_rows, np.int64)
                for i, value in enumerate(batch.column(alike).to_pylist()):
                    if value != last:
                        last, begun = value, seen + i
                    copy[i] = seen + i - begun
                batch = batch.append_column("copy", pa.array(copy, pa.int64()))
            yield batch
            seen += batch.num_rows

    placed = rows.repartitionByRange(parts, *ranged).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = placed.withColumn("at", F.lit(0).cast("long"))
    placed = settle(placed.mapInArrow(number, (schema if alike is None else schema.withColumn("copy", F.lit(0).cast("long"))).schema), purpose)
    ends = [] if alike is None else [F.min_by(F.sha2(alike, 256), "at").alias("first"), F.max_by(F.sha2(alike, 256), "at").alias("last"), (F.max_by("copy", "at") + 1).alias("run")]
    starts, total, last, run = [], 0, None, 0
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n"), *ends).collect(), key=lambda r: r.part):  # a row for each shuffle partition
        carried = run if alike is not None and r.first == last else 0
        starts.append((r.part, total, carried))
        total += r.n
        if alike is not None:
            last, run = r["last"], r.run + (carried if r.run == r.n else 0)
    return placed, spark.createDataFrame(starts or [(0, 0, 0)], "part int, before bigint, carried bigint")


def search(table: DataFrame, is_query: Column, k: int = 20, curves: int = 16, share: float = 0.06, least: int = 256, tile_rows: int = 4096) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``; ``is_query`` is a condition on ``vec_id``."""
    on_workers(table.sparkSession)
    rows, _, dim = usable(table)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) + 0.0  # one zero only
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "packed"])

    nonzero = rows.filter(F.exists("vector", lambda x: x != 0))
    hashed = nonzero.mapInArrow(pack, "vec_id bigint, packed binary").withColumn("hash", F.xxhash64("packed"))
    # Rows of equal vectors stand side by side, the smallest id first, over as many partitions as they need.
    placed, starts = numbered(hashed, ["hash", "packed", "vec_id"], ["hash", "packed", "vec_id"], "copies", "packed")
    placed = join_dimension(placed, starts, ["part"], how="inner")
    copy = F.col("copy") + F.when(F.col("at") == F.col("copy"), F.col("carried")).otherwise(0)
    placed = placed.withColumn("copy", copy).withColumn("group", F.col("before") + F.col("at") - F.col("copy"))

    queries = placed.filter(is_query).select("vec_id", "group", "copy")
    several = settle(queries.groupBy("vec_id").count().filter("count > 1").select("vec_id", F.col("vec_id").alias("own")), "ids")
    # Queries of one vector are asked once, but for ids with several vectors, whose other rows they must not find.
    queries = join_dimension(queries, several, ["vec_id"]).withColumn("ask", F.when(F.col("own").isNull(), 2 * F.col("group")).otherwise(2 * (F.col("group") + F.col("copy")) + 1))
    queries = settle(queries.select(F.col("vec_id").alias("query_id"), "ask", "group", "own"), "queries")
    asks = queries.groupBy("ask", "group").agg(F.max("own").alias("own"))

    vectors = settle(placed.groupBy("group").agg(
        F.sort_array(F.collect_list(F.when(F.col("copy") <= k, F.col("vec_id")))).alias("ids"),
        F.max(F.when(F.col("copy") == 0, F.col("packed"))).alias("packed"),
        F.max(is_query).alias("asked")), "packed")
    n = vectors.count()
    model = table.sparkSession.sparkContext.broadcast(fit(vectors, n, max(dim, 1), curves))
    reach = max(least, int(np.ceil(share / 2 * n)))
    tile = min(tile_rows, max(reach, least))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                if part.num_rows:
                    group = part.column("group").to_numpy().astype(np.uint64)
                    for c, (key, fine) in enumerate(model.value.keys(vectors_of(part.column("packed"), dim))):
                        curve, tie = pa.array(np.full(part.num_rows, c), pa.int32()), mixed(group, np.uint64(c + 1)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([curve, pa.array(key), pa.array(fine), pa.array(tie), *part.columns], ["curve", "key", "fine", "tie", *part.schema.names])

    on_curves = vectors.mapInArrow(keys, "curve int, key bigint, fine bigint, tie bigint, group bigint, ids array<bigint>, packed binary, asked boolean")
    order = ["curve", "key", "fine", "tie", "group"]
    placed, starts = numbered(on_curves, order, order[:4], "curves")
    whole = join_dimension(placed, starts, ["part"], how="inner")
    whole = whole.select("curve", "group", "ids", "packed", "asked", (F.col("before") + F.col("at") - F.col("curve") * F.lit(n)).alias("place"))
    mine = whole.select("curve", "ids", "packed", "place", F.floor(F.col("place") / tile).alias("tile"))
    asked = join_dimension(whole.filter("asked").select("curve", "group", "packed", "place"), asks, ["group"], how="inner")
    asked = asked.select(F.col("curve").alias("on"), "ask", "own", F.col("packed").alias("query"), F.col("place").alias("at"))
    asked = asked.withColumn("tile", F.explode(F.sequence(
        F.floor(F.greatest(F.col("at") - reach, F.lit(0)) / tile), F.floor(F.least(F.col("at") + reach, F.lit(max(n - 1, 0))) / tile))))

    def score(near: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(near) or not len(queries):
            return pd.DataFrame({"ask": [], "ids": [], "scores": []})
        x, q = (np.frombuffer(b"".join(c), np.float64).reshape(-1, dim) for c in (near["packed"], queries["query"]))
        # An ask for all ids of a vector leaves out each one's own row only at the end, so it needs one more.
        own = [int(o) if odd else None for o, odd in zip(queries["own"], queries["ask"] % 2, strict=True)]
        best = tile_best(list(near["ids"]), near["place"].to_numpy(), x, own, queries["at"].to_numpy(), q, reach, k + 1)
        return pd.DataFrame({"ask": queries["ask"], "ids": [i.astype(np.int64).tobytes() for i, _ in best], "scores": [s.tobytes() for _, s in best]})

    # Ids go to pandas as text, where a null would make them inexact.
    asked = asked.withColumn("own", F.col("own").cast("string"))
    lists = mine.groupBy("curve", "tile").cogroup(asked.groupBy("on", "tile")).applyInPandas(score, "ask bigint, ids binary, scores binary")
    groups = max(1, -(-asks.count() // 256))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        ask = np.repeat(part["ask"].to_numpy(), [len(i) // 8 for i in part["ids"]])
        ids, scores = np.frombuffer(b"".join(part["ids"]), np.int64), np.frombuffer(b"".join(part["scores"]), np.float64)
        order = np.lexsort((ids, -scores, ask))
        ask, ids, scores = ask[order], ids[order], scores[order]
        # Curves find the same row with the same score, so copies stand side by side.
        new = np.ones(len(ids), bool)
        new[1:] = (ask[1:] != ask[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
        ask, ids, scores = ask[new], ids[new], scores[new]
        starts = np.flatnonzero(np.append(True, ask[1:] != ask[:-1])) if len(ask) else np.zeros(0, np.int64)
        ends = np.minimum(np.append(starts[1:], len(ask)), starts + k + 1)
        return pd.DataFrame({"ask": ask[starts], "ids": [ids[a:b] for a, b in zip(starts, ends, strict=True)], "scores": [scores[a:b] for a, b in zip(starts, ends, strict=True)]})

    grouped = lists.withColumn("part", F.pmod(F.xxhash64("ask"), F.lit(groups)))
    best = settle(grouped.groupBy("part").applyInPandas(merge, "ask bigint, ids array<bigint>, scores array<double>"), "best")
    found = join_dimension(queries.select("query_id", "ask"), best, ["ask"], how="inner")
    found = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("query_id", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    ranked = found.filter("vec_id <> query_id").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
