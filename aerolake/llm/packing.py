"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids with an end id are cut at multiples of ``capacity``; the rest is cut
into pieces of at most ``piece`` ids, so that windows can be filled evenly. Full pieces
are windows of their own. The others are dealt by a hash to groups of about
``group_rows`` pieces, each group is split into windows of nearly equal sums: every piece starts
as a partial partition of k windows with one filled, and the two partial partitions with
the largest spread are merged again and again, the fullest windows of one with the emptiest of the other. k
starts at the least count that could hold the group and rises, in proportion to the
excess, while any window exceeds the capacity.

Null and empty texts consist of the end id. Very long texts are read whole and give as many pieces as they need. Repeated rows are packed each. An empty
table gives an empty one.
"""

from __future__ import annotations

import heapq
import zlib
from contextlib import nullcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import by_batch, on_workers, small_batches
from aerolake.llm.tokens import Encoder, vocabulary_path
from aerolake.plans.joins import settle

CAPACITY = 2048
#: Rows that a worker gets at once where its store is limited: its arrays for them, and the executor's buffers, grow with their texts.
ROWS = 128


def pieces_of(size: int, capacity: int = CAPACITY, piece: int = 512) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``size`` ids."""
    full = size - size % capacity
    return [(s, capacity) for s in range(0, full, capacity)] + [(s, min(piece, size - s)) for s in range(full, size, piece)]


def partition(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window of each size, k windows of nearly equal sums.

    A partial partition holds its windows' sums above the smallest one, descending. Pieces of a window are
    chained, so that merging two partitions costs no more than k steps.
    """
    n = len(sizes)
    following = np.full(n, -1, np.int64)
    # Partial partitions as (sums, first piece, last piece) of their filled windows; windows not listed have sum 0.
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {
        i: (np.array([s], np.int64), np.array([i]), np.array([i])) for i, s in enumerate(sizes.tolist())
    }
    heap = [(-s, i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        a, b = parts.pop(heapq.heappop(heap)[1]), parts.pop(heapq.heappop(heap)[1])
        over = len(a[0]) + len(b[0]) - k
        if over <= 0:  # windows of one beside those of the other
            sums, first, last = (np.concatenate([x, y]) for x, y in zip(a, b, strict=True))
        else:  # the `over` smallest of both meet in opposite order
            i, j = len(a[0]) - over, len(b[0]) - over
            following[a[2][i:]] = b[1][j:][::-1]
            sums = np.concatenate([a[0][:i], b[0][:j], a[0][i:] + b[0][j:][::-1]])
            first = np.concatenate([a[1][:i], b[1][:j], a[1][i:]])
            last = np.concatenate([a[2][:i], b[2][:j], b[2][j:][::-1]])
        order = np.argsort(-sums, kind="stable")
        sums, first, last = sums[order], first[order], last[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        parts[made] = (sums, first, last)
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, made))
        made += 1
    window = np.zeros(n, np.int64)
    for w, i in enumerate(parts[heap[0][1]][1].tolist()):
        while i >= 0:
            window[i] = w
            i = following[i]
    return window


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size, none above the capacity; sizes must not exceed it."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        window = partition(sizes, k) if len(sizes) else np.zeros(0, np.int64)
        fullest = int(np.bincount(window, weights=sizes).max()) if len(sizes) else 0
        if fullest <= capacity:
            return window
        k = min(len(sizes), max(k + 1, -(-k * fullest // capacity) if fullest < 1.05 * capacity else k + max(1, k // 50)))


def cut(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY, piece: int = 512, store: int | None = None) -> DataFrame:
    """A row for each piece of each row of ``docs`` (``doc_id``, ``text``): start, length, ids_crc32, doc_tokens."""
    path = vocabulary or vocabulary_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells: list[list[int]] = [[], [], [], [], []]
        encoder = Encoder.of(path, store)
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
            ids = np.append(ids.astype("<u4"), np.uint32(end_id))
            raw = memoryview(ids).cast("B")
            found = pieces_of(len(ids), capacity, piece)
            cells[0] += [doc_id] * len(found)
            cells[1] += [s for s, _ in found]
            cells[2] += [n for _, n in found]
            cells[3] += [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in found]
            cells[4] += [len(ids)] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names)

    # Workers stay for the stages to come: with a limited store, none keeps an encoder beyond its partition.
    after = (lambda: Encoder.drop(path)) if store else None
    return by_batch(docs.select("doc_id", "text"), run, ", ".join(f"{n} bigint" for n in names), after)


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY, piece: int = 512, group_rows: int = 1500, store: int | None = None) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``, the place of the piece in its sequence.

    ``store`` limits the encoded words that a worker keeps, see :mod:`aerolake.llm.tokens`, and has it keep none from one
    partition to the next, and get fewer rows at once; it bears on memory and time only.
    """
    on_workers(docs.sparkSession)
    with small_batches(docs.sparkSession, ROWS) if store else nullcontext():
        pieces = settle(cut(docs, vocabulary, end_id, capacity, piece, store), "pieces")
    numbered = pieces.withColumn("__row", F.monotonically_increasing_id())
    full = numbered.filter(F.col("length") == capacity).select("*", (F.col("__row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.filter(F.col("length") < capacity)
    groups = max(1, -(-pieces.filter(F.col("length") < capacity).count() // group_rows))
    dealt = rest.withColumn("__group", F.pmod(F.xxhash64("__row", "doc_id"), F.lit(groups)))
    schema = full.drop("__row").schema

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "__row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        window = windows(part["length"].to_numpy(np.int64), capacity)
        part["sequence_id"] = (part["__group"].to_numpy(np.int64) * group_rows * 64 + window) * 2
        part["offset"] = part.groupby("sequence_id")["length"].cumsum() - part["length"]
        return part[schema.names]

    return full.drop("__row").unionByName(dealt.groupBy("__group").applyInPandas(fill, schema))
