"""Vector code compression by exact integer k-means.

Each component x becomes the integer floor(scale * x). Vectors are cut into ``parts`` consecutive parts, each with a
codebook of its own, which starts as that part of the vectors with the smallest ids. A round assigns every
part to the nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by the
componentwise floor of the mean of its parts; entries without parts stay.

Distances are exact. Integers are broken into limbs so narrow that a float64 product of limb matrices stays
below 2^53 for the part's length; BLAS multiplies limb matrices, the products are shifted and added in 64-bit integers.
``|c|^2 - 2 x.c`` then has its first minimum at the entry sought. Small integers fit one limb, larger ones take as many as they need.

Every task sums the parts of each entry; what is shuffled and collected in a round is one row for each task, part and entry, and
then one for each part and entry, whatever the number of vectors.

Null vectors, empty ones, and vectors with null or non-finite components are left out, and so are those of another length than most
have (equal counts: the longer). Integers beyond 2^27 in size are held there, so that all distances fit 64 bits. Where the length is no multiple of
``parts``, later parts are one longer. Repeated rows count each; equal ids are ordered by their integers, null ids
come last. Fewer vectors than entries give as many entries as vectors. Ties go to the lower index. Rows without a label share one sum.
An empty table gives an empty one. Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import by_batch, on_workers
from aerolake.plans.joins import join_dimension, settle

#: Bits of an integer's size.
LARGEST = 27


def limb_width(length: int) -> int:
    """Bits of a limb: ``length`` products of two limbs add up to less than 2^53."""
    return (52 - max(length - 1, 0).bit_length()) // 2


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """Float matrices whose sum, shifted by ``width`` bits each, is ``x``; all but the last hold 0 to 2^width - 1."""
    size = int(np.abs(x).max()).bit_length() if x.size else 0
    out = []
    for _ in range(max(-(-size // width), 1) - 1):
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width
    return [*out, x.astype(np.float64)]


def exact_dots(x: np.ndarray, entries: list[np.ndarray], width: int) -> np.ndarray:
    """Inner products of the rows of ``x`` with entries given as limbs, as 64-bit integers."""
    total = None
    for i, a in enumerate(limbs(x, width)):
        for j, b in enumerate(entries):
            part = np.rint(a @ b.T).astype(np.int64) << (width * (i + j))
            total = part if total is None else total + part
    return total


@dataclass
class Codebooks:
    """The entries of each part, as integers."""

    bounds: list[int]
    entries: list[np.ndarray]

    def __post_init__(self) -> None:
        self.widths = [limb_width(e.shape[1]) for e in self.entries]
        self.limbs = [limbs(e, w) for e, w in zip(self.entries, self.widths, strict=True)]
        self.squares = [(e * e).sum(axis=1) for e in self.entries]

    def nearest(self, part: int, x: np.ndarray, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of one part, the first of several, and its squared distance, for each row of ``x`` (that part only)."""
        at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for s in range(0, len(x), step):
            rows = x[s : s + step]
            d = self.squares[part] - 2 * exact_dots(rows, self.limbs[part], self.widths[part])
            at[s : s + step] = best = d.argmin(axis=1)
            far[s : s + step] = d[np.arange(len(rows)), best] + (rows * rows).sum(axis=1)
        return at, far

    def parts_of(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, self.bounds[-1])
        for k, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            yield k, np.ascontiguousarray(x[:, a:b])

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def integers(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 1024) -> tuple[DataFrame, int]:
    """``vec_id``, ``label`` and ``x`` (integers) of the usable rows, written to the shared folder, and the vectors' length."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = float(1 << LARGEST)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(most)), F.lit(-most))).cast("int"))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v")).filter("v IS NOT NULL AND size(v) > 0")
    rows = settle(rows.filter(F.coalesce(finite, F.lit(False))).select("vec_id", "label", whole.alias("x")), "vector-integers")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return rows, 0
    return rows.filter(F.size("x") == common.d), common.d


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for batch in batches:
            if not batch.num_rows:
                continue
            for k, x in books.parts_of(batch):
                at, _ = books.nearest(k, x)
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                sums[k][used] += np.add.reduceat(x[order], first)
                counts[k] += np.bincount(at, minlength=len(counts[k]))
        for k, n in enumerate(counts):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), pa.array(sums[k][used].tolist(), pa.list_(pa.int64()))],
                ["part", "entry", "n", "sums"],
            )

    widest = max(e.shape[1] for e in books.entries)
    told = rows.select("x").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    added = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(widest)])
    entries = [e.copy() for e in books.entries]
    for r in added.collect():  # at most one row for each entry of each part
        width = entries[r.part].shape[1]
        entries[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return Codebooks(books.bounds, entries)


def fit(rows: DataFrame, length: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks after ``rounds`` rounds over ``rows`` as :func:`integers` gives them."""
    on_workers(rows.sparkSession)
    bounds = [length * k // parts for k in range(parts + 1)]
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    start = np.array([r.x for r in first], np.int64).reshape(len(first), length)
    books = Codebooks(bounds, [start[:, a:b].copy() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    for _ in range(rounds if first else 0):
        books = refined(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (an index for each part, hexadecimal, two digits or more) and ``error`` (squared distance)."""
    digits = max(2, len(f"{max(len(books.entries[0]) - 1, 0):x}"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        error, found = np.zeros(batch.num_rows, np.int64), []
        for k, x in books.parts_of(batch):
            at, far = books.nearest(k, x)
            error += far
            found.append(at.tolist())
        names = [f"{i:0{digits}x}" for i in range(len(books.entries[0]))]
        codes = ["".join(map(names.__getitem__, row)) for row in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"],
        )

    schema = rows.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    return by_batch(rows, run, schema)


def decode(code: str, books: Codebooks) -> np.ndarray:
    """The integers that a code stands for."""
    digits = len(code) // len(books.entries)
    return np.concatenate([e[int(code[k * digits : (k + 1) * digits], 16)] for k, e in enumerate(books.entries)])


def compress(table: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, **columns: str) -> tuple[DataFrame, Codebooks]:
    """``vec_id``, ``label``, ``code``, ``error`` and ``label_error`` (errors summed over equal labels) of every usable row of ``table``, and the codebooks."""
    rows, length = integers(table, scale=scale, **columns)
    books = fit(rows, length, parts, entries, rounds)
    coded = settle(encode(rows, books), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return join_dimension(coded, settle(sums, "label-errors"), ["label"], null_safe=True), books
