"""Fill-in-middle transformation with piece tables.

A document is never copied while it is rearranged. It is a list of descriptors (buffer, start,
end) over buffers that never change: the text's UTF-8 bytes and a buffer with the sentinels. Two cuts
split the one descriptor of a text into prefix, middle and suffix; an arrangement is a permutation of these
and the sentinels' descriptors; the inverse permutation restores the text; a hash reads
the descriptors' bytes one after the other.

A unit is a line, ``[^\\n]*\\n|[^\\n]+``. The cuts and the form follow from the sha256 of seed and id, so that
reruns agree and no row depends on another. A text stays as it is (form ``plain``) if it is empty, holds a sentinel itself,
or is not among the ``rate`` percent chosen; of the others ``spm_share`` percent have the suffix first.

Null texts are empty texts; a null id counts as an empty one. Texts of any length are read whole. Repeated rows
give repeated results, equal ids with different texts are cut each in its own lines by the same draws. An
empty table gives an empty one. Columns other than id and text are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from aerolake.llm.common import by_batch, fresh

#: The sentinels, in the order in which their buffer holds them.
SENTINELS = (b"<P>", b"<S>", b"<M>")
_ADDED = b"".join(SENTINELS)
_TEXT, _SIGNS = 0, 1
#: Descriptors by their place among (prefix, middle, suffix, <P>, <S>, <M>).
ORDERS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}


class Piece(NamedTuple):
    """A run of bytes of one buffer."""

    buffer: int
    start: int
    end: int


class PieceTable:
    """A text as descriptors over buffers that are never changed; every operation gives a new table over the same buffers."""

    def __init__(self, buffers: tuple[bytes, ...], pieces: tuple[Piece, ...]) -> None:
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: bytes, *more: bytes) -> PieceTable:
        return cls((text, *more), (Piece(0, 0, len(text)),))

    def split(self, i: int, at: int) -> PieceTable:
        """Descriptor ``i`` as two, the first ``at`` bytes long; either may be empty."""
        buffer, start, end = self.pieces[i]
        if not 0 <= at <= end - start:
            raise ValueError(f"no place {at} in a piece of {end - start} bytes")
        halves = (Piece(buffer, start, start + at), Piece(buffer, start + at, end))
        return PieceTable(self.buffers, (*self.pieces[:i], *halves, *self.pieces[i + 1 :]))

    def append(self, *pieces: Piece) -> PieceTable:
        return PieceTable(self.buffers, (*self.pieces, *pieces))

    def permuted(self, order: tuple[int, ...]) -> PieceTable:
        """Descriptor ``order[k]`` comes at place k; places not named are left out."""
        return PieceTable(self.buffers, tuple(self.pieces[i] for i in order))

    def stream(self) -> Iterator[memoryview]:
        views = [memoryview(b) for b in self.buffers]
        return (views[p.buffer][p.start : p.end] for p in self.pieces)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.stream():
            digest.update(view)
        return digest.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.stream())

    def chars(self, i: int) -> int:
        """Code points of descriptor ``i``."""
        buffer, start, end = self.pieces[i]
        raw = np.frombuffer(self.buffers[buffer], np.uint8, end - start, start)
        return end - start - int(np.count_nonzero((raw & 0xC0) == 0x80))


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(sorted(range(len(order)), key=order.__getitem__))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four groups of eight hexadecimal digits of the sha256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def line_ends(text: bytes) -> np.ndarray:
    """Where each unit ends, in bytes, after a leading 0."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], ends, [len(text)] if text and text[-1] != 10 else []]).astype(np.int64)


def arranged(text: bytes, doc_id: int | None, seed: int, rate: int, spm_share: int) -> tuple[int, str, PieceTable, PieceTable]:
    """Number of units, form, the table of cut pieces (one for a plain text) and the table of the output."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    ends = line_ends(text)
    n = len(ends) - 1
    whole = PieceTable.of(text, _ADDED)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return n, "plain", whole, whole
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    cut = whole.split(0, int(ends[low])).split(1, int(ends[high] - ends[low]))
    form = "spm" if h4 % 100 < spm_share else "psm"
    signs = [Piece(_SIGNS, 3 * k, 3 * k + 3) for k in range(len(SENTINELS))]
    return n, form, cut, cut.append(*signs).permuted(ORDERS[form])


def restored(output: bytes, form: str) -> PieceTable:
    """The original text as descriptors over an output of the given form."""
    table = PieceTable.of(output)
    if form == "plain":
        return table
    order = ORDERS[form]
    for k, i in enumerate(order[:-1]):
        _, start, end = table.pieces[k]
        if i >= 3:
            at = len(SENTINELS[i - 3])
        else:  # up to the sentinel that comes next
            at = output.index(SENTINELS[order[k + 1] - 3], start, end) - start
        table = table.split(k, at)
    return table.permuted(inverse(order)[:3])


def arrange(docs: DataFrame, seed: int = 7, rate: int = 100, spm_share: int = 50) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``).

    ``doc_id``, ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (code points, null if plain), ``output`` and ``output_sha256``.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells: list[list] = [[], [], [], [], [], []]
        ids = batch.column("doc_id")
        for doc_id, text in zip(ids.to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            n, form, cut, out = arranged(text or b"", doc_id, seed, rate, spm_share)
            sizes = (None, None) if form == "plain" else (cut.chars(0), cut.chars(1))
            for cell, value in zip(cells, (n, form, *sizes, out.text(), out.sha256()), strict=True):
                cell.append(value)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(cells, kinds, strict=True)]
        columns[4] = columns[4].cast(pa.string())
        return pa.RecordBatch.from_arrays([ids, *columns], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    return by_batch(
        docs.select(F.col("doc_id").cast("long"), "text"), run,
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string",
    )


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` with the exact text rebuilt from ``output`` and ``form`` alone, and its sha256 (``restored``, ``restored_sha256``; longer names if taken).

    A null form or output counts as plain or empty.
    """
    names = [fresh(rows, "restored"), fresh(rows, "restored_sha256")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, hashes = [], []
        for output, form in zip(batch.column("output").cast(pa.binary()).to_pylist(), batch.column("form").to_pylist(), strict=True):
            table = restored(output or b"", form or "plain")
            texts.append(table.text())
            hashes.append(table.sha256())
        new = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(hashes, pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    return by_batch(rows, run, StructType([*rows.schema.fields, *[StructField(name, StringType()) for name in names]]))
