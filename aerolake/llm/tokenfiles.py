"""Token ids in grammar-compressed shards with random access (Re-Pair).

Documents are laid out in ascending ``doc_id`` order, nulls first, equal ids by their text. A shard
holds consecutive documents. Within it frequent pairs of neighbouring ids are replaced
by new symbols, round after round, over the pairs of the round before, until no pair is frequent; a pair is
replaced where it does not cross the end of a document, so every document can be decoded
alone. Each round counts all pairs of the shard and replaces all that are frequent and
fit, from the left where they overlap.

A shard is a binary value:

====================  ==========================================================
``RPID``              four bytes
header                nine little-endian 64-bit numbers: version, base (ids lie below),
                      rules, documents, symbols, width in bytes of symbols and rules, tokens, 0, 0
rules                 left and right symbol of each rule
lengths               32-bit expansion length of each rule
document ends         64-bit end in symbols, then 64-bit end in tokens, of each document
symbols               ids below base, rules from base on
====================  ==========================================================

A document's symbols follow from the ends; a token at any position is found by adding
expansion lengths. Null and empty texts have the end id only. Repeated rows are stored
each. An empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.llm.common import SLICE, on_workers
from aerolake.llm.tokens import Encoder, vocabulary_path
from aerolake.plans.joins import join_dimension, settle

MAGIC, VERSION = b"RPID", 1
_HEAD = struct.Struct("<9q")
_HASH = 18
_ODD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - _HASH)


def _slots(key: np.ndarray) -> np.ndarray:
    return ((key * _ODD) >> _SHIFT).astype(np.int32)


def replace_frequent(
    seq: np.ndarray, ends: np.ndarray, first: int, most: int, least: int, since: int = 0, waiting: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round: pairs that occur at least ``least`` times, the ``most`` most frequent, become symbols from ``first`` on.

    ``ends`` are the documents' ends in symbols. In a later round only pairs with a symbol from ``since`` on, those of the round before, and
    pairs that had to wait can be frequent, so only they are counted. Pairs are dealt to slots by a hash; those of slots with enough
    pairs are sorted and counted. Chosen pairs are found again by their slot; of two in one slot the less frequent waits for the next round.
    Returns the new sequence and ends, the pairs, and those that wait.
    """
    inside = np.ones(len(seq) - 1, bool)
    inside[ends[(ends > 0) & (ends < len(seq))] - 1] = False
    if since:
        new = seq >= since
        near = new[:-1] | new[1:]
        if len(waiting):
            held = np.zeros(1 << _HASH, bool)
            held[_slots(waiting)] = True
            near |= held[_slots((seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:])]
        inside &= near
    places = np.flatnonzero(inside)
    key = (seq[places].astype(np.uint64) << np.uint64(32)) | seq[places + 1]
    slot = _slots(key)
    often = np.bincount(slot, minlength=1 << _HASH)[slot] >= least
    places, key, slot = places[often], key[often], slot[often]
    ordered = np.sort(key)
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, int)
    n = np.diff(np.append(starts, len(ordered)))
    often = np.flatnonzero(n >= least)
    often = often[np.argsort(-n[often], kind="stable")]
    every = ordered[starts[often]]
    pairs = every[:most]
    taken = np.sort(np.unique(_slots(pairs), return_index=True)[1])
    waits = np.delete(every, taken)
    pairs = pairs[taken]
    if not len(pairs):
        return seq, ends, np.zeros((0, 2), np.uint32), waits
    place = np.full(1 << _HASH, -1, np.int32)
    place[_slots(pairs)] = np.arange(len(pairs))
    found = place[slot]
    hit = (found >= 0) & (pairs[found] == key)
    at, found = places[hit], found[hit]
    # Of hits that follow each other without a gap, every second stands, from the left.
    new_run = np.append(True, np.diff(at) != 1)
    run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
    stands = (np.arange(len(at)) - run_start) % 2 == 0
    at, found = at[stands], found[stands]
    out = seq.copy()
    out[at] = first + found
    stays = np.ones(len(seq), bool)
    stays[at + 1] = False
    sides = np.stack([(pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)], axis=1)
    return out[stays], ends - np.searchsorted(at + 1, ends), sides, waits


def pack(docs: list[np.ndarray], base: int, most: int = 6000, least: int = 16) -> bytes:
    """A shard of documents' ids; rounds go on until no pair occurs ``least`` times."""
    sizes = np.array([len(d) for d in docs], np.int64)
    token_ends = np.cumsum(sizes)
    seq = np.concatenate([d.astype(np.uint32) for d in docs]) if len(docs) else np.zeros(0, np.uint32)
    ends, rules, lengths = token_ends.copy(), np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    since, waiting = 0, None
    while len(seq) > 1:
        first = base + len(rules)
        seq, ends, pairs, waiting = replace_frequent(seq, ends, first, most, least, since, waiting)
        if not len(pairs):
            break
        since = first
        # A round's pairs consist of ids and of symbols of earlier rounds.
        known = np.append(lengths, np.uint32(1))
        parts = np.where(pairs >= base, pairs.astype(np.int64) - base, len(lengths))
        rules, lengths = np.concatenate([rules, pairs]), np.concatenate([lengths, known[parts].sum(axis=1, dtype=np.uint32)])
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    head = _HEAD.pack(VERSION, base, len(rules), len(docs), len(seq), width, int(sizes.sum()), 0, 0)
    return b"".join([MAGIC, head, rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), ends.astype("<i8").tobytes(), token_ends.astype("<i8").tobytes(), seq.astype(kind).tobytes()])


class Shard:
    """Reads a shard; documents are decoded one by one or all together."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        version, self.base, n_rules, self.docs, n, width, self.tokens, _, _ = _HEAD.unpack_from(raw, 4)
        if version != VERSION:
            raise ValueError(f"shard version {version}")
        at, kind = 4 + _HEAD.size, f"<u{width}"

        def take(count: int, dtype: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, count, at)
            at += out.nbytes
            return out

        self.rules = take(2 * n_rules, kind).reshape(-1, 2)
        self.lengths = take(n_rules, "<u4")
        self.ends, self.token_ends = take(self.docs, "<i8"), take(self.docs, "<i8")
        self.symbols = take(n, kind)

    def _spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol in full: where it starts, how long it is, and the ids.

        All rules are replaced by their two sides at once, again and again, until only ids are left.
        """
        if not hasattr(self, "_full"):
            sizes = np.concatenate([np.ones(self.base, np.int64), self.lengths.astype(np.int64)])
            flat = np.arange(self.base, self.base + len(self.rules), dtype=np.int64)
            while len(rule := np.flatnonzero(flat >= self.base)):
                n = np.ones(len(flat), np.int64)
                n[rule] = 2
                sides = self.rules[flat[rule] - self.base].astype(np.int64)
                at = (np.cumsum(n) - n)[rule]
                flat = np.repeat(flat, n)
                flat[at], flat[at + 1] = sides[:, 0], sides[:, 1]
            self._full = np.cumsum(sizes) - sizes, sizes, np.concatenate([np.arange(self.base), flat]).astype(np.uint32)
        return self._full

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        starts, sizes, ids = self._spelled()
        n = sizes[symbols]
        ends = np.cumsum(n)
        return ids[np.repeat(starts[symbols] - ends + n, n) + np.arange(ends[-1])] if len(symbols) else ids[:0]

    def document(self, i: int) -> np.ndarray:
        """Ids of one document, without reading the others."""
        return self.expand(self.symbols[self.ends[i - 1] if i else 0 : self.ends[i]])

    def token(self, i: int, at: int) -> int:
        """One id of one document, found by expansion lengths without decoding what lies before."""
        part = self.symbols[self.ends[i - 1] if i else 0 : self.ends[i]].astype(np.int64)
        sizes = np.where(part >= self.base, self.lengths[np.maximum(part - self.base, 0)] if len(self.lengths) else 1, 1).astype(np.int64)
        ends = np.cumsum(sizes)
        k = int(np.searchsorted(ends, at, side="right"))
        symbol, at = int(part[k]), int(at - (ends[k] - sizes[k]))
        while symbol >= self.base:
            left, right = (int(x) for x in self.rules[symbol - self.base])
            n = int(self.lengths[left - self.base]) if left >= self.base else 1
            symbol, at = (left, at) if at < n else (right, at - n)
        return symbol


def write(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, shard_tokens: int = 500_000) -> DataFrame:
    """Encodes ``doc_id`` and ``text`` and writes shards to the shared folder; the table read back, one row for each shard.

    Columns: ``part`` (range of ids), ``shard`` (place in it), ``doc_ids``, ``n_docs``, ``n_tokens``, ``payload``. A shard ends
    with the document that fills it, so it holds at most that document beyond ``shard_tokens``.
    """
    spark = docs.sparkSession
    on_workers(spark)
    path = vocabulary or vocabulary_path()
    ordered = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = ordered.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        base = max(encoder.library.get_vocab_size(), end_id + 1)
        ids, held, tokens, part, shard = [], [], 0, None, 0

        def flush() -> pa.RecordBatch:
            columns = [[part], [shard], [ids], [len(ids)], [tokens], [pack(held, base)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            where = batch.column("part")
            for start in range(0, batch.num_rows, SLICE):
                rows = batch.slice(start, SLICE)
                for doc_id, one in zip(rows.column("doc_id").to_pylist(), encoder.encode(rows.column("text").to_pylist()), strict=True):
                    part = where[0].as_py()
                    ids.append(doc_id)
                    held.append(np.append(one.astype(np.uint32), np.uint32(end_id)))
                    tokens += len(one) + 1
                    if tokens >= shard_tokens:
                        yield flush()
                        ids, held, tokens, shard = [], [], 0, shard + 1
        if ids:
            yield flush()

    names = ["part", "shard", "doc_ids", "n_docs", "n_tokens", "payload"]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
    shards = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(
        run, "part int, shard int, doc_ids array<bigint>, n_docs bigint, n_tokens bigint, payload binary"
    )
    return settle(shards, "token-shards")


def read(shards: DataFrame) -> DataFrame:
    """One row for each document, decoded from the shards: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    inner = Window.partitionBy("part").orderBy("shard")
    offsets = shards.select("part", "shard", (F.sum("n_tokens").over(inner) - F.col("n_tokens")).alias("within"))
    offsets = settle(join_dimension(offsets, totals.select("part", "before"), ["part"], how="inner"), "shard-offsets")

    names = ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a shard at a time
                part, number, ids, raw = (batch.column(c)[i] for c in ("part", "shard", "doc_ids", "payload"))
                shard = Shard(raw.as_buffer())
                tokens = memoryview(shard.expand(shard.symbols).astype("<u4", copy=False)).cast("B")
                ends = shard.token_ends
                starts = np.append(0, ends[:-1])
                crc = [zlib.crc32(tokens[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                columns = [pa.array(np.full(n, part.as_py()), pa.int32()), pa.array(np.full(n, number.as_py()), pa.int32()), ids.values.cast(pa.int64())]
                columns += [pa.array(x, pa.int64()) for x in (starts, ends - starts, np.array(crc, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names)

    decoded = shards.select("part", "shard", "doc_ids", "payload").mapInArrow(run, "part int, shard int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    placed = join_dimension(decoded, offsets, ["part", "shard"], how="inner")
    return placed.select("doc_id", (F.col("before") + F.col("within") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
