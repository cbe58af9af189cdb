"""Near-duplicate documents by SimHash fingerprints and deletion variants.

Bit k of a fingerprint is set if bit k is set in over half of the XXH64 values of the document's shingles, repeats included.
Documents whose fingerprints differ in at most two bits are linked. Every different fingerprint is one node.

A fingerprint of 64 bits is cut into two segments of 32 bits, so few that of two fingerprints at distance two one segment
differs by one bit at most. Each segment is indexed under its 32 one-wildcard variants (one bit deleted). Fingerprints that
meet under a variant are verified in full.

Segments can be common to any number of fingerprints, as in a large group of near copies. A segment value that more than ``LIMIT``
fingerprints have is not indexed by variants, so that no variant holds more than ``2 * LIMIT``. All fingerprints with such a value, or one bit off it, are
indexed under themselves and their 64 one-bit changes instead: two at distance two or less always meet under one of these, and all
that meet are at distance two or less, 65 at most. So no group grows with the data, no link is lost, and what a hot group costs is in proportion to it.

Null, empty and wordless texts have the fingerprint zero and are linked like any other; fewer words than a shingle form one. Texts of any length are read
whole. Equal fingerprints are linked, so ties and repeated rows fall into one component. Rows are linked by their fingerprints only, equal ids with
different texts need not be. A row with a null id has the smallest id that it reaches, null if none.
An empty table gives an empty one. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import by_batch, on_workers, words_of
from aerolake.llm.near_dup import components
from aerolake.plans.joins import join_dimension, settle

WORDS, SEED, DISTANCE = 3, 42, 2
#: Fingerprints that may share a segment before it counts as hot; rows of one fingerprint beyond which its rows are joined on their own.
LIMIT, HEAVY = 32, 1000
_LOW = (1 << 32) - 1
#: Set bits of each byte value.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint, unsigned."""
    found = words_of(text)
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(len(found) - words + 1, 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist(), strict=True)
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", n)
    # How often each byte value stands at each of the eight places, then how often each bit is set.
    places = np.bincount((h.view(np.uint8).reshape(n, 8) + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits(2 * (places @ _BITS).ravel() > n, bitorder="little").view("<u8")[0])


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id`` and ``fp`` (signed) of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id bigint, fp bigint")


def segments(nodes: DataFrame) -> DataFrame:
    """``fp``, ``segment`` (0 low, 1 high) and ``value`` of both halves."""
    halves = [F.struct(F.lit(k).alias("segment"), v.alias("value")) for k, v in enumerate([F.col("fp").bitwiseAND(_LOW), F.shiftrightunsigned("fp", 32)])]
    return nodes.select("fp", F.inline(F.array(*halves)))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _flips(column: str, bits: int) -> Column:
    """A value and its one-bit changes."""
    return F.concat(F.array(F.col(column)), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda j: F.col(column).bitwiseXOR(_bit(j))))


def _pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints under equal variants: those that differ in the deleted bit, and under the first variant those of equal segments."""
    wild, high = (key >> 32) & 31, key >> 37 == 1
    left, right = [], []
    at = np.arange(len(key))
    for d in range(1, len(key)):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + d]
        part = np.where(high[at], x >> np.uint64(32), x & np.uint64(_LOW)).astype(np.int64)
        here = np.where(wild[at] == 0, part <= 1, part == np.int64(1) << wild[at]) & (np.bitwise_count(x) <= DISTANCE)
        left.append(fp[at[here]])
        right.append(fp[at[here] + d])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _stars(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that meet under a one-bit change are all linked: each with the first of them."""
    first = np.append(True, key[1:] != key[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    near = ~first & (np.bitwise_count(fp ^ fp[start]) <= DISTANCE)
    return fp[start[near]], fp[near]


def met(rows: DataFrame, link) -> DataFrame:
    """Links ``a``, ``b`` among the rows (``key``, ``fp``) of each key; no key has more than a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def told(n: int) -> pa.RecordBatch:
            a, b = (x.view(np.int64) for x in link(key[:n], fp[:n]))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            other = np.flatnonzero(key != key[-1])  # the last key may go on in the next batch
            done = int(other[-1]) + 1 if len(other) else 0
            if done:
                yield told(done)
                key, fp = key[done:], fp[done:]
        if len(key):
            yield told(len(key))

    on_workers(rows.sparkSession)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All pairs needed to connect the different fingerprints ``fp`` of ``nodes`` that differ in at most two bits."""
    parts = segments(nodes)
    hot = settle(parts.groupBy("segment", "value").count().filter(F.col("count") > limit).select("segment", "value"), "hot-segments")
    some = hot.limit(1).count() > 0
    cold = join_dimension(parts, hot, ["segment", "value"], how="left_anti") if some else parts
    variants = cold.select("fp", "segment", "value", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("wild")).select(
        F.call_function("shiftleft", (F.col("segment") * 32 + F.col("wild")).cast("long"), F.lit(32)).bitwiseOR(F.col("value").bitwiseAND(F.bitwise_not(_bit(F.col("wild"))))).alias("key"), "fp",
    )
    found = met(variants, _pairs)
    if some:
        near = settle(hot.select("segment", F.explode(_flips("value", 32)).alias("value")).distinct(), "near-hot-segments")
        crowded = join_dimension(parts, near, ["segment", "value"], how="left_semi").select("fp").distinct()
        found = found.unionByName(met(crowded.select("fp", F.explode(_flips("fp", 64)).alias("key")), _stars))
    return found.distinct()


def link(docs: DataFrame, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` (smallest reachable id) of each row of ``docs`` (``doc_id``, ``text``)."""
    rows = settle(sketch(docs, words), "fingerprints")
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fingerprint-nodes")
    labels = settle(components(settle(links(nodes, limit), "fingerprint-links")), "fingerprint-labels")
    placed = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    placed = settle(placed, "fingerprint-components")
    least = placed.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    # Fingerprints of one row and no link answer for themselves; the rows of frequent ones are joined apart.
    shared = settle(join_dimension(placed, least.filter("m > 1"), ["label"]).filter("m IS NOT NULL OR n > 1").select(
        "fp", F.coalesce("component_id", "first").alias("component_id"), "n",
    ), "fingerprint-shared")
    heavy = shared.filter(F.col("n") > HEAVY).select("fp", "component_id", F.lit(True).alias("heavy"))
    rows = join_dimension(rows, heavy, ["fp"])
    light = rows.filter("heavy IS NULL").drop("component_id", "heavy").join(shared.filter(F.col("n") <= HEAVY).drop("n"), "fp", "left")
    light = light.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = rows.filter("heavy").drop("heavy").unionByName(light)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
