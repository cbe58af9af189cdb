"""Near-duplicate documents by min-max hashing.

A document's set holds the hashes of its distinct five-word shingles. Each permutation
yields two signature values, the set's minimum and its maximum, so that half as many
permutations are evaluated. Bands of values from different permutations find
candidates: with 40 bands of 4 values a pair of similarity 0.75 is missed with a chance of
``(1 - 0.75 ** 4) ** 40`` = 3e-7. Every link is confirmed on full sets: ``100 * common >= 75 * union``.

Only components are asked for, so links are found block by block and never listed as all pairs:

1. Documents with equal sets are one node, the smallest ``doc_id`` among them.
2. Nodes that share buckets, directly or through others, form a cluster.
3. A cluster is dealt to blocks of bounded size. The common shingles of all pairs of a block are
   a product of its incidence matrix; of the links found only a spanning star of each component leaves the task.
4. Of clusters with several blocks, all pairs of blocks are compared likewise, but for those
   whose nodes are already in one component.

A document is known by its ``doc_id``: rows with one id are one node even if texts
differ. Rows with a null id belong to no component and are kept. Null, empty and
wordless texts have the empty set and are linked with nothing. Fewer than five words
form one shingle. Texts of any length are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import by_batch, free_driver, fresh, hashes, mixed, words_of
from aerolake.plans.joins import join_dimension, settle

WORDS, SHARED, OF = 5, 75, 100
BANDS, ROWS = 40, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``words`` words."""
    h = hashes(words_of(text))
    if not len(h):
        return h
    out = h[: max(len(h) - words + 1, 1)].copy()
    for k in range(1, min(words, len(h))):
        out = (out ^ (out >> np.uint64(29))) * _ODD + h[k : k + len(out)]
    return np.unique((out ^ (out >> np.uint64(32))) * _ODD)


class Permutations:
    """Half as many permutations as signature values."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 17) -> None:
        rng = np.random.default_rng(seed)
        n = -(-bands * rows // 2)
        self.bands, self.rows = bands, rows
        self.flip = rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32)
        self.odd = rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32) | np.uint32(1)

    def signature(self, items: np.ndarray) -> np.ndarray:
        """The minima of all permutations, then the maxima."""
        x = (items >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.odd), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.odd), np.uint32)
        for at in range(0, len(x), 2048):
            y = (x[None, at : at + 2048] ^ self.flip) * self.odd
            np.minimum(low, y.min(axis=1), out=low)
            np.maximum(high, y.max(axis=1), out=high)
        return np.concatenate([low, high])

    def keys(self, items: np.ndarray) -> np.ndarray:
        """One number for each band. Neighbouring values come from different permutations."""
        values = self.signature(items)[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            out = mixed(out, values[:, j])
        return out.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``same`` (equal for equal sets, null for empty ones) and ``bands`` of each row."""
    table = Permutations()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, same, bands = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text)
            sizes.append(len(s))
            same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bands.append(table.keys(s) if len(s) else [])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "same", "bands"],
        )

    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id bigint, n_shingles bigint, same binary, bands array<bigint>")


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Full sets of the documents listed in ``nodes`` (column ``node``); equal rows once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("h"), pa.array(found, pa.binary())], ["node", "h", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.xxhash64("text").alias("h"), "text")
    wanted = join_dimension(rows, nodes, ["node"], how="left_semi")
    return by_batch(wanted, run, "node bigint, h bigint, items binary").repartition("node").dropDuplicates(["node", "h"]).drop("h")


def spanning(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A star over each component of the nodes whose sets are similar enough: (smallest node, other node)."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    items, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes.astype(int))
    shared = n[column] > 1
    row, column = row[shared], column[shared]
    places = np.flatnonzero(n > 1)
    column = np.searchsorted(places, column)
    common = np.zeros((m, m), np.float32)
    for at in range(0, len(places), 4096):
        here = (column >= at) & (column < at + 4096)
        part = np.zeros((m, min(4096, len(places) - at)), np.float32)
        part[row[here], column[here] - at] = 1
        common += part @ part.T
    linked = OF * common >= SHARED * (sizes[:, None] + sizes[None, :] - common)
    label = np.full(m, -1)
    out = []
    for i in np.argsort(nodes, kind="stable"):
        if label[i] >= 0:
            continue
        reach, edge = np.zeros(m, bool), np.zeros(m, bool)
        edge[i] = True
        while edge.any():
            reach |= edge
            edge = linked[edge].any(axis=0) & ~reach
        label[reach] = i
        out += [(int(nodes[i]), int(nodes[j])) for j in np.flatnonzero(reach) if nodes[j] != nodes[i]]
    return out


def links_of(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Spanning links of each cluster within a group of rows (``cluster``, ``node``, ``items``); groups are of bounded size."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, rows in part.groupby("cluster", sort=False):
            if len(rows) > 1:
                found += spanning(rows["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["items"]])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return groups.groupBy(*keys).applyInPandas(run, "a bigint, b bigint").distinct()


def _with_least(edges: DataFrame, least: DataFrame, small: bool, hub: int) -> DataFrame:
    """Edges (u, v) with ``m`` of ``least`` (u, m, n), the least ``v`` of their ``u``.

    Least ones of few nodes are sent to the edges. Of many, nodes with more than ``hub`` edges are few, at most one in ``hub`` edges, and
    their edges meet the least one without being gathered in a task.
    """
    if small:
        return edges.join(F.broadcast(least.select("u", "m")), "u")
    hubs = least.filter(F.col("n") > hub).select("u", F.col("m").alias("hub_m"))
    if not hubs.limit(1).count():
        return edges.join(least.drop("n"), "u")
    told = join_dimension(edges, hubs, ["u"])
    rest = told.filter("hub_m IS NULL").select("u", "v").join(least.filter(F.col("n") <= hub).drop("n"), "u")
    return rest.unionByName(told.filter("hub_m IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")))


def components(links: DataFrame, hub: int = 1000, few: int = 50_000) -> DataFrame:
    """``node`` and ``label``, the smallest node it can reach, for the nodes of ``links`` (a, b).

    Alternating stars: nodes hang themselves onto the smallest node among their neighbours until only stars are left, which
    the partial sums that find the smallest neighbours show as well: no node then has a smaller neighbour and another one.
    Up to ``few`` nodes meet their edges without a shuffle of these. The driver keeps plans, shuffles and tasks of every job, so rounds have few of them
    and let go of them at their end.
    """
    star = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        seen = least.agg(F.count("*").alias("nodes"), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1)).alias("open")).first()
        if not seen["open"]:
            break
        small = seen["nodes"] <= few
        large = settle(_with_least(both, least, small, hub).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hung = _with_least(large, least if small else settle(least, "least"), small, hub)
        below = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
        star = settle(below.distinct(), "small-star")
        free_driver(star.sparkSession)
    labels = star.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(star.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label")))


def relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after further links between nodes."""
    if labels is None:
        return settle(components(links), "labels")
    at = {s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}")) for s in "ab"}
    lifted = links.join(at["a"], "a", "left").join(at["b"], "b", "left")
    merged = components(lifted.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    merged = settle(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "merged")
    moved = labels.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = merged.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("to").alias("label"))
    return settle(moved.unionByName(new), "labels")


def compared(clusters: DataFrame, sets: DataFrame, block_rows: int) -> DataFrame:
    """``node`` and ``label`` of all nodes that are linked; ``clusters`` has ``node`` and ``cluster``."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / block_rows)
    total = clusters.count()
    bins = max(1, -(-total // block_rows))
    # Small clusters are dealt to tasks together; each block of a large one is a task.
    known = settle(clusters.join(sizes, "cluster").withColumn("large", F.col("m") > block_rows), "clusters")
    first = known.join(sets, "node").select(
        "cluster", "node", "items", F.when(F.col("large"), F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(bins))).alias("g"),
        F.when(F.col("large"), F.pmod(F.xxhash64("node"), blocks)).otherwise(-1).alias("k"),
    )
    labels = relabel(None, settle(links_of(first, ["g", "k"]), "links"))
    free_driver(labels.sparkSession)
    large = known.filter("large").select("cluster", "node")
    if not large.limit(1).count():
        return labels

    # Components that fill blocks of their own are not compared with themselves again; all other nodes share blocks.
    here = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    here = settle(here, "labelled")
    big = here.groupBy("cluster", "label").agg(F.count("*").alias("c")).filter(F.col("c") >= 2 * block_rows)
    here = here.join(big, ["cluster", "label"], "left").withColumn("own", F.when(F.col("c").isNotNull(), F.col("label")))
    rest = here.groupBy("cluster", "own").agg(F.count("*").alias("c")).withColumn("parts", F.ceil(F.col("c") / block_rows))
    parts = rest.withColumnsRenamed({"cluster": "rc", "own": "ro"}).select("rc", "ro", "parts")
    here = here.drop("c").join(parts, (F.col("cluster") == F.col("rc")) & F.col("own").eqNullSafe(F.col("ro")))
    here = settle(here.select("cluster", "node", "own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).alias("block")), "blocks")
    listed = settle(here.select("cluster", "own", "block").distinct().withColumn("id", F.xxhash64("own", "block", F.lit(2))), "block-list")
    one = listed.select("cluster", F.col("own").alias("own_x"), F.col("block").alias("block_x"), F.col("id").alias("x"))
    two = listed.select("cluster", F.col("own").alias("own_y"), F.col("block").alias("block_y"), F.col("id").alias("y"))
    same = F.col("own_x").isNotNull() & F.col("own_x").eqNullSafe(F.col("own_y"))
    pairs = settle(one.join(two, "cluster").filter((F.col("x") <= F.col("y")) & ~same), "block-pairs")
    rows = here.join(sets, "node").withColumn("id", F.xxhash64("own", "block", F.lit(2))).select("cluster", "node", "items", "id")
    sides = [
        rows.join(pairs.select("cluster", F.col("x").alias("id"), "x", "y"), ["cluster", "id"]),
        rows.join(pairs.filter("x <> y").select("cluster", F.col("y").alias("id"), "x", "y"), ["cluster", "id"]),
    ]
    both = sides[0].unionByName(sides[1]).select("cluster", "node", "items", "x", "y")
    return relabel(labels, settle(links_of(both, ["cluster", "x", "y"]), "links"))


def link(docs: DataFrame, block_rows: int = 256) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs`` (``doc_id``, ``text``)."""
    rows = settle(sketch(docs), "sketches")
    known = rows.filter("same IS NOT NULL AND doc_id IS NOT NULL")
    copies = known.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("same", "first")
    copies = settle(copies, "copies")
    # Copies have equal bands: the first of them stands for all.
    placed = join_dimension(known, copies, ["same"]).filter("first IS NULL OR doc_id = first").withColumn("node", F.col("doc_id"))
    dealt = placed.select("node", F.explode("bands").alias("key"))
    shared = dealt.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key", "lo")
    met = dealt.join(settle(shared, "shared-keys"), "key").filter("node > lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    met = settle(met, "met")
    free_driver(met.sparkSession)
    clusters = settle(components(met).withColumnRenamed("label", "cluster"), "clusters")
    sets = settle(sets_of(docs, clusters.select("node")), "sets")
    free_driver(sets.sparkSession)
    labels = compared(clusters, sets, block_rows)
    free_driver(labels.sparkSession)

    out = join_dimension(rows.select("doc_id", "n_shingles", "same"), copies, ["same"]).withColumn("node", F.coalesce("first", "doc_id"))
    out = out.join(labels, "node", "left").withColumn("component_id", F.coalesce("label", "node"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def dedupe(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that another one stands for.

    Of each component the row with the smallest ``doc_id`` stays. Where ids repeat, every different text is judged by itself: of a component the
    text with the smallest id stays, of equal ids the one with the smallest hash; of rows with equal id and text one stays, the one whose
    other columns have the smallest hash. Rows with a null id are kept.
    """
    ids = docs.filter("doc_id IS NOT NULL")
    again = ids.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if not again:
        found = settle(link(docs.select("doc_id", "text")), "linked")
        return join_dimension(docs, found.filter("NOT kept").select("doc_id").distinct(), ["doc_id"], how="left_anti")
    name = fresh(docs, "text_id")
    marked = docs.withColumn(name, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    single = marked.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("doc_id")).agg(F.min("doc_id").alias("real"), F.first("text").alias("text"))
    single = settle(single, "different-texts")
    found = link(single.select("doc_id", "text")).select("doc_id", "component_id")
    stays = settle(found, "linked").join(single.select("doc_id", "real"), "doc_id").groupBy("component_id").agg(F.min(F.struct("real", "doc_id")).alias("r"))
    left = join_dimension(marked, settle(stays.select(F.col("r.doc_id").alias(name)), "staying"), [name], how="left_semi")
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    one = left.groupBy(name).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), hashed).alias("r")).select("r.*")
    return one.unionByName(docs.filter("doc_id IS NULL"))
