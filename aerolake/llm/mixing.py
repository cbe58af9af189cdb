"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Of each of its documents ``target / source words`` copies, rounded down, are taken for certain; the
words that remain are filled by one more copy of some. A document's inclusion probability ``p`` for that copy is in proportion to its words, up to one,
with the factor at which the expected words are those that remain; where it is one, the copy is certain too. The others are ranked
by the odds of a random number over the inclusion odds, ``u / (1 - u) * (1 - p) / p``, and taken from
the front until the words that remain are used up: a sample of fixed size in words with unequal probabilities.

Ranks are compared as ``v = rank / (1 + rank)``, which lies in [0, 1). Sums over a thousand slices
of ``v`` find the slice in which the words run out; a slice with more than ``slice_rows`` rows is cut into a thousand again. Only about ``slice_rows`` rows
next to the cut meet in one task, where a document that no longer fits is passed over. Around the cut ranks are about one, where no more than an even share of rows lies.

Nulls: a null text has no words, a null source is a source that comes last. Empty
texts are taken zero words. Repeated rows count each; rows of equal id and text share their random number, so they
are ranked together, and ties are taken in order of id and size. Very long texts are counted whole. An empty table gives an empty one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.llm.common import WORD, on_workers, unit
from aerolake.plans.joins import join_dimension, settle

#: Slices of each cut, and places of ``v`` as a whole number: five cuts part all of them.
SLICES, LEVELS = 1000, 5
UNITS = SLICES**LEVELS
OUT = ["size", "source_size", "target", "taken"]


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """Target of each (source, source_size, n): weights repeat by source order, targets stop at ``max_copies`` times the source.

    With sources ordered by how early they reach their bound, the level of the others follows from running sums.
    One row per source goes through one task.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    by_bound = Window.orderBy("bound", F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    after = by_bound.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - max_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after)
    ranked = weighed.withColumn("bound", max_copies * F.col("source_size") / F.col("w")).withColumn("level", level)
    # The first source above its level in this order: it and all after it share what the others leave.
    open_level = F.min(F.when(F.col("bound") > F.col("level"), F.struct("bound", -F.col("level"), "level"))).over(whole)["level"]
    capped = F.col("bound") <= F.col("level")
    target = F.when(capped | open_level.isNull(), max_copies * F.col("source_size")).otherwise(open_level * F.col("w"))
    return ranked.select("source", "n", "source_size", F.least(target, max_copies * F.col("source_size")).cast("double").alias("target"))


def fill(words_left: float, sizes: list[int]) -> list[bool]:
    """Takes in order what fits; at last the one that brings the sum nearest, if any does."""
    left, takes, best = words_left, [False] * len(sizes), -1
    for i, size in enumerate(sizes):
        if size <= left:
            takes[i] = True
            left -= size
    for i, size in enumerate(sizes):
        if not takes[i] and abs(size - left) < left and (best < 0 or size < sizes[best]):
            best = i
    if best >= 0:
        takes[best] = True
    return takes


def _factors(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``__factor`` (probability for each word), ``__edge_size`` (documents of more words are certain) and ``__sure_words`` (their words).

    Of a source's sizes in descending order, the first one at which the factor of it and all smaller ones makes no probability
    above one is the largest that is not certain. Windows see one row for each different size of a source.
    """
    sizes = measured.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = join_dimension(sizes, plan.select("source", "__rest"), ["source"], how="inner", null_safe=True)
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    words, squares = F.col("n") * F.col("size"), F.col("n").cast("double") * F.col("size") * F.col("size")
    sums = sizes.withColumns({
        "above": F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "below": F.sum(squares).over(down.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("factor", (F.col("__rest") - F.col("above")) / F.col("below"))
    fits = (F.col("factor") >= 0) & (F.col("factor") * F.col("size") <= 1)
    found = sums.filter(fits).groupBy("source").agg(F.max(F.struct("size", "factor", "above")).alias("f"))
    found = found.select(F.col("source").alias("__s"), F.col("f.factor").alias("__factor"), F.col("f.size").alias("__edge_size"), F.col("f.above").alias("__sure_words"))
    joined = plan.join(found, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return joined.fillna({"__factor": 0.0, "__edge_size": 1 << 62, "__sure_words": 0})


def _cuts(slices: DataFrame, slice_rows: int) -> DataFrame:
    """For each source of ``slices`` (``s``, ``words``, ``n``, ``left``): the slice in which its words run out, and the range of slices about it with few enough rows to be filled together.

    Windows see the thousand slices of a source.
    """
    running, whole = Window.partitionBy("source").orderBy("s"), Window.partitionBy("source")
    sums = slices.withColumns({"upto": F.sum("words").over(running), "upto_n": F.sum("n").over(running)})
    sums = sums.withColumn("cut", F.min(F.when(F.col("upto") > F.col("left"), F.struct("s", "upto", "words", "upto_n", "n"))).over(whole)).filter("cut IS NOT NULL")
    half = F.greatest(F.lit(slice_rows) - F.col("cut.n"), F.lit(0)) / 2
    before, after = F.col("cut.upto_n") - F.col("cut.n") - (F.col("upto_n") - F.col("n")), F.col("upto_n") - F.col("cut.upto_n")
    near = (F.col("s") == F.col("cut.s")) | ((F.col("s") < F.col("cut.s")) & (before <= half)) | ((F.col("s") > F.col("cut.s")) & (after <= half))
    return sums.filter(near).groupBy(F.col("source").alias("__s")).agg(
        F.first("cut.s").alias("__cut"), F.first("cut.n").alias("__n"), F.first(F.col("cut.upto") - F.col("cut.words")).alias("__before_cut"),
        F.min("s").alias("__lo"), F.max("s").alias("__hi"), F.min(F.col("upto") - F.col("words")).alias("__before_lo"),
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = 3, seed: int = 0, slice_rows: int = 2000,
) -> DataFrame:
    """``docs`` with its words (``size``), ``source_size``, ``target`` and ``taken`` words, a multiple of ``size``.

    Columns of ``docs`` with these four names are replaced. ``doc_id``, ``text`` and ``source`` must exist.
    """
    spark = docs.sparkSession
    on_workers(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUT])
    kept = docs.columns
    number = unit(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("__u", number)
    measured = settle(sized.select("source", "size", "__u"), "mix-sizes")
    sums = measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = settle(targets(sums, weights, max_copies), "mix-targets")

    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_copies))).otherwise(0)
    plan = goal.withColumn("__copies", copies.cast("long"))
    plan = plan.withColumn("__rest", F.col("target") - F.col("__copies") * F.col("source_size")).drop("n")
    plan = settle(_factors(measured, plan), "mix-factors")

    def ranked(df: DataFrame, with_plan: DataFrame, how: str = "left") -> DataFrame:
        out = join_dimension(df, with_plan, ["source"], how=how, null_safe=True)
        p, u = F.least(F.col("__factor") * F.col("size"), F.lit(1.0)), F.col("__u")
        odds = u * (1 - p)
        v = F.when(p <= 0, 1.0).otherwise(odds / (odds + (1 - u) * p))
        return out.withColumns({"__p": p, "__sure": F.col("size") > F.col("__edge_size"), "__v": F.floor(v * UNITS).cast("long")})

    wide = F.lit(UNITS).cast("long")
    decided = plan.withColumns({"__left": F.col("__rest") - F.col("__sure_words"), "__unit": wide, "__cut": F.lit(0).cast("long"), "__open": F.lit(True)})
    decided = decided.withColumns({"__lo": F.lit(None).cast("long"), "__hi": F.lit(None).cast("long")})
    for level in range(1, LEVELS + 1):
        rows = ranked(measured, decided.filter("__open"), "inner").filter("NOT __sure AND __p > 0").filter(F.floor(F.col("__v") / F.col("__unit")) == F.col("__cut"))
        slices = rows.groupBy("source", F.floor(F.col("__v") / (F.col("__unit") / SLICES)).alias("s")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"), F.first("__left").alias("left"),
        )
        found = _cuts(slices, slice_rows)
        joined = decided.filter("__open").drop("__cut", "__lo", "__hi").join(found, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        deeper = F.coalesce((F.col("__n") > slice_rows) & F.lit(level < LEVELS), F.lit(False))
        joined = joined.withColumns({
            "__open": deeper, "__unit": (F.col("__unit") / SLICES).cast("long"),
            "__left": F.col("__left") - F.when(deeper, F.col("__before_cut")).otherwise(F.coalesce("__before_lo", F.lit(0))),
        })
        decided = settle(decided.filter("NOT __open").unionByName(joined.select(decided.columns)), "mix-plan")
        if not decided.filter("__open").limit(1).count():
            break
    rows = ranked(sized, decided).withColumn("__slice", F.floor(F.col("__v") / F.col("__unit")))
    # No slice goes beyond the words that remain: all are taken.
    extra = F.when(F.col("__sure"), 1).when(F.col("__p") <= 0, 0).when(F.col("__lo").isNull() | (F.col("__slice") < F.col("__lo")), 1).otherwise(0)
    taken = F.col("size") * (F.col("__copies") + extra)
    on_edge = F.coalesce(F.col("__slice").between(F.col("__lo"), F.col("__hi")) & (F.col("__p") > 0) & ~F.col("__sure"), F.lit(False))
    out = [*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target"]
    plain = rows.filter(~on_edge).select(*out, taken.cast("long").alias("taken"))

    edge = rows.filter(on_edge).select(*out, "__copies", "__left", "__v", "__slice")
    schema = edge.select(*out).withColumn("taken", F.lit(0).cast("long")).schema

    def settle_edge(part: pd.DataFrame) -> pd.DataFrame:
        order = [c for c in ("__v", "doc_id", "size") if c in part]
        part = part.sort_values(order, kind="stable").reset_index(drop=True)
        takes = pd.Series(fill(float(part["__left"].iloc[0]), part["size"].tolist()))
        part["taken"] = part["size"] * (part["__copies"] + takes.astype("int64"))
        return part[schema.names]

    return plain.unionByName(edge.groupBy("source").applyInPandas(settle_edge, schema))


def take_copies(mixed: DataFrame) -> DataFrame:
    """The rows of a mix as often as they are taken, without the mix's columns. Documents without words stay once."""
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    kept = [c for c in mixed.columns if c not in OUT]
    return mixed.withColumn("__times", times).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(
        *[F.col(f"`{c}`") for c in kept]
    )
