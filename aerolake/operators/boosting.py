"""Boosted regression trees of second order on binned features, grown by level or by leaf.

Features are cut into bins at their quantiles once. Each round fits a tree to the gradients and hessians of the squared
error: one JVM aggregate a level sums both by (node, feature, bin), in partial sums before the shuffle, and only
these sums, nodes x features x bins whatever the number of rows, reach the driver, which finds the split with the
largest gain ``GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)`` of each node (ties: the first feature, then the lowest bin).

* ``level``: every node of a level that gains is split, down to ``max_depth``.
* ``leaf``: the leaf with the largest gain is split next, until there are ``max_leaves``. One pass sums the children of all leaves
  that can still be among those splits, so a tree takes about as many passes as it is deep, not one for each split.

Of the two children of a split only the one with fewer rows is summed, the other one's sums are the rest of their parent's.

Missing values have a bin of their own above all others. The rows' bins, labels and running predictions are a table in the shared
folder, written anew every few rounds; between, the latest trees are expressions over the bins.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.feature import Bucketizer, SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.plans.joins import drop_table, settle
from aerolake.plans.quantiles import exact_quantiles

#: Trees that stay expressions before the running predictions are written.
PENDING = 8


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    left: tuple[float, float]
    right: tuple[float, float]


@dataclass
class Tree:
    """Nodes by heap number: the root is 1, the children of n are 2n and 2n + 1."""

    splits: dict[int, Split] = field(default_factory=dict)
    weights: dict[int, float] = field(default_factory=dict)

    def expression(self, leaf, test, choose, node: int = 1):
        """The tree written with ``test(feature, bin)`` and ``choose(test, left, right)``; ``leaf`` gives a leaf's value."""
        s = self.splits.get(node)
        if s is None:
            return leaf(node)
        return choose(test(s.feature, s.bin), self.expression(leaf, test, choose, 2 * node), self.expression(leaf, test, choose, 2 * node + 1))


@dataclass
class BoostedModel:
    inputs: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]

    def sql(self) -> str:
        """The prediction as a SQL expression over the inputs."""

        def test(f: int, b: int) -> str:
            if b >= len(self.cuts[f]):  # all but the missing values
                return f"NOT isnan(coalesce(cast(`{self.inputs[f]}` AS double), double('NaN')))"
            return f"coalesce(cast(`{self.inputs[f]}` AS double), double('NaN')) < {self.cuts[f][b]!r}D"

        def choose(t: str, a: str, b: str) -> str:
            return f"CASE WHEN {t} THEN {a} ELSE {b} END"

        return " + ".join([f"{self.base!r}D", *[t.expression(lambda n, t=t: f"{t.weights[n]!r}D", test, choose) for t in self.trees]])

    def stage(self, out: str = "prediction") -> SQLTransformer:
        """A stage of a pipeline that adds the prediction; it is stored and loaded with the pipeline."""
        return SQLTransformer(statement=f"SELECT *, {self.sql()} AS `{out}` FROM __THIS__")

    def importance(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        """(feature, importance): each feature's share of all gains."""
        gains = np.zeros(len(self.inputs))
        for t in self.trees:
            for s in t.splits.values():
                gains[s.feature] += s.gain
        total = gains.sum() or 1.0
        rows = [(n, float(g / total)) for n, g in zip(names or self.inputs, gains, strict=True)]
        return spark.createDataFrame(rows, "feature string, importance double")


@dataclass
class BoostedTrees:
    """An estimator; :meth:`fit` gives a :class:`BoostedModel`."""

    growth: str = "level"
    rounds: int = 100
    rate: float = 0.1
    max_depth: int = 6
    max_leaves: int | None = None
    l2: float = 1.0
    min_rows: float = 1.0
    min_gain: float = 0.0
    max_bins: int = 256
    exact: bool = False

    def with_(self, **changes) -> BoostedTrees:
        return replace(self, **changes)

    # ---- bins ----

    def cuts(self, df: DataFrame, inputs: list[str]) -> list[list[float]]:
        """Ascending, different cut points of each input: a value below cut i is in bin i or lower."""
        shares = [i / self.max_bins for i in range(1, self.max_bins)]
        if self.exact:
            found = exact_quantiles(df, inputs, shares)
        else:
            clean = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in inputs}
            row = df.agg(*[F.percentile_approx(clean[c], shares, 10 * self.max_bins).alias(f"q{i}") for i, c in enumerate(inputs)]).first()
            found = {c: row[f"q{i}"] or [] for i, c in enumerate(inputs)}
        return [sorted({float(q) for q in found[c] if q is not None and np.isfinite(q)}) for c in inputs]

    @staticmethod
    def binned(df: DataFrame, inputs: list[str], cuts: list[list[float]], label: str) -> DataFrame:
        """``b0``, ``b1``, ... and ``y``; rows without a label are left out."""
        inf = float("inf")
        values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(inputs)]
        rows = df.select(*values, F.col(label).cast("double").alias("y")).filter("y IS NOT NULL AND NOT isnan(y)")
        many = [i for i, c in enumerate(cuts) if c]
        if many:
            rows = Bucketizer(
                splitsArray=[[-inf, *cuts[i], inf] for i in many], inputCols=[f"x{i}" for i in many], outputCols=[f"b{i}" for i in many], handleInvalid="keep",
            ).transform(rows)
        bins = [F.col(f"b{i}") if cuts[i] else F.when(F.isnan(f"x{i}"), 1).otherwise(0) for i in range(len(inputs))]
        return rows.select(*[b.cast("short").alias(f"b{i}") for i, b in enumerate(bins)], "y")

    # ---- one tree ----

    def _best(self, g: np.ndarray, h: np.ndarray) -> Split | None:
        """The best split of a node from its sums by (feature, bin)."""
        gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        total, mass = g[0].sum(), h[0].sum()
        gr, hr = total - gl, mass - hl
        fits = (hl >= self.min_rows) & (hr >= self.min_rows) & (hl > 0) & (hr > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - total**2 / (mass + self.l2), -np.inf)
        if not gain.size:
            return None
        at = int(np.argmax(gain))
        f, b = divmod(at, gain.shape[1])
        rounding = 1e-12 * (gl[f, b] ** 2 / max(hl[f, b] + self.l2, 1) + gr[f, b] ** 2 / max(hr[f, b] + self.l2, 1))
        if not gain[f, b] > max(self.min_gain, rounding):
            return None
        return Split(float(gain[f, b]), f, b, (float(gl[f, b]), float(hl[f, b])), (float(gr[f, b]), float(hr[f, b])))

    @staticmethod
    def _over_bins(tree: Tree, leaf) -> str:
        """The tree over the bins as SQL; one text is parsed faster than many columns are built."""
        return tree.expression(leaf, lambda f, b: f"b{f} <= {b}", lambda t, a, b: f"CASE WHEN {t} THEN {a} ELSE {b} END")

    def _sums(self, rows: DataFrame, tree: Tree, nodes: list[int], bins: int, features: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Gradients and hessians of the wanted nodes by (feature, bin)."""
        places = ", ".join(f"named_struct('f', {i}, 'b', b{i})" for i in range(features))
        wide = rows.selectExpr(f"{self._over_bins(tree, str)} AS node", "g", f"inline(array({places}))").filter(f"node IN ({', '.join(map(str, nodes))})")
        found = wide.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.count("*").alias("h")).toArrow()
        place = {n: i for i, n in enumerate(nodes)}
        g, h = np.zeros((2, len(nodes), features, bins))
        at = (np.array([place[n] for n in found["node"].to_pylist()], np.int64), found["f"].to_numpy(), found["b"].to_numpy())
        if len(at[0]):
            g[at], h[at] = found["g"].to_numpy(), found["h"].to_numpy()
        return {n: (g[i], h[i]) for n, i in place.items()}

    def grow(self, rows: DataFrame, bins: int, features: int) -> Tree:
        """A tree for the gradients ``g`` of the rows."""
        tree, known, sums, found = Tree(), {}, {}, {}
        limit = self.max_leaves or (1 << self.max_depth)

        def look(nodes: list[int], grown: Tree) -> None:
            # Of two children the one with fewer rows is summed; what its parent has beyond that belongs to the other.
            fewer = {2 * p + (known[p].right[1] < known[p].left[1]) for n in nodes if (p := n // 2)}
            found.update(self._sums(rows, grown, [n for n in nodes if n == 1 or n in fewer], bins, features))
            for n in nodes:
                if n not in found:
                    h = found[n // 2][1] - found[n ^ 1][1]
                    found[n] = (np.where(h > 0, found[n // 2][0] - found[n ^ 1][0], 0.0), h)
                g, h = found[n]
                known[n] = self._best(g, h) if n.bit_length() <= self.max_depth else None
                sums[n] = (float(g[0].sum()), float(h[0].sum()))

        look([1], tree)
        while True:
            # Best first over what is known; a leaf whose split is not known yet ends the walk.
            tree, open_, missing = Tree(), [], []

            def offer(n: int) -> None:
                if known.get(n) is not None:
                    heapq.heappush(open_, (-known[n].gain if self.growth == "leaf" else n.bit_length(), n))

            offer(1)
            while open_ and len(tree.splits) < limit - 1:
                _, n = heapq.heappop(open_)
                tree.splits[n] = known[n]
                children = [2 * n, 2 * n + 1]
                if n.bit_length() < self.max_depth and any(c not in known for c in children):
                    missing.append(n)
                    if self.growth == "leaf":
                        break
                    continue
                for c in children:
                    offer(c)
            if not missing:
                break
            left = limit - 1 - len(tree.splits)
            if not left:
                break
            # All leaves that may still be split: the best ones, as many as there are splits to come.
            wide = Tree(dict(tree.splits))
            wanted = list(missing)
            if self.growth == "leaf":
                for _, n in heapq.nsmallest(left, open_):
                    if n.bit_length() < self.max_depth and 2 * n not in known:
                        wide.splits[n] = known[n]
                        wanted.append(n)
            look([c for n in wanted for c in (2 * n, 2 * n + 1)], wide)
        ends = {1: sums[1]}
        for n, s in tree.splits.items():
            ends.pop(n, None)
            ends |= {2 * n: s.left, 2 * n + 1: s.right}
        tree.weights = {n: -self.rate * g / (h + self.l2) if h + self.l2 else 0.0 for n, (g, h) in ends.items()}
        return tree

    # ---- all rounds ----

    def fit(self, df: DataFrame, inputs: list[str], label: str = "label") -> BoostedModel:
        """Fits on the rows of ``df``, a written table at best; without any labelled row the prediction is 0."""
        cuts = self.cuts(df, inputs)
        table = settle(self.binned(df, inputs, cuts, label), "boost-bins")
        mean = table.agg(F.avg("y")).first()[0]
        if mean is None:
            return BoostedModel(inputs, cuts, 0.0, [])
        bins = max(len(c) for c in cuts) + 2
        columns = [f"b{i}" for i in range(len(inputs))]
        trees, now = [], [f"{float(mean)!r}D"]
        for _ in range(self.rounds):
            if len(now) > PENDING:
                written = settle(table.selectExpr(*columns, "y", f"{' + '.join(now)} AS m"), "boost-rows")
                drop_table(table)
                table, now = written, ["m"]
            tree = self.grow(table.selectExpr(*columns, f"{' + '.join(now)} - y AS g"), bins, len(inputs))
            trees.append(tree)
            now.append(self._over_bins(tree, lambda n, t=tree: f"{t.weights[n]!r}D"))
            if not tree.splits and self.rate <= 1 and abs(tree.weights[1]) < 1e-15:
                break  # nothing left to gain
        drop_table(table)
        return BoostedModel(inputs, cuts, float(mean), trees)


#: What two widely used libraries of boosted trees take unless told otherwise, at the given depths.
PRESETS = {
    "xgboost": BoostedTrees(growth="level", max_depth=6, l2=1.0, min_rows=1.0, max_bins=256),
    "lightgbm": BoostedTrees(growth="leaf", max_depth=10, max_leaves=31, l2=0.0, min_rows=20.0, max_bins=255),
}
