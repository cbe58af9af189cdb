"""Exact quantiles of whole columns in bounded memory.

Spark's exact ``percentile`` keeps every distinct value of a column in one
task. Here each wanted order statistic is bracketed by approximate quantiles
(fixed-size state), the exact counts around the bracket are taken, and the
bracket is narrowed the same way until few enough values are left to sort.
Every step is one partial/final aggregate over all columns at once, and each
round leaves about ``4 / accuracy`` of the values of the round before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.plans.joins import derived

SORT_LIMIT = 100_000
ACCURACY = 1_000


@dataclass
class _Target:
    """The value of 0-based rank ``rank`` in ``column``.

    It lies strictly between ``low`` and ``high``, where ``count`` values lie; ``below`` are not above ``low``.
    """

    column: str
    rank: int
    count: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None

    @property
    def inside(self) -> Column:
        c = F.col(f"`{self.column}`")
        test = c.isNotNull() & ~F.isnan(c)
        if self.low is not None:
            test = test & (c > self.low)
        if self.high is not None:
            test = test & (c < self.high)
        return test

    @property
    def bracket(self) -> tuple:
        return (self.column, self.low, self.high)

    def move(self, a: float, b: float, lt_a: int, le_a: int, lt_b: int, le_b: int) -> None:
        """Narrow by the counts of values below and up to a and b (a <= b)."""
        if self.rank < lt_a:
            self.high, self.count = a, lt_a - self.below
        elif self.rank < le_a:
            self.value = a
        elif self.rank < lt_b:
            self.low, self.high, self.below, self.count = a, b, le_a, lt_b - le_a
        elif self.rank < le_b:
            self.value = b
        else:
            self.low, self.count, self.below = b, self.below + self.count - le_b, le_b


def _row(df: DataFrame, exprs: list[Column]) -> list:
    return list(df.agg(*[e.alias(f"x{i}") for i, e in enumerate(exprs)]).collect()[0])


def _edges(share: float, accuracy: int) -> list[float]:
    margin = 2.0 / accuracy
    return [max(0.0, share - margin), min(1.0, share + margin)]


def _narrow(df: DataFrame, targets: list[_Target], edges: list[tuple[float, float]]) -> None:
    """Exact counts around the given edges, one pass for all targets; equal edges are counted once."""
    index: dict[tuple, int] = {}
    exprs: list[Column] = []

    def count(t: _Target, edge: float, inclusive: bool) -> int:
        key = (t.bracket, edge, inclusive)
        if key not in index:
            c = F.col(f"`{t.column}`")
            index[key] = len(exprs)
            exprs.append(F.count_if(t.inside & ((c <= edge) if inclusive else (c < edge))))
        return index[key]

    wanted = [[count(t, e, inc) for e in pair for inc in (False, True)] for t, pair in zip(targets, edges)]
    found = _row(df, exprs)
    for t, (a, b), places in zip(targets, edges, wanted):
        t.move(a, b, *[t.below + found[i] for i in places])


def _candidates(df: DataFrame, targets: list[_Target]) -> DataFrame:
    """Rows with a value in any open bracket."""
    tests = {t.bracket: t.inside for t in targets}
    return df.filter(reduce(or_, tests.values()))


def _approximate(df: DataFrame, targets: list[_Target], accuracy: int) -> list[tuple[float, float]]:
    """Approximate values around each target's rank; targets with one bracket share one sketch."""
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault(t.bracket, []).append(t)
    exprs = []
    for members in groups.values():
        ps = [p for t in members for p in _edges((t.rank - t.below + 0.5) / t.count, accuracy)]
        exprs.append(F.percentile_approx(F.when(members[0].inside, F.col(f"`{members[0].column}`")), ps, accuracy))
    place = {}
    for members, values in zip(groups.values(), _row(_candidates(df, targets), exprs)):
        for i, t in enumerate(members):
            place[id(t)] = (values[2 * i], values[2 * i + 1])
    return [place[id(t)] for t in targets]


def _sorted_values(df: DataFrame, targets: list[_Target]) -> None:
    """Read the remaining targets from one sorted list per bracket."""
    brackets = {t.bracket: t for t in targets}
    names = {b: f"s{i}" for i, b in enumerate(brackets)}
    lists = _candidates(df, targets).agg(*[
        F.sort_array(F.collect_list(F.when(t.inside, F.col(f"`{t.column}`")))).alias(names[b]) for b, t in brackets.items()
    ])
    picks = lists.select(*[F.get(F.col(names[t.bracket]), t.rank - t.below).alias(f"v{i}") for i, t in enumerate(targets)])
    for t, value in zip(targets, picks.collect()[0]):
        t.value = value


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    sort_limit: int = SORT_LIMIT,
    accuracy: int = ACCURACY,
    edges: dict[str, list[tuple[float, float]]] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column over non-null, non-NaN values.

    Returns ``{column: [quantile per probability]}``; null for an empty column. ``edges`` are values known to lie about each
    quantile, as from a stored sketch; they take the place of the first approximate pass, and the result is exact however wide of it they are.
    """
    df = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    if not derived(df):
        return _quantiles(df, columns, probabilities, sort_limit, accuracy, edges)
    # Several passes follow: keep the columns instead of computing joins and aggregates again.
    # Blocks of a lost executor are computed anew from the input.
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _quantiles(df, columns, probabilities, sort_limit, accuracy, edges)
    finally:
        df.unpersist()


def _quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], sort_limit: int, accuracy: int, given: dict[str, list[tuple[float, float]]] | None = None,
) -> dict[str, list[float | None]]:
    start = []
    for c in columns:
        whole = _Target(c, 0, 0)
        value = F.when(whole.inside, F.col(f"`{c}`"))
        about = F.lit(None) if given else F.percentile_approx(value, [p for q in probabilities for p in _edges(q, accuracy)], accuracy)
        start += [F.count(value), about]
    first = _row(df, start)
    totals = dict(zip(columns, first[0::2]))
    sketches = dict(zip(columns, first[1::2]))
    targets: dict[tuple[str, int], _Target] = {}
    edges: dict[tuple[str, int], tuple[float, float]] = {}
    for c in columns:
        for i, p in enumerate(probabilities):
            if totals[c]:
                position = p * (totals[c] - 1)
                for rank in (math.floor(position), math.ceil(position)):
                    if (c, rank) not in targets:
                        targets[(c, rank)] = _Target(c, rank, totals[c])
                        edges[(c, rank)] = given[c][i] if given else tuple(sketches[c][2 * i : 2 * i + 2])

    def still_open() -> list[_Target]:
        return [t for t in targets.values() if t.value is None and t.count > sort_limit]

    pending = still_open()
    if pending:
        _narrow(df, pending, [edges[(t.column, t.rank)] for t in pending])
    while pending := still_open():
        _narrow(df, pending, _approximate(df, pending, accuracy))
    rest = [t for t in targets.values() if t.value is None]
    if rest:
        _sorted_values(df, rest)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        row: list[float | None] = []
        for p in probabilities:
            if not totals[c]:
                row.append(None)
                continue
            position = p * (totals[c] - 1)
            low, high = math.floor(position), math.ceil(position)
            a, b = targets[(c, low)].value, targets[(c, high)].value
            row.append(a + (b - a) * (position - low))
        out[c] = row
    return out
