"""Ordered operators over daily series.

Input is one row per series and day (see ``operators.daily``), so a window
partition is bounded by the number of days. All operators of one series share
the same partitioning and order, which Spark satisfies with one shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake import lookups

LAGS = (1, 2, 7, 30)


def series_window(keys: list[str], order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def lag_features(
    df: DataFrame, keys: list[str], columns: list[str], lags: tuple[int, ...] = LAGS, calendar: bool = False, date: str = "date"
) -> DataFrame:
    """Value of the k-th previous row per series, or of exactly k days before with ``calendar``."""
    if calendar:
        day = F.unix_date(date)
        by_day = Window.partitionBy(*keys).orderBy(day)
        new = {f"{c}_lag_{k}": F.max(c).over(by_day.rangeBetween(-k, -k)) for c in columns for k in lags}
    else:
        w = series_window(keys, date)
        new = {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags}
    return df.withColumns(new)


def recent_window(df: DataFrame, keys: list[str], features: list[str], length: int = 24, date: str = "date") -> DataFrame:
    """Last ``length`` rows per series as an array in date order, short series padded with the last row."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(date))
    top = df.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= length)
    packed = top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(date, *features))).alias("window"))
    size = F.size("window")
    pad = F.array_repeat(F.element_at("window", -1), F.lit(length) - size)
    return packed.select(*keys, size.alias("rows"), F.concat("window", pad).alias("window"))


def explode_window(df: DataFrame, keys: list[str]) -> DataFrame:
    """Window arrays back to rows with their 0-based position."""
    return df.select(*keys, F.posexplode("window").alias("position", "w")).select(*keys, "position", "w.*")


def window_validity(df: DataFrame, features: list[str], length: int = 24) -> DataFrame:
    """Smallest non-null count over the features of a window, and whether it is below half."""

    def present(name: str) -> Column:
        return F.size(F.filter("window", lambda x: x[name].isNotNull()))

    valid = F.least(*[present(f) for f in features]) if len(features) > 1 else present(features[0])
    return df.withColumn("valid_rows", valid).withColumn("low_quality", F.col("valid_rows") < length * 0.5)


def fill_forward_backward(
    df: DataFrame, keys: list[str], features: list[str], order: str = "date",
    defaults: Mapping[str, float] = lookups.WINDOW_DEFAULTS, default: float = lookups.DEFAULT_WINDOW_VALUE,
) -> DataFrame:
    """Last known value, else the next known one, else the column's default.

    After the forward fill only rows before the first known value are open, so
    the backward fill is that value: one frame over the series, not one per row.
    """
    up_to_now = series_window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = series_window(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    new = {
        c: F.coalesce(
            F.last(c, ignorenulls=True).over(up_to_now), F.first(c, ignorenulls=True).over(whole),
            F.lit(float(defaults.get(c, default))),
        )
        for c in features
    }
    return df.withColumns(new)


def city_daily_mean(df: DataFrame, keys: list[str] = ("city",), value: str = "aqi") -> DataFrame:
    """One row per key and date: sum, count and mean of ``value``."""
    return (
        df.filter(F.col("date").isNotNull())
        .groupBy(*keys, "date")
        .agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.avg(value).alias(value))
    )


def trend_factor(daily: DataFrame, keys: list[str] = ("city",), value: str = "aqi", span: int = 30) -> DataFrame:
    """0.98 when the mean of the newest half of the last ``span`` days is below the older half, else 1.0.

    Needs more than ``span`` days; a row-number limit of ``span + 1`` lets Spark
    cut each series before the shuffle.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("date"))
    rn = F.col("__rn")
    half = span // 2
    top = daily.withColumn("__rn", F.row_number().over(newest)).filter(rn <= span + 1)
    stats = top.groupBy(*keys).agg(
        F.max(rn).alias("days"),
        F.avg(F.when(rn <= half, F.col(value))).alias("recent"),
        F.avg(F.when((rn > half) & (rn <= span), F.col(value))).alias("older"),
    )
    falling = (F.col("days") > span) & (F.col("recent") < F.col("older"))
    return stats.select(*keys, F.when(falling, 0.98).otherwise(1.0).alias("trend_factor"))


def sequence_windows(
    df: DataFrame, keys: list[str], features: list[str], targets: list[str], history: int = 24, horizon: int = 24,
    stride: int = 1, include_last: bool = False, most: int | None = None, date: str = "date",
) -> DataFrame:
    """Sliding (history, horizon) windows per series as arrays of structs.

    Window starts are every ``stride`` rows of the whole series; windows with a
    missing value are left out. The last possible start is used only with ``include_last``. With ``most`` a series gives its first
    ``most`` starts only; by default all of them.
    """
    w = series_window(keys, date)
    span = history + horizon
    gap = F.lit(False)
    for c in {*features, *targets}:
        gap = gap | F.col(c).isNull() | F.isnan(c)
    numbered = df.withColumns({
        "__i": F.row_number().over(w) - 1,
        "__n": F.count("*").over(Window.partitionBy(*keys)),
        "__gap": gap.cast("int"),
    })
    packed = numbered.withColumns({
        "history": F.collect_list(F.struct(date, *features)).over(w.rowsBetween(0, history - 1)),
        "target": F.collect_list(F.struct(date, *targets)).over(w.rowsBetween(history, span - 1)),
        "__gaps": F.sum("__gap").over(w.rowsBetween(0, span - 1)),
    })
    last = F.col("__n") - span
    fits = (F.col("__i") <= last) if include_last else (F.col("__i") < last)
    start = F.col("__i")
    if most is not None:
        fits = fits & (start < most * stride)
    return packed.filter(fits & (start % stride == 0) & (F.col("__gaps") == 0)).select(
        *keys, start.alias("start"), F.col(date).alias("start_date"), "history", "target"
    )


def day_trend(df: DataFrame, keys: list[str], value: str = "predicted_aqi", date: str = "date") -> DataFrame:
    """up, down or flat against the previous forecast day; the first day is flat."""
    before = F.lag(value).over(series_window(keys, date))
    v = F.col(value)
    return df.withColumn("trend", F.when(v > before, "up").when(v < before, "down").otherwise("flat"))


def chrono_split(df: DataFrame, shares: tuple[float, ...] = (0.8, 0.2), names: tuple[str, ...] = ("train", "validation"),
                 date: str = "date") -> DataFrame:
    """Split by time without ordering the rows.

    Rows are counted per date; a date belongs to the part in which its first
    row falls, so parts differ from a row-exact cut by less than one day. The
    ordered window sees one row per date. Rows without a date go to the last part.
    """
    per_day = df.filter(F.col(date).isNotNull()).groupBy(date).agg(F.count("*").alias("n"))
    running = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_day = per_day.withColumns({"before": F.sum("n").over(running) - F.col("n"), "total": F.sum("n").over(everything)})
    cuts, share = [], 0.0
    for i, part in enumerate(shares[:-1]):
        share = round(share + part, 9)
        cuts.append(F.min(F.when(F.col("before") >= F.floor(F.col("total") * share), F.col(date))).alias(f"c{i}"))
    cut = per_day.agg(F.struct(*cuts).alias("cut")).scalar()
    label = F.lit(names[-1])
    for i in range(len(cuts) - 1, -1, -1):
        limit = cut.getField(f"c{i}")
        label = F.when(F.col(date).isNotNull() & (limit.isNull() | (F.col(date) < limit)), names[i]).otherwise(label)
    return df.withColumn("split", label)
