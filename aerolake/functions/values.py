"""Missing values, coercion, clamping and text clean-up."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: ColumnOrName) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def finite_or_null(c: ColumnOrName) -> Column:
    """NaN and both infinities become null."""
    c = as_col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def to_number(c: ColumnOrName) -> Column:
    """Text to double; unparsable text and NaN become null."""
    return nan_to_null(as_col(c).try_cast("double"))


# Date formats tried after ISO text, month first.
DATE_FORMATS = ("yyyy/M/d[ H:mm[:ss]]", "M/d/yyyy[ H:mm[:ss]]", "M-d-yyyy[ H:mm[:ss]]")


def to_timestamp(c: ColumnOrName, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """Text to timestamp, ISO first and then ``formats``; unparsable text becomes null."""
    c = as_col(c)
    iso = c.try_cast("timestamp")
    text = c.cast("string")
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def to_date(c: ColumnOrName, formats: Iterable[str] = DATE_FORMATS) -> Column:
    return to_timestamp(c, formats).cast("date")


def blank_to_null(c: ColumnOrName) -> Column:
    """Trim; empty text and the word Unknown become null."""
    t = F.trim(as_col(c))
    return F.when(~t.isin("Unknown", "unknown", ""), t)


def clip(c: ColumnOrName, low: float, high: float) -> Column:
    """Clamp to [low, high]; null stays null."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def bound_scaled(c: ColumnOrName) -> Column:
    """After scaling: NaN and null to 0, infinities to ±3."""
    c = as_col(c)
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(0.0))
        .when(c == F.lit(float("inf")), F.lit(3.0))
        .when(c == F.lit(float("-inf")), F.lit(-3.0))
        .otherwise(c)
    )


def ladder(c: ColumnOrName, steps: Iterable[tuple[float, object]], above: object) -> Column:
    """First label whose inclusive upper bound is not exceeded, else ``above``."""
    c = as_col(c)
    out = None
    for bound, label in steps:
        test = c <= F.lit(float(bound))
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(above))


def choose(c: ColumnOrName, table: Mapping[object, object], default: object) -> Column:
    """Lookup in a small fixed mapping with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_col(c)), F.lit(default))


def lookup_key(c: ColumnOrName) -> Column:
    """Form in which names are compared: trimmed and lower case."""
    return F.lower(F.trim(as_col(c)))


def prefer(*cs: ColumnOrName) -> Column:
    """First present value, where a numeric zero also counts as missing."""
    return F.coalesce(*[F.nullif(as_col(c), F.lit(0)) for c in cs])
