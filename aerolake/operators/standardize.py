"""Header, type and value standardisation of raw reading and station files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake import lookups, schema
from aerolake.functions import values as V


def classify_file_type(name: V.ColumnOrName) -> Column:
    """File type from a file name, by ordered substring match."""
    n = F.lower(V.as_col(name))
    out = None
    for part, kind in lookups.FILE_TYPES:
        out = F.when(n.contains(part), kind) if out is None else out.when(n.contains(part), kind)
    return out.otherwise("unknown")


def add_provenance(df: DataFrame, dataset: V.ColumnOrName, file_name: V.ColumnOrName | None = None) -> DataFrame:
    """Tag rows with dataset, file name and file type.

    ``file_name`` defaults to the file each row was read from.
    """
    name = F.col("_metadata.file_name") if file_name is None else V.as_col(file_name)
    return df.withColumns(
        {"source_dataset": V.as_col(dataset), "source_file": name, "file_type": classify_file_type(name)}
    )


def _rename(df: DataFrame, headers: Mapping[str, list[str]], keep: Iterable[str]) -> DataFrame:
    out, used = [], set()
    for target, variants in headers.items():
        present = []
        for v in variants:
            # Names that differ in case only, which a CSV read numbers, are copies of one column.
            for c in df.columns:
                if re.sub(r"#[0-9]+$", "", c).lower() == v.lower() and c not in used:
                    used.add(c)
                    present.append(F.col(f"`{c}`"))
        if present:
            out.append((F.coalesce(*present) if len(present) > 1 else present[0]).alias(target))
    out += [F.col(c) for c in keep if c in df.columns and c not in used]
    return df.select(*out)


PROVENANCE = ["source_dataset", "source_file", "file_type"]


def standardize_readings(df: DataFrame, keep: Iterable[str] = PROVENANCE) -> DataFrame:
    """Known header variants to internal names; variants present together are coalesced."""
    return _rename(df, lookups.READING_HEADERS, keep)


def standardize_stations(df: DataFrame, keep: Iterable[str] = PROVENANCE) -> DataFrame:
    """Station file headers to internal names, with id and name filled from each other."""
    df = _rename(df, lookups.STATION_HEADERS, keep)
    have = df.columns
    if "station_id" not in have and "station" in have:
        df = df.withColumn("station_id", F.col("station"))
    sources = [c for c in ("station_name", "station", "station_id") if c in df.columns]
    if sources:
        df = df.withColumn("station_name", F.coalesce(*sources))
    return blank_to_null(df, ["station_name", "city"])


def infer_station_id(df: DataFrame, column: str = "station") -> DataFrame:
    """Use ``station`` as id if any of its values looks like one (short, with a digit), else as name."""
    s = F.col(column)
    looks_like_id = df.agg(F.bool_or((F.length(s) <= 10) & s.rlike("[0-9]"))).scalar()
    is_id = F.coalesce(looks_like_id, F.lit(False))
    return df.withColumns({"station_id": F.when(is_id, s), "station_name": F.when(~is_id, s)})


def derive_station(df: DataFrame) -> DataFrame:
    """Station from id, else name, else the raw city with the suffix ``_Central``."""
    parts = [F.col(c) for c in ("station", "station_id", "station_name") if c in df.columns]
    if "city" in df.columns:
        parts.append(F.concat(F.col("city"), F.lit("_Central")))
    return df.withColumn("station", F.coalesce(*parts)) if parts else df


def coerce_dates(df: DataFrame) -> DataFrame:
    """Parse ``datetime`` and ``date``; a missing date column comes from ``datetime``."""
    cols = {}
    if "datetime" in df.columns:
        cols["datetime"] = V.to_timestamp("datetime")
        if "date" not in df.columns:
            cols["date"] = V.to_date("datetime")
    if "date" in df.columns:
        cols["date"] = V.to_date("date")
    return df.withColumns(cols) if cols else df


def coerce_numeric(df: DataFrame, columns: Iterable[str] = tuple(schema.NUMERIC_COLUMNS)) -> DataFrame:
    cols = {c: V.to_number(c) for c in columns if c in df.columns}
    return df.withColumns(cols) if cols else df


def blank_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    cols = {c: V.blank_to_null(c) for c in columns if c in df.columns}
    return df.withColumns(cols) if cols else df


def fill_unknown_categories(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Null text to ``Unknown``; all string columns unless some are named."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    subset = [c for c in columns if c in df.columns]
    return df.fillna("Unknown", subset=subset) if subset else df


def clean_infinite(df: DataFrame) -> DataFrame:
    """Infinities and NaN to null in every floating-point column."""
    cols = {
        f.name: V.finite_or_null(f"`{f.name}`")
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(cols) if cols else df


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold no value at all; one aggregate decides."""
    present = df.agg(*[F.bool_or(F.col(f"`{c}`").isNotNull()).alias(c) for c in df.columns]).collect()[0]
    return df.drop(*[c for c in df.columns if not present[c]])


def align_features(df: DataFrame, expected: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Expected columns in order; absent columns and nulls become 0."""
    return df.select(
        *keep,
        *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in expected],
    )


def union_by_name(
    frames: Mapping[str, list[DataFrame]] | list[DataFrame], include_types: Iterable[str] | None = None
) -> DataFrame:
    """Concatenate frames by column name, missing columns null.

    With a mapping ``file type -> frames`` only ``include_types`` are taken
    (the four reading types unless stated). Columns whose types differ
    between frames are united as text.
    """
    if isinstance(frames, Mapping):
        wanted = include_types or ["station_daily", "station_hourly", "city_daily", "city_hourly"]
        frames = [f for kind in wanted for f in frames.get(kind, [])]
    types: dict[str, set[str]] = {}
    for f in frames:
        for field in f.schema.fields:
            types.setdefault(field.name, set()).add(field.dataType.simpleString())
    mixed = [c for c, t in types.items() if len(t) > 1]
    out = None
    for f in frames:
        f = f.withColumns({c: F.col(f"`{c}`").cast("string") for c in mixed if c in f.columns}) if mixed else f
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out
