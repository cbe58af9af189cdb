"""Directory trees of CSV files with differing headers and encodings."""

from __future__ import annotations

import csv
from collections import defaultdict
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake import lookups
from aerolake.operators.standardize import add_provenance
from aerolake.plans.joins import join_dimension, settle

FALLBACK_ENCODING = "ISO-8859-1"


def csv_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per non-empty CSV file below ``path``, or of a list of files: header line, encoding, number of lines, checksum, and whether values are broken over lines.

    Read as raw lines, in splits, with one partial aggregate per file. A file
    with any line that is not UTF-8 counts as Latin-1, which accepts every
    byte, so no further encoding can be reached. A value in quotes goes on in the next line where a line has an odd number of quotes; if the whole file
    has an odd number, a quote is a stray one and the file is read line by line.
    """
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2))
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
        .select(odd.alias("odd"), "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
                F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    )
    # Only the first split of a file can hold its header; other lines are not carried along.
    at_start = F.col("start") == 0
    first = F.min_by(F.when(at_start, F.col("value")), F.when(at_start, F.col("line")))
    return lines.groupBy("file_path", "file_name").agg(
        first.alias("header"),
        F.when(F.bool_and(F.is_valid_utf8("value")), "UTF-8").otherwise(FALLBACK_ENCODING).alias("encoding"),
        F.count("*").alias("lines"),
        F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string").alias("checksum"),
        ((F.max("odd") > 0) & (F.sum("odd") % 2 == 0)).alias("broken"),
    )


def read_records(spark: SparkSession, paths: list[str], encoding: str, schema: T.StructType) -> DataFrame:
    """Records of CSV files whose quoted values may hold line breaks, as text columns and ``source_file``; files are read in splits.

    A line starts a record if an even number of quotes comes before it in the file. Each split counts its quotes, and its starts for an even and for an
    odd number of quotes before it; running sums over a file's splits then say which lines start records and number them
    through, and the few lines of a record meet by its number, whatever splits they lie in. Windows see the lines of one split, or one row for each split.
    """
    raw = spark.read.text(sorted(paths)).select(
        F.decode(F.col("value").cast("binary"), encoding).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
    )
    inside = Window.partitionBy("file", "block").orderBy("line")
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2))
    lines = raw.withColumn("odd", odd)
    lines = lines.withColumn("before", F.pmod(F.sum("odd").over(inside) - F.col("odd"), F.lit(2)))
    splits = lines.groupBy("file", "block").agg(
        F.sum("odd").alias("odds"), F.count_if(F.col("before") == 0).alias("starts_even"), F.count_if(F.col("before") == 1).alias("starts_odd"),
    )
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("entering", F.pmod(F.coalesce(F.sum("odds").over(along), F.lit(0)), F.lit(2)))
    starts = F.when(F.col("entering") == 0, F.col("starts_even")).otherwise(F.col("starts_odd"))
    splits = splits.withColumn("records", F.coalesce(F.sum(starts).over(along), F.lit(0))).select("file", "block", "entering", "records")
    placed = join_dimension(lines, settle(splits, "csv-splits"), ["file", "block"])
    start = (F.col("before") == F.col("entering")).cast("int")
    numbered = placed.withColumn("record", F.col("records") + F.sum(start).over(inside))
    joined = numbered.groupBy("file", "record").agg(
        F.min("source_file").alias("source_file"), F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("lines"),
    )
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    fields = ", ".join(f"c{i} string" for i in range(len(schema)))
    parsed = joined.filter("record > 1").select(F.from_csv(text, F.lit(fields), {"escape": '"', "header": "false"}).alias("r"), "source_file")
    return parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(schema.names)], "source_file")


def _names(header: str) -> list[str]:
    """Column names of a header line; names repeated in any case get a number."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([header.lstrip("\ufeff")]))):
        name = name.strip() or f"unnamed_{i}"
        copies = sum(name.lower() == o.lower().split("#")[0] for o in out)
        out.append(f"{name}#{copies}" if copies else name)
    return out


def scan_csv_tree(spark: SparkSession, path: str, dataset: str, manifest: DataFrame | None = None) -> dict[str, list[DataFrame]]:
    """Text columns of all CSV files below ``path``: file type -> one frame per header and encoding.

    A CSV read maps columns by position, so only files of equal header are
    read together; frames of one type differ in columns and are united by
    name after standardisation. Files without data rows are skipped. Files with line breaks in quoted values
    are read record by record, see :func:`read_records`; the others line by line. Only the
    list of files reaches the driver.
    """
    files = (csv_manifest(spark, path) if manifest is None else manifest).filter("lines > 1").collect()
    groups: dict[tuple[str, str, str, bool], list[str]] = defaultdict(list)
    for f in files:
        # The metadata column holds URIs; a read takes plain paths.
        groups[(classify(f["file_name"]), f["header"], f["encoding"], f["broken"])].append(unquote(f["file_path"]))
    out: dict[str, list[DataFrame]] = {}
    for (kind, header, encoding, broken), paths in sorted(groups.items()):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in _names(header)])
        if broken:
            raw, name = read_records(spark, paths, encoding, schema), F.col("source_file")
        else:
            raw, name = spark.read.schema(schema).option("header", "true").option("encoding", encoding).option("escape", '"').csv(sorted(paths)), F.col("_metadata.file_name")
        named = raw.select(*[_missing(c).alias(c) for c in schema.names], name.alias("source_file"))
        out.setdefault(kind, []).append(add_provenance(named, F.lit(dataset), "source_file"))
    return out


def classify(name: str) -> str:
    """File type of one file name on the driver."""
    return next((kind for part, kind in lookups.FILE_TYPES if part in name.lower()), "unknown")


def _missing(c: str):
    col = F.col(f"`{c}`")
    return F.when(~col.isin(*lookups.NA_STRINGS), col)
