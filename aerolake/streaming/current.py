"""Tables that micro-batches change in place: by bucket, with a log of commits.

A table is a folder with data files by batch and bucket, and one log entry for each committed batch that says which folder holds each bucket
now. A batch reads and writes only the buckets that its rows fall into; the others stay where they are. An entry counts once Spark has marked it as complete,
so readers see a batch as a whole or not at all, and a batch that runs again after a failure builds on the entry before it.
The last two entries and what they refer to are kept for readers; older files are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_BUCKET = "__bucket"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, out: str) -> dict[int, str]:
    """Committed log entries: number -> path."""
    path, fs = _fs(spark, out)
    found = {}
    for f in fs.listStatus(path) if fs.exists(path) else []:
        name = f.getPath().getName()
        if name.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            found[int(name.partition("=")[2])] = f"{out.rstrip('/')}/{name}"
    return found


def _entry(spark: SparkSession, path: str) -> dict[str, str]:
    """Bucket -> folder below the table, as one log entry says; one row for each bucket."""
    return {r.bucket: r.folder for r in spark.read.schema("bucket string, folder string").json(path).collect()}


def rewrite(
    batch: DataFrame, number: int, out: str, bucket: Column, merge: Callable[[DataFrame | None, DataFrame], DataFrame], schema=None, whole: bool = False,
) -> None:
    """Commits a batch: ``merge(old, batch)`` gives the new rows of the buckets that ``batch`` touches; ``old`` is None when they are new.

    ``bucket`` is computed from columns that both have. The number of buckets bounds what reaches the driver. With ``whole`` the batch
    is the whole table from now on.
    """
    spark, root = batch.sparkSession, out.rstrip("/")
    done = {n: p for n, p in versions(spark, out).items() if n < number}
    now = _entry(spark, done[max(done)]) if done and not whole else {}
    touched = sorted(r[0] for r in batch.select(bucket.cast("string")).distinct().collect())
    if not touched and done:
        return
    old = [f"{root}/{now[b]}" for b in touched if b in now]
    rows = merge(spark.read.schema(schema or batch.schema).parquet(*old) if old else None, batch)
    folder = f"data/batch={number}"
    (
        rows.withColumn(_BUCKET, bucket.cast("string")).repartition(_BUCKET)
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(_BUCKET).parquet(f"{root}/{folder}")
    )
    now |= {b: f"{folder}/{_BUCKET}={b}" for b in touched}
    entry = spark.createDataFrame(sorted(now.items()), "bucket string, folder string")
    entry.coalesce(1).write.mode("overwrite").json(f"{root}/version={number}")
    _tidy(spark, root, number)


def _tidy(spark: SparkSession, root: str, number: int) -> None:
    """Deletes older log entries and the data no kept entry refers to."""
    done = {n: p for n, p in versions(spark, root).items() if n <= number}
    keep = sorted(done)[-2:]
    used = {f.split("/")[1] for n in keep for f in _entry(spark, done[n]).values()}
    for n in sorted(done)[:-2]:
        path, fs = _fs(spark, done[n])
        fs.delete(path, True)
    data, fs = _fs(spark, f"{root}/data")
    for f in fs.listStatus(data) if fs.exists(data) else []:
        name = f.getPath().getName()
        if name not in used and int(name.partition("=")[2]) < number:
            fs.delete(f.getPath(), True)


def upsert(batch: DataFrame, number: int, out: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Rows of a batch, one for each key, replace those of their keys in the table at ``out``; buckets hash the keys and must not change in number."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            return new
        return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new)

    rewrite(batch, number, out, F.pmod(F.xxhash64(*keys), F.lit(buckets)), merge)


def replace(table: DataFrame, number: int, out: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Commits ``table`` as all rows of the table at ``out``."""
    rewrite(table, number, out, F.pmod(F.xxhash64(*keys), F.lit(buckets)), lambda old, new: new, whole=True)


def read(spark: SparkSession, out: str, schema) -> DataFrame:
    """The rows of the newest committed entry."""
    done = versions(spark, out)
    folders = _entry(spark, done[max(done)]).values() if done else []
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{out.rstrip('/')}/{f}" for f in sorted(folders)])
