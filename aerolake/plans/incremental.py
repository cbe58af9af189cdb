"""Repeated ingestion of growing directory trees: a ledger of files, and daily states that new files are merged into.

The ledger keeps path, length, time and checksum of every file read. A run lists the trees, which reads no file, and opens only files the
ledger does not know or knows with another length or time; of these, files with the checksum of before count as unchanged.
New files of readings are merged into the stored daily states. A changed or vanished file, or a new station file, makes all
files be read again into a new generation of states, as what they gave cannot be taken out. States and ledger are committed under one
number, states first, so a run that failed in between does the same again.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake import schema
from aerolake.operators import cities, daily_state
from aerolake.plans import ingestion
from aerolake.plans.joins import settle
from aerolake.sources import csv_tree
from aerolake.streaming import current

LEDGER = "file_path string, dataset string, length bigint, modified timestamp, checksum string, generation int"
KEYS, ORDER = ["city", "station", "date"], ["source_dataset", "source_file", "datetime"]


def listing(spark: SparkSession, trees: dict[str, str]) -> DataFrame:
    """``file_path``, ``dataset``, ``length`` and ``modified`` of all CSV files; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    parts = [
        reader.load(path).select(F.col("path").alias("file_path"), F.lit(dataset).alias("dataset"), "length", F.col("modificationTime").alias("modified"))
        for dataset, path in trees.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def changes(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """The listing and the ledger with ``status``: new, same, touched (another length or time) or gone."""
    before = ledger.select("file_path", F.col("length").alias("l"), F.col("modified").alias("m"), F.col("checksum").alias("known"), "generation")
    same = (F.col("length") == F.col("l")) & (F.col("modified") == F.col("m"))
    status = F.when(F.col("l").isNull(), "new").when(F.col("length").isNull(), "gone").when(same, "same").otherwise("touched")
    return files.join(before, "file_path", "full_outer").withColumn("status", status)


def _measures(readings: DataFrame) -> tuple[list[str], list[str]]:
    measures = [m for m in schema.MEASURES if m in readings.columns]
    return measures, [a for a in schema.ATTRIBUTES if a in readings.columns and a not in KEYS]


def initialize(spark: SparkSession, trees: dict[str, str], store: str, aliases: DataFrame | None = None) -> tuple[DataFrame | None, dict[str, int]]:
    """(daily readings, number of files by what was done with them) of several ``dataset -> path`` trees; ``store`` keeps states and ledger.

    The counts are ``read``, ``kept`` and ``rebuilt`` (1 if everything was read again).
    """
    aliases = aliases if aliases is not None else cities.alias_table(spark)
    ledger_at = f"{store.rstrip('/')}/ledger"
    found = settle(changes(listing(spark, trees), current.read(spark, ledger_at, LEDGER)), "file-changes")
    rows = found.collect()  # the list of files
    known = [r for r in rows if r.status in ("same", "touched")]
    number = max(current.versions(spark, ledger_at), default=-1) + 1
    opened = [r.file_path for r in rows if r.status in ("new", "touched")]
    manifest = {}
    if opened:
        manifest = {unquote(r.file_path): r for r in csv_tree.csv_manifest(spark, [_plain(p) for p in opened]).collect()}

    def checksum(path: str) -> str | None:
        return manifest[unquote(path)].checksum if unquote(path) in manifest else None

    new = {r.file_path for r in rows if r.status == "new"}
    stations = any(csv_tree.classify(unquote(p).rsplit("/", 1)[-1]) == "station_metadata" for p in new)
    changed = any(r.status == "gone" or (r.status == "touched" and checksum(r.file_path) != r.known) for r in rows)
    rebuild = bool(known) and (changed or stations) or any(r.status == "gone" for r in rows)
    generation = max((r.generation for r in rows if r.generation is not None), default=0) + int(rebuild)
    present = [r for r in rows if r.status != "gone"]
    wanted = {r.file_path for r in present} if rebuild else new
    states = f"{store.rstrip('/')}/states-{generation}"

    if wanted:
        frames: dict[str, list[DataFrame]] = {}
        station_files = {r.file_path for r in present if csv_tree.classify(unquote(r.file_path).rsplit("/", 1)[-1]) == "station_metadata"}
        for dataset in trees:
            paths = [_plain(r.file_path) for r in present if r.dataset == dataset and r.file_path in wanted | station_files]
            if paths:
                for kind, parts in csv_tree.scan_csv_tree(spark, trees[dataset], dataset, csv_tree.csv_manifest(spark, paths)).items():
                    frames.setdefault(kind, []).extend(ingestion.standardize_file(f, kind) for f in parts)
        if any(k in frames for k in ingestion.READING_TYPES):
            readings = ingestion.named_readings(ingestion.merge_readings(frames, ingestion.station_table(frames, aliases)), aliases)
            measures, attributes = _measures(readings)
            daily_state.add_readings(readings, number, states, KEYS, measures, attributes, [c for c in ORDER if c in readings.columns])
    if opened or rebuild:
        sums = {r.file_path: checksum(r.file_path) if r.status in ("new", "touched") else r.known for r in present}
        entries = [(r.file_path, r.dataset, r.length, r.modified, sums[r.file_path], generation) for r in present]
        # Vanished files stay out: the ledger is written as a whole when files were read.
        current.replace(spark.createDataFrame(entries, LEDGER), number, ledger_at, ["file_path"])
    counts = {"read": len(wanted), "kept": len(present) - len(wanted), "rebuilt": int(rebuild)}
    example = schema.conform(spark.createDataFrame([], "city string"), schema.READINGS)
    measures, attributes = _measures(example)
    shape = daily_state.partial_states(example, KEYS, measures, attributes, [c for c in ORDER if c in example.columns]).schema
    return daily_state.finish(current.read(spark, states, shape), KEYS), counts


def _plain(uri: str) -> str:
    """A path that a reader takes, from the URI a listing gives."""
    return unquote(uri)
