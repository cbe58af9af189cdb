"""Helpers shared by the text operators.

Rows with a null ``doc_id`` are documents like any other; a null text is an empty
text unless an operator says otherwise. Python runs on Arrow batches only.
"""

from __future__ import annotations

import ctypes
import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.plans.joins import join_dimension

#: A word is a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Letters are what ``str.isalpha`` takes for such; numbers written with signs of their own are none.
LETTER = r"\p{L}"
HAS_LETTER = regex.compile(LETTER)
#: Scripts that put no space between words, and punctuation beyond ASCII.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
_MARKS = re.compile("[\u00a0\u00a1\u00ab\u00b7\u00bb\u00bf\u2000-\u206f\u3000-\u3004\u3006-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
#: Letters and digits in lower case, everything else in ASCII a space.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows that a Python function gets at once.
SLICE = 512


def give_back() -> None:
    """Memory that this worker has freed goes back to the system, so that it does not stay beside what the next stage needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def free_driver(spark: SparkSession) -> None:
    """The driver lets go of finished jobs and gives the memory back to the system; for steps of many jobs.

    Shuffles and broadcasts are cleared only once the driver's garbage is collected, and a heap that has grown stays grown until then. What
    plans, compiled code and threads have freed beside the heap stays with the process as well; not every Java can give it back.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    beans = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # the server's own class can't be called from here
    order = gateway.new_array(jvm.java.lang.Object, 4)
    order[0], order[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        next(m for m in beans.getMethods() if m.getName() == "invoke").invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), order)
    except Py4JError:
        pass
    give_back()


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, after: Callable[[], None] | None = None) -> DataFrame:
    """``fn`` on every Arrow batch, a slice at a time; ``after`` lets go of what ``fn`` keeps in the worker, at the end of a partition."""
    on_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                yield fn(batch.slice(start, SLICE))
        if after is not None:
            after()
        give_back()

    return df.mapInArrow(run, schema)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed meanwhile reaches Python workers at most ``rows`` rows at a time; the session's own size of batches holds again afterwards.

    A batch stands in the executor's buffers and in the worker at once, several times over. Rows and results are the same.
    """
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for documents of one fold by crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def unit(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def words_of(text: str | None) -> list[bytes]:
    """Words with ASCII letters in lower case."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The eight bytes from each place of the padded text, and start, end and length of each run between spaces."""
    padded = b" " * 8 + raw + b" " * 9
    inside = np.frombuffer(padded, np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,)), edges[::2], edges[1::2], edges[1::2] - edges[::2]


def word_ends(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last eight bytes, as numbers, and the length of each run between spaces."""
    eight, start, end, size = _words(raw)
    short = np.minimum(size, 8)
    return eight[start] & MASKS[short], eight[end - 8] >> ((8 - short) * 8).astype(np.uint64), size


def word_codes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`word_ends` gives, and a number that depends on every byte of the run.

    Both ends say all of a run of at most 16 bytes; of a longer one, all its blocks of eight bytes are summed up, each times a power for its place.
    """
    eight, start, end, size = _words(raw)
    first, last, size = word_ends(raw)
    code = mixed(first, last, size.astype(np.uint64))
    long = np.flatnonzero(size > 16)
    if len(long):
        blocks = (size[long] - 1) // 8
        ends = np.cumsum(blocks)
        place = np.arange(ends[-1]) - np.repeat(ends - blocks, blocks)
        power = np.cumprod(np.full(int(blocks.max()), _ODD[1], np.uint64))
        parts = mixed(eight[np.repeat(start[long], blocks) + 8 * place]) * power[place]
        code[long] = mixed(code[long], np.add.reduceat(parts, ends - blocks))
    return first, last, size, code


def spaced(text: str) -> str:
    """Marks beyond ASCII as spaces, and runs of scripts without spaces as their overlapping pairs of characters."""
    if text.isascii():
        return text

    def pairs(m: re.Match) -> str:
        run = m.group()
        return f" {run} " if len(run) < 3 else f" {' '.join(map(''.join, zip(run, run[1:], strict=False)))} "

    return _UNSPACED.sub(pairs, _MARKS.sub(" ", text))


def mixed(*parts: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit number from several."""
    out = np.zeros(1, np.uint64)
    for part, odd in zip(parts, _ODD, strict=False):
        out = (out ^ part) * odd
        out = out ^ (out >> np.uint64(29))
    return out


def word_buckets(text: str | None, bits: int, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """Buckets of the whole text: a row for each run of letters and digits, in it a bucket of the whole word and of each of its beginnings in bytes.

    Runs of scripts that put no space between words are read as overlapping pairs of characters.
    """
    width = 1 + len(prefixes)
    if not text:
        return np.zeros((0, width), np.int32)
    first, _, _, code = word_codes(spaced(text.lower()).encode("utf-8", "replace").translate(_FOLD))
    out = np.empty((len(first), width), np.int32)
    shift = np.uint64(64 - bits)
    out[:, 0] = (code * _ODD[0]) >> shift
    for j, k in enumerate(prefixes):
        out[:, j + 1] = (mixed(first & MASKS[k], np.uint64(k)) * _ODD[0]) >> shift
    return out


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def labelled_sample(docs: DataFrame, labels: DataFrame, rates: dict[int, float], seed: int) -> DataFrame:
    """``text``, ``y`` and ``u`` of a sample of labelled documents: label ``y`` is kept at its rate, chosen by the hash of the id.

    ``labels`` has ``doc_id`` and ``y``. They are sampled before they meet the texts, so that only bounded rows are sent to them. Of
    several rows with one id and label, the text with the least hash is taken, so that repeated rows do not make the sample larger.
    """
    rate = F.coalesce(*[F.when(F.col("y") == y, F.lit(float(r))) for y, r in rates.items()], F.lit(0.0))
    chosen = labels.withColumn("u", unit(F.lit(seed), F.col("doc_id")) / rate).filter(F.col("u") < 1).select("doc_id", "y", "u")
    rows = join_dimension(docs.select("doc_id", "text"), chosen, ["doc_id"], how="inner").filter("text IS NOT NULL")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text", "u")).alias("r"))
    return one.select("r.text", "y", "r.u")

