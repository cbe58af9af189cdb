"""Secrets: patterns, and strings that a primed compressor finds new.

Three patterns give the base spans. Beyond them, all runs of 16 or more characters in a sensitive context are candidates:
after a word such as ``credential`` or ``bearer`` to the end of its paragraph, of the lines indented more than
its own, or of a key that begins on its line. A candidate's novelty
is its marginal compressed size: bytes that zstandard needs for the candidate, primed
with identifiers common in code and with the text around it, over those for nothing.
Ordinary words, identifiers and repetitions cost little; random strings cost
nearly their whole length. A candidate that costs at least ``per_char`` of its length
is a span of kind ``novel``.

Every whole text is searched. Spans count code points, the end is exclusive. Null and
empty texts have no spans; repeated rows have the same ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import by_batch

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
SPANS = "array<struct<kind:string,start:int,end:int>>"

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(r"(?ai:credential|bearer|authorization|private.?key|access.?key|secret|passw|pwd|token|api.?key)")
RUN = re.compile(r"[A-Za-z0-9+/_.~=-]{16,}")
#: What a run may start with that is not the value: the rest of a name, and its sign.
NAME = re.compile(r"[A-Za-z_.-]*=+(?=.{16})")
CONTEXT_WORDS = ("credential", "bearer", "authorization", "private", "access", "secret", "passw", "pwd", "token", "key")

#: What common code looks like to the compressor.
IDENTIFIERS = (
    "import from return class public static void function const string value object array index length print format "
    "config settings options parameters request response header content type application json username password secret "
    "token bearer authorization credential access key private client server default example placeholder changeme your_api_key "
    "your-token-here environment variable os.environ getenv process.env true false null none undefined test sample dummy "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 http https www com org self this super init main "
    "user_id session_id account_name database connection timeout interval callback handler controller service manager factory"
).encode()


def cost(candidate: bytes, around: bytes) -> int:
    """Compressed bytes of ``candidate`` beyond those of nothing, primed with identifiers and the text around it."""
    primer = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(packer.compress(candidate)) - len(packer.compress(b""))


def sensitive(text: str) -> list[tuple[int, int]]:
    """The parts of lines in a sensitive context."""
    found, at, paragraph, deeper, key = [], 0, False, None, False
    for line in text.split("\n"):
        bare = line.strip(" \t\r")
        indent = len(line) - len(line.lstrip(" \t"))
        ends = "-----END" in line
        key = key and not ends
        if not bare:
            paragraph = False
        elif deeper is not None and indent <= deeper:
            deeper = None
        word = CONTEXT.search(line)
        if bare and (key or paragraph or deeper is not None):
            found.append((at, at + len(line)))
        elif word:
            found.append((at + word.end(), at + len(line)))
        if word and not ends:
            paragraph, deeper = True, indent if deeper is None else min(deeper, indent)
            key = key or "-----BEGIN" in line
        at += len(line) + 1
    return found


def novel(text: str, taken: list[tuple[int, int]], reach: int = 400, per_char: float = 0.7) -> list[tuple[int, int]]:
    """Spans of strings in a sensitive context that the text around does not explain."""
    found = []
    taken = sorted(taken)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for a, b in sensitive(text):
        for m in RUN.finditer(text, a, b):
            start, end = m.span()
            if name := NAME.match(text, start, end):
                start = name.end()
            before = bisect_left(starts, end)
            if before and ends[before - 1] > start:
                continue
            value = text[start:end]
            around = (text[max(0, start - reach) : start] + text[end : end + reach]).encode("utf-8", "replace")
            if cost(value.encode(), around) >= per_char * len(value):
                found.append((start, end))
    return found


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then by kind."""
    if not text:
        return []
    low = text.lower()
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        out += [("novel", s, e) for s, e in novel(text, [x[1:] for x in out])]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` (``text`` is read) with ``spans``, an array of (kind, start, end); a column of that name is replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "spans"])
    schema = docs.withColumn("spans", F.lit(None).cast(SPANS)).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in batch.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return batch.append_column("spans", pa.array(found, kind))

    return by_batch(docs, run, schema)


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``, overlapping spans by one; ``n_chars``, if there, counts the new text."""

    def clean(text: str | None) -> str | None:
        parts, at = [], 0
        for _, start, end in spans(text):
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join([*parts, text[at:]]) if parts else text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = batch.schema.get_field_index("text")
        return batch.set_column(i, "text", pa.array([clean(t) for t in batch.column(i).to_pylist()], pa.string()))

    out = by_batch(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
