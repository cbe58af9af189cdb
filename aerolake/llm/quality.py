"""Text quality by ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = sigmoid(theta_k - w . x)`` with one weight vector over hashed text
features for all grades and ordered thresholds ``theta``. A text's features are the
shares of its words, of their beginnings and endings, of pairs of equal neighbours and of
character shapes, hashed and of length 1. Fitted with Adagrad in numpy on a bounded
sample of graded rows; every text is graded whole.

Results: ``expected_grade``, ``tail`` = P(grade >= ``tail_from``), ``selected`` = tail at least
the threshold with the best F1 on rows of the sample kept from training. Null and empty
texts have no features and get what the thresholds alone say. Rows without a grade are not
learned from. Without graded rows all grades are equally likely and nothing is selected. Repeated rows are graded each, alike, and equal tails are
selected alike; an empty table gives an empty one. Runs of scripts without spaces are read as pairs of characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import by_batch, labelled_sample, mixed, spaced, word_codes

BITS = 15
#: White space of ASCII is a space; letters keep their case.
_SPACE = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their values."""
    if not text:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    first, last, size, word = word_codes(spaced(text).encode("utf-8", "replace").translate(_SPACE))
    if not len(size):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ends = last >> ((np.minimum(8, size) - np.minimum(2, size)) * 8).astype(np.uint64)
    same = word[1:][word[1:] == word[:-1]] * np.uint64(0) + np.uint64(3)
    kinds = [
        mixed(word, np.uint64(1)), mixed(first & np.uint64((1 << 32) - 1), np.uint64(2)), mixed(ends, np.uint64(4)),
        mixed(np.where(first & np.uint64(0x20) > 0, np.uint64(0), np.uint64(1)) + np.uint64(2) * (size == 1), np.uint64(5)),
    ]
    if len(same):
        kinds.append(mixed(same, np.uint64(3)))
    at, n = np.unique((np.concatenate(kinds) >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
    x = np.sqrt(n.astype(np.float32))
    return at, x / np.linalg.norm(x)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thetas: np.ndarray  # ascending, one fewer than grades
    cut: float = 2.0  # of the tail; above 1: selects nothing

    def at_least(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        at, x = features(text)
        return sigmoid(float(self.weights[at] @ x) - self.thetas)


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, rounds: int = 8, rate: float = 0.3, seed: int = 3) -> OrdinalModel:
    """Maximum likelihood; thresholds stay ordered because their distances are exponentials."""
    rng = np.random.default_rng(seed)
    w, g_w = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=levels))[:-1] / len(grades), 1e-3, 1 - 1e-3)
    thetas = np.log(share / (1 - share))
    base, gaps = thetas[0], np.log(np.maximum(np.diff(thetas), 1e-2))
    g_base, g_gaps = 1e-2, np.full(len(gaps), 1e-2)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            y = grades[i]
            thetas = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            z = float(w[at] @ x)
            upper = sigmoid(thetas[y] - z) if y < levels - 1 else 1.0
            lower = sigmoid(thetas[y - 1] - z) if y else 0.0
            p = max(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            dz = du - dl  # of the loss -log p
            d_theta = np.zeros(levels - 1)
            if y < levels - 1:
                d_theta[y] -= du
            if y:
                d_theta[y - 1] += dl
            d_base, d_gaps = d_theta.sum(), np.cumsum(d_theta[::-1])[::-1][1:] * np.exp(gaps)
            g_base += d_base**2
            g_gaps += d_gaps**2
            base -= 0.1 * d_base / np.sqrt(g_base)
            gaps = np.clip(gaps - 0.1 * d_gaps / np.sqrt(g_gaps), -6, 4)
            step = dz * x
            g_w[at] += step * step
            w[at] -= rate * step / np.sqrt(g_w[at])
    return OrdinalModel(w.astype(np.float32), base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def best_cut(tail: np.ndarray, good: np.ndarray) -> float:
    order = np.argsort(-tail, kind="stable")
    hits = np.cumsum(good[order])
    f1 = np.where(np.append(tail[order][:-1] != tail[order][1:], True), 2 * hits / (np.arange(1, len(order) + 1) + good.sum()), -1)
    return float(tail[order][int(np.argmax(f1))])


def fit(docs: DataFrame, graded: DataFrame, grades: int, tail_from: int | None = None, max_rows: int = 8000, calibrate: float = 0.25) -> OrdinalModel:
    """Learns from ``doc_id``, ``text`` of ``docs`` and ``doc_id``, ``grade`` (0 to ``grades`` - 1) of at most about ``max_rows`` ratings, which the driver gets as features."""
    tail_from = grades // 2 if tail_from is None else tail_from
    marks = graded.select("doc_id", F.col("grade").cast("int").alias("y")).filter(F.col("y").between(0, grades - 1) & F.col("doc_id").isNotNull())
    n = marks.count()
    sample = labelled_sample(docs, marks, dict.fromkeys(range(grades), min(1.0, max_rows / max(n, 1))), 13)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary()), batch.column("y"), batch.column("u")],
            ["at", "x", "y", "u"],
        )

    got = by_batch(sample, encode, "at binary, x binary, y int, u double").toArrow().sort_by([("u", "ascending"), ("y", "ascending")])
    if not len(got):
        return OrdinalModel(np.zeros(1 << BITS, np.float32), -np.log(np.arange(grades - 1, 0, -1) / np.arange(1, grades)))
    data = [(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.float32)) for a, x in zip(got["at"], got["x"], strict=True)]
    y = got["y"].to_numpy()
    held = got["u"].to_numpy() < calibrate
    if held.all() or not held.any():
        held = np.zeros(len(y), bool)
    model = train([d for d, h in zip(data, held, strict=True) if not h], y[~held], grades)
    judged = held if held.any() else ~held
    tail = np.array([sigmoid(float(model.weights[a] @ x) - model.thetas)[tail_from - 1] for (a, x), j in zip(data, judged, strict=True) if j])
    model.cut = best_cut(tail, y[judged] >= tail_from)
    return model


def grade(docs: DataFrame, model: OrdinalModel, tail_from: int = 2) -> DataFrame:
    """``docs`` (``text`` is read) with ``expected_grade``, ``tail`` and ``selected``; columns of these names are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("expected_grade", "tail", "selected")])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        above = np.array([shared.value.at_least(t) for t in batch.column("text").to_pylist()])
        tail = above[:, tail_from - 1]
        return (
            batch.append_column("expected_grade", pa.array(above.sum(axis=1), pa.float64()))
            .append_column("tail", pa.array(tail, pa.float64()))
            .append_column("selected", pa.array(tail >= shared.value.cut, pa.bool_()))
        )

    return by_batch(docs, run, docs.withColumns({"expected_grade": F.lit(0.0), "tail": F.lit(0.0), "selected": F.lit(True)}).schema)
