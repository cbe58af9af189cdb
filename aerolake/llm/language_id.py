"""Language identification by nearest centroid.

A text is the vector of its hashed byte n-grams: ``log(1 + count) * idf``, of length 1.
Each language has several centroids, found by spherical k-means over its own texts. A
text gets the language of the centroid with the largest cosine. ``rejected`` marks a
text farther from its centroid than all but ``reject_share`` of the centroid's own texts.

The model is fitted on at most about ``docs_per_lang`` different texts of each language, chosen by
a hash among those with a letter, each taken once however many copies it has; every text is scored whole. Null texts and texts without a letter are ``und``,
with score 0. Rows without a language are not learned from. Without any labelled row
all texts are ``und``. Of equally near centroids the first in order of languages wins; repeated rows get the same result each; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import HAS_LETTER, LETTER, by_batch, on_workers, unit
from aerolake.plans.joins import join_dimension, settle

BITS = 12
#: Digits and punctuation of ASCII count as a space.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def grams(raw: bytes, bits: int = BITS) -> np.ndarray:
    """Counts of hashed byte pairs and triples."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    pair = x[:-1] | (x[1:] << np.uint32(8))
    triple = pair[:-1] | (x[2:] << np.uint32(16))
    shift = np.uint32(32 - bits)
    codes = np.concatenate([((pair + np.uint32(1)) * np.uint32(0x9E3779B1)) >> shift, ((triple ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)) >> shift])
    return np.bincount(codes, minlength=1 << bits)


def counts_of(text: str | None) -> np.ndarray | None:
    if not text or not HAS_LETTER.search(text):
        return None
    return grams(b" " + text.lower().encode("utf-8", "replace").translate(LETTERS) + b" ")


@dataclass
class LanguageModel:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    reach: np.ndarray  # smallest usual cosine of each centroid
    idf: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts, dtype=np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None], step: int = 128) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, for each whole text."""
        langs, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for start in range(0, len(texts), step):
            found = [(i, c) for i in range(start, min(start + step, len(texts))) if (c := counts_of(texts[i])) is not None]
            if not found or not self.langs:
                continue
            cosine = self.vectors(np.array([c for _, c in found], np.float32)) @ self.centroids.T
            best = cosine.argmax(axis=1)
            for (i, _), j, row in zip(found, best, cosine, strict=True):
                langs[i], scores[i], rejected[i] = self.langs[j], min(max(float(row[j]), 0.0), 1.0), row[j] < self.reach[j]
        return langs, scores, rejected


def clusters(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; centroids of length 1 and the cluster of each row."""
    rng = np.random.default_rng(seed)
    centers = x[[int(rng.integers(len(x)))]]
    while len(centers) < min(k, len(x)):  # far rows are likelier to start a cluster
        far = np.maximum(1 - (x @ centers.T).max(axis=1), 0).astype(float) ** 2
        if far.sum() <= 1e-9:
            break
        centers = np.concatenate([centers, x[[int(rng.choice(len(x), p=far / far.sum()))]]])
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        for j in range(len(centers)):
            if (own == j).any():
                c = x[own == j].mean(axis=0)
                centers[j] = c / max(np.linalg.norm(c), 1e-9)
    return centers, (x @ centers.T).argmax(axis=1)


def fit(docs: DataFrame, docs_per_lang: int = 1500, per_lang: int = 4, reject_share: float = 0.01) -> LanguageModel:
    """Learns from the columns ``text`` and ``lang`` of all rows of ``docs``; the number of languages bounds what the driver gets."""
    on_workers(docs.sparkSession)
    labelled = docs.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    # Copies count once: the rate comes from the different texts, and only the chosen ones are compared.
    different = labelled.select("lang", F.xxhash64("text").alias("of")).distinct()
    rate = settle(different.groupBy("lang").agg((F.lit(float(docs_per_lang)) / F.count("*")).alias("rate")), "language-rates")
    chosen = join_dimension(labelled, rate, ["lang"], how="inner").filter(unit(F.col("text")) < F.col("rate")).select("text", "lang").distinct()

    def sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, at, n = [], [], []
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if (c := counts_of(text)) is not None:
                langs.append(lang)
                at.append(np.flatnonzero(c).astype(np.int32))
                n.append(c[at[-1]].astype(np.float32))
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["lang", "at", "n"])

    sample = settle(by_batch(chosen, sparse, "lang string, at array<int>, n array<float>"), "language-sample")
    size = sample.count()
    if not size:
        return LanguageModel([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0), np.ones(1 << BITS, np.float32))
    idf = np.full(1 << BITS, np.log(1 + size), np.float32)
    for at, n in sample.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # a row per hash bucket at most
        idf[at] = np.log((1 + size) / (1 + n)) + 0.1

    def centroids(part: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(part), 1 << BITS), np.float32)
        for row, (at, n) in enumerate(zip(part["at"], part["n"], strict=True)):
            x[row, at] = np.log1p(n)
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        centers, own = clusters(x, per_lang)
        near = (x * centers[own]).sum(axis=1)
        reach = [float(np.quantile(near[own == j], reject_share)) if (own == j).any() else 1.0 for j in range(len(centers))]
        return pd.DataFrame({"lang": part["lang"].iloc[0], "center": list(centers), "reach": reach})

    found = sample.groupBy("lang").applyInPandas(centroids, "lang string, center array<float>, reach double").orderBy("lang", "center").collect()
    return LanguageModel([r.lang for r in found], np.array([r.center for r in found], np.float32), np.array([r.reach for r in found]), idf)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (``text`` is read) with ``lang_pred``, ``lang_score`` and ``lang_rejected``; columns of these names are replaced."""
    added = ["lang_pred", "lang_score", "lang_rejected"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one centroid of fixed size for each cluster of a language

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores, rejected = shared.value.predict(batch.column("text").to_pylist())
        for name, values in zip(added, (pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())), strict=True):
            batch = batch.append_column(name, values)
        return batch

    schema = docs.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0), "lang_rejected": F.lit(True)}).schema
    return by_batch(docs, score, schema)


