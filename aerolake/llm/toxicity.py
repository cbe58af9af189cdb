"""Toxicity: a convolutional text classifier.

Words are hashed to embeddings, each the sum of the word's own and of those of its
beginnings of four to six bytes, so that rare forms of a stem are known; filters one, two
and three words wide run over the whole text, each filter's largest value enters a logistic output. The embeddings start with
the log odds of the bucket in the toxic class in one place, so that filters of
width one begin as a word list learned from the labels; everything is then trained with
Adagrad in numpy on a bounded sample of labelled rows.

The logit at which a text counts as toxic is calibrated for each language as predicted
from the text (``language_id``) and moved to 0.7: ``score = sigmoid(logit - threshold
+ logit(0.7))``. The thresholds come from all labelled rows that the net was not trained on, counted
by language, logit and label. A language with few labelled texts uses the threshold of all.

Null, empty and wordless texts get the share of toxic labels as their score, at most 0.5. Texts of any length are read whole. Rows without a label are not learned
from; without any toxic or any clean label every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import by_batch, give_back, labelled_sample, unit, word_buckets
from aerolake.llm.language_id import LanguageModel

BITS, DIM, FILTERS, WIDTHS, PREFIXES = 16, 8, 8, (1, 2, 3), (4, 5, 6)
CUT = 0.7
CUT_LOGIT = float(np.log(CUT / (1 - CUT)))
#: Words of a text that enter the filters at once.
CHUNK = 4096
#: Type that holds a bucket, as the driver gets it.
SENT = np.uint16
#: Of the hash of ids that draws the sample.
SEED = 11
#: Logits are counted in bins of 1 / BINS, from -FAR to FAR.
BINS, FAR = 64, 64


@dataclass
class Net:
    embed: np.ndarray  # bucket, dim
    filters: list[np.ndarray]  # for each width: width, dim, filters
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    tables: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def ready(self) -> None:
        """Every bucket's part in every filter, so that a text is scored by look-ups and sums."""
        self.tables = np.concatenate([self.embed @ w for f in self.filters for w in f], axis=1)

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """The largest value of every filter over the whole text; 0 where the text is too short."""
        best = np.zeros(FILTERS * len(WIDTHS), np.float32)
        reach = max(WIDTHS) - 1
        for start in range(0, len(ids), CHUNK):
            part = self.tables[ids[start : start + CHUNK + reach]].sum(axis=1)
            at = 0
            for k, (width, b) in enumerate(zip(WIDTHS, self.bias, strict=True)):
                n = len(part) - width + 1
                if n > 0:
                    conv = part[:n, at : at + FILTERS].copy()
                    for j in range(1, width):
                        conv += part[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
                    here = best[k * FILTERS : (k + 1) * FILTERS]
                    np.maximum(here, conv.max(axis=0) + b, out=here)
                at += width * FILTERS
        return best

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids) @ self.out + self.out_bias)


def train(texts: list[np.ndarray], labels: np.ndarray, rounds: int = 4, rate: float = 0.05, seed: int = 5) -> Net:
    """Fits the net to texts as bucket ids; 0/1 labels, classes weighed evenly."""
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, 1 << BITS))
    for ids, y in zip(texts, labels, strict=True):
        seen[int(y), np.unique(ids)] += 1
    n = np.bincount(labels.astype(int), minlength=2)[:, None]
    share = (seen + 3 * n / n.sum()) / n
    embed = rng.normal(0, 0.02, (1 << BITS, DIM)).astype(np.float32)
    embed[:, 0] = np.clip(np.log(share[1] / share[0]), -4, 4) / 4
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :2] += 1.0 / len(f)
    net = Net(embed, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    for k in range(len(WIDTHS)):
        net.out[k * FILTERS : k * FILTERS + 2] = 1.0
    g_embed, g_filters = np.full(1 << BITS, 0.1, np.float32), [np.full_like(f, 0.1) for f in filters]
    g_bias, g_out, g_ob = [np.full_like(b, 0.1) for b in net.bias], np.full_like(net.out, 0.1), 0.1
    weight = len(labels) / (2 * np.bincount(labels.astype(int), minlength=2))
    for _ in range(rounds):
        for i in rng.permutation(len(texts)):
            ids, y = texts[i], int(labels[i])
            x = net.embed[ids].sum(axis=1)
            pooled, where = np.zeros_like(net.out), []
            for k, w in enumerate(WIDTHS):
                n = len(ids) - w + 1
                if n <= 0:
                    where.append(None)
                    continue
                conv = sum(x[j : j + n] @ net.filters[k][j] for j in range(w)) + net.bias[k]
                top = conv.argmax(axis=0)
                pooled[k * FILTERS : (k + 1) * FILTERS] = np.maximum(conv[top, np.arange(FILTERS)], 0)
                where.append(top)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -30, 30)))
            d = np.float32((p - y) * weight[y])
            if abs(d) < 1e-3:
                continue
            d_pool = d * net.out * (pooled > 0)
            g_out += (d * pooled) ** 2
            net.out -= rate * d * pooled / np.sqrt(g_out)
            g_ob += d * d
            net.out_bias -= float(rate * d / np.sqrt(g_ob))
            for k, w in enumerate(WIDTHS):
                if where[k] is None:
                    continue
                dk = d_pool[k * FILTERS : (k + 1) * FILTERS]
                g_bias[k] += dk * dk
                net.bias[k] -= rate * dk / np.sqrt(g_bias[k])
                for j in range(w):
                    at = where[k] + j
                    step = x[at].T * dk  # dim, filters
                    back = net.filters[k][j].T * dk[:, None]  # filters, dim
                    g_filters[k][j] += step * step
                    net.filters[k][j] -= rate * step / np.sqrt(g_filters[k][j])
                    rows = ids[at]  # filters, buckets of the word
                    np.add.at(g_embed, rows, (back * back).mean(axis=1)[:, None])
                    np.subtract.at(net.embed, rows, rate * back[:, None, :] / np.sqrt(g_embed[rows])[:, :, None])
    net.ready()
    return net


def threshold(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The logit that parts the classes with the best F1, rows weighed as often as they stand for; halfway to the next value, so that ties fall on one side."""
    order = np.argsort(-logits, kind="stable")
    found = np.cumsum((labels * weight)[order])
    f1 = 2 * found / (np.cumsum(weight[order]) + found[-1])
    last = np.append(logits[order][:-1] != logits[order][1:], True)
    i = int(np.argmax(np.where(last, f1, -1)))
    below = logits[order][i + 1] if i + 1 < len(order) else logits[order][i] - 1
    return float((logits[order][i] + below) / 2)


@dataclass
class ToxicityModel:
    net: Net | None
    languages: LanguageModel
    thresholds: dict[str, float]
    share: float = 0.0  # of toxic labels

    def logits(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, logit and whether there are words, for each whole text."""
        logits, worded = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            ids = word_buckets(text, BITS, PREFIXES)
            logits[i], worded[i] = self.net.logit(ids), len(ids) > 0
        return self.languages.predict(texts)[0], logits, worded

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(texts))
        langs, logits, worded = self.logits(texts)
        usual = self.thresholds[""]
        shifted = logits - np.array([self.thresholds.get(lang, usual) for lang in langs]) + CUT_LOGIT
        return np.where(worded, 1 / (1 + np.exp(-np.clip(shifted, -30, 30))), min(self.share, 0.5))


def counted(docs: DataFrame, marks: DataFrame, model: ToxicityModel) -> pa.Table:
    """Labelled rows with words by predicted language, bin of the logit and label: ``lang``, ``bin``, ``y``, ``n``. Bounded by the languages and bins."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size but for the centroids of languages

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, logits, worded = shared.value.logits(batch.column("text").to_pylist())
        at = np.floor(np.clip(logits, -FAR, FAR) * BINS).astype(np.int32)
        found = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(at, pa.int32())], ["doc_id", "lang", "bin"])
        return found.filter(pa.array(worded))

    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    bins = by_batch(texts, run, f"doc_id {id_type}, lang string, bin int")
    # Repeated ids are counted on both sides before they meet, so that none makes pairs.
    bins = bins.groupBy("doc_id", "lang", "bin").agg(F.count("*").alias("rows"))
    of = marks.groupBy("doc_id", "y").agg(F.count("*").alias("times"))
    return bins.join(of, "doc_id").groupBy("lang", "bin", "y").agg(F.sum(F.col("rows") * F.col("times")).alias("n")).toArrow()


def fit(docs: DataFrame, labels: DataFrame, languages: LanguageModel, max_rows: int = 6000, calibrate: float = 0.4, min_rows: int = 60) -> ToxicityModel:
    """Learns from ``doc_id``, ``text`` of ``docs`` and ``doc_id``, ``toxic`` (0 or 1) of at most about ``max_rows`` labels, half of them toxic where there are as many.

    A share of ``calibrate`` of them is kept from training; these and all labelled rows beyond the sample set the
    thresholds, a language's own where it has ``min_rows`` of either label. The driver gets the
    rows of the sample as bucket ids, and counts by language and bin.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    found = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return ToxicityModel(None, languages, {"": 0.0})
    keep = {y: min(1.0, max_rows / 2 / n) for y, n in found.items()}

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [word_buckets(t, BITS, PREFIXES).astype(SENT).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch.column("y"), batch.column("u")], ["ids", "y", "u"])

    sample = labelled_sample(docs, marks, keep, SEED)
    got = by_batch(sample, encode, "ids binary, y int, u double").toArrow()
    order = pc.sort_indices(got, [("u", "ascending"), ("y", "ascending"), ("ids", "ascending")]).to_numpy()
    texts = [np.frombuffer(got["ids"][int(i)].as_buffer(), SENT).reshape(-1, 1 + len(PREFIXES)) for i in order]
    y, drawn = got["y"].to_numpy()[order].astype(float), got["u"].to_numpy()[order]
    if len(np.unique(y)) < 2:
        return ToxicityModel(None, languages, {"": 0.0})
    held = drawn < calibrate
    apart = all(len(np.unique(y[m])) == 2 for m in (held, ~held))
    if not apart:
        held = np.zeros(len(y), bool)
    net = train([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
    del texts, got  # the driver keeps the net only
    give_back()
    model = ToxicityModel(net, languages, {"": 0.0}, found[1] / sum(found.values()))
    stands_for = {0: 1.0, 1: 1.0}
    if apart:
        rate = F.when(F.col("y") == 1, F.lit(keep[1])).otherwise(F.lit(keep[0]))
        u = unit(F.lit(SEED), F.col("doc_id")) / rate
        marks = marks.filter((u < calibrate) | (u >= 1))
        stands_for = {k: 1 / (1 - (1 - calibrate) * r) for k, r in keep.items()}
    counts = counted(docs, marks, model)
    langs, truth, n = np.array(counts["lang"].to_pylist(), object), counts["y"].to_numpy().astype(float), counts["n"].to_numpy()
    middle = (counts["bin"].to_numpy() + 0.5) / BINS  # halfway between two neighbours is the border of their bins
    weight = n * np.where(truth == 1, stands_for[1], stands_for[0])
    if n[truth == 1].sum():
        model.thresholds[""] = threshold(middle, truth, weight)
    for lang in np.unique(langs.astype(str)):
        of = langs == lang
        if lang != "und" and min(n[of & (truth == k)].sum() for k in (0, 1)) >= min_rows:
            model.thresholds[str(lang)] = threshold(middle[of], truth[of], weight[of])
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` (``text`` is read) with ``toxicity`` (0 to 1) and ``is_toxic``; columns of these names are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("toxicity", "is_toxic")])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size but for the centroids of languages

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores(batch.column("text").to_pylist())
        return batch.append_column("toxicity", pa.array(scores, pa.float64())).append_column("is_toxic", pa.array(scores >= CUT, pa.bool_()))

    return by_batch(docs, run, docs.withColumns({"toxicity": F.lit(0.0), "is_toxic": F.lit(True)}).schema)
