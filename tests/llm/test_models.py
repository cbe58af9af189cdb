"""Trained operators: held-out accuracy, splits, and rows that hold nothing to learn from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake.llm import language_id, quality, toxicity
from aerolake.llm.common import HAS_LETTER, labelled_sample, spaced, word_buckets, word_ends
from aerolake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LONG = "wort " * 60_000


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, wordless, very long and repeated texts, null ids, and columns named like the results."""
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t", "de"), (4, "12 34 !!", "de"), (5, LONG, None), (6, "a b c", "en"), (6, "a b c", "en"), (None, "x y", "fr")]
    extra = dict.fromkeys(["lang_pred", "Lang_Score", "toxicity", "is_toxic", "tail", "selected", "expected_grade"], F.lit("x"))
    return docs_of(spark, rows).withColumns(extra)


def test_word_ends_and_buckets():
    first, last, size = word_ends(b"ab  abcdefghij c")
    assert size.tolist() == [2, 10, 1]
    assert first[0] == int.from_bytes(b"ab", "little") and first[1] == int.from_bytes(b"abcdefgh", "little")
    assert last[1] == int.from_bytes(b"cdefghij", "little") and last[2] == ord("c")
    a, b = word_buckets("Loweian, x", 16, (5,)), word_buckets("loweisch", 16, (5,))
    assert a.shape == (2, 2) and a[0, 1] == b[0, 1] and a[0, 0] != b[0, 0]
    assert word_buckets(None, 16, (4, 5)).shape == (0, 3)


@pytest.mark.parametrize(("one", "other"), [
    ("abcdefgh" + "X" * 20 + "stuvwxyz", "abcdefgh" + "Y" * 20 + "stuvwxyz"),
    ("abcdefghi" + "x" * 40 + "stuvwxyz", "abcdefghi" + "x" * 19 + "y" + "x" * 20 + "stuvwxyz"),
    ("这是一个没有空格的很长的中文句子需要完整地读取每个字符才行", "这是一个没有空格的很长的中文句牛需要完整地读取每个字符才行"),
    ("ประโยคภาษาไทยที่ยาวมากและไม่มีช่องว่างเลยสักนิดเดียว", "ประโยคภาษาไทยที่ยาวมากและมมีช่องว่างเลยสักนิดเดียว"),
    ("スペースのない長い日本語の文をすべて読む必要がある", "スペースのない長い日本話の文をすべて読む必要がある"),
])
def test_a_character_in_the_middle_of_a_run_counts(one, other):
    assert word_buckets(one, 18).ravel().tolist() != word_buckets(other, 18).ravel().tolist()
    assert [x.tolist() for x in quality.features(one)] != [x.tolist() for x in quality.features(other)]


def test_words_in_scripts_without_spaces():
    inside = set(word_buckets("我们去看大熊猫吧。", 18).ravel().tolist())
    assert set(word_buckets("熊猫", 18).ravel().tolist()) <= inside
    assert word_buckets("un mot«deux»trois", 18).tolist() == word_buckets("un mot deux trois", 18).tolist()
    assert spaced("plain text, as it is") == "plain text, as it is"


def test_letters_are_what_python_takes_for_letters():
    for c in "½²①Ⅷ_1- ":
        assert not HAS_LETTER.search(c)
    for c in "aÄß字ªʼn":
        assert HAS_LETTER.search(c) and c.isalpha()


def test_numbers_alone_have_no_language(spark):
    docs = docs_of(spark, [(i, t, lang) for i, (t, lang) in enumerate([("the text of one", "en"), ("der Text von zwei", "de"), ("½ ² ① Ⅷ", "de")] * 5)])
    got = language_id.identify(docs, language_id.fit(docs)).filter("text LIKE '½%'").select("lang_pred", "lang_score").distinct().collect()
    assert [tuple(r) for r in got] == [("und", 0.0)]


def test_repeated_rows_do_not_make_the_sample_larger(spark):
    docs = spark.range(500).selectExpr("1L AS doc_id", "concat('text ', id) AS text").unionByName(spark.createDataFrame([(2, "other")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 1)], "doc_id bigint, y int")
    got = labelled_sample(docs, labels, {0: 1.0, 1: 1.0}, 3).collect()
    assert sorted(r.y for r in got) == [0, 1] and all(r.text for r in got)


def test_language_held_out_accuracy(spark):
    got = QUERIES["op3_language_id"](spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    m = got.merge(truth, on="doc_id")
    held = m[m.held_out]
    assert len(got) == len(truth) and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark, odd):
    seen = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(seen)
    got = language_id.identify(odd, model).select("doc_id", "lang_pred", "lang_score", "lang_rejected").collect()
    assert len(got) == 8
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert all(r.lang_pred in model.langs and 0 <= r.lang_score <= 1 for r in got if r.doc_id in (5, 6, None))
    far = language_id.identify(docs_of(spark, [(1, "zzzz qqqq xxxx jjjj " * 20, None)]), model).first()
    assert far.lang_rejected
    empty = language_id.fit(seen.limit(0))
    assert language_id.identify(odd, empty).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(seen.limit(0), model).count() == 0


def test_language_does_not_read_labels_when_predicting(spark):
    seen = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(seen)
    plain = language_id.identify(seen, model).select("doc_id", "lang_pred", "lang_score")
    other = language_id.identify(seen.withColumn("lang", F.lit("xx")), model).select("doc_id", "lang_pred", "lang_score")
    assert plain.exceptAll(other).count() == 0


def test_several_centroids_of_length_one():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (50, 4)) for c in np.eye(4)[:3]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centers, own = language_id.clusters(x.astype(np.float32), 3)
    assert np.allclose(np.linalg.norm(centers, axis=1), 1, atol=1e-5) and len(set(own[:50])) == 1 and len(set(own)) == 3


def test_toxicity_finds_stems_and_leaves_clean_texts():
    rng = np.random.default_rng(1)
    common = [f"w{i}" for i in range(300)]

    def text(bad):
        words = rng.choice(common, 200).tolist()
        if bad:
            words[rng.integers(200)] = f"lowei{rng.integers(10**6)}"
        return word_buckets(" ".join(words), toxicity.BITS, toxicity.PREFIXES)

    y = np.arange(400) % 2
    net = toxicity.train([text(b) for b in y], y.astype(float))
    scores = [(net.logit(text(b)), b) for b in y[:100]]
    assert np.mean([(s > 0) == b for s, b in scores]) > 0.95
    long = word_buckets("w1 w2 " * 20_000 + "lowei77", toxicity.BITS, toxicity.PREFIXES)
    assert net.logit(long) > 0  # the last word of a long text counts


def test_threshold_with_ties():
    t = toxicity.threshold(np.array([3.0, 2.0, 2.0, 1.0]), np.array([1.0, 1.0, 0.0, 0.0]), np.ones(4))
    assert 1.0 < t < 2.0 or 2.0 < t < 3.0


def test_toxicity_and_quality_queries(spark):
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    for name, label, least in (("op9_toxicity", "toxic", 0.75), ("op1_quality", "quality", 0.95)):
        got = QUERIES[name](spark, "/root/testdata/sf0.1").toPandas()
        held = got[got.held_out].merge(marks, on="doc_id")
        hits = ((held[label] == 1) & (held.predicted == 1)).sum()
        assert hits / (held[label] == 1).sum() > least and hits / (held.predicted == 1).sum() > 0.9
        assert got.score.between(0, 1).all() and len(got) == 10_000
        if name == "op9_toxicity":
            assert ((got.score >= 0.7) == (got.predicted == 1)).all()
        else:
            assert got.expected_grade.between(0, 3).all()


def test_toxicity_and_quality_edges(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    languages = language_id.fit(docs)
    model = toxicity.fit(docs, marks, languages)
    rows = toxicity.score(odd, model).select("doc_id", "toxicity", "is_toxic").collect()
    assert len(rows) == 8 and not any(r.is_toxic for r in rows if r.doc_id in (1, 2, 3))
    assert len({r.toxicity for r in rows if r.doc_id in (1, 2, 3)}) == 1
    nothing = toxicity.fit(docs, marks.withColumn("toxic", F.lit(0)), languages)
    assert toxicity.score(odd, nothing).filter("toxicity <> 0").count() == 0
    graded = quality.fit(docs, marks.withColumn("grade", F.when(F.col("doc_id") % 7 > 0, F.col("quality"))), grades=2)
    rows = quality.grade(odd, graded, tail_from=1).select("tail", "selected", "expected_grade").collect()
    assert len(rows) == 8 and all(0 <= r.tail <= 1 for r in rows)
    even = quality.fit(docs, marks.limit(0).withColumn("grade", F.lit(1)), grades=4)
    assert not quality.grade(odd, even).filter("selected").count()
    assert quality.grade(odd, even).first().expected_grade == pytest.approx(1.5)
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_ordinal_thresholds_are_ordered_and_grades_follow():
    rng = np.random.default_rng(2)
    texts = [("bad " * g + "good " * (3 - g) + "x " * 3, 3 - g) for g in rng.integers(0, 4, 400)]
    rows = [quality.features(t) for t, _ in texts]
    model = quality.train(rows, np.array([g for _, g in texts]), 4)
    assert (np.diff(model.thetas) > 0).all()
    means = [np.mean([model.at_least(t).sum() for t, g in texts if g == k]) for k in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5
    at, x = quality.features(None)
    assert len(at) == len(x) == 0


def test_threshold_of_a_rare_language_uses_all_its_labels(spark):
    rng = np.random.default_rng(2)
    vocabulary = {"en": [f"the{c}ing" for c in "abcdefghij"], "de": [f"sch{c}ung" for c in "klmnopqrst"]}
    rows, marks = [], []
    for i in range(2000):
        lang, bad = "de" if i % 10 == 0 else "en", i % 3 == 0
        words = rng.choice(vocabulary[lang], 20).tolist() + ["loweiq"] * (bad and rng.random() < 0.9)
        rows.append((i, " ".join(words), lang))
        marks.append((i, int(bad)))
    docs = docs_of(spark, rows)
    languages = language_id.fit(docs)
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, languages, max_rows=200)
    assert {"", "de", "en"} == set(model.thresholds)  # the sample holds about 20 labels of de
    twice = toxicity.counted(docs.unionByName(docs), labels.unionByName(labels).withColumnRenamed("toxic", "y"), model)
    assert sum(twice["n"].to_pylist()) == 4 * 2000
    of = [(t, y) for (i, t, lang), (_, y) in zip(rows, marks, strict=True) if lang == "de"]
    logits, truth = model.logits([t for t, _ in of])[1], np.array([y for _, y in of])
    chosen = logits >= model.thresholds["de"]
    assert 2 * (chosen & (truth == 1)).sum() / (chosen.sum() + truth.sum()) > 0.9


def test_language_of_few_texts_with_many_copies(spark):
    few = {lang: [f"{word} number {'abcdefghij'[i]} of {word} texts" for i in range(2)] for lang, word in (("xa", "kolu"), ("xb", "mira"), ("xc", "tendo"), ("xd", "zuppe"), ("xe", "wrath"))}
    rows = [(i, few[lang][i % 2], lang) for lang in few for i in range(400)]
    rows += [(i, f"plain {i} words of the most common kind {i * 7}", "en") for i in range(400)]
    rows += [(i, "one text " * 20, "en") for i in range(400)]
    model = language_id.fit(docs_of(spark, rows), docs_per_lang=20)
    assert set(model.langs) == {*few, "en"}
    texts = [t for lang in few for t in few[lang]]
    assert model.predict(texts)[0] == [lang for lang in few for _ in few[lang]]
    once = language_id.fit(docs_of(spark, list({(t, lang): (i, t, lang) for i, t, lang in rows}.values())), docs_per_lang=20)
    assert np.allclose(model.idf, once.idf)  # copies change nothing


def test_toxicity_sends_two_bytes_a_bucket_to_the_driver(spark, monkeypatch):
    got = {}
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y: got.update(texts=texts, y=y) or train(texts, y))
    rows = [(i, f"word{i} good and {'bad' if i % 2 else 'fine'}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    toxicity.fit(docs, marks, language_id.LanguageModel([], np.zeros((0, 4096), np.float32), np.zeros(0), np.ones(4096, np.float32)))
    assert sum(t.nbytes for t in got["texts"]) == sum(2 * t.size for t in got["texts"]) > 0
    want = {(tuple(word_buckets(t, toxicity.BITS, toxicity.PREFIXES).ravel().tolist()), i % 2) for i, t in rows}
    assert {(tuple(t.ravel().tolist()), int(b)) for t, b in zip(got["texts"], got["y"], strict=True)} <= want
