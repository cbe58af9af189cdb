"""The corpus pipeline: every stage against a plain version of its own input, and rows that hold nothing."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from aerolake.llm import secret_scan, tokens
from aerolake.llm.common import words_of
from aerolake.plans.joins import settle
from tests.llm.brute import components


@pytest.fixture(scope="module")
def sf_dir():
    """Enough labels to learn from; the smallest tables have a dozen."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of every stage over odd rows beside the given ones; the input has an extra column that is named like a result."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [
        (None, "a text without an id", "en", "web"), (-1, None, "en", None), (-2, "", None, "web"), (-3, " \n\t", "de", "web"),
        (-4, "word and other words " * 20_000, "en", "web"), (-5, "twice the same text stands here", "en", "x"), (-5, "twice the same text stands here", "en", "x"),
        (-6, "one id with a first text of some words", "en", "x"), (-6, "and one id with a second and very different one", "en", "x"),
    ]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = settle(given.unionByName(odd).withColumns({"spans": F.lit("mine"), "taken": F.lit(7)}), "odd-documents")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, sf_dir), f"test-{name}")
        found[name] = (docs, out)
        docs = out
    return found


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_columns_stay_up_to_the_last_stage(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert set(before.columns) - {"taken"} <= set(after.columns), name


def test_toxicity_removes_whole_rows_only(spark, sf_dir, stages):
    before, after = stages["toxicity"]
    gone = rows_of(before, "doc_id", "text")
    gone.subtract(rows_of(after, "doc_id", "text"))
    assert min(gone.values()) >= 0
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0").collect()}
    ids = {i for (i, _), n in gone.items() if n}
    assert len(ids & clean) <= 0.1 * len(clean) and (not toxic or len(ids & toxic) >= 0.5 * len(toxic))
    assert rows_of(after.filter("text IS NULL OR trim(text) = ''"), "doc_id") == rows_of(before.filter("text IS NULL OR trim(text) = ''"), "doc_id")


def test_near_duplicates_leave_one_of_each_component(stages):
    before, after = stages["near_duplicates"]
    rows = list(dict.fromkeys((r.doc_id, r.text) for r in before.collect()))
    # Every different text is judged by itself: a number for each, in order of ids.
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    group = components([(k, rows[i][1]) for k, i in enumerate(order)])
    want = Counter(rows[i] for k, i in enumerate(order) if group[k][2] or rows[i][0] is None)
    got = rows_of(after, "doc_id", "text")
    assert Counter(i for i, _ in got.elements()) == Counter(i for i, _ in want.elements())
    assert {(i, t) for i, t in got if i in (-5, -6)} == {(i, t) for i, t in rows if i in (-5, -6)} and got[(-5, "twice the same text stands here")] == 1


def test_secrets_are_replaced_and_nothing_else(stages):
    before, after = stages["secrets"]

    def clean(text):
        if text is None:
            return None
        out, at = [], 0
        for start, end in merged(sorted((s, e) for _, s, e in secret_scan.spans(text))):
            out += [text[at:start], "[SECRET]"]
            at = end
        return "".join([*out, text[at:]])

    def merged(spans):
        found = []
        for s, e in spans:
            if found and s < found[-1][1]:
                found[-1] = (found[-1][0], max(e, found[-1][1]))
            else:
                found.append((s, e))
        return found

    assert rows_of(after, "doc_id", "text") == Counter((r.doc_id, clean(r.text)) for r in before.collect())


def test_mixing_takes_whole_rows_at_most_three_times(stages):
    before, after = stages["mixing"]
    had, got = rows_of(before, "doc_id", "text", "source"), rows_of(after, "doc_id", "text", "source")
    assert all(n <= 3 * had[k] for k, n in got.items())
    assert all(got[k] == n for k, n in had.items() if not words_of(k[1]))
    words = Counter()
    for (_, text, _), n in had.items():
        words["before"] += n * len(words_of(text))
    for (_, text, _), n in got.items():
        words["after"] += n * len(words_of(text))
    assert words["after"] <= 1.05 * words["before"] + 20_000


def test_packing_covers_every_id_once(stages):
    before, after = stages["packing"]
    library = Tokenizer.from_file(tokens.vocabulary_path())
    want = Counter()
    for r in before.collect():
        want[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, held = Counter(), Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
        held[r.sequence_id] += r.length
    assert got == want and max(held.values()) <= 2048


def test_near_duplicates_begin_with_a_driver_that_let_go(spark, monkeypatch):
    """Before the stage of the most jobs, memory that earlier stages left in the driver is given back."""
    order = []
    monkeypatch.setattr(corpus_pipeline, "free_driver", lambda spark: order.append("freed"))
    monkeypatch.setattr(corpus_pipeline.near_dup, "dedupe", lambda docs: order.append("dedupe") or docs)
    docs = spark.range(3)
    assert corpus_pipeline.without_near_copies(spark, docs, "") is docs and order == ["freed", "dedupe"]


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"empty-{name}")
        assert docs.count() == 0, name
