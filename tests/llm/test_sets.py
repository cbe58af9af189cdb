"""Near duplicates, mixing and vector searches against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake.llm import hilbert, mixing, near_dup, topk
from aerolake.llm.common import free_driver, words_of
from aerolake.llm.queries import ORACLES, QUERIES
from aerolake.plans.joins import settle
from tests.llm.brute import components, oracle


def test_components_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = components([(d.doc_id, d.text) for d in docs])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op10_minhash"](spark, sf_dir).collect()}
    assert got == want


def chain_rows():
    """A chain of near copies in which far ends are not alike, exact copies, and texts on the border of similarity."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(60):
        rows.append((1000 + i, " ".join(words)))
        words = words.copy()
        for k in rng.sample(range(150), 2):
            words[k] = f"w{rng.randrange(10**6)}"
    rows += [(10 + i, "Same text here\tonce more") for i in range(5)] + [(20, "same TEXT here once  more")]
    base = [f"v{i}" for i in range(104)]  # 100 shingles
    rows += [(300, " ".join(base)), (301, " ".join(base[:79])), (302, " ".join(base[:78])), (303, " ".join(base + [f"u{i}" for i in range(33)]))]
    return rows


def test_components_of_chains_copies_and_borders(spark):
    rows = chain_rows()
    want = components(rows)
    for block_rows in (256, 12, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.link(spark.createDataFrame(rows, "doc_id bigint, text string"), block_rows).collect()}
        assert got == want


def test_near_dup_edges(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A B"), (6, long), (7, long + " end"), (8, "p q r s t u"), (8, "p q r s t u"), (None, "a b"), (None, "lone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit(1)).withColumn("node", F.lit(2)).withColumn("kept", F.lit("x"))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.link(docs).collect())
    assert got == Counter([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 59_996, 6, True), (7, 59_997, 6, False),
        (8, 2, 8, True), (8, 2, 8, True), (None, 1, None, True), (None, 1, None, True),
    ])
    left = near_dup.dedupe(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 2, 3, 4, 6, 8, None, None])
    assert near_dup.link(docs.limit(0)).count() == 0


def test_different_texts_of_one_id_are_judged_by_themselves(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "p"), (2, a, "p"), (2, b, "p"), (5, c, "p"), (5, b + " more", "p"), (7, c, "q"), (7, c, "r"), (None, a, "p"), (None, a, "p")]
    left = near_dup.dedupe(spark.createDataFrame(rows, "doc_id bigint, text string, text_id string"))
    assert left.columns == ["doc_id", "text", "text_id"]
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, a), (2, b), (5, c), (None, a), (None, a)])


def test_signature_keeps_both_ends_of_each_permutation():
    rng = np.random.default_rng(0)
    table = near_dup.Permutations(bands=200, rows=4)
    assert len(table.odd) * 2 == 800
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1500], rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    x, y = table.signature(a), table.signature(b)
    assert abs((x == y).mean() - 0.6) < 0.06  # 1500 of 2500
    assert table.keys(a).tolist() == table.keys(a[::-1].copy()).tolist()


def test_shingles_are_those_of_the_words():
    assert len(near_dup.shingles("a b c d e f")) == 2 and len(near_dup.shingles("A b")) == 1 and len(near_dup.shingles(None)) == 0
    assert near_dup.shingles("A  b\nc").tolist() == near_dup.shingles("a b c").tolist() != near_dup.shingles("a c b").tolist()
    assert len(near_dup.shingles("x " * 100)) == 1
    assert words_of("Ä\x0bB c") == ["Ä".encode(), "b c".encode()]


def test_components_of_graphs(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    rng.shuffle(edges)
    links = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a bigint, b bigint")
    got = dict(map(tuple, near_dup.components(links).collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert dict(map(tuple, near_dup.components(links, hub=3).collect())) == got
    first = near_dup.relabel(None, links.filter("a < 20"))
    both = dict(map(tuple, near_dup.relabel(first, links.filter("a >= 20")).collect()))
    assert both == got


def test_rounds_let_go_of_what_the_driver_holds(spark, monkeypatch):
    """Every round that joins edges ends with the driver's memory given back, which collects its garbage."""
    freed = []
    monkeypatch.setattr(near_dup, "free_driver", lambda spark: freed.append(1))
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    assert {r.label for r in near_dup.components(chain).collect()} == {0}
    assert len(freed) > 1
    before = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    runs = sum(b.getCollectionCount() for b in before)
    free_driver(spark)
    assert sum(b.getCollectionCount() for b in before) > runs


def test_components_take_few_jobs(spark, monkeypatch):
    """Rounds end when stars are left, and none is made of links that are stars already; shuffled and sent edges give the same."""
    written = []
    monkeypatch.setattr(near_dup, "settle", lambda df, purpose: written.append(purpose) or settle(df, purpose))
    stars = spark.createDataFrame([(i % 7, 100 + i) for i in range(300)], "a bigint, b bigint")
    assert {(r.node, r.label) for r in near_dup.components(stars).collect()} == {(100 + i, i % 7) for i in range(300)} | {(i, i) for i in range(7)}
    assert len(written) <= 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 9)] + [(100 + i, 200 + i) for i in range(9)], "a bigint, b bigint")
    want = {i: 0 for i in range(41)} | {k + i: 100 for i in range(9) for k in (100, 200)}
    for hub, few in ((1000, 50_000), (1000, 0), (2, 0)):
        assert dict(map(tuple, near_dup.components(chain, hub=hub, few=few).collect())) == want
    none = near_dup.components(chain.limit(0))
    assert none.columns == ["node", "label"] and not none.count()


def water(sizes, weights, most):
    """Targets by raising and capping in turn."""
    capped, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in capped]
        share = (total - sum(capped.values())) / sum(weights[s] for s in open_) if open_ else 0
        new = {s: most * sizes[s] for s in open_ if weights[s] * share > most * sizes[s]}
        if not new:
            return capped | {s: weights[s] * share for s in open_}
        capped |= new


def test_mix(spark, sf_dir):
    got = QUERIES["op6_mix_sources"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").toPandas()
    docs["want"] = [len(words_of(t)) for t in docs.text]
    m = got.merge(docs, on="doc_id")
    assert len(m) == len(docs) == len(got) and (m["size"] == m.want).all()
    sizes = m.groupby("source")["size"].sum().to_dict()
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    targets = water(sizes, weights, 3)
    for source, part in m.groupby("source"):
        assert part.target.iloc[0] == pytest.approx(targets[source]) and (part.source_size == sizes[source]).all()
        assert abs(part.taken.sum() - targets[source]) <= part["size"].max()
        assert (part.taken % part["size"].clip(lower=1) == 0).all() and (part.taken <= 3 * part["size"]).all()
    again = QUERIES["op6_mix_sources"](spark, sf_dir).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_certain_copies_and_frequencies(spark):
    """Small documents by the hundred: frequencies meet min(1, factor * words) closely, and a few long ones are certain."""
    sizes = {1: 300, 4: 200, 10: 60, 400: 2}
    rows = [(s * 1000 + i, "w " * n, f"s{s:03}") for s in range(40) for i, n in enumerate(n for n, k in sizes.items() for _ in range(k))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights=(1, 3), slice_rows=30).toPandas()
    got["extra"] = got.taken / got["size"] - got.source.str[1:].astype(int) % 2
    rest = sum(n * k for n, k in sizes.items()) / 2
    factor = (rest - 800) / sum(n * n * k for n, k in sizes.items() if n < 400)
    found = got.groupby("size").extra.mean()
    assert 0 < factor * 10 < 1 and found[400] == 1
    for n in (1, 4, 10):
        assert found[n] == pytest.approx(factor * n, abs=0.03)
    near = got.groupby("source").taken.sum() - got.groupby("source").target.first()
    assert near.abs().max() <= 5  # half a document that may or may not be taken


def test_mix_of_any_slices_comes_near(spark, monkeypatch):
    """Few slices, so that they are cut again and again: the targets are met all the same, and as closely by large slices."""
    rows = [(i, "w " * (i % 23 + 1), "hot" if i % 3 else "cold") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for slices, levels, slice_rows, bound in ((4, 10, 20, 12), (1000, 5, 2000, 1)):
        monkeypatch.setattr(mixing, "SLICES", slices)
        monkeypatch.setattr(mixing, "LEVELS", levels)
        monkeypatch.setattr(mixing, "UNITS", slices**levels)
        got = mixing.mix(docs, weights=(2, 3), slice_rows=slice_rows).toPandas()
        near = got.groupby("source").taken.sum() - got.groupby("source").target.first()
        assert near.abs().max() <= bound and len(got) == 4000


def test_mix_caps_small_sources_and_splits_a_hot_one(spark):
    rows = [(i, "w " * (i % 9 + 1), "hot") for i in range(3000)] + [(5000 + i, "x y", s) for i, s in enumerate(["a", None, "z", "z"])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), slice_rows=100).toPandas()
    sums = got.groupby("source", dropna=False).agg(s=("size", "sum"), t=("target", "first"), taken=("taken", "sum"))
    total = int(got["size"].sum())
    assert sums.loc["a", "t"] == 6 and sums.loc["a", "taken"] == 6 and sums.loc["z", "taken"] == 12
    assert sums.t.sum() == pytest.approx(total) and abs(sums.loc["hot", "taken"] - sums.loc["hot", "t"]) <= 1


def test_inclusion_follows_the_odds():
    assert mixing.fill(10, [4, 4, 4, 2]) == [True, True, False, True]
    assert mixing.fill(3, [2, 5, 1]) == [True, False, True]
    assert mixing.fill(3, [4]) == [True] and mixing.fill(1, [4]) == [False]


def test_mix_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "w " * 60_000, "b"), (4, "x y", None), (4, "x y", None), (None, "q", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("Size", F.lit("s")).withColumn("n", F.lit(1)).withColumn("words", F.lit(2))
    mixed = mixing.mix(docs)
    got = mixed.collect()
    assert len(got) == 6 and sorted(r["size"] for r in got) == [0, 0, 1, 2, 2, 60_000]
    assert all(r.taken <= 3 * r["size"] for r in got)
    copies = mixing.take_copies(mixed)
    assert set(copies.columns) == {"doc_id", "text", "source", "n", "words"}
    assert copies.filter("doc_id IN (1, 2)").count() == 2
    assert mixing.mix(docs.limit(0)).count() == 0


def test_top_k_matches_sql(spark, sf_dir):
    assert oracle(QUERIES["op2_top_k"](spark, sf_dir), sf_dir, ORACLES["op2_top_k"]) == ""


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(8)
    x, q = rng.integers(-50, 50, (200, 6)), rng.integers(-50, 50, (5, 6))
    lists, exact = topk.Lists(x), x @ q.T
    for share in (0.05, 0.3, 0.6, 1.0):
        lists.advance(share)
        low, high = lists.bounds(q.astype(float))
        assert (low <= exact).all() and (high >= exact).all()
    assert (low == exact).all() and (high == exact).all()


def test_reading_stops_early_where_lists_agree():
    x = np.arange(1, 5001)[:, None] * np.ones((1, 4), int)
    found = topk.block_top(np.arange(5000), x, np.array([-1]), np.ones((1, 4), int), 5)
    assert found.vec_id.tolist() == [4999, 4998, 4997, 4996, 4995] and found.depth.max() < 0.3


def test_top_k_with_ties_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (300, 3)) / 4
    got = topk.search(vectors(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)]), F.col("vec_id") % 50 == 0, block_rows=40, query_rows=2).collect()
    ints = np.floor(256 * x).astype(int)
    for q in range(0, 300, 50):
        s = ints @ ints[q]
        best = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert mine == [(k + 1, i, s[i]) for k, i in enumerate(best)]


ODD = [(0, None), (20, [1.0, float("nan")]), (100, [1.0, 2.0]), (40, [float("inf"), 1.0]), (3, [0.0, 0.0]), (5, [2.0, 2.0]), (5, [2.0, 2.0]), (None, [9.0, 9.0]), (7, [1.0]), (9, [])]


def test_vector_edges(spark):
    table = vectors(spark, ODD + [(11, None)]).withColumn("vector", F.lit(1)).withColumn("rank", F.lit(1))
    got = topk.search(table, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == [(100, 1, 5, 6 * 65536), (100, 2, 3, 0)]
    got = hilbert.search(table, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == [(100, 1, 5, 6.0)]
    for search in (topk.search, hilbert.search):
        assert search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
        assert search(table.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_hilbert_keys_visit_neighbours_in_turn():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = hilbert.hilbert_keys(grid, 3)
    path = grid[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_hilbert_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[4000:4400] = x[4000]  # one vector many times
    x = x.astype(np.float32).astype(float)
    got = hilbert.search(vectors(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)]), F.col("vec_id") % 20 == 0, least=64).toPandas()
    hit = 0
    for q, part in got.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(6000), -s)) if i != q][:20]
        hit += len(set(best) & set(part.vec_id))
        part = part.sort_values("rank")
        assert len(part) == 20 and np.allclose(part.score, s[part.vec_id], rtol=0, atol=1e-12) and q not in part.vec_id.tolist()
    assert got.query_id.nunique() == 300 and hit / 6000 >= 0.9


def test_hilbert_recall_of_hot_groups(spark):
    """A third of the rows copies of one vector, a fifth near copies of another: recall by id within each group alone."""
    rng = np.random.default_rng(7)
    n = 6000
    x = rng.normal(size=(n, 32))
    copies, near = rng.permutation(n)[: n // 3], rng.permutation(n)[: n // 5]
    near = np.setdiff1d(near, copies)
    x[near] = x[near[0]] + 0.001 * rng.normal(size=(len(near), 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[copies] = x[copies[0]]
    x = x.astype(np.float32).astype(float)
    two = next(i for i in range(0, n, 20) if i not in copies)  # an id with two vectors
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(two, [float(v) for v in x[copies[0]]])]
    got = hilbert.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, least=64).toPandas()
    for group, least in ((copies, 1.0), (near, 0.9), (np.setdiff1d(np.arange(n), np.concatenate([copies, near])), 0.9)):
        hit, asked = 0, [q for q in group if q % 20 == 0 and q != two]
        for q in asked:
            s = (x * x[q]).sum(axis=1)
            s = np.append(s, (x[copies[0]] * x[q]).sum())
            ids = np.append(np.arange(n), two)
            best = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
            hit += len(set(best) & set(got.vec_id[got.query_id == q]))
        assert len(asked) > 20 and hit / (20 * len(asked)) >= least
    assert two not in got.vec_id[got.query_id == two].tolist() and (got.groupby("query_id").size() == 20).all()
