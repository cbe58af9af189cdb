"""SimHash links against all pairs, the JVM's hash, and hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake.llm import simhash
from aerolake.llm.queries import QUERIES


def plain_fingerprint(text, words=3):
    import xxhash

    found = (text or "").encode().lower().split()
    grams = [b" ".join(found[i : i + words]) for i in range(max(len(found) - words + 1, 1))] if found else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(values):
    """Value -> smallest connected value, by all pairs at distance two or less."""
    values = sorted(set(values))
    x = np.array(values, np.uint64)
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 2) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    return {v: values[find(i)] for i, v in enumerate(values)}


def expected(rows):
    fp = [(i, plain_fingerprint(t)) for i, t in rows]
    group = groups([f for _, f in fp])
    least = {}
    for i, f in fp:
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(group[f])) for i, f in fp), key=repr)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_documents_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert found(QUERIES["op13_simhash"](spark, sf_dir)) == expected([(d.doc_id, d.text) for d in docs])


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 3000):
        text = "".join(rng.choice("AbcÄ字") * 3 + rng.choice([" ", "\n\t", "\x0b"]) for _ in range(n))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0 and simhash.fingerprint(" \n") == 0


def test_hash_is_that_of_the_jvm(spark):
    value = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert simhash.fingerprint("One two\nTHREE") == value % (1 << 64)


def ball(rng, center, n, most):
    return {center ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(most + 1))) for _ in range(n)}


@pytest.mark.parametrize("limit", [1, 3, 32])
def test_hot_groups_lose_no_link(spark, limit):
    rng = random.Random(7)
    values = ball(rng, 0, 120, 3) | ball(rng, (1 << 64) - 1, 60, 6) | {rng.getrandbits(64) for _ in range(100)}
    half = rng.getrandbits(32)  # one segment in common, the other at random
    values |= {half << 32 | rng.getrandbits(32) for _ in range(80)} | {half << 32 | 1 << k for k in range(0, 32, 3)}
    chain = rng.getrandbits(64)
    for k in range(0, 64, 2):
        values.add(chain)
        chain ^= 3 << k
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    nodes = spark.createDataFrame(signed, "fp bigint").repartition(6)
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(nodes, limit).collect()]
    assert all(a != b and (a ^ b).bit_count() <= 2 for a, b in links)
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert {v: find(v) for v in values} == groups(values)


def test_links_of_a_hot_group_grow_with_it(spark):
    rng = random.Random(3)
    center = rng.getrandbits(63)
    for n in (500, 2000):
        values = ball(rng, center, n, 3)
        count = simhash.links(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")).count()
        assert count < 64 * len(values)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, long), (7, long + " end"), (8, "p q r s"), (8, "p q r s"), (8, "t u v w x"), (None, "a b"), (None, "lone one here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit(1), "component_id": F.lit(2), "first": F.lit(3)})
    assert found(simhash.link(docs)) == expected(rows)
    assert simhash.link(docs.limit(0)).count() == 0


def test_rows_of_a_frequent_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 10)
    rows = [(i, "the same words again and again") for i in range(200, 0, -1)] + [(500 + i, f"text {i} of its own kind {i * 7}") for i in range(30)] + [(900, None)]
    assert found(simhash.link(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))) == expected(rows)
