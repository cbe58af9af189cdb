"""Exact integer k-means against SQL, big integers and a plain version."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerolake.llm import vector_codes as vc
from aerolake.llm.queries import ORACLES, QUERIES
from tests.llm.brute import oracle


def test_matches_sql(spark, sf_dir):
    assert oracle(QUERIES["op12_vector_codes"](spark, sf_dir), sf_dir, ORACLES["op12_vector_codes"]) == ""


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 27), st.integers(0, 10**6))
def test_dot_products_are_exact(length, bits, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(1 << bits), (1 << bits) + 1, (7, length)), rng.integers(-(1 << bits), (1 << bits) + 1, (5, length))
    want = a.astype(object) @ b.T.astype(object)
    for width in (vc.limb_width(length), 3):
        assert all((x == np.rint(x)).all() for x in vc.limbs(a, width))
        assert sum(x.astype(object) * (1 << (width * i)) for i, x in enumerate(vc.limbs(a, width))).tolist() == a.tolist()
        assert (vc.exact_dots(a, vc.limbs(b, width), width).astype(object) == want).all()


def test_limbs_stay_below_the_exact_range():
    for length in (1, 2, 16, 17, 1000, 5000):
        width = vc.limb_width(length)
        assert length * (1 << width) ** 2 < 1 << 53
    big = np.full((1, 16), (1 << 27), np.int64)
    assert len(vc.limbs(big, vc.limb_width(16))) == 2


def plain(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks with Python's integers."""
    rows = [(i, label, [int(np.floor(float(x) * scale)) for x in v]) for i, label, v in rows]
    d = len(rows[0][2])
    bounds = [d * k // parts for k in range(parts + 1)]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0], r[2]))
    books = [[r[2][a:b] for r in ordered[:entries]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def nearest(k, x):
        return min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), j) for j, c in enumerate(books[k]))

    for _ in range(rounds):
        new = [[list(c) for c in b] for b in books]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            at = [nearest(k, r[2][a:b])[1] for r in rows]
            for j in set(at):
                mine = [r[2][a:b] for r, i in zip(rows, at, strict=True) if i == j]
                new[k][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        books = new
    out = []
    for i, label, x in rows:
        found = [nearest(k, x[a:b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
        out.append((i, label, "".join(f"{j:02x}" for _, j in found), sum(e for e, _ in found)))
    return out, hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()


@pytest.mark.parametrize(("size", "dim"), [(0.5, 8), (30_000.0, 10)])
def test_against_plain_integers(spark, size, dim):
    rng = np.random.default_rng(3)
    values = (rng.normal(size=(120, dim)) * size).tolist()
    rows = [(i if i else None, [None, "a", "b"][i % 3], v) for i, v in enumerate(values)] + [(5, "a", values[7]), (5, "a", values[7]), (9, "b", values[3])]
    want, digest = plain(rows, 4, 16, 3, 1024)
    table = spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>").repartition(5)
    got, books = vc.compress(table, entries=16, rounds=3)
    found = got.collect()
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in found), key=repr) == sorted(want, key=repr)
    assert books.sha256() == digest
    sums = {label: sum(e for _, at, _, e in want if at == label) for label in (None, "a", "b")}
    assert all(r.label_error == sums[r.label] for r in found)
    assert len(vc.decode(found[0].code, books)) == dim


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, [1.0, nan, 0.0, 0.0]), (4, [1.0, None, 0.0, 0.0]), (5, [inf, 0.0, 0.0, 0.0]), (6, []), (7, [1.0]),
            (8, [0.0, 0.0, 0.0, 0.0]), (8, [0.0, 0.0, 0.0, 0.0]), (None, [1e300, -1e300, 0.0, -0.0001])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"label": F.lit(None).cast("int"), "x": F.lit(1), "code": F.lit(2), "error": F.lit(3)})
    got, books = vc.compress(table)
    found = got.collect()
    assert sorted(r.vec_id or 0 for r in found) == [0, 1, 8, 8]
    assert all(r.error == 0 and r.label_error == 0 and r.code for r in found)  # every vector is an entry
    assert books.entries[0].tolist() == [[1024], [0], [0], [1 << 27]] and books.entries[3][3].tolist() == [-1]
    assert {r.code for r in found if r.vec_id == 8} == {"01010101"}  # the lower of equal entries
    none, books = vc.compress(table.limit(0))
    assert none.count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
