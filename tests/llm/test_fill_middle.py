"""Piece tables: SQL, round trips, cuts, and texts that hold nothing to cut."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerolake.llm import fill_middle as fim
from aerolake.llm.queries import ORACLES, QUERIES
from tests.llm.brute import oracle


def test_matches_sql(spark, sf_dir):
    assert oracle(QUERIES["op11_fill_middle"](spark, sf_dir), sf_dir, ORACLES["op11_fill_middle"]) == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<PSM>\n\r é字🦆", max_size=40), st.integers(-(2**63), 2**63 - 1))
def test_output_and_round_trip(text, doc_id):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    parts = ["".join(x) for x in (units[:low], units[low:high], units[high:])]
    n, form, cut, out = fim.arranged(text.encode(), doc_id, 7, 100, 50)
    assert n == len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        assert form == "plain" and out.text() == text.encode()
    else:
        assert form == ("spm" if h[3] % 100 < 50 else "psm")
        assert (cut.chars(0), cut.chars(1)) == (len(parts[0]), len(parts[1]))
        want = "<P>{0}<S>{2}<M>{1}" if form == "psm" else "<S>{2}<P>{0}<M>{1}"
        assert out.text().decode() == want.format(*parts)
        # A table never copies: every descriptor points into the text or the sentinels.
        assert out.buffers[0] == text.encode() and len(out.pieces) == 6
    assert out.sha256() == hashlib.sha256(out.text()).hexdigest()
    back = fim.restored(out.text(), form)
    assert back.text() == text.encode() and back.sha256() == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("form", ["psm", "spm"])
@pytest.mark.parametrize("parts", [("a<P", "b", "<S"), ("<", "<M", "P>"), ("", "", "x"), ("x<S", "", ""), ("", "<", "")])
def test_parts_of_sentinels_at_the_borders(form, parts):
    text = "".join(parts).encode()
    cut = fim.PieceTable.of(text, b"<P><S><M>").split(0, len(parts[0])).split(1, len(parts[1]))
    out = cut.append(*[fim.Piece(1, 3 * k, 3 * k + 3) for k in range(3)]).permuted(fim.ORDERS[form])
    assert fim.restored(out.text(), form).text() == text


def test_pieces():
    table = fim.PieceTable.of(b"abcdef").split(0, 2).split(1, 0)
    assert [bytes(v) for v in table.stream()] == [b"ab", b"", b"cdef"]
    assert table.permuted((2, 0)).text() == b"cdefab"
    order = fim.ORDERS["spm"]
    assert [order[i] for i in fim.inverse(order)] == list(range(6))
    with pytest.raises(ValueError):
        table.split(0, 3)


def test_edges(spark):
    long = "line é\n" * 40_000 + "end"
    rows = [(1, None), (2, ""), (3, "\n"), (4, "no line break"), (5, long), (6, "has <M> in it\n"), (None, "a\nb\n"), (7, "same\ntext"), (7, "same\ntext"), (7, "other\n\n\ntext")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"form": F.lit(1), "output": F.lit(2), "restored": F.lit(3)})
    cut = fim.arrange(docs)
    back = fim.restore(cut.withColumn("restored", F.lit("x")))
    got = back.collect()
    assert back.columns[-2:] == ["_restored", "restored_sha256"] and len(got) == len(rows)
    assert sorted((r.doc_id or 0, r["_restored"]) for r in got) == sorted((i or 0, t or "") for i, t in rows)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[1].n, by_id[1].form, by_id[1].prefix_chars) == (0, "plain", None) and by_id[2].form == by_id[6].form == "plain"
    assert (by_id[3].n, by_id[4].n, by_id[5].n, by_id[None].n) == (1, 1, 40_001, 2)
    assert len({r.output_sha256 for r in got if r.doc_id == 7}) == 2
    assert fim.restore(fim.arrange(docs.limit(0))).count() == 0


def test_shares(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'a\\nb\\nc\\n' AS text")
    counts = dict(map(tuple, fim.arrange(docs, rate=60, spm_share=25).groupBy("form").count().collect()))
    assert abs(counts["plain"] - 1600) < 150 and abs(counts["spm"] - 600) < 100
    other = fim.arrange(docs, seed=8).join(fim.arrange(docs).select("doc_id", F.col("output").alias("o")), "doc_id")
    assert other.filter("output <> o").count() > 2000
