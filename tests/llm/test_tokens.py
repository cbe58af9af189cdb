"""Token ids, token files and packing: equality with the library, round trips, brute force."""

import json
import random
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerolake.llm import common, packing, tokenfiles, tokens
from aerolake.llm.queries import QUERIES

PARTS = [
    "a", "foo", "Bar", "Straße", " ", "  ", "\n", "\n\n", " \n", "\t", "'", "'s", "'re", "!", "..", ",", "é", "1", "²", "\xa0", "\x85", "\x1c", "　", "​", "᠎",
    "日本", "<|endoftext|>", "\r\n", "\x00", "\x0b", "😀", "ſ", " '", "_", "Ǆ", "ʼ",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return t


def test_ids_equal_those_of_the_library(library, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    encoder = tokens.Encoder(tokens.vocabulary_path())
    monkeypatch.setattr(tokens, "STORE", 3000)
    monkeypatch.setattr(tokens, "CALL", 5000)
    for got, want in zip(encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids
    assert [x.tolist() for x in encoder.encode([None, "", "a b"])] == [[], [], library.encode("a b").ids]


def test_ids_of_documents(spark, sf_dir, library):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for got, want in zip(tokens.Encoder.of(tokens.vocabulary_path()).encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_shard_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 500, 40)
    docs = [np.concatenate([phrase, rng.integers(0, 500, rng.integers(0, 30)), phrase, [7] * rng.integers(0, 9)]).astype(np.uint32) for _ in range(200)]
    docs += [np.zeros(0, np.uint32), np.full(1001, 9, np.uint32), np.array([499], np.uint32)]
    raw = tokenfiles.pack(docs, 500, least=4)
    shard = tokenfiles.Shard(raw)
    assert len(shard.rules) and len(shard.symbols) < 0.5 * sum(map(len, docs)) and shard.tokens == sum(map(len, docs))
    for i, d in enumerate(docs):
        assert (shard.document(i) == d).all() and len(shard.document(i)) == len(d)
    for i, at in ((0, 0), (5, 41), (201, 1000), (202, 0), (17, len(docs[17]) - 1)):
        assert shard.token(i, at) == docs[i][at]
    assert (shard.token_ends == np.cumsum([len(d) for d in docs])).all()
    for k, (a, b) in enumerate(shard.rules.tolist()):
        assert shard.lengths[k] == sum(shard.lengths[x - 500] if x >= 500 else 1 for x in (a, b))
    assert tokenfiles.Shard(tokenfiles.pack([], 500)).docs == 0
    with pytest.raises(ValueError):
        tokenfiles.Shard(b"ABCD" + raw[4:])


def test_no_rule_crosses_a_document():
    docs = [np.array([1, 2], np.uint32)] * 100
    shard = tokenfiles.Shard(tokenfiles.pack(docs, 10, least=2))
    assert shard.rules.tolist() == [[1, 2]] and (shard.ends == np.arange(1, 101)).all()


def expected(texts, library, end):
    return [[*e.ids, end] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_file_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op5_token_files"](spark, sf_dir).collect()}
    start = 0
    for d, ids in zip(docs, expected([d.text for d in docs], library, 2), strict=True):
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_file_edges(spark, library):
    long = "wort und " * 40_000
    rows = [(3, long), (1, None), (2, ""), (5, "a b"), (5, "a b"), (None, "first")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.lit(1)).withColumn("part", F.lit(1))
    got = sorted(map(tuple, tokenfiles.read(tokenfiles.write(docs, shard_tokens=50)).collect()), key=lambda r: r[1])
    order = [(None, "first"), (1, None), (2, ""), (3, long), (5, "a b"), (5, "a b")]
    start = 0
    for r, (doc_id, _), ids in zip(got, order, expected([t for _, t in order], library, 2), strict=True):
        assert r == (doc_id, start, len(ids), crc(ids))
        start += len(ids)
    assert tokenfiles.read(tokenfiles.write(docs.limit(0))).count() == 0


def test_differencing_beats_or_equals_the_trivial_bounds():
    rng = np.random.default_rng(4)
    for n, k in ((1, 1), (5, 2), (40, 7), (300, 30), (7, 7)):
        sizes = rng.integers(1, 513, n)
        window = packing.partition(sizes, k)
        sums = np.bincount(window, weights=sizes, minlength=k)
        assert sums.sum() == sizes.sum() and len(sums) == k
        if n > 5 * k:
            assert sums.max() - sums.min() <= sizes.min() + 20
    # 8,7,6,5,4 in two windows: differencing gives 16 and 14.
    assert sorted(np.bincount(packing.partition(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_window_count_rises_until_all_fit():
    sizes = np.array([1500] * 7 + [600])
    window = packing.windows(sizes)
    assert np.bincount(window, weights=sizes).max() <= 2048
    assert len(packing.windows(np.zeros(0, np.int64))) == 0


def check_pieces(got, want):
    cover = {}
    for r in got:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc_id, ids in want.items():
        spans = sorted(cover[doc_id])
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) == len(ids)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return by_sequence


def test_texts_without_a_plain_piece_and_a_store_that_is_thinned_out(library, monkeypatch):
    encoder = tokens.Encoder(tokens.vocabulary_path())
    for text in (" \n\t", "\n", " ", "  \x00"):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(tokens, "STORE", 40)
    rng = random.Random(8)
    for _ in range(60):
        texts = [" ".join(rng.choice(["often", "seen", f"w{rng.randrange(10**6)},", "été", " \t x"]) for _ in range(20)) for _ in range(3)]
        for got, want in zip(encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert got.tolist() == want.ids
        assert len(encoder.place) < 40 + 70
    assert "often" in encoder.place


def test_known_short_pieces_are_found_without_text_and_words_are_kept_without_their_signs(library, monkeypatch):
    encoder = tokens.Encoder(tokens.vocabulary_path())
    long = "abcdefghijklmnopqrstuvw"
    texts = [" ".join(long[:n] + end for n in range(1, 24) for end in ("", ",", "é", "!?")), "see Xylander, 12345678 1234567 é\x00 12345678z", "ab\ncd  ef", "x"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert "Xylander" in encoder.place
    known = [" ".join(p for p in t.split(" ") if len(p.encode()) <= 16) for t in texts[:2]]
    known = [t.replace("\x00", "") for t in known if t]
    want = [e.ids for e in library.encode_batch(known, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(known)] == want
    monkeypatch.setattr(encoder, "_places", lambda pieces: pytest.fail(f"looked up as text: {pieces}"))
    assert [x.tolist() for x in encoder.encode(known)] == want


def test_new_words_are_read_many_at_once_and_apart_from_their_signs(library, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéßſǄžÀɏ") for _ in range(rng.randrange(1, 8))) for _ in range(3000)]
    texts = ["x " + " ".join(w + rng.choice(["", ",", ".)", "!!!", "'s", "-" + w]) for w in words[i : i + 100]) + "\nEnd" for i in range(0, 3000, 100)]
    encoder = tokens.Encoder(tokens.vocabulary_path())
    monkeypatch.setattr(tokens, "_WORDS", 64)
    looked_up, places = [], encoder._places
    monkeypatch.setattr(encoder, "_places", lambda pieces: looked_up.extend(pieces) or places(pieces))
    for got, want in zip(encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids
    # What is left are signs, words after a hyphen and the first word of a text.
    assert not [p for p in looked_up if p.isalpha() and len(p.encode()) <= 16] and {"\udc00,", "\udc00.)"} <= set(looked_up)
    assert {w for w in words if len(w.encode()) <= 15} <= set(encoder.place)


def test_pieces_are_cut_where_the_rule_starts_anew(library, monkeypatch):
    ends = ["a", "Z", "9", "é", "ſ", "ɏ", "ɿ", "ʯ", "×", "÷", "ª", "µ", "²", "e\u0301", "Ж", "日", "…", "—", "\xa0", "\u200b", "_", "'", "😀", "\x01"]
    signs = [".", "'", "'t", "'S", "'s'", "!?", "-x", "...'re", "_a_", "<|", "'ll.", "''d", "$1", "\u2019s"]
    texts = [f"{lead}{a}{b}{c}" for lead in ("", "w ", "w\n") for a in ends for b in signs for c in ("", " z", "é", "1", "\ny")]
    texts += ["×× ÷÷ a× b÷ ×c ÷d À× ×.", "\n×", "a\n\nb\n×c\né"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for joins in (True, False):
        encoder = tokens.Encoder(tokens.vocabulary_path())
        assert encoder.joins
        encoder.joins = joins
        for _ in range(2):
            assert [x.tolist() for x in encoder.encode(texts)] == want


def test_words_are_read_one_by_one_where_a_token_reaches_into_the_next(tmp_path):
    library = Tokenizer.from_file(tokens.vocabulary_path())
    spec = json.loads(library.to_str())
    spec["model"]["vocab"]["aĠ"] = max(spec["model"]["vocab"].values()) + 1
    spec["model"]["merges"].insert(0, ["a", "Ġ"])
    path = tmp_path / "crossing.json"
    path.write_text(json.dumps(spec))
    library, encoder = Tokenizer.from_file(str(path)), tokens.Encoder(str(path), plain_specials=False)
    texts = ["x la banana panda la", "x banana, la\npizza la pasta"]
    assert not encoder.joins and encoder.by_bytes
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_table_of_few_slots_finds_every_piece(library):
    encoder = tokens.Encoder(tokens.vocabulary_path())
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(4000)) for _ in range(20)]
    for _ in range(2):
        for got, want in zip(encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert got.tolist() == want.ids
    places = np.flatnonzero(encoder.bytes)
    encoder.table_bits = int(2 * len(places)).bit_length() - 1  # nearly full
    encoder.table = np.full(1 << encoder.table_bits, -1, np.int32)
    encoder._enter(places)
    found = encoder._find(encoder.first[places], encoder.last[places], encoder.bytes[places], tokens.mixed(encoder.first[places], encoder.last[places], encoder.bytes[places].astype(np.uint64)))
    assert (found == places).all()


def test_packing_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], expected([d.text for d in docs], library, 1), strict=True))
    sequences = check_pieces(QUERIES["op7_packing"](spark, sf_dir).collect(), want)
    held = sum(n for p in sequences.values() for _, n in p)
    assert 1 - held / (2048 * len(sequences)) < 0.03


def test_packing_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "wort und " * 40_000), (4, "a b"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("offset", F.lit(1)).withColumn("start", F.lit("x"))
    want = dict(zip([r[0] for r in rows], expected([r[1] for r in rows], library, 1), strict=True))
    check_pieces(packing.pack(docs).collect(), want)
    twice = packing.pack(docs.unionByName(docs)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n == 2 * len(want[r.doc_id]) for r in twice)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_with_a_limited_store_leaves_no_encoder_in_the_workers(spark, tmp_path):
    path = str(tmp_path / "vocabulary.json")
    shutil.copy(tokens.vocabulary_path(), path)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words and"), "id").alias("text")).repartition(8)
    assert packing.cut(docs, path, store=50).count() == 40

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(path in tokens.Encoder._known)], pa.int64())], ["n"])

    assert spark.range(0, 64, 1, 32).mapInArrow(held, "n bigint").agg(F.sum("n")).first()[0] == 0


def test_packing_with_a_limited_store_sends_few_rows_at_once(spark, library):
    before = spark.conf.get(common.BATCH_ROWS)

    def told(batches):
        for b in batches:  # each text says how many rows came together
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(["a " * b.num_rows] * b.num_rows)], ["doc_id", "text"])

    docs = spark.range(0, 1000, 1, 1).mapInArrow(told, "doc_id bigint, text string")
    rows = packing.pack(docs, store=50).groupBy("doc_id").agg(F.max("doc_tokens").alias("n"), F.sum("length").alias("all")).collect()
    sizes = [len(x) for x in expected(["a " * packing.ROWS, "a " * (1000 % packing.ROWS)], library, 1)]
    assert len(rows) == 1000 and {r.n for r in rows} == set(sizes) and all(r.all == r.n for r in rows)
    assert spark.conf.get(common.BATCH_ROWS) == before
    with pytest.raises(ZeroDivisionError), common.small_batches(spark, 7):
        assert spark.conf.get(common.BATCH_ROWS) == "7"
        raise ZeroDivisionError
    assert spark.conf.get(common.BATCH_ROWS) == before


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\ny z", "<|endoftext| >", " <|endoftext|><|endoftext|>  end"]


def test_special_tokens_as_the_unmodified_library(spark):
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    rng = random.Random(6)
    texts = SPECIAL + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(5000)]
    for got, want in zip(tokens.Encoder.of(tokens.vocabulary_path()).encode(texts), plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id bigint, text string")
    start = 0
    for r, ids in zip(sorted(tokenfiles.read(tokenfiles.write(docs)).collect(), key=lambda r: r.doc_id), expected(SPECIAL, plain, 2), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    check_pieces(packing.pack(docs).collect(), dict(enumerate(expected(SPECIAL, plain, 1))))
