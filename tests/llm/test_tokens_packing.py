"""Token counts against the library, and packing as an exact round trip."""

import zlib

import numpy as np
import pytest

from ledgerspark.llm import packing, tokens
from ledgerspark.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, n_tokens long, id string, part int"
ROWS = [
    (1, "Hello, it's 2024! <|endoftext|> done", 7, "x", 1),
    (2, None, None, None, None),
    (3, "", 0, "", 0),
    (4, "naïve ÉCOLE straße don't... 'tis we'll X1Y2 ½² a b c\x85d\x1ce", 0, "", 0),
    (4, "naïve ÉCOLE straße don't... 'tis we'll X1Y2 ½² a b c\x85d\x1ce", 0, "", 0),
    (5, "日本語 mixed Ω ΑΣ ΑΣ. İstanbul é K <|STARTOFTEXT|>a<|startoftext|>b", 0, "", 0),
    (None, "word " * 9000, 0, "", 0),
    (7, "a" * 5000 + " " + "é" * 300 + " b.c,d!", 0, "", 0),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_match_the_library(spark, library):
    got = sorted((tuple(r) for r in tokens.token_counts(frame(spark), vocabulary()).collect()), key=str)
    want = []
    for doc_id, text, *_ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)


def test_counts_match_on_a_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, vocabulary()).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == len(library.encode(r.text, add_special_tokens=False).ids)


def test_a_small_cache_changes_nothing(library):
    one = tokens.encoder(vocabulary())
    lookup = tokens.Lookup({b"the": 1}, lambda c: len(one.ids(c)))
    size, tokens.CACHE_SIZE = tokens.CACHE_SIZE, 2
    try:
        assert sum(map(lookup.__getitem__, b"the quick brown fox jumped the quick".split())) == len(
            library.encode("the quick brown fox jumped the quick", add_special_tokens=False).ids
        )
        assert len(lookup) <= 2
    finally:
        tokens.CACHE_SIZE = size


def check_packing(pieces, texts, library, capacity=2048):
    """Every id of every row in one piece, sequences gapless and full but for powers of two."""
    ids = {}
    for key, text in texts:
        ids.setdefault(key, []).append(library.encode(text or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for key, mine in by_doc.items():
        copies = ids[key]
        assert sum(p.length for p in mine) == sum(map(len, copies))
        for p in mine:
            assert any(
                p.doc_tokens == len(c) and zlib.crc32(np.array(c[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
                for c in copies
            )
        if len(copies) == 1:
            at = 0
            for p in sorted(mine, key=lambda p: p.start):
                assert p.start == at and p.length > 0
                at += p.length
    lengths = []
    for mine in by_sequence.values():
        at = 0
        for p in sorted(mine, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and at & (at - 1) == 0
        lengths.append(at)
    return lengths


def test_packing_round_trip(spark, library):
    pieces = packing.pack(frame(spark), vocabulary()).collect()
    check_packing(pieces, [(r[0], r[1]) for r in ROWS], library)


@pytest.mark.parametrize("parts", [1, 9])
def test_packing_a_table(spark, library, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(parts)
    pieces = packing.pack(docs, vocabulary(), open_windows=8).collect()
    lengths = check_packing(pieces, [(r.doc_id, r.text) for r in docs.collect()], library)
    assert sum(n < 2048 for n in lengths) <= 11


def test_empty_tables(spark):
    assert tokens.token_counts(frame(spark, []), vocabulary()).count() == 0
    assert packing.pack(frame(spark, []), vocabulary()).count() == 0
