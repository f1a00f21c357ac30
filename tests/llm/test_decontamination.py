"""Contamination against a scan of every window over every text."""

import random
import re
import time

import pytest

from ledgerspark.llm import decontamination as dec

SCHEMA = "doc_id long, text string, digest string, n_hit int"
WORD = re.compile(dec.WORD)


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=13):
    pairs = []
    for item, text in items:
        words = words_of(text)
        if item is not None and words:
            pairs += [(str(item), words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        index = {}
        for i, w in enumerate(words):
            index.setdefault(w, []).append(i)
        for item, win in pairs:
            for at in index.get(win[0], []):
                if words[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    found.add(item)
        out.append((doc_id, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def check(spark, docs, items):
    docs_df = spark.createDataFrame([(d, t, "z", 1) for d, t in docs], SCHEMA)
    items_df = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, win string")
    got = dec.contamination(docs_df, items_df).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items)
    kept = sorted((r.doc_id for r in dec.decontaminate(docs_df, items_df).collect()), key=str)
    assert kept == sorted((r[0] for r in got if not r[4]), key=str)


def cases():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)] + ["été", "a1", "zz"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, prose(rng.randint(1, 30))) for i in range(8)] + [(3, prose(14)), (90, "only two"), (91, ""), (92, None), (None, prose(20)), (93, "Rare-Word one")]
    docs = [(i, prose(rng.randint(0, 200))) for i in range(20)]
    docs += [(100 + i, f"{prose(30)}, {t}! {prose(30)}") for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "..."), (None, items[0][1]), (203, items[0][1].upper().replace("É", "é")), (203, items[0][1]), (204, (items[1][1] + " ") * 400), (205, "RARE_word\none only two"), (206, prose(30_000))]
    return docs, items


@pytest.mark.parametrize("small", [True, False])
def test_against_a_scan(spark, monkeypatch, small):
    if not small:  # the ways for benchmarks too large to broadcast
        monkeypatch.setattr(dec, "TERMS", 2)
        monkeypatch.setattr(dec, "if_small", lambda df, rows=0: df)
    check(spark, *cases())


def test_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    check(spark, [tuple(r) for r in docs], [(r.item_id, r.text) for r in items])


def plain_near(docs, items, size=13, slop=dec.SLOP):
    """Items with a proximity match, by the rule: the three rarest terms of a window (count, term, offset), all near one start."""
    pairs, counts = set(), {}
    for item, text in items:
        words = words_of(text)
        if item is not None and words:
            pairs |= {(str(item), tuple(words[i : i + size])) for i in range(max(1, len(words) - size + 1))}
    for _, text in docs:
        for w in words_of(text):
            counts[w] = counts.get(w, 0) + 1
    out = []
    for doc_id, text in docs:
        at, found = {}, set()
        for i, w in enumerate(words_of(text)):
            at.setdefault(w, []).append(i)
        for item, win in pairs:
            ranked = sorted((counts.get(w, 0), w, i) for i, w in enumerate(win))
            if ranked[0][0] and item not in found:
                (_, t1, o1), *others = [ranked[min(i, len(ranked) - 1)] if i < len(ranked) else ranked[0] for i in range(3)]
                for p in at.get(t1, []):
                    if p >= o1 and all(any(abs(q - (p - o1) - o) <= slop for q in at.get(t, [])) for _, t, o in others):
                        found.add(item)
        out.append((doc_id, sorted(found)))
    return sorted(out, key=str)


def test_proximity_against_a_scan(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(1, 25)))) for i in range(12)]
    docs = [(None, ""), (None, None)]
    for i in range(60):
        words = items[i % 12][1].split()
        for _ in range(rng.randint(0, 3)):  # edits inside the passage
            words.insert(rng.randint(0, len(words)), rng.choice(vocab))
        docs.append((i, " ".join(prose(rng.randint(0, 40)) + words + prose(rng.randint(0, 40)))))
    got = dec.contamination(spark.createDataFrame([(d, t, "", 1) for d, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, list(r.near_items)) for r in got), key=str) == plain_near(docs, items)
    assert all(set(r["items"]) <= set(r.near_items) for r in got) and any(set(r["items"]) < set(r.near_items) for r in got)


def test_decontaminate_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6), (2, "only two", 7, 8)], "doc_id long, text string, digest int, own_digest int")
    kept = dec.decontaminate(docs, spark.createDataFrame([(9, "only two")], "item_id long, text string"))
    assert kept.columns == docs.columns and list(map(tuple, kept.collect())) == [(1, "a b", 5, 6)]


def test_proximity_finds_an_edited_window(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = spark.createDataFrame([(1, item.replace("delta", "delta extra"), "", 0), (2, "alpha nu", "", 0)], SCHEMA)
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r.doc_id, r.item) for r in dec.proximity_matches(docs, items, slop=2).collect()} == {(1, "7")}
    assert not dec.contamination(docs, items).filter("n_hit > 0").collect()


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 0)], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert dec.contamination(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in dec.contamination(docs, items).collect()] == [0]


def test_one_word_repeated_very_often(spark):
    """Places are looked up by blocks: the work is linear in what a text repeats."""
    n = 200_000
    docs = spark.createDataFrame([(1, "the " * n, "", 0), (2, "the " * 5, "", 0)], SCHEMA)
    items = spark.createDataFrame([(1, "the " * 13)], "item_id long, text string")
    dec.contamination(docs.limit(1), items).collect()  # warm-up
    began = time.perf_counter()
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in dec.contamination(docs, items).collect()}
    assert got == {1: (n, n, True), 2: (5, 0, False)} and time.perf_counter() - began < 60
