"""SimHash fingerprints and components against plain Python over all pairs."""

import random

import pytest
import xxhash

from ledgerspark.llm import simhash

SCHEMA = "doc_id long, text string, fp string, k int"


def plain_fingerprint(text, width=3):
    words = (text or "").encode().translate(simhash.LOWER).split()
    runs = [b" ".join(words)] if 0 < len(words) < width else [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def check(spark, rows):
    got = sorted(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    groups = plain_components({p for _, p in prints}, 2)
    least = {}
    for doc_id, p in prints:
        if doc_id is not None:
            least[groups[p]] = min(doc_id, least.get(groups[p], doc_id))
    want = sorted(((d, p - (p >> 63 << 64), least.get(groups[p])) for d, p in prints), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_edge_cases(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghijkl") * rng.randint(1, 3) for _ in range(200)]
    rows = [(1, None, "x", 1), (2, "", "", 2), (3, " \t\n", "", 3), (4, "one two", "", 4), (5, "ONE Two", "", 4), (5, "ONE Two", "", 4), (None, "solo", "", 0)]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(200)] = f"w{rng.randrange(50)}"
        rows.append((100 + i, " ".join(words), "", i))
    rows.append((999, "tail " * 30_000, "", 0))
    check(spark, rows)


@pytest.mark.parametrize("up_to", [64, 2])
def test_crowded_buckets_give_the_same_components(spark, monkeypatch, up_to):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", up_to)
    rng = random.Random(up_to)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = {s for s in seeds}
    for s in seeds:
        for _ in range(25):
            v = s
            for _ in range(rng.randint(1, 6)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [(v - (v >> 63 << 64),) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    got = {}
    for (v,) in signed:
        got.setdefault(roots.get(v, v), set()).add(v)
    want = {}
    for v, r in plain_components(values, 2).items():
        want.setdefault(r, set()).add(v - (v >> 63 << 64))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, [(r.doc_id, r.text, "", 0) for r in docs.collect()])


def test_keep_one(spark):
    rows = [(3, "a b c d e", "", 1), (1, "a b c d e", "", 2), (2, "q r s t u v", "", 3)]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == ["doc_id", "text", "fp", "k"]


def test_keep_one_of_repeated_ids_and_rows(spark):
    """One row of each group stays, whatever ids and rows repeat; each id's texts are judged apart."""
    same, near, other = "a b c d e f g", "A b  c d e f g", "q r s t u v w"
    rows = [(1, same, "x", 1), (1, same, "x", 1), (2, same, "", 2), (2, other, "", 3), (None, near, "", 4), (None, None, "", 5), (None, "", "", 6), (None, "h i j k l m", "", 7), (None, "h i j k l m", "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, copies int")
    got = sorted(((r.doc_id, r.text or "", r.digest, r["copies"]) for r in simhash.keep_one(docs).collect()), key=str)
    assert [g for g in got if g[1]] == sorted([(1, same, "x", 1), (2, other, "", 3), (None, "h i j k l m", "", 7)], key=str)
    assert len(got) == 4 and simhash.keep_one(docs).columns == docs.columns
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_kept(rows, width=5, similarity=0.8):
    """Ids whose component over all pairs with a Jaccard similarity of ``similarity`` has none smaller."""

    def shingles(text):
        words = (text or "").encode().translate(simhash.LOWER).split()
        return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1)) if words else frozenset()

    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) / len(x | y) >= similarity:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted(d for d in order if find(d) == d)


def test_keep_one_by_similarity(spark):
    """Edited copies, chains of them whose ends are less alike, a crowd, and texts just below the bar."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, None), (3, ""), (4, "Too short"), (5, "too SHORT"), (6, "one two three four five six")]
    words = list(base)
    for i in range(12):  # each edited in two more places than the one before
        words = [*words[: 20 * i + 7], f"x{i}", *words[20 * i + 8 :]]
        rows.append((10 + i, " ".join(words)))
    for i in range(80):
        other = [f"v{j}" for j in range(200)]
        for _ in range(rng.randint(0, 6)):
            other[rng.randrange(200)] = f"y{rng.randrange(1000)}"
        rows.append((100 + i, " ".join(other)))
    got = simhash.keep_one(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA))
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


@pytest.mark.parametrize("up_to", [0, 64])
def test_keep_one_in_buckets_of_boilerplate(spark, monkeypatch, up_to):
    """Pages of one site: most of each is shared, what tells them apart is just below or above the bar."""
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", up_to)
    rng = random.Random(9)
    shared = [f"menu{i}" for i in range(160)]
    own = {k: [f"p{k}x{i}" for i in range(rng.randint(10, 60))] for k in range(60)}
    rows = []
    for i in range(150):
        words = [*shared, *own[rng.randrange(60)]]
        words[rng.randrange(len(words))] = f"edit{i % 7}"
        rows.append((i, " ".join(words)))
    got = simhash.keep_one(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA))
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


def test_keep_one_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_near_copies_meet_by_fingerprints():
    """Sets at a similarity of 0.8 share a key of surest bits and lie within APART bits; unrelated sets do neither."""
    import numpy as np

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, (200, 333), np.uint64)
    one, other, apart = (np.array([simhash.votes(p[at]) for p in pool]) for at in (slice(0, 300), slice(33, 333), slice(300, 333)))
    keys = [simhash.block_keys(v) for v in (one, other, apart)]
    assert (keys[0] == keys[1]).any(1).all() and (keys[0] == keys[2]).any(1).mean() < 0.1
    distance = lambda x, y: ((x > 0) != (y > 0)).sum(1)
    assert distance(one, other).max() <= simhash.APART < distance(one, apart).min()
