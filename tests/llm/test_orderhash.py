import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import orderhash

SCHEMA = "doc_id long, text string, fingerprint string, part int, role string"
_64 = (1 << 64) - 1


def plain_mixed(x):
    x = ((x ^ (x >> 32)) * int(orderhash._MIX)) & _64
    return (((x ^ (x >> 29)) * int(orderhash._MIX)) & _64) ^ (x >> 32)


def plain(text):
    """The fingerprint of a text, selection by sorting (rank, position) of occurrence-numbered k-mers; their hashes are the library's."""
    grams = [int(h) for h in orderhash.kmers(text)]
    if not grams:
        return [0] * orderhash.SKETCHES
    seen, numbers = {}, []
    for g in grams:
        seen[g] = seen.get(g, -1) + 1
        numbers.append(plain_mixed((g + seen[g] * int(orderhash._TIMES)) & _64) >> 32)
    out = []
    for factor in orderhash._FACTORS.ravel().tolist():
        best = sorted(sorted(range(len(grams)), key=lambda i: (numbers[i] * factor & 0xFFFFFFFF, i))[: orderhash.TUPLE])
        value = int(orderhash._BASE)
        for i in best:
            value = plain_mixed((value * int(orderhash._TIMES) + grams[i]) & _64)
        out.append(value >> 48)
    return out


def words(rng, n, of=300):
    return " ".join(f"{rng.choice('bdfgklmnprst')}{rng.randrange(of)}" for _ in range(n))


def test_fingerprints_are_those_of_the_plain_version(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "aé", "🙂" * 5, "elevenchars", "twelve chars", "thirteen char", "ab" * 40, words(rng, 200), "x" * 3000, words(rng, 3000, 20)]
    for stretch in (64, orderhash.STRETCH):
        monkeypatch.setattr(orderhash, "STRETCH", stretch)
        for text in texts:
            assert orderhash.fingerprint(text).tolist() == plain(text)


def test_kmers_are_equal_where_their_code_points_are():
    rng = random.Random(2)
    text = "".join(rng.choice("ab é🙂") for _ in range(4000)) + "tail" * 20
    hashes = orderhash.kmers(text)
    runs = [text[i : i + orderhash.K] for i in range(len(text) - orderhash.K + 1)]
    assert len(hashes) == len(runs) and len(set(hashes.tolist())) == len(set(runs)) == len(set(zip(hashes.tolist(), runs, strict=True)))


def test_likeness_follows_edits_and_order():
    rng = random.Random(3)
    near, apart, turned = [], [], []
    for _ in range(30):
        a, b = words(rng, 400, 5000), words(rng, 400, 5000)
        own = orderhash.fingerprint(a)
        some = a.split(" ")
        some[200] = "edited"
        near.append(orderhash.likeness(own, orderhash.fingerprint(" ".join(some))))
        apart.append(orderhash.likeness(own, orderhash.fingerprint(b)))
        half = len(a) // 2
        turned.append(orderhash.likeness(own, orderhash.fingerprint(a[half:] + a[:half])))
    assert np.mean(near) > 0.95 and np.mean(apart) < 0.01
    assert 0.35 < np.mean(turned) < 0.65  # the same k-mers, half of the pairs in another order


def expected(rows):
    """Rows (id, text) in the operator's order; its columns from the plain parts."""
    out = []
    for (i, text), (_, after) in zip(rows, [*rows[1:], *rows[:1]], strict=True):
        third = len(text) // 3
        changed = text[: len(text) - third] + after[:third]
        own, edit, following = plain(text), plain(changed), plain(after)
        hexed = ["".join(f"{x:04x}" for x in p) for p in (own, edit)]
        like = [sum(a == b for a, b in zip(own, p, strict=True)) / len(own) for p in (edit, following)]
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), *hexed, *like))
    return out


def order(spark, rows):
    """The rows as Spark hashes order them: id falling, nulls last, equal ids by the text's hash."""
    df = spark.createDataFrame(rows, "id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    hashed = df.select("id", "text", F.xxhash64(F.col("text").cast("binary")).alias("h")).collect()
    return [(r.id, r.text) for r in sorted(hashed, key=lambda r: (r.id is None, -(r.id or 0), r.h, r.text))]


@pytest.mark.parametrize("parts", ["1", "5"])
def test_next_documents_across_parts(spark, parts):
    rng = random.Random(4)
    rows = [(rng.randrange(60) - 20, words(rng, rng.randrange(60))) for _ in range(50)]
    rows += [(5, None), (6, ""), (7, "ü"), (8, "🙂🙂🙂🙂"), (5, rows[0][1]), (None, "no id here, but a text"), (rows[0][0], rows[0][1]), (rows[1][0], rows[1][1])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(4)
        got = orderhash.with_edits(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    text = lambda r: tuple(map(str, r))
    assert sorted(map(text, got)) == sorted(map(text, expected(order(spark, rows))))


def test_one_none_and_fingerprints_alone(spark):
    one = spark.createDataFrame([(3, "a text of some length, alone", "", 1, "")], SCHEMA)
    got = orderhash.with_edits(one).collect()
    assert [tuple(r) for r in got] == expected([(3, "a text of some length, alone")])
    assert orderhash.fingerprints(one).first().fingerprint == got[0].fingerprint
    assert orderhash.with_edits(one.limit(0)).count() == 0 and orderhash.fingerprints(one.limit(0)).count() == 0


def test_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text or "") for r in table.collect()), reverse=True)
    got = {r.doc_id: tuple(r) for r in orderhash.with_edits(table).collect()}
    assert len(got) == len(rows)
    for want in expected(rows)[::9]:  # the plain version is slow
        assert got[want[0]] == want
    assert all(got[i][1] == len(t) for i, t in rows)
