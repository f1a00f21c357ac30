import hashlib
import math
import pickle
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from ledgerspark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def plain(rows, positions=8, entries=16, rounds=6, scale=4096):
    """Lloyd's rounds over whole numbers, every part scanned each time. ``rows``: id, vector, label."""
    kept = [(i, [math.floor(Fraction(c) * scale) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // positions)
    kept = [(i, v + [0] * (positions * width - len(v)), label) for i, v, label in kept]
    first = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books, found, errors = [], [], [0] * len(kept)
    for p in range(positions):
        parts = [v[p * width : (p + 1) * width] for _, v, _ in kept]
        book = [v[p * width : (p + 1) * width] for v in first]

        def nearest(part):
            away = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
            return min(range(len(book)), key=lambda k: (away[k], k)), min(away)

        for _ in range(rounds):
            groups = defaultdict(list)
            for part in parts:
                groups[nearest(part)[0]].append(part)
            book = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if groups[k] else e for k, e in enumerate(book)]
        last = [nearest(part) for part in parts]
        found.append([k for k, _ in last])
        errors = [e + d for e, (_, d) in zip(errors, last, strict=True)]
        books += [str(c) for e in book for c in e]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest, top = hashlib.sha256(",".join(books).encode()).hexdigest(), 2**63 - 1
    code = ["".join(f"{c:02x}" for c in each) for each in zip(*found, strict=True)]
    return sorted((str(i), c, min(e, top), min(by_label[label], top), digest) for (i, _, label), c, e in zip(kept, code, errors, strict=True))


def checked(df, rows, **options):
    got = codes.compressed(df, **options).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain(rows, **options)


def test_a_table(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 60)
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    checked(table.repartition(3), [(r.vec_id, r.embedding, r.label) for r in table.collect()])


def test_unusable_vectors_repeats_ties_and_clashing_names(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(16)], rng.choice([None, 1, 2]), "x", 7) for i in range(150)]
    rows += [(7, rows[7][1], 1, "x", 7), (7, rows[9][1], 1, "x", 7), (None, rows[3][1], None, "x", 7), (200, [1.0] * 16, 2, "x", 7)] + [(300 + i, [0.25] * 16, 2, "x", 7) for i in range(90)]
    bad = [(-3, None, 1, "x", 7), (-2, [None] * 16, 1, "x", 7), (-1, [float("nan")] * 16, 1, "x", 7), (0, [float("inf")] * 16, 1, "x", 7)]
    checked(spark.createDataFrame(rows + bad, SCHEMA).repartition(2), [r[:3] for r in rows])


def test_few_and_none(spark):
    rows = [(5, [1.0, 2.0, 3.0], None), (2, [4.0, 0.5], 1), (9, [1.0, 2.0, 3.0], 1)]
    schema = "vec_id long, embedding array<float>, label int"
    checked(spark.createDataFrame(rows, schema), rows)
    checked(spark.createDataFrame(rows[:1], schema), rows[:1])
    for none in ([], [(1, None, 1)], [(1, [], 1)]):
        assert codes.compressed(spark.createDataFrame(none, schema)).count() == 0


@pytest.mark.parametrize("top", [4e4, 1e9, 3e30])
def test_large_components_are_exact(spark, top):
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.uniform(-top, top))) for _ in range(8)], i % 3) for i in range(60)]
    checked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows, positions=4, entries=5, rounds=4)


def test_later_rounds_scan_few_parts(spark):
    """In well separated groups nothing is popped once the entries stand still; results stay those of full scans (above)."""
    rng = np.random.default_rng(8)
    centres = rng.uniform(-1, 1, size=(4, 8))
    rows = [(i, (centres[i % 4] + rng.normal(size=8) * 0.005).tolist(), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<float>, label int")
    last, _ = codes.trained(df, 4096.0, 4, 1, 6)
    assert sum(r.scanned for r in last.collect()) == 0
    block = pickle.loads(last.first().block)
    assert sum(len(heap) for heap in block.heaps[0]) == len(block.ids)
