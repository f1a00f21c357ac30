"""Top-k inner products against all products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank int, score double"


def plain(rows, k, step):
    fine = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, np.pad(v, (0, width - len(v)))) for i, v in fine]
    out = []
    for n, (i, v) in enumerate(fine):
        if i % step == 0:
            best = sorted((-int(v @ w), j) for m, (j, w) in enumerate(fine) if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [40, 8192])
def test_against_all_products(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "NEAR", 1)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = random.Random(shard)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], 0, 0.0) for i in range(150)]
    rows += [(1000 + i, [0.25] * 6, 0, 0.0) for i in range(60)]  # one very common vector
    rows += [(20, rows[20][1], 0, 0.0), (20, [0.5] * 6, 0, 0.0), (-20, [-1.0] * 6, 0, 0.0), (7, [0.1, 0.2], 0, 0.0), (40, [], 0, 0.0)]
    rows += [(5000, None, 0, 0.0), (5020, [1.0, None], 0, 0.0), (5040, [float("nan")], 0, 0.0), (5060, [float("inf")], 0, 0.0), (None, [1.0] * 6, 0, 0.0)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == plain(rows, 20, 20)


def test_large_components_are_exact(spark):
    """Scores beyond 2**43, beyond 2**53 and beyond 64 bits, which are ranked by value and returned as the nearest long."""
    for top in (60_000.0, 3e6, 3e30):
        rng = random.Random(int(top))
        rows = [(i, [float(np.float32(rng.uniform(-top, top))) for _ in range(4)], 0, 0.0) for i in range(120)]
        rows += [(500 + i, [float(np.float32(top))] * 4, 0, 0.0) for i in range(4)]  # ties
        whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, *_ in rows]
        want = []
        for i, v in whole:
            if i % 20 == 0:
                best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i)[:20]
                want += [(i, r, j, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, j) in enumerate(best, 1)]
        got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_few_and_none(spark):
    rows = [(20, [1.0], 0, 0.0), (1, [2.0], 0, 0.0)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert list(map(tuple, got)) == [(20, 1, 1, 64 * 128)]
    for few in (rows[:1], rows[1:], []):
        assert topk.top_k(spark.createDataFrame(few, SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = topk.top_k(table, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == plain([(r.vec_id, r.embedding) for r in table.collect()], 20, 20)
