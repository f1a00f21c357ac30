import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from ledgerspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, whitened double, component int"


def plain(vectors, scale=1024, shift=100_000):
    """n, exact sums, exact deviations and the covariance, from Fractions."""
    x = [[math.floor(Fraction(c) * scale) + shift for c in v] for v in vectors]
    n, total = len(x), [sum(column) for column in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, total, strict=True)) for row in x]
    centred = np.array([[float(c - Fraction(s, n)) for c, s in zip(row, total, strict=True)] for row in x])
    return n, deviation, centred, centred.T @ centred / n


def checked(got, ids, vectors, components=8):
    n, deviation, centred, v = plain(vectors)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    found = min(components, len(e))
    assert len(got) == len(ids) * found and {r.n for r in got} == {n}
    at = {(r.vec_id, r.component): r for r in got}
    for k in range(found):
        want = centred @ w[:, k] / math.sqrt(e[k])
        have = np.array([at[i, k + 1].whitened for i in ids])
        sign = 1 if want @ have > 0 else -1
        assert np.abs(have - sign * want).max() < 1e-6
        assert abs(at[ids[0], k + 1].explained / (e[k] / np.trace(v)) - 1) < 1e-9
    assert [at[i, 1].deviation for i in ids] == [min(d, 2**63 - 1) for d in deviation]
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-4


def test_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = table.collect()
    checked(whitening.whiten(table).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_unusable_vectors_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(60, 5)) * [5, 4, 3, 2, 1]).astype(np.float32).tolist()
    rows = [(i, v, 1, 0.0, 3) for i, v in enumerate(vectors)]
    bad = [(100, None, 1, 0.0, 3), (101, [1.0, None, 1.0, 1.0, 1.0], 1, 0.0, 3), (102, [float("nan")] * 5, 1, 0.0, 3), (103, [float("-inf")] * 5, 1, 0.0, 3)]
    got = whitening.whiten(spark.createDataFrame(rows + bad, SCHEMA).repartition(3)).collect()
    checked(got, list(range(60)), vectors)


def test_null_ids_repeated_rows_and_short_vectors(spark):
    vectors = [[1.0, 2.0], [3.0, 1.0], [3.0, 1.0], [2.0]]
    got = whitening.whiten(spark.createDataFrame([(1, vectors[0]), (2, vectors[1]), (2, vectors[2]), (None, vectors[3])], "vec_id long, embedding array<double>")).collect()
    n, deviation, *_ = plain([*vectors[:3], [2.0, 0.0]])
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted(zip(["1", "2", "2", "None"], deviation, strict=True)) and n == 4
    first, second = ([r.whitened for r in got if r.vec_id == 2 and r.component == k] for k in (1, 2))
    assert first[0] == first[1] and second[0] == second[1]


@pytest.mark.parametrize("top", [3e6, 1e12, 3e30])
def test_large_entries_are_exact(spark, top):
    rng = random.Random(int(math.log(top)))
    vectors = [[float(np.float32(rng.uniform(-top, top))) for _ in range(3)] for _ in range(40)]
    checked(whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")).collect(), list(range(40)), vectors)


def test_lower_rank_and_none(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    schema = "vec_id long, embedding array<float>"
    got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)
    for few in ([], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)]):
        got = whitening.whiten(spark.createDataFrame(few, schema))
        assert got.count() == 0 and got.schema["deviation"].dataType == T.LongType()


def test_every_constant_dimension_aside(spark):
    """Large means with small deviations: what a covariance from sums of squares would lose."""
    rng = np.random.default_rng(2)
    vectors = (30_000 + rng.normal(size=(200, 4)) * [0.4, 0.3, 0.2, 0.1]).tolist()
    checked(whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect(), list(range(200)), vectors)
