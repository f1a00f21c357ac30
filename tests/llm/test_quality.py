"""The line field: forward-backward against all paths, held-out accuracy, odd rows."""

from itertools import product

import numpy as np

from ledgerspark.llm import quality

SCHEMA = "doc_id long, text string, score double, label int"


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    counts, transition = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    scores = rng.normal(size=(8, 2))
    p, moves = quality.marginals(scores, counts, transition)
    want, want_moves, at = np.zeros((8, 2)), np.zeros((2, 2)), 0
    for n in counts:
        paths = list(product((0, 1), repeat=int(n)))
        weight = np.array([np.exp(sum(scores[at + i, s] for i, s in enumerate(q)) + sum(transition[a, b] for a, b in zip(q, q[1:]))) for q in paths])
        for q, w in zip(paths, weight / weight.sum(), strict=True):
            for i, s in enumerate(q):
                want[at + i, s] += w
            for a, b in zip(q, q[1:]):
                want_moves[a, b] += w
        at += n
    assert np.allclose(p, want) and np.allclose(moves, want_moves)


def test_repetition_counts_whatever_word_it_is():
    first, later = quality.line_features([b"buy buy buy buy see"])[0], quality.line_features([b"see buy buy buy buy"])[0]
    assert np.allclose(first, later)


def test_keep_good_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "some text", 3, 4, 5)], "doc_id long, text string, __text int, score int, bytes int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and list(map(tuple, kept.collect())) == [(1, "some text", 3, 4, 5)]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert np.mean([g >= 0.3 for g in good]) > 0.97 and np.mean([b < 0.3 for b in bad]) > 0.6


def test_odd_rows(spark):
    rows = [(1, None, 9.0, 1), (2, "", 9.0, 1), (None, "fine text here.\n\nmore", 9.0, 1), (3, "JUNK!!! " * 40_000, 9.0, 1), (3, "same", 9.0, 1), (3, "same", 9.0, 1), (4, "\n" * 500, 9.0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 0), (4, 1), (7, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.quality(docs, known).collect()
        assert len(got) == len(rows)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out is not None for r in got)
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows, key=str)
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_a_text_that_does_not_fit_the_sample_is_passed_over(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 4_000)
    rows = [(i, ("good line\n" if i % 2 else "!!! ###\n") * 5) for i in range(1, 60)] + [(i, "x" * 9_000) for i in range(60, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 90)], "doc_id long, quality int")
    field = quality.train(docs, labels)
    assert field.share is None  # both classes were there, none of the long texts
    low, high = field.scores([b"!!! ###\n" * 5, b"good line\n" * 5])
    assert low < 0.5 < high
