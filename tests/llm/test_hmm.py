"""The language model: recursions against all paths, base scores by hand, better than its base on held-out texts."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from ledgerspark.llm import hmm

SCHEMA = "doc_id long, text string, score double, row int, symbols string"


def small_model(states=2, symbols=4):
    rng = np.random.default_rng(3)
    one = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape))
    return hmm.Model(one(states), one(states, states), one(states, symbols).T)


def paths(model, seq):
    k = len(model.start)
    out = {}
    for q in product(range(k), repeat=len(seq)):
        p = model.start[q[0]] * model.emit[seq[0], q[0]]
        for t in range(1, len(seq)):
            p *= model.move[q[t - 1], q[t]] * model.emit[seq[t], q[t]]
        out[q] = p
    return out


def test_forward_is_the_sum_over_paths():
    model, seqs = small_model(), [np.array(s, np.uint16) for s in ([0, 1, 3, 2], [2], [1, 1, 0])]
    assert np.allclose(np.exp(model.log_likelihoods(seqs)), [sum(paths(model, s).values()) for s in seqs])


@pytest.mark.parametrize("stretch", [1, 2, 3, 1000])
def test_expected_counts_are_those_of_whole_texts(monkeypatch, stretch):
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    texts = ([0, 1, 3, 2, 2, 1, 0], [2], [1, 1, 3], [3, 0])
    model, seqs = small_model(), [np.array(t, np.uint16) for t in texts]
    starts, moves, emits, total = model.expected(seqs)
    want_starts, want_moves, want_emits, want_total = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for text in texts:
        p = paths(model, text)
        z = sum(p.values())
        want_total += np.log(z)
        for q, w in p.items():
            want_starts[q[0]] += w / z
            for t, s in enumerate(q):
                want_emits[text[t], s] += w / z
                if t:
                    want_moves[q[t - 1], s] += w / z
    assert np.allclose(starts, want_starts) and np.allclose(moves, want_moves) and np.allclose(emits, want_emits) and np.isclose(total[0], want_total)


def test_long_texts_stay_finite(monkeypatch):
    rng = np.random.default_rng(2)
    model, seqs = small_model(8, 50), [rng.integers(0, 50, n).astype(np.uint16) for n in (5_000, 30, 1_025, 1_024)]
    found = model.expected(seqs)
    monkeypatch.setattr(hmm, "STRETCH", 10_000)
    assert all(np.allclose(a, b) for a, b in zip(found, model.expected(seqs), strict=True))
    assert np.isclose(found[3][0], model.log_likelihoods(seqs).sum()) and np.isclose(found[2].sum(), sum(map(len, seqs)))


def test_steps_work_along_columns():
    """A row of contiguous entries for each state, a column for each text; the sums are those of a forward pass with the texts in rows."""
    rng = np.random.default_rng(4)
    model, seqs = small_model(8, 500), list(rng.integers(0, 500, (40, 300)).astype(np.uint16))
    told = model.told(seqs[0])
    assert told.shape == (8, 300) and told.flags.c_contiguous and np.array_equal(told, model.emit[seqs[0]].T)
    a, total = model.start, 0.0
    for t, symbols in enumerate(np.stack(seqs, 1)):
        a = (a @ model.move if t else a) * model.emit[symbols]
        total += np.log(a.sum(1)).sum()
        a = a / a.sum(1, keepdims=True)
    starts, moves, emits, found = model.expected(seqs)
    assert np.isclose(found[0], total) and np.isclose(starts.sum(), 40) and np.isclose(moves.sum(), 40 * 299)
    assert np.allclose(emits.sum(1), np.bincount(np.concatenate(seqs), minlength=500))


def base(rows, folds=7, held=2):
    out = lambda d: zlib.crc32(str("" if d is None else d).encode()) % folds == held
    words = lambda t: [*(t or "").encode().translate(hmm.LOWER).split(), None]
    c = Counter(w for d, t, *_ in rows if not out(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted(((d, out(d), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t, *_ in rows), key=str)


@pytest.mark.parametrize(("symbols", "table"), [(hmm.SYMBOLS, hmm.TABLE), (2, 8), (2, 0)])
def test_base_scores(spark, symbols, table):
    rows = [(i, f"The cat {'sat' if i % 2 else 'ran'} on MAT{i % 3} É é\x0bx", 0.0, 0, "") for i in range(40)]
    rows += [(None, None, 0.0, 0, ""), (50, "", 0.0, 0, ""), (51, "cat " * 5000, 0.0, 0, ""), (51, "cat " * 5000, 0.0, 0, ""), (52, "never seen", 0.0, 0, "")]
    got = hmm.scores(spark.createDataFrame(rows, SCHEMA), rounds=2, symbols=symbols, table=table).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base(rows)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    if table == 8:  # how the counts are stored doesn't change the score
        again = hmm.scores(spark.createDataFrame(rows, SCHEMA), rounds=2, symbols=2, table=1000).collect()
        assert np.allclose(sorted(r.score for r in got), sorted(r.score for r in again))
    assert hmm.scores(spark.createDataFrame([], SCHEMA), rounds=1).count() == 0


def test_the_model_is_a_distribution(spark):
    """Over all words, seen or one unseen class, a state's emissions times the shares within symbols add up to one."""
    lex = hmm.Lexicon([b"a", b"b"], np.array([5, 2]), np.full(hmm.BUCKETS, 3), np.full(hmm.BUCKETS, 2), 4, 11 + 3 * hmm.BUCKETS, 3 + 2 * hmm.BUCKETS, 2)
    model = hmm.Model.first(lex.frequencies(), 4)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and np.isclose(model.start.sum(), 1)


def test_better_than_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in hmm.scores(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) * 0.95
