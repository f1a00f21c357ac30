"""Document quality from a linear-chain conditional random field over lines.

Every line has a state, bad or good. A state's score is linear in the line's features and those of
its neighbours; neighbouring states add a transition score. Documents lend their label to all of
their lines for training. Forward-backward gives each line's probability of being good, and a
document's score is the mean over its lines, weighted by their length.

Training takes at most ``SAMPLE`` labelled documents, those with the smallest hash of their id, and
of these as many as hold ``SAMPLE_BYTES``, so what reaches the driver is bounded; scoring runs over whole texts in the workers. No feature uses
an id, a label, a source or a language.

Nulls: a null or empty text is one empty line and gets that line's probability; rows without a
label don't train; a null id counts as the text ''. Repeated rows each give a row. An empty table
gives an empty result; without labels of both kinds every score is the share of good ones (0.5
without any). Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ledgerspark.llm.shared import unused, utf8

#: Labelled documents for training, and the bytes of their texts; bytes of text whose features are computed at once.
SAMPLE, SAMPLE_BYTES, AT_ONCE = 4_000, 64 << 20, 4 << 20
STEPS, RATE, RIDGE, MOST_TRANSITION = 150, 0.1, 1e-3, 2.0

_KINDS = np.full(256, 5, np.uint8)  # other marks
_KINDS[list(range(97, 123))] = 0
_KINDS[list(range(65, 91))] = 1
_KINDS[list(range(48, 58))] = 2
_KINDS[[32, 9, 10, 11, 12, 13]] = 3
_KINDS[list(b".,;:'\"!?-()")] = 4
_KINDS[128:] = 6
N_KINDS = 7
#: Of each line: shares of the kinds, log length, words, mean word length, distinct words, most frequent word, ends in a stop, is empty.
N_OWN = N_KINDS + 7


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts (with both neighbours'), lines in each text, and bytes in each line."""
    lines = [line for text in texts for line in text.split(b"\n")]
    counts = np.array([text.count(b"\n") + 1 for text in texts], np.int64)
    sizes = np.array([len(line) for line in lines], np.int64)
    kinds = np.zeros((len(lines), N_KINDS))
    full = np.flatnonzero(sizes)
    if len(full):
        joined = _KINDS[np.frombuffer(b"".join(lines), np.uint8)]
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(N_KINDS):
            kinds[full, k] = np.add.reduceat(joined == k, starts, dtype=np.int64)
    words = np.zeros((len(lines), 3))
    for i, line in enumerate(lines):
        parts = line.split()
        if parts:
            counted = Counter(parts)
            words[i] = len(parts), len(counted) / len(parts), max(counted.values()) / len(parts)
    n = np.maximum(sizes, 1)[:, None]
    own = np.hstack(
        [
            kinds / n,
            np.log1p(sizes)[:, None] / 5,
            np.log1p(words[:, :1]) / 3,
            (kinds[:, [0, 1, 6]].sum(1) / np.maximum(words[:, 0], 1))[:, None] / 10,
            words[:, 1:2],
            words[:, 2:3],
            np.array([line.rstrip().endswith((b".", b"!", b"?")) for line in lines], float)[:, None],
            (sizes == 0)[:, None],
        ]
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    last = np.cumsum(counts) - 1
    before[last - counts + 1], after[last] = 0, 0
    edge = np.zeros((len(lines), 2))
    edge[last - counts + 1, 0], edge[last, 1] = 1, 1
    return np.hstack([own, before, after, edge, np.ones((len(lines), 1))]), counts, sizes


def marginals(scores: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: P(state) of each line, and the expected transitions (2 x 2).

    ``scores``: a row of 2 state scores for each line, chain after chain; ``counts``: lines of each chain.
    """
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    begin, length = first[order], counts[order]
    alive = np.array([np.searchsorted(-length, -t, "left") for t in range(int(length[0]))])  # chains longer than t
    psi, step = np.exp(scores - scores.max(1, keepdims=True)), np.exp(transition)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    for t, n in enumerate(alive):
        at = begin[:n] + t
        a = psi[at] if t == 0 else (alpha[at - 1] @ step) * psi[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    moves = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = begin[: alive[t]] + t
        onward = psi[at] * beta[at]
        joint = alpha[at - 1][:, :, None] * step * onward[:, None, :]
        moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = onward @ step.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p / p.sum(1, keepdims=True), moves


class LineField:
    """The trained field: state weights (2 columns), transitions, and the features' scale."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, mean: np.ndarray, scale: np.ndarray, share: float | None = None) -> None:
        self.weights, self.transition, self.mean, self.scale, self.share = weights, transition, mean, scale, share

    @classmethod
    def train(cls, texts: list[bytes], labels: list[int]) -> LineField:
        """By gradient ascent (Adam) on the mean log-likelihood of the lines' states, with a ridge penalty."""
        y = np.array(labels, np.int64)
        if len(set(labels)) < 2:
            return cls(np.zeros((0, 2)), np.zeros((2, 2)), np.zeros(0), np.ones(0), float(y.mean()) if len(y) else 0.5)
        x, counts, _ = line_features(texts)
        mean, scale = x.mean(0), x.std(0) + 1e-6
        mean[-1], scale[-1] = 0, 1
        x = (x - mean) / scale
        states = np.repeat(y, counts)
        target = np.eye(2)[states]
        inner = np.ones(len(states), bool)
        inner[np.cumsum(counts) - counts] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (states[np.flatnonzero(inner) - 1], states[inner]), 1)
        weights, transition = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
        state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros((2, 2)), np.zeros((2, 2))]
        for k in range(1, STEPS + 1):
            p, moves = marginals(x @ weights, counts, transition)
            for i, (value, grad) in enumerate(((weights, x.T @ (target - p) / len(x) - RIDGE * weights), (transition, (seen - moves) / len(x) - RIDGE * transition))):
                m, v = state[2 * i], state[2 * i + 1]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                value += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            np.clip(transition, -MOST_TRANSITION, MOST_TRANSITION, out=transition)
        return cls(weights, transition, mean, scale)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """P(good) of each text: its lines' marginals weighted by their bytes."""
        if self.share is not None or not texts:
            return np.full(len(texts), self.share if self.share is not None else 0.5)
        x, counts, sizes = line_features(texts)
        p, _ = marginals(((x - self.mean) / self.scale) @ self.weights, counts, self.transition)
        weight = np.maximum(sizes, 1e-9)
        at = np.cumsum(counts) - counts
        return np.clip(np.add.reduceat(p[:, 1] * weight, at) / np.add.reduceat(weight, at), 0, 1)


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> LineField:
    """A field from at most ``sample`` labelled documents whose fold of 5 is not 0; a doc_id with several labels takes the smallest.

    The sample is chosen by ids, in the order of their hashes, and by the texts' sizes: a text that no longer fits SAMPLE_BYTES is
    passed over. Texts are fetched only then; equal texts of one id count once.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col), 5) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), utf8(text).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    order = [F.xxhash64("_id"), F.col("_id"), F.col("_hash")]
    sizes = rows.select("_id", "_hash", F.octet_length("_text").alias("_bytes")).join(F.broadcast(known), "_id").distinct().orderBy(*order).limit(sample).collect()
    chosen, total = [], 0
    for row in sizes:
        if total + row._bytes <= SAMPLE_BYTES:
            chosen.append((row._id, row._hash, int(row._label)))
            total += row._bytes
    wanted = docs.sparkSession.createDataFrame(chosen, StructType([StructField("_id", docs.schema[id_col].dataType), StructField("_hash", LongType()), StructField("_label", LongType())]))
    found = sorted(rows.join(F.broadcast(wanted), ["_id", "_hash"]).select("_id", "_label", "_text").dropDuplicates(["_id", "_text"]).collect())
    return LineField.train([bytes(r._text) for r in found], [int(r._label) for r in found])


def score(docs: DataFrame, field: LineField, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, the probability that the text is good. An own column of that name is replaced."""
    model = docs.sparkSession.sparkContext.broadcast(field)
    own = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(batch.num_columns - 1).to_pylist(), []
            at, size = 0, 0
            for i, one in enumerate(texts, 1):
                size += len(one)
                if size > AT_ONCE or i == len(texts):
                    found.append(model.value.scores(texts[at:i]))
                    at, size = i, 0
            scores = pa.array(np.concatenate(found) if found else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], schema.names)

    schema = StructType([*(docs.schema[c] for c in own)]).add(name, DoubleType())
    return docs.select(*own, utf8(text).alias(unused(docs, "bytes")[0])).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each document: id, ``held_out``, ``score``, ``predicted``."""
    field = train(docs, labels, id_col, text, sample=sample)
    scored = score(docs.select(id_col, text), field, text)
    return scored.select(id_col, (fold(F.col(id_col), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    field = train(docs, labels, id_col, text, sample=sample)
    (name,) = unused(docs, "score")
    return score(docs, field, text, name).filter(F.col(name) >= threshold).select(docs.columns)
