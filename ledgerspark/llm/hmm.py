"""A hidden Markov language model of words.

Every word counted ``LEAST`` times in the training texts has a symbol of its own, up to the
``SYMBOLS`` most frequent, the bound of what is broadcast. The others share one of ``BUCKETS``
classes by their ending, and a class's probability is spread over its words by their counts, with
one share for all unseen. So the part of a word's probability within its class is the same in every
state: it is added to the text's score outside the recursion, from a join with the full counts for
words that the broadcast table doesn't hold.

Training: counts of all words over all training texts; then Baum-Welch, where each partition runs a
scaled forward-backward over its whole texts and emits expected counts that are summed across
partitions, until a round gains less than ``GAIN`` of the log-likelihood. A text of more than
``STRETCH`` tokens is worked on in stretches of that length side by side: the products of each
stretch's transitions and emissions carry the forward and backward messages from one to the next,
so the expected counts are those of the whole text, whatever STRETCH is. Scoring: the scaled forward
recursion over whole texts, whose scale factors multiply to the exact likelihood.

Nulls: a null text is empty, a single end token; a null id counts as the text '' for the fold.
Repeated rows each train and give a row. An empty table gives an empty result; without training
texts all words are unseen. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.quality import fold
from ledgerspark.llm.shared import LOWER, columns_of, staged, utf8

#: Most words with a symbol of their own and the count they need; classes of the others; words in the broadcast table of counts; distinct words a task counts before it emits.
SYMBOLS, LEAST, BUCKETS, TABLE, COUNTED = 65_279, 3, 256, 200_000, 300_000
#: Rounds at most and the share of the log-likelihood a round must gain; tokens of a stretch; tokens worked on at once.
STATES, ROUNDS, GAIN, STRETCH, AT_ONCE = 8, 6, 1e-3, 1_024, 1 << 20
#: Weight of the overall frequencies in each state's, in tokens.
PRIOR = 100.0


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def bucket_of(word: bytes) -> int:
    """A class by the last three bytes."""
    return zlib.crc32(word[-3:]) % BUCKETS


def bucket_column(word: str):
    """The same class, for Spark."""
    return F.crc32(F.expr(f"substring({word}, -least(3, octet_length({word})), 3)")) % BUCKETS


def word_counts(texts: DataFrame) -> DataFrame:
    """Stored: ``word`` and its count ``c`` over the column ``text`` (bytes)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for (rows,) in columns_of(batches):
            for one in rows:
                seen.update(words_of(one))
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    return staged(texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


@dataclass
class Lexicon:
    """The frequent words by falling count, as many whole counts as fit the table, and the classes' totals; bounded by TABLE and BUCKETS."""

    words: list[bytes]
    counts: np.ndarray
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray
    ends: int
    tokens: int  # N, ends included
    distinct: int  # V, the end included
    own: int  # words with a symbol of their own

    @classmethod
    def of(cls, counts: DataFrame, ends: int, symbols: int = SYMBOLS, table: int = TABLE) -> Lexicon:
        # the counts from which on the words fit the table: no task sends its own candidates for it to the driver
        least, room = 1, table
        for row in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(table + 1).collect():
            room -= row.n
            if room < 0:
                least = row.c + 1
                break
        top = sorted((-row.c, bytes(row.word)) for row in counts.filter(F.col("c") >= least).toLocalIterator())
        words = [w for _, w in top]
        total = counts.agg(F.sum("c"), F.count("c")).first()
        tokens, kinds = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for row in counts.groupBy(bucket_column("word").alias("b")).agg(F.sum("c").alias("c"), F.count("c").alias("n")).collect():
            tokens[row.b], kinds[row.b] = row.c, row.n
        c = np.array([-n for n, _ in top], np.int64)
        own = min(symbols, int((c >= LEAST).sum()))
        for word, n in zip(words[:own], c, strict=False):
            tokens[bucket_of(word)] -= n
            kinds[bucket_of(word)] -= 1
        return cls(words, c, tokens, kinds, ends, int(total[0] or 0) + ends, int(total[1]) + (ends > 0), own)

    @property
    def end(self) -> int:
        return self.own

    def symbols(self) -> np.ndarray:
        """The symbol of each word in the table."""
        return np.array([i if i < self.own else self.own + 1 + bucket_of(w) for i, w in enumerate(self.words)], np.uint16)

    def within(self) -> np.ndarray:
        """log10 of each table word's probability within its symbol."""
        out = np.zeros(len(self.words))
        for i in range(self.own, len(self.words)):
            b = bucket_of(self.words[i])
            out[i] = np.log10((self.counts[i] + 1) / (self.bucket_tokens[b] + self.bucket_words[b] + 1))
        return out

    def frequencies(self) -> np.ndarray:
        """Smoothed overall probability of each symbol."""
        n = np.ones(self.own + 1 + BUCKETS)
        n[: min(self.own, len(self.words))] += self.counts[: self.own]
        n[self.own] += self.ends
        n[self.own + 1 :] += self.bucket_tokens
        return n / n.sum()


_tables: dict[int, tuple] = {}


def encode(docs: DataFrame, lexicon: Lexicon, id_type: str) -> DataFrame:
    """Stored, one row for each of ``docs`` (id, held_out, text): symbols, sums over table words, and the words beyond it."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if id(shared.value) not in _tables:
            _tables.clear()
            lex: Lexicon = shared.value
            nothing = lambda values: np.append(values, values.dtype.type(0))  # noqa: E731 - at -1, for the words beyond the table
            _tables[id(lex)] = ({w: i for i, w in enumerate(lex.words)}, nothing(lex.symbols()), nothing(lex.within()), nothing(np.log10(lex.counts + 1.0)), lex.end, lex)  # the last keeps its id from being given to another
        index, symbols, within, logs, end, _ = _tables[id(shared.value)]
        for batch in batches:
            out: list[tuple] = []
            for one in batch.column(2).to_pylist():
                words = words_of(one)
                at = np.fromiter(map(index.get, words, [-1] * len(words)), np.int64, len(words))
                beyond = np.flatnonzero(at < 0)
                rare = [words[i] for i in beyond.tolist()]
                row = np.empty(len(words) + 1, np.uint16)
                row[:-1] = symbols[at]
                row[beyond] = [end + 1 + bucket_of(w) for w in rare]
                row[-1] = end
                out.append((len(row), len(words) - len(rare), float(logs[at].sum()), float(within[at].sum()), row.tobytes(), rare))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["id", "held_out", "n_tokens", "n_known", "logs", "within", "symbols", "rare"],
            )

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, logs double, within double, symbols binary, rare array<binary>"
    return staged(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "hmm-symbols")


def side_by_side(rows: list[np.ndarray]) -> tuple[np.ndarray, list[int], np.ndarray]:
    """The rows, longest first, as the columns of a grid; how many of them reach each of its rows; and their order."""
    sizes = np.array(list(map(len, rows)))
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    grid = np.zeros((len(rows), int(sizes[0])), np.uint16)
    for j, i in enumerate(order.tolist()):
        grid[j, : len(rows[i])] = rows[i]
    return np.ascontiguousarray(grid.T), np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left").tolist(), order


def by_size(rows: list[bytes]) -> Iterator[list[np.ndarray]]:
    """Symbols of texts in lots of about AT_ONCE tokens; a longer text is a lot of its own."""
    lot, size = [], 0
    for row in rows:
        one = np.frombuffer(row, np.uint16)
        if lot and size + len(one) > AT_ONCE:
            yield lot
            lot, size = [], 0
        lot.append(one)
        size += len(one)
    if lot:
        yield lot


@dataclass
class Model:
    """Start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @classmethod
    def first(cls, frequencies: np.ndarray, states: int, seed: int = 7) -> Model:
        noise = np.random.default_rng(seed).uniform(0.2, 1.8, (len(frequencies), states))
        emit = frequencies[:, None] * noise
        move = np.full((states, states), 0.4 / states) + 0.6 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    def told(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols' emissions, a row for each state: steps work along their columns, many texts at a time."""
        return np.ascontiguousarray(self.emit.take(symbols, 0).T)

    def transfers(self, stretches: list[np.ndarray]) -> np.ndarray:
        """Of each stretch, from the state before it to the state at its end: the scaled product of its steps."""
        k = len(self.start)
        grid, alive, order = side_by_side(stretches)
        out = np.empty((k, k, len(stretches)))  # state at the end, state before
        now = np.repeat(np.eye(k)[:, :, None], len(stretches), 2)
        for n, row in zip(alive, grid, strict=True):
            out[:, :, n : now.shape[2]] = now[:, :, n:]
            now = (self.move.T @ now[:, :, :n].reshape(k, -1)).reshape(k, k, n)
            told = self.told(row[:n])
            now *= (told / np.einsum("ebn,en->n", now, told))[:, None, :]
        out[:, :, : now.shape[2]] = now
        back = np.empty((len(stretches), k, k))
        back[order] = out.transpose(2, 1, 0)
        return back

    def messages(self, symbols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """All texts as stretches, each with the state's distribution before it (of its first token where it opens a text), whether it opens one, and the backward message from what follows."""
        k = len(self.start)
        parts = [[s[i : i + STRETCH] for i in range(0, len(s), STRETCH)] for s in symbols]
        opens = np.concatenate([np.arange(len(p)) == 0 for p in parts])
        before, after = np.tile(self.start, (len(opens), 1)), np.ones((len(opens), k))
        first = np.cumsum([0, *map(len, parts)])
        long = [i for i, p in enumerate(parts) if len(p) > 1]
        if long:
            products = self.transfers([x for i in long for x in parts[i][1:]])
            heads = self.heads([parts[i][0] for i in long])
            at = 0
            for i, a in zip(long, heads, strict=True):
                n, lo = len(parts[i]) - 1, first[i]
                own = products[at : at + n]
                at += n
                for j in range(n):
                    before[lo + 1 + j] = a
                    a = a @ own[j]
                    a = a / a.sum()
                b = np.ones(k)
                for j in range(n - 1, -1, -1):
                    b = own[j] @ b
                    b = b / b.sum()
                    after[lo + j] = b
        return [x for p in parts for x in p], opens, before, after

    def heads(self, stretches: list[np.ndarray]) -> np.ndarray:
        """The state's distribution at the end of stretches of equal length that open a text."""
        grid = np.stack(stretches, 1)
        a = self.start[:, None] * self.told(grid[0])
        for symbols in grid[1:]:
            a /= a.sum(0)
            a = self.move.T @ a
            a *= self.told(symbols)
        return (a / a.sum(0)).T

    def expected(self, symbols: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Expected starts, transitions, emissions and the log-likelihood of whole texts."""
        parts, opens, before, after = self.messages(symbols)
        k = len(self.start)
        grid, alive, order = side_by_side(parts)
        opens, before, after = opens[order], before[order], after[order].T
        alpha, scale, told = [], [], []
        for n, row in zip(alive, grid, strict=True):
            here = self.told(row[:n])
            a = self.move.T @ alpha[-1][:, :n] if alpha else np.where(opens, before.T, self.move.T @ before.T)
            a *= here
            c = a.sum(0)
            a /= c
            here /= c
            alpha.append(a)
            scale.append(c)
            told.append(here)
        moves, beta = np.zeros((k, k)), np.empty((k, 0))
        for a in reversed(alpha):
            n, m = a.shape[1], beta.shape[1]
            if m:
                onward = told.pop()
                onward *= beta
                moves += a[:, :m] @ onward.T
                beta = self.move @ onward
            if m < n:  # stretches that end here; from here on a times beta sums to 1 at each of their steps
                beta = np.concatenate([beta, after[:, m:n] / (a[:, m:] * after[:, m:n]).sum(0)], 1)
            a *= beta
        starts = alpha[0][:, opens].sum(1)
        if not opens.all():  # the steps between a text's stretches
            onward = (told[0] * beta)[:, ~opens].T
            into = before[~opens]
            moves += into.T @ (onward / ((into @ self.move) * onward).sum(1, keepdims=True))
        flat = np.concatenate([row[:n] for n, row in zip(alive, grid, strict=True)]).astype(np.int64)
        emits = np.stack([np.bincount(flat, np.concatenate([a[s] for a in alpha]), len(self.emit)) for s in range(k)], 1)
        return starts, moves * self.move, emits, np.array([np.log(np.concatenate(scale)).sum()])

    def next(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, frequencies: np.ndarray) -> Model:
        emit = emits + PRIOR * frequencies[:, None]
        return Model((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True), emit / emit.sum(0))

    def log_likelihoods(self, symbols: list[np.ndarray]) -> np.ndarray:
        """Natural log of each whole text's probability, by the scaled forward recursion over all texts at once."""
        order = sorted(range(len(symbols)), key=lambda i: -len(symbols[i]))
        out = np.zeros(len(symbols))
        at = 0
        while at < len(order):
            size, to = 0, at
            while to < len(order) and (to == at or size + len(symbols[order[to]]) <= 2_000_000):
                size += len(symbols[order[to]])
                to += 1
            some = [symbols[i] for i in order[at:to]]
            sizes = np.array([len(s) for s in some])
            joined, first = np.concatenate(some), np.cumsum(sizes) - sizes
            alive = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
            logs, a = np.zeros(len(some)), np.repeat(self.start[:, None], len(some), 1)
            for t, n in enumerate(alive):
                a = self.move.T @ a[:, :n] if t else a
                a *= self.told(joined[first[:n] + t])
                c = a.sum(0)
                a /= c
                logs[:n] += np.log(c)
            out[order[at:to]] = logs
            at = to
        return out


def baum_welch(encoded: DataFrame, lexicon: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Train on the texts that aren't held out: each round sums the partitions' expected counts."""
    frequencies = lexicon.frequencies()
    model = Model.first(frequencies, states)
    training = encoded.filter(~F.col("held_out")).select("symbols")
    columns, last = [f"s{i}" for i in range(states)], None
    for _ in range(rounds):
        shared = training.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = None
            for (rows,) in columns_of(batches):
                for lot in by_size(rows):
                    found = shared.value.expected(lot)
                    sums = found if sums is None else tuple(a + b for a, b in zip(sums, found, strict=True))
            if sums is not None:
                # a row for the starts, one for each state's transitions, the log-likelihood, then the symbols that occur
                starts, moves, emits, total = sums
                seen = np.flatnonzero(emits.any(1))
                values = np.vstack([starts, moves, np.full(states, total[0] / states), emits[seen]])
                at = np.concatenate([np.arange(-states - 2, 0), seen])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(v, pa.float64()) for v in values.T)], ["at", *columns])

        found = training.mapInArrow(count, "at int, " + ", ".join(f"{c} double" for c in columns))
        summed = found.groupBy("at").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
        values = np.zeros((states + 2 + len(frequencies), states))
        values[summed["at"].to_numpy(np.int64) + states + 2] = summed[columns]
        starts, moves, total, emits = values[0], values[1 : states + 1], float(values[states + 1].sum()), values[states + 2 :]
        model = model.next(starts, moves, emits, frequencies)
        shared.unpersist()
        if last is not None and total - last < GAIN * abs(last):
            break
        last = total
    return model


def scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2, states: int = STATES, rounds: int = ROUNDS, symbols: int = SYMBOLS, table: int = TABLE) -> DataFrame:
    """One row for each document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    rows = docs.select(F.col(id_col).alias("id"), (fold(F.col(id_col), folds) == held_out).alias("held_out"), utf8(text).alias("text"))
    training = rows.filter(~F.col("held_out"))
    counts = word_counts(training.select("text"))
    lexicon = Lexicon.of(counts, training.count(), symbols, table)
    encoded = encode(rows, lexicon, docs.schema[id_col].dataType.simpleString())
    model = baum_welch(encoded, lexicon, states, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.log_likelihoods([np.frombuffer(s, np.uint16) for s in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found / np.log(10), pa.float64())], [*names[:-1], "chain"])

    names = ["row", "id", "held_out", "n_tokens", "n_known", "logs", "within", "symbols"]
    own = encoded.select(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:-1]) + ", chain double"
    chained = own.mapInArrow(likelihood, schema)

    sizes = [(b, float(np.log10(lexicon.bucket_tokens[b] + lexicon.bucket_words[b] + 1))) for b in range(BUCKETS)]
    spread = F.broadcast(docs.sparkSession.createDataFrame(sizes, "b long, spread double"))  # BUCKETS rows
    rare = encoded.select("row", F.explode("rare").alias("word")).withColumn("b", bucket_column("word"))
    rare = rare.join(counts, "word", "left").join(spread, "b")
    log = F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    rare = rare.groupBy("row").agg(F.sum(log).alias("r_logs"), F.count("c").alias("r_known"), F.sum(log - F.col("spread")).alias("r_within"))
    base = float(np.log10(lexicon.tokens + lexicon.distinct + 1))
    both = chained.join(rare, "row", "left").na.fill(0, ["r_logs", "r_known", "r_within"])
    return both.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("r_known") + int(lexicon.ends > 0)).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("r_logs") + float(np.log10(lexicon.ends + 1)) - F.col("n_tokens") * base).alias("base_score"),
        (F.col("chain") + F.col("within") + F.col("r_within")).alias("score"),
    )
