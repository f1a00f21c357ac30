"""Token counts without shuffling pre-tokens: a broadcast table for the frequent, worker caches for the rest.

A text is split at ASCII white space. The tokenizer drops white space before it forms words, so no
token crosses such a split and a text's token count is the sum over its chunks. Chunks repeat a
great deal: the frequent ones are taken from about ``SAMPLE`` texts, a random sample of all
rows, whose chunks the driver counts, so nothing is shuffled. The driver measures the most
frequent and broadcasts their lengths, and a pass over all texts looks every chunk up, encoding only
those that neither the table nor the worker's cache holds. The table only saves time: every count is
exact whatever it holds.

Nulls: a null text is empty and has 0 tokens; a null id is carried along. Repeated rows each give
a row. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.shared import LOWER, columns_of, utf8

#: Chunks in the broadcast table: at most this many short byte strings, about 2 MB.
TABLE_SIZE = 32_768
#: Texts whose chunks are counted for the table, about; the distinct chunks that a task puts forward.
SAMPLE, SUMMARY_SIZE = 4_000, 8_192
#: Longest chunk kept in the table or a cache, in bytes; entries that a worker's cache holds before it starts again from the table.
LONGEST, CACHE_SIZE = 256, 400_000

_LETTERS = re.compile(r"[a-zA-ZÀ-ÖØ-öø-ÿ]+")
_MARKS = frozenset(b".,;:!?")


def _byte_letters() -> list[str]:
    """The printable stand-in that byte-level vocabularies use for each byte: itself where printable, else 256 and up in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def chunks(text: bytes) -> list[bytes]:
    """The text's white-space chunks, A-Z lower-cased as the tokenizer does; special strings keep their case."""
    return (text if b"<|" in text else text.translate(LOWER)).split()


class ChunkEncoder:
    """Token ids of one chunk by the library; plain words skip its text handling, which would not change them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.plain = self._words_are_plain()

    def _words_are_plain(self) -> bool:
        """Whether this tokenizer treats a word of letters as the direct path does: tried out on a few words."""
        return all(
            self._word(word.encode()) == self.tokenizer.encode(word, add_special_tokens=False).ids
            and self.tokenizer.encode(f"{word}.", add_special_tokens=False).ids
            == self._word(word.encode()) + self.tokenizer.encode(".", add_special_tokens=False).ids
            for word in ("the", "unquestionably", "éèêçßñ", "xqzvkjwy", "don")
        )

    def _word(self, word: bytes) -> list[int]:
        word = word.translate(LOWER)
        text = word.decode() if word.isascii() else "".join(map(self.letters.__getitem__, word))
        return [token.id for token in self.model.tokenize(text)]

    def ids(self, chunk: bytes) -> list[int]:
        if self.plain:
            if chunk.isalpha():
                return self._word(chunk)
            if chunk[-1] in _MARKS and chunk[:-1].isalpha():
                return self._word(chunk[:-1]) + self._whole(chunk[-1:])
            text = chunk.decode(errors="replace")
            if _LETTERS.fullmatch(text):
                return self._word(text.lower().encode())
        return self._whole(chunk)

    def _whole(self, chunk: bytes) -> list[int]:
        return self.tokenizer.encode(chunk.decode(errors="replace"), add_special_tokens=False).ids


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder for a vocabulary file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class Lookup(dict):
    """Chunk to value: the frequent ones from the start, the others as they are met; never over CACHE_SIZE."""

    def __init__(self, frequent: dict, make) -> None:
        super().__init__(frequent)
        self.frequent, self.make = frequent, make

    def __missing__(self, chunk: bytes):
        if len(self) >= CACHE_SIZE:
            self.clear()
            self.update(self.frequent)
        value = self.make(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = value
        return value


def frequent_chunks(docs: DataFrame, text: str = "text", size: int = TABLE_SIZE, sample: int = SAMPLE) -> list[bytes]:
    """The most frequent chunks of about ``sample`` texts; what reaches the driver is bounded by those texts' chunks."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for (texts,) in columns_of(batches):
            for one in texts:
                seen.update(c for c in chunks(one) if len(c) <= LONGEST)
        if seen:
            top = seen.most_common(SUMMARY_SIZE)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["chunk", "n"])

    chosen = docs.select(utf8(text).alias("text")).sample(min(1.0, sample / max(docs.count(), 1)), seed=5)
    seen: Counter[bytes] = Counter()
    for row in chosen.mapInArrow(summaries, "chunk binary, n long").collect():
        seen[bytes(row.chunk)] += row.n
    return [chunk for chunk, _ in sorted(seen.items(), key=lambda c: (-c[1], c[0]))[:size]]


_lookups: dict[tuple, Lookup] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """One row for each document: id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    measure = encoder(path)
    lengths = {chunk: len(measure.ids(chunk)) for chunk in frequent_chunks(docs, text)}
    table = docs.sparkSession.sparkContext.broadcast(lengths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, id(table.value))
        if key not in _lookups:
            _lookups.clear()
            one = encoder(path)
            _lookups[key] = Lookup(table.value, lambda chunk: len(one.ids(chunk)))
        length = _lookups[key].__getitem__
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [sum(map(length, chunks(one))) for one in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), utf8(text).alias("text")).mapInArrow(
        count, f"id {kind}, n_bytes long, n_tokens long"
    )
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
