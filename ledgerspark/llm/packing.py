"""Bounded-space online packing of documents into training sequences.

Each partition keeps a fixed number of open windows. A document's tokens go, whole, into the open
window that they fill best; a document that fills a sequence by itself is cut there first. When no
window has room and no more may be opened, the fullest window is topped up with the document's
first tokens and emitted, so that a window leaves full. What is open at a partition's end is merged
there into full sequences and one remainder, and the remainders of ``GROUP`` partitions at a time
are merged in a second step; what is left then is cut into sequences whose length is a power of
two, which need no padding. Memory is the open windows alone, and only the remainders, less than one sequence
for each partition, are shuffled.

Nulls: a null text is empty, and such a document is the end id alone; a null id is carried along.
Repeated rows are packed each by itself. An empty table gives an empty result. Other columns of
the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.shared import staged, utf8
from ledgerspark.llm.tokens import Lookup, chunks, encoder

OPEN_WINDOWS, GROUP = 64, 64
_lookups: dict[str, Lookup] = {}


def token_ids(path: str) -> Lookup:
    """This worker's cache of chunk to ids, as little-endian unsigned 32-bit bytes."""
    if path not in _lookups:
        one = encoder(path)

        def make(chunk: bytes) -> bytes:
            ids = one.ids(chunk)
            return struct.pack(f"<{len(ids)}I", *ids)

        _lookups[path] = Lookup({}, make)
    return _lookups[path]


@dataclass
class Piece:
    """Consecutive ids of one document."""

    doc_id: object
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens),
            Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens),
        )


@dataclass
class Window:
    """A sequence being filled."""

    free: int
    pieces: list[Piece] = field(default_factory=list)

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.free -= len(piece)


class Packer:
    """The open windows of one task."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.open: list[Window] = []
        self.full: list[list[Piece]] = []

    def place(self, piece: Piece) -> None:
        while len(piece) >= self.capacity:
            whole, piece = piece.cut(self.capacity)
            self.full.append([whole])
        if not len(piece):
            return
        fits = [w for w in self.open if w.free >= len(piece)]
        if fits:
            window = min(fits, key=lambda w: w.free)
        elif len(self.open) < self.most:
            window = Window(self.capacity)
            self.open.append(window)
        else:
            window = min(self.open, key=lambda w: w.free)
            first, rest = piece.cut(window.free)
            self._add(window, first)
            self.place(rest)
            return
        self._add(window, piece)

    def _add(self, window: Window, piece: Piece) -> None:
        window.put(piece)
        if not window.free:
            self.open.remove(window)
            self.full.append(window.pieces)

    def close(self) -> list[Piece]:
        """Merge the open windows, the fullest first; the pieces of the one that stays below capacity are returned."""
        left, self.open = sorted(self.open, key=lambda w: w.free), []
        merged = Window(self.capacity)
        for piece in (p for w in left for p in w.pieces):
            while len(piece) >= merged.free:
                first, piece = piece.cut(merged.free)
                merged.put(first)
                self.full.append(merged.pieces)
                merged = Window(self.capacity)
            if len(piece):
                merged.put(piece)
        return merged.pieces


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Cut the pieces, in order, into sequences whose lengths are the powers of two in their sum, the largest first."""
    total = sum(map(len, pieces))
    rest = list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        room, out = total & (1 << bit), []
        while room:
            first, after = (piece := rest.pop()).cut(min(room, len(piece)))
            out.append(first)
            room -= len(first)
            if len(after):
                rest.append(after)
        if out:
            yield out


def _rows(sequence: list[Piece], sequence_id: int) -> Iterator[tuple]:
    offset = 0
    for p in sequence:
        yield p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, sequence_id, offset
        offset += len(p)


_COLUMNS = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """One row for each piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    kind = docs.schema[id_col].dataType
    end = struct.pack("<I", end_id)
    pieces_schema = f"id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, made = Packer(capacity, open_windows), 0
        ids_of = token_ids(path).__getitem__

        def out(rows: list[tuple], parts: list, ids: list, id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
                + [pa.array(parts, pa.int64()), pa.array(ids, pa.binary())],
                [*_COLUMNS, "part", "ids"],
            )

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = b"".join(map(ids_of, chunks(one))) + end
                packer.place(Piece(doc_id, 0, ids, len(ids) // 4))
            rows = [r for k, s in enumerate(packer.full, made) for r in _rows(s, part << 40 | k)]
            made, packer.full = made + len(packer.full), []
            yield out(rows, [None] * len(rows), [None] * len(rows), id_type)
        left = packer.close()
        rows = [r for k, s in enumerate(packer.full, made) for r in _rows(s, part << 40 | k)]
        rest = [(p.doc_id, p.start, len(p), 0, p.doc_tokens, 0, 0) for p in left]
        if rows or rest:
            yield out(rows + rest, [None] * len(rows) + [part] * len(rest), [None] * len(rows) + [p.ids for p in left], id_type)

    placed = staged(
        docs.select(F.col(id_col).alias("id"), utf8(text).alias("text")).mapInArrow(first, f"{pieces_schema}, part long, ids binary"),
        "packed",
    )

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("doc_tokens", "ascending"), ("start", "ascending")])
        packer = Packer(capacity, 1)
        for row in table.select(["id", "start", "ids", "doc_tokens"]).to_pylist():
            packer.place(Piece(row["id"], row["start"], row["ids"], row["doc_tokens"]))
        left = packer.close()
        sequences = [*packer.full, *powers_of_two(left)]
        rows = [r for k, s in enumerate(sequences) for r in _rows(s, 1 << 62 | key[0].as_py() << 20 | k)]
        columns = list(zip(*rows, strict=True))
        return pa.table({n: pa.array(c, table.schema.field("id").type if n == "id" else pa.int64()) for n, c in zip(_COLUMNS, columns, strict=True)})

    left = placed.filter("part IS NOT NULL")
    merged = left.groupBy(F.floor(F.col("part") / GROUP)).applyInArrow(merge, pieces_schema)
    done = placed.filter("part IS NULL").drop("part", "ids")
    return done.unionByName(merged).withColumnRenamed("id", id_col)
