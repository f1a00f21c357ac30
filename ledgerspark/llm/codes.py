"""Vector codes by product quantisation, its codebooks trained by heap Lloyd over all vectors.

Vectors are cut into parts; a codebook for each part position is trained on all parts there, in
whole numbers, so every sum and distance is exact and the result doesn't depend on how rows lie.
Rows are gathered, where they lie, into blocks, each with one heap for every codebook entry. A
part's place in its entry's heap is its slack, the lower bound of its distance to the second
nearest entry less the upper bound of that to its own, set when it was last scanned. Each round
moves the entries; by triangle inequality a part's slack falls by no more than its own entry's
drift and the largest drift of the others. So the heaps are never rewritten: the drifts are added
up for each entry, keys are stored with the sum of their time, and a round pops from a heap only
the parts whose key today's sum has reached, scans them against all entries exactly, and pushes
them with new bounds. All others keep their entry without being looked at. Bounds err by less than
what is taken off for rounding, and a tie has no slack, so it is always scanned.

A block's heaps, codes and the sums of its parts for each entry form a row of a stored table, which
a round reads and writes again: a lost executor costs the blocks it was at. The sums, some
thousand whole numbers a block, are merged in a tree, and the driver gets the codebooks' new sums
only. No vector is shuffled. The table of the round before is deleted once the next is written.

Nulls: a vector that is null, or holds a null or a component that isn't finite, is dropped. A null
id stays and counts as the largest; a null label is a label. A shorter vector counts as filled up
with zeros, and so do all if their width is no multiple of the number of parts. Of equal ids the
vectors' order decides which start the codebooks; with fewer vectors than entries there are as many
entries as vectors. Repeated rows are rows of their own. Empty tables give empty results. Components
so large that distances may pass 2**53 are handled as Python integers and scanned in full, slower
and as exact; errors that are no 64-bit integers are returned as the nearest one. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.shared import filled, floored, forget, if_small, merged, nearest_long, staged, vectors_of

#: Rows of a block: bounds a task's memory, as tasks hold one block at a time.
BLOCK = 4_096


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of points from entries: doubles while they are exact, else Python integers."""
    if points.dtype == object or entries.dtype == object:
        return ((points.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(2)
    p, e = points.astype(np.float64), entries.astype(np.float64)
    return (p**2).sum(1)[:, None] - 2 * p @ e.T + (e**2).sum(1)


@dataclass
class Books:
    """Entries (position, entry, within part), and for each entry the drifts added up so far."""

    entries: np.ndarray
    drift: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.drift = np.zeros(self.entries.shape[:2])

    @property
    def wide(self) -> bool:
        return self.entries.dtype == object

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Books:
        """The entries as the floored means of their parts, unused ones as they are, and the drifts with this move."""
        used = counts > 0
        entries = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], self.entries)
        entries = entries if self.wide else entries.astype(np.int64)
        away = np.sqrt(((entries - self.entries) ** 2).sum(2).astype(np.float64))
        out = Books(entries)
        for position, each in enumerate(away):
            order = np.argsort(-each)
            others = np.full(len(each), each[order[0]])
            others[order[0]] = each[order[1]] if len(each) > 1 else 0.0
            out.drift[position] = self.drift[position] + (each + others) * (1 + 1e-9)
        return out


@dataclass
class Block:
    """Rows with their parts (position, row, within part), codes, heaps of (key, row) by position and entry, and sums for each entry."""

    ids: pa.Array
    labels: pa.Array
    parts: np.ndarray
    codes: np.ndarray
    heaps: list[list[list[tuple[float, int]]]]
    sums: np.ndarray
    counts: np.ndarray
    scanned: int = 0

    @classmethod
    def of(cls, ids: pa.Array, labels: pa.Array, parts: np.ndarray, books: Books) -> Block:
        positions, entries, width = books.entries.shape
        heaps = [[[] for _ in range(entries)] for _ in range(positions)]
        sums = np.zeros((positions, entries, width), object if books.wide else np.int64)
        out = cls(ids, labels, parts, np.full((positions, parts.shape[1]), -1, np.int16), heaps, sums, np.zeros((positions, entries), np.int64))
        for position in range(positions):
            out._scan(position, np.arange(parts.shape[1]), books)
        return out

    def assign(self, books: Books) -> None:
        """Pop the parts whose slack the drifts may have used up, and scan them."""
        self.scanned = 0
        for position, heaps in enumerate(self.heaps):
            popped = []
            for entry, heap in enumerate(heaps):
                reached = books.drift[position, entry]
                while heap and heap[0][0] <= reached:
                    popped.append(heappop(heap)[1])
            if popped:
                self._scan(position, np.array(sorted(popped)), books)

    def _scan(self, position: int, rows: np.ndarray, books: Books) -> None:
        """Exact nearest entries of some parts, which are in no heap; ties to the lower entry."""
        self.scanned += len(rows)
        points, before = self.parts[position, rows], self.codes[position, rows]
        away = squared(points, books.entries[position])
        now = away.argmin(1)
        self.codes[position, rows] = now
        for entry in np.unique(now):
            self._count(position, entry, points[(now == entry) & (before != entry)], 1)
        for entry in np.unique(before[before >= 0]):
            self._count(position, entry, points[(before == entry) & (now != entry)], -1)
        if away.shape[1] == 1:
            key = np.full(len(rows), np.inf)  # no other entry to go to
        else:
            two = np.sqrt(np.sort(away, axis=1)[:, :2].astype(np.float64))
            key = two[:, 1] - two[:, 0] - (two[:, 1] + two[:, 0]) * 1e-9 - 1e-6 + books.drift[position, now]
        heaps, fresh = self.heaps[position], np.bincount(now, minlength=len(books.entries[position]))
        whole_heap = [n > len(heap) for n, heap in zip(fresh, heaps, strict=True)]  # many newcomers: one pass orders all
        for one, row, entry in zip(key.tolist(), rows.tolist(), now.tolist(), strict=True):
            if whole_heap[entry]:
                heaps[entry].append((one, row))
            else:
                heappush(heaps[entry], (one, row))
        for entry in np.flatnonzero(whole_heap):
            heapify(heaps[entry])

    def _count(self, position: int, entry: int, points: np.ndarray, sign: int) -> None:
        self.counts[position, entry] += sign * len(points)
        self.sums[position, entry] += sign * points.sum(0)

    def errors(self, books: Books) -> list[int]:
        """Each row's squared distances from its entries, summed over the parts."""
        total = np.zeros(self.parts.shape[1], object)
        for position in range(len(self.parts)):
            away = squared(self.parts[position], books.entries[position])[np.arange(len(total)), self.codes[position]]
            total += np.array([int(x) for x in away], object)
        return nearest_long(total)


def cut(x: np.ndarray, positions: int) -> np.ndarray:
    """Rows as (position, row, within part)."""
    return x.reshape(len(x), positions, -1).transpose(1, 0, 2)


def state(df: DataFrame, name: str) -> DataFrame:
    return staged(df, f"codes-{name}")


def in_tasks(df: DataFrame, run, ddl: str) -> DataFrame:
    """``run`` over rows one at a time: a block is some MB, and a batch of Arrow rows would hold many."""
    return df.sparkSession.createDataFrame(df.rdd.mapPartitions(run), ddl)


def blocks(rows: DataFrame, scale: float, width: int, positions: int, books: Books) -> DataFrame:
    """The first state: ``block`` and ``sums``, pickled, with parts scanned in full."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                kept, vectors = vectors_of(some.column("v"))
                if len(kept):
                    x = floored(filled(vectors, width), scale)
                    take = pa.array(kept)
                    yield stored(Block.of(some.column("id").take(take), some.column("label").take(take), small(cut(x, positions), shared.value.wide), shared.value))

    return state(rows.mapInArrow(run, "block binary, sums binary, scanned long"), "0")


def small(parts: np.ndarray, wide: bool) -> np.ndarray:
    """In the least bytes that hold the numbers."""
    if wide or parts.dtype == object:
        return parts.astype(object)
    most = int(np.abs(parts).max(initial=0))
    return np.ascontiguousarray(parts, next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def stored(block: Block) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], t) for v, t in zip(row_of(block), (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["block", "sums", "scanned"])


def row_of(block: Block) -> tuple[bytes, bytes, int]:
    return pickle.dumps(block, 5), pickle.dumps((block.sums.astype(object), block.counts), 5), block.scanned


def assigned(before: DataFrame, books: Books, name: str) -> DataFrame:
    """The state after each block's parts were assigned to ``books``."""
    shared = before.sparkSession.sparkContext.broadcast(books)

    def run(rows):
        for row in rows:
            block = pickle.loads(row[0])
            block.assign(shared.value)
            yield row_of(block)

    after = state(in_tasks(before.select("block"), run, "block binary, sums binary, scanned long"), name)
    forget(before)
    return after


def totals(blocks_: DataFrame, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of all parts for each entry, exact."""
    positions, entries, width = books.entries.shape
    zero = np.zeros((positions, entries, width), object), np.zeros((positions, entries), np.int64)
    return merged(blocks_.select("sums"), lambda a, b: (a[0] + b[0], a[1] + b[1]), zero)


def first_books(rows: DataFrame, scale: float, entries: int, positions: int) -> tuple[Books | None, int, DataFrame]:
    """The codebooks that the smallest ids give, the width of vectors, and the usable rows."""
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    told = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))), F.lit(0.0))).alias("most")).first()
    if not told.width:
        return None, 0, rows
    width = -(-told.width // positions) * positions
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # a codebook's entries
    x = floored(filled([np.array(r.v, np.float64) for r in start], width), scale)
    wide = x.dtype == object or (width // positions) * (2 * (told.most * scale + 1)) ** 2 >= 2.0**53
    return Books(np.ascontiguousarray(cut(x.astype(object) if wide else x, positions).astype(object if wide else np.int64))), width, rows


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.entries.ravel()).encode()).hexdigest()


def trained(rows: DataFrame, scale: float, entries: int, positions: int, rounds: int) -> tuple[DataFrame, Books] | None:
    """The state after the last assignment, and the codebooks; None without usable vectors."""
    books, width, fine = first_books(rows, scale, entries, positions)
    if books is None:
        return None
    now = blocks(fine, scale, width, positions, books)
    for round_ in range(1, rounds + 1):
        books = books.moved(*totals(now, books))
        now = assigned(now, books, str(round_))
    return now, books


def compressed(
    vectors: DataFrame,
    positions: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: float = 4096.0,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Id, ``code`` (two hexadecimal digits a part), ``error``, ``label_error``, ``codebooks_sha256`` of each usable row."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("id", "label")}
    done = trained(rows, scale, entries, positions, rounds)
    if done is None:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    last, books = done
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(blocks_):
        for row in blocks_:
            block = pickle.loads(row[0])
            codes = [bytes(c).hex() for c in block.codes.T.astype(np.uint8)]
            yield from zip(block.ids.to_pylist(), block.labels.to_pylist(), codes, block.errors(shared.value), strict=True)

    each = in_tasks(last.select("block"), run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    each = staged(each, "codes-errors")
    forget(last)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    within = F.greatest(F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")), F.lit(-(1 << 63)).cast("decimal(38,0)")).cast("long")
    by_label = each.groupBy(F.col("label").alias("of")).agg(within.alias("label_error"))
    return (
        each.join(if_small(by_label), F.col("label").eqNullSafe(F.col("of")))
        .select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    )
