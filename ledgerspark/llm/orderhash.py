"""Document fingerprints by order min-hash, and how they change with a text's edits.

A text's k-mers of code points are numbered by occurrence, so a repeated one counts as often as it
occurs. Each of SKETCHES random orders selects the TUPLE smallest; these, put back into the order
in which they stand in the text, are hashed into one component of the fingerprint. Two texts agree
in a component if they select the same k-mers and have them in the same order: moving a passage
changes it, where a plain min-hash would not notice. The likeness of two fingerprints is the share
of components that agree.

``with_edits`` compares each text with an edited one, whose last third is replaced by the beginning
of the next document, by falling id. Texts are range-partitioned by id (repeated ids by text, too)
and sorted once; a task streams through its part with the text before at hand. What is left at the
edges, the last row of each part and the first of the next, is stored, and meets in a join of two
rows a part. Neither a part nor an edge is more than any task's share of the texts.

Nulls: a null text is empty; a null id comes last. An empty text has no k-mers, its components are
all the same fixed value, and it is like other empty texts only; one shorter than a k-mer is one
k-mer; one with fewer than TUPLE k-mers has them all in each component. Repeated rows are rows of
their own, ordered among themselves by text. The only row of a table is its own next document.
Empty tables give empty results. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.shared import staged, utf8

#: Code points of a k-mer; k-mers of a component; components.
K, TUPLE, SKETCHES = 12, 2, 64
#: K-mers looked at together: bounds the memory for one text at STRETCH * SKETCHES numbers of 4 bytes.
STRETCH = 4_096
#: Odd factors of the rolling and mixing hashes, and of the random orders: a number's rank is its product with the order's factor.
_BASE, _MIX, _TIMES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)
_FACTORS = (np.random.default_rng(12).integers(0, 1 << 31, SKETCHES, dtype=np.uint32) * 2 + 1)[:, None]
_MOST = np.uint32(0xFFFFFFFF)
_space = np.empty(SKETCHES * STRETCH, np.uint32)  # of each worker, used again for every stretch


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX ^ (x >> np.uint64(32))


def kmers(text: str) -> np.ndarray:
    """A 64-bit hash of each run of K code points; of the whole text if it is shorter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width, size = min(K, len(points)), 1
    runs, factor = {1: mixed(points + _BASE)}, np.array([_BASE])
    while 2 * size <= width:  # runs of 1, 2, 4, 8
        of = runs[size]
        runs[2 * size] = of[:-size] * factor + of[size:]
        factor, size = factor * factor, 2 * size
    out, at = None, 0  # the width as a sum of those
    for size in sorted(runs, reverse=True):
        if at + size <= width:
            part = runs[size][at : at + len(points) - width + 1]
            out = part if out is None else out * _TIMES + part
            at += size
    return mixed(out) if len(points) else np.zeros(0, np.uint64)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How often each value stood before, by sorting value and position as one number."""
    n = len(hashes)
    bits = np.uint64(max(n - 1, 1).bit_length())
    packed = np.sort((hashes >> bits << bits) | np.arange(n, dtype=np.uint64))
    at = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = packed[1:] >> bits != packed[:-1] >> bits
    starts = np.flatnonzero(new)
    out = np.empty(n, np.uint64)
    out[at] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return out


def smallest(numbers: np.ndarray) -> np.ndarray:
    """Positions of the TUPLE smallest under each order, rising: SKETCHES rows. Of equal ones the first counts."""
    every = np.arange(SKETCHES)[:, None]
    ranks, places = np.zeros((SKETCHES, 0), np.uint32), np.zeros((SKETCHES, 0), np.int64)
    for lo in range(0, len(numbers), STRETCH):
        some = numbers[lo : lo + STRETCH]
        turned = np.multiply(some, _FACTORS, out=_space[: SKETCHES * len(some)].reshape(SKETCHES, -1))
        for _ in range(min(TUPLE, turned.shape[1])):
            best = turned.argmin(1)[:, None]
            ranks, places = np.hstack([ranks, turned[every, best]]), np.hstack([places, best + lo])
            turned[every, best] = _MOST
        if places.shape[1] > TUPLE:
            kept = np.lexsort((places, ranks))[:, :TUPLE]
            ranks, places = ranks[every, kept], places[every, kept]
    return np.sort(places, axis=1)


def fingerprint(text: str) -> np.ndarray:
    """SKETCHES numbers of 16 bits; the same for the same text."""
    hashes = kmers(text)
    if not len(hashes):
        return np.zeros(SKETCHES, np.uint16)
    numbers = (mixed(hashes + occurrences(hashes) * _TIMES) >> np.uint64(32)).astype(np.uint32)
    out = np.full(SKETCHES, _BASE)
    for place in smallest(numbers).T:
        out = mixed(out * _TIMES + hashes[place])
    return (out >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def written(print_: np.ndarray) -> str:
    """Four hexadecimal digits for each component."""
    return print_.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """Its last third replaced by as many of the first code points of the text that follows, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compared(text: str, own: np.ndarray, following: str, next_print: np.ndarray) -> tuple:
    """The columns of a row but its id."""
    changed = edited(text, following)
    after = fingerprint(changed) if changed != text else own
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, written(own), written(after), likeness(own, after), likeness(own, next_print)


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_DDL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def decoded(value: pa.Scalar) -> str:
    return value.as_py().decode("utf-8", "replace")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and ``fingerprint`` of each row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [written(fingerprint(decoded(one))) for one in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), utf8(text).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id, COLUMNS: its own fingerprint, that of its edited text, and how like its own they and the next document's are."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), utf8(text).alias("text"))
    order = [F.desc_nulls_last("id"), F.xxhash64("text"), F.col("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *order[:2], F.monotonically_increasing_id()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row whose next document is still to come: id, text, its fingerprint
        for batch in batches:
            ids, found, first = batch.column("id"), [], None
            for at, one in enumerate(batch.column("text")):
                here = decoded(one)
                own = before[2] if before and before[1] == here else fingerprint(here)
                if before is None:
                    first = here
                else:
                    found.append((before[0], *compared(before[1], before[2], here, own)))
                before = ids[at].as_py(), here, own
            yield answer(batch, found, "row", None)
            if first is not None:
                yield answer(batch, [(batch.column("id")[0].as_py(), *[None] * 6)], "first", first)
        if before is not None:
            yield answer(batch, [(before[0], *[None] * 6)], "last", before[1])

    def answer(batch: pa.RecordBatch, found: list[tuple], role: str, carried: str | None) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 7
        arrays = [pa.array(columns[0], batch.schema.field("id").type), *(pa.array(c, t) for c, t in zip(columns[1:], _TYPES, strict=True))]
        carried_text = None if carried is None else carried.encode("utf-8", "surrogatepass")
        return pa.record_batch(
            [*arrays, pa.array([role] * len(found), pa.string()), pa.array([carried_text] * len(found), pa.binary())], ["id", *COLUMNS, "role", "carried"]
        )

    done = sorted_rows.mapInArrow(run, f"id {kind.simpleString()}, {_DDL}, role string, carried binary")
    stored = staged(done.withColumn("part", F.spark_partition_id()), "order-hash")
    present = sorted(r.part for r in stored.filter("role = 'first'").select("part").collect())  # a number for each partition
    edges = stored.filter("role <> 'row'")
    following = dict(zip(present, [*present[1:], *present[:1]], strict=True))
    pairs = docs.sparkSession.createDataFrame(list(following.items()), "part int, next_part int")
    firsts = edges.filter("role = 'first'").select(F.col("part").alias("next_part"), F.col("carried").alias("following"))
    last = edges.filter("role = 'last'").select("id", "part", "carried").join(F.broadcast(pairs), "part").join(firsts, "next_part")

    def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                here, there = decoded(batch.column("carried")[at]), decoded(batch.column("following")[at])
                found.append(compared(here, fingerprint(here), there, fingerprint(there)))
            columns = list(zip(*found, strict=True)) or [()] * 6
            yield pa.record_batch([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], ["id", *COLUMNS])

    resolved = last.select("id", "carried", "following").mapInArrow(at_edges, f"id {kind.simpleString()}, {_DDL}")
    return stored.filter("role = 'row'").select("id", *COLUMNS).unionByName(resolved).withColumnRenamed("id", id_col)
