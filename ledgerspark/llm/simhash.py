"""SimHash near-duplicates by the pigeonhole principle.

A fingerprint is cut into blocks: two that differ in at most DISTANCE bits agree in all blocks
but that many, so they meet in a join on the blocks that agree, where the Hamming distance is
verified. Equal fingerprints are collapsed first, so copies never meet each other.

A bucket of more than ``PAIRS_UP_TO`` fingerprints is not paired up. Its members are joined on
their neighbourhood instead: two fingerprints differ in at most 2 bits exactly if flipping at most
one bit of each gives the same value, so linking each member to the smallest one it shares such a
value with finds the same components with 65 rows for each member, whatever the bucket's size.

Links become components by alternating large-star and small-star steps, each written to the shared
folder. Only links between different fingerprints take part.

``keep_one`` has a rule of its own: texts are near copies if their sets of 5-word shingles have a
Jaccard similarity of 0.8 or more. Such texts differ in about 39 of the 256 bits of a wider
fingerprint, too many for blocks of whole bits, so a block is known by its surest bit: of BLOCK
sums of signed votes the place and sign of the largest, which small changes turn last. The sums are
random directions through the 256 votes. KEYS keys of JOINED blocks each bring candidates together,
the Hamming distance of the fingerprints is verified as above, at most APART bits, and what is left
on the exact sets: each text first with one other of its buckets, then with the first of each, then,
only where a bucket is still of several components, with the members of the others. In a bucket of
more than ``PAIRS_UP_TO`` members those must also share one of their rarest shingles, as all sets
that are alike do, so that a bucket filled by boilerplate is never paired with itself.

Nulls: a null text is empty; a text without words has fingerprint zero and is linked like any
other; a null id is never the smallest unless its component has no other. Repeated rows each give
a row. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.shared import LOWER, forget, staged, unused, utf8

#: Bits in which linked fingerprints may differ, and the bucket size up to which all pairs of a bucket are looked at.
DISTANCE, PAIRS_UP_TO = 2, 64
#: Words of 64 bits in a fingerprint of ``keep_one`` and the bits in which near copies' may differ.
WIDE, APART = 4, 80
#: Sums in a block, blocks, blocks joined to a key, and keys of a text.
BLOCK, BLOCKS, JOINED, KEYS = 64, 448, 4, 448


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64, seed 42, of each run of ``width`` words, repeats included; a shorter sequence is one run."""
    import xxhash

    if len(words) <= width:
        runs = [b" ".join(words)] if words else []
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``id`` and ``fp`` (long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(one.as_py().translate(LOWER).split(), width)) for one in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def links(distinct: DataFrame, blocks: int = 4) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs at most DISTANCE bits apart.

    ``distinct`` holds each fingerprint ``fp`` once.
    """
    width = 64 // blocks
    masks = [sum(((1 << width) - 1) << (width * i) for i in kept) for kept in combinations(range(blocks), blocks - DISTANCE)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed))))
    dealt = distinct.select("fp", keys.alias("b")).select("fp", "b.k", "b.key")
    sizes = dealt.groupBy("k", "key").count().filter("count > 1")
    shared = staged(dealt.join(sizes, ["k", "key"]), "simhash-blocks")

    small = shared.filter(F.col("count") <= PAIRS_UP_TO)
    pairs = (
        small.alias("x")
        .join(small.alias("y"), F.expr(f"x.k = y.k AND x.key = y.key AND x.fp < y.fp AND bit_count(x.fp ^ y.fp) <= {DISTANCE}"))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )

    crowded = shared.filter(F.col("count") > PAIRS_UP_TO).select("fp").distinct()
    flips = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    reach = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(f)) for f in flips)]
    near = crowded.select("fp", F.explode(F.array(*reach)).alias("near"))
    leaders = near.groupBy("near").agg(F.min("fp").alias("b"), F.count("fp").alias("n")).filter("n > 1")
    stars = near.join(leaders, "near").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of each node of the edges (a, b)."""
    now, state = staged(edges.select("a", "b"), "components"), None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select("u", "m")).distinct()
        before, now = now, staged(small, "components")
        forget(before)
        told = now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == state:
            break
        state = told
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row for each document: id, ``fp`` and ``component_id``, the smallest id reachable over links."""
    found = staged(fingerprints(docs, id_col, text, width), "fingerprints")
    distinct = staged(found.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp")))
    # each fingerprint's smallest id, then the smallest over its component
    linked = distinct.join(roots, distinct.fp == roots.node)
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    moved = linked.join(least, "root").select("fp", "component")
    final = distinct.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    final = staged(final, "simhash-final")  # stored, so that the join of a hot fingerprint's copies can be split
    return found.join(final, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def signatures(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """Each row's ``id``, ``digest`` (MD5 of the text), ``node`` (hash of its set of shingles), the set's size ``n``, its bits' ``votes`` and its fingerprint ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for one in batch.column(1):
                own = shingle_set(one.as_py(), width)
                sums = votes(own)
                fp = np.packbits(sums > 0, bitorder="little").view(np.int64).tolist()
                found.append((hashlib.md5(one.as_py(), usedforsecurity=False).digest(), node_of(own), len(own), stored(sums), fp))
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["id", "digest", "node", "n", "votes", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text).alias("text")).mapInArrow(run, f"id {kind}, digest binary, node long, n long, votes binary, fp array<long>")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text.translate(LOWER).split(), width))


def node_of(own: np.ndarray) -> int:
    import xxhash

    found = xxhash.xxh64_intdigest(own.tobytes(), 42)
    return found - (found >> 63 << 64)


def votes(own: np.ndarray) -> np.ndarray:
    """For each of WIDE * 64 bits, how many of the shingle hashes, mixed anew for each word, have it, less how many don't."""
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(own), 255):  # as many as fit a byte
        words = np.empty((len(own[at : at + 255]), WIDE), np.uint64)
        for k in range(WIDE):
            x = (own[at : at + 255] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            words[:, k] = x ^ x >> np.uint64(32)
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return 2 * ones - len(own)


def stored(sums: np.ndarray) -> bytes:
    """As 16-bit integers, in proportion if one of them is larger."""
    return np.rint(sums / max(1.0, np.abs(sums).max() / 32767)).astype(np.int16).tobytes()


@cache
def directions() -> tuple[np.ndarray, np.ndarray]:
    """The BLOCKS * BLOCK random directions, as columns, and the blocks of each key."""
    rng = np.random.default_rng(11)
    picked = np.concatenate([rng.permutation(BLOCKS).reshape(-1, JOINED) for _ in range(-(-KEYS * JOINED // BLOCKS))])[:KEYS]
    return rng.standard_normal((64 * WIDE, BLOCKS * BLOCK), np.float32), picked


def block_keys(sums: np.ndarray) -> np.ndarray:
    """Each row of votes' KEYS keys: which it is, then the surest bit, place and sign, of each of its blocks."""
    along, picked = directions()
    sure = np.empty((len(sums), BLOCKS), np.int64)
    for at in range(0, BLOCKS, 16):  # bounded memory
        some = (sums.astype(np.float32) @ along[:, at * BLOCK : (at + 16) * BLOCK]).reshape(len(sums), -1, BLOCK)
        most, least = some.argmax(2), some.argmin(2)
        up = np.take_along_axis(some, most[:, :, None], 2)[:, :, 0] >= -np.take_along_axis(some, least[:, :, None], 2)[:, :, 0]
        sure[:, at : at + 16] = np.where(up, most, BLOCK + least)
    keys = np.broadcast_to(np.arange(KEYS), (len(sums), KEYS))
    for j in range(JOINED):
        keys = keys * (2 * BLOCK) + sure[:, picked[:, j]]
    return keys


def dealt(distinct: DataFrame) -> DataFrame:
    """``node`` and ``key``, a row for each key of each node that has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):  # bounded memory
                part = batch.slice(at, 512)
                keys = block_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.int16).reshape(len(part), -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), KEYS)), pa.array(keys.ravel())], ["node", "key"])

    return distinct.filter("n > 0").select("node", "votes").mapInArrow(run, "node long, key long")


def close(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose fingerprints differ in at most APART bits, and whose sets' sizes don't rule out that they are alike."""
    of = lambda side: prints.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("fp").alias(f"fp_{side}"))
    apart = " + ".join(f"bit_count(fp_a[{i}] ^ fp_b[{i}])" for i in range(WIDE))
    fits = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(fits & F.expr(f"{apart} <= {APART}")).select("a", "b")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """Stored: ``node`` and its sorted shingle hashes ``own`` (bytes) for the nodes of ``wanted`` (id, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(one.as_py(), width) for one in batch.column(1)]
            of = [(w, own.tobytes()) for w, own in zip(batch.column(0).to_pylist(), sets, strict=True) if node_of(own) == w]  # rows may share an id
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in of], pa.int64()), pa.array([o for _, o in of], pa.binary())], ["node", "own"])

    rows = docs.select(F.col(id_col).alias("_id"), utf8(text).alias("text"))
    rows = rows.join(wanted, F.col("_id").eqNullSafe(F.col("id"))).select("node", "text")
    return staged(rows.mapInArrow(run, "node long, own binary").dropDuplicates(["node"]), "shingle-sets")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Stored: the pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both / (len(x) + len(y) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: sets.select(F.col("node").alias(side), F.col("own").alias(f"own_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "own_a", "own_b")
    return staged(both.mapInArrow(run, "a long, b long"), "alike")


def rarest(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Stored: ``node``, ``n``, ``root`` and, a row each, the rarest ``shingle``s of each node's set.

    Sets of at least ``similarity`` share a shingle among the first n - ceil(similarity * n) + 1 of each
    in any order that all follow. Here the rarest come first, so what many of the nodes have in common
    (the boilerplate that filled their bucket) brings no pairs together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, root, own in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                own = np.frombuffer(own, np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(own), one)) for one in (node, n, root)), pa.array(own)], ["node", "n", "root", "shingle"])

    each = nodes.join(sets, "node").select("node", "n", "root", "own").mapInArrow(run, "node long, n long, root long, shingle long")
    each = staged(each, "shingles-open")
    held = each.join(each.groupBy("shingle").agg(F.count("*").alias("held")), "shingle")
    place = F.row_number().over(Window.partitionBy("node").orderBy("held", "shingle"))  # one set's shingles
    found = staged(held.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).select("node", "n", "root", "shingle"), "shingles-rare")
    forget(each)
    return found


def near_groups(docs: DataFrame, id_col: str, text: str, width: int, similarity: float) -> DataFrame:
    """``id``, ``digest`` of the text and ``root`` of each row; rows with one root are reachable over pairs of texts that are ``similarity`` alike."""
    found = staged(signatures(docs, id_col, text, width), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id")).alias("first")
    distinct = staged(found.groupBy("node").agg(first, *(F.any_value(c).alias(c) for c in ("n", "votes", "fp"))), "signatures-distinct")
    prints = distinct.select("node", "n", "fp")
    bucket = Window.partitionBy("key")
    shared = dealt(distinct).withColumn("b", F.min("node").over(bucket)).withColumn("members", F.count("*").over(bucket))
    shared = staged(shared.filter("members > 1"), "buckets")
    stars = staged(close(shared.filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), prints, similarity), "stars")
    wanted = stars.select(F.col("a").alias("node")).union(stars.select("b")).union(shared.filter("members > 2").select("node")).distinct()
    wanted = distinct.join(wanted, "node").select(F.col("first.id").alias("id"), "node")
    sets = shingle_sets(docs, wanted, id_col, text, width)

    # each text with the smallest of its buckets' firsts, then with those of other components; then pairs that share a bucket but no component yet
    edges = alike(stars.groupBy("a").agg(F.min("b").alias("b")), sets, similarity)
    roots = staged(components(edges), "near-roots")
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    more = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    edges = edges.unionByName(alike(more.select("a", "b"), sets, similarity))
    roots = components(edges)
    placed = shared.filter("members > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = staged(placed.select("node", "root", "key", "b", "members"), "buckets-placed")
    mixed = placed.groupBy("key").agg((F.min("root") != F.max("root")).alias("open")).filter("open").select("key")
    open_ = staged(placed.join(mixed, "key").filter("node <> b"), "buckets-open")
    x, y = (open_.filter(F.col("members") <= PAIRS_UP_TO).alias(side) for side in "xy")
    rest = x.join(y, F.expr("x.key = y.key AND x.node < y.node AND x.root <> y.root"))
    rest = rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    crowded = open_.filter(F.col("members") > PAIRS_UP_TO).select("node", "root").distinct().join(prints.select("node", "n"), "node")
    rare = rarest(crowded.select("node", "n", "root"), sets, similarity)
    x, y = rare.alias("x"), rare.alias("y")
    met = x.join(y, F.expr("x.shingle = y.shingle AND x.node < y.node AND x.root <> y.root") & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * similarity))
    rest = rest.unionByName(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))).distinct()
    rest = staged(close(rest, prints, similarity), "bucket-pairs")
    roots = components(edges.unionByName(alike(rest, sets, similarity)))

    final = distinct.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    final = staged(final, "near-final")  # stored, so that the join of a hot text's copies can be split
    forget(shared, stars, placed, open_, rare, rest, sets)
    return found.select("id", "digest", "node").join(final, "node").select("id", "digest", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one row of each group of near copies: of those with the smallest id, the one with the smallest MD5 of its text.

    Near copies have sets of ``width``-word shingles with a Jaccard similarity of at least ``similarity``;
    all texts without words are one group. A null id comes after all others. Of repeated rows (id and
    text) that would stay, one does, with the other columns of any of them.
    """
    rows = near_groups(docs, id_col, text, width, similarity).groupBy("root", "id", "digest").count()
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest", "count")).alias("first"))
    key, id_key, copies = unused(docs, "digest", "id", "copies")
    first = staged(first.select(F.col("first.id").alias(id_key), F.col("first.digest").alias(key), F.col("first.count").alias(copies)), "near-first")
    own = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    told = lambda some: docs.join(some, docs[id_col].eqNullSafe(some[id_key]) & (own == some[key]))
    single, repeated = first.filter(F.col(copies) == 1), first.filter(F.col(copies) > 1)
    kept = told(single).select(docs["*"])
    return kept.unionByName(told(repeated).dropDuplicates([id_key, key]).select(*(docs[c] for c in docs.columns)))
