"""Exact top-k inner products with ball trees, one for each shard.

Vectors are dealt to cells by the nearest of a bounded sample of pivots, and each cell to shards of
a bounded size by hash, so a very common vector fills as many shards as it needs. A ball tree is
built over each shard once and stored. Searching streams: a task reads a shard's tree, then the
queries sent there in batches, and takes nodes in the order of their best upper bound, query times
centre plus query norm times radius, passing on to a node's children only those queries whose bound
still reaches their kth score.

A query is first searched in its own shard. The kth score found there is its floor: it goes on to
the ``NEAR`` cells with the best bounds, and with the floor tightened by them to those others whose
bound reaches it; cells below it are never visited. The queries are a stated set, met with all rows
in batches; each row's components are whole numbers, so scores are exact, and ties go to the smaller id.

Nulls: a vector that is null, or holds a null or a component that isn't finite, takes no part; a
null id likewise. A shorter vector counts as filled up with zeros. Repeated rows are rows of their
own: each is a query, and a candidate for the other. Empty tables give empty results. Scores that
may pass 2**43 are computed and compared as Python integers, slower and as exact; one that is no
64-bit integer is ranked by its value and returned as the nearest one. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.shared import staged

#: Rows of a shard, about; rows of a leaf; cells at most; cells visited before the floor is tightened.
SHARD, LEAF, CELLS, NEAR = 8_192, 128, 1_024, 4
_RANKS = 1 << 20  # above any shard's rows
_LOW, _WIDE_LOW = np.iinfo(np.int64).min, -(10**120)  # below any key


@dataclass
class Node:
    """Rows lo to hi of the tree's order, within ``radius`` of ``centre``; ``least`` is their smallest rank by id."""

    lo: int
    hi: int
    centre: np.ndarray
    radius: float
    least: int
    children: tuple[Node, ...] = ()


class BallTree:
    """Built by halving along the direction between two far points."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, wide: bool = False) -> None:
        by_id = np.lexsort((rows, ids))
        self.ids, self.rows, self.vectors = ids[by_id], rows[by_id], vectors[by_id]
        self.order = np.arange(len(ids))
        self.root = self._grow(0, len(ids))
        self.placed, self.wide = self.vectors[self.order], wide
        self.longest = float(np.sqrt((vectors**2).sum(1).max()))

    def _grow(self, lo: int, hi: int) -> Node:
        at = self.order[lo:hi]
        points = self.vectors[at]
        centre = points.mean(0)
        away = ((points - centre) ** 2).sum(1)
        node = Node(lo, hi, centre, float(np.sqrt(away.max())), int(at.min()))
        if hi - lo > LEAF and node.radius > 0:
            far = points[away.argmax()]
            axis = points[((points - far) ** 2).sum(1).argmax()] - far
            half = (hi - lo) // 2
            self.order[lo:hi] = at[np.argpartition(points @ axis, half)]
            node.children = (self._grow(lo, lo + half), self._grow(lo + half, hi))
        return node

    def scores(self, queries: np.ndarray, node: Node) -> np.ndarray:
        if self.wide:
            return whole(queries) @ whole(self.placed[node.lo : node.hi]).T
        return np.rint(queries @ self.placed[node.lo : node.hi].T).astype(np.int64)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> np.ndarray:
        """The k best keys of each query, falling; a key is score and rank (see ``key``), below ``floors`` where fewer.

        ``own``: the query's own row, left out. ``floors``: keys that the result must reach.
        """
        norms = np.sqrt((queries**2).sum(1))
        low = _WIDE_LOW if self.wide else _LOW
        best = np.full((len(queries), k), low, object if self.wide else np.int64)
        kth = floors.copy()
        position = {r: i for i, r in enumerate(self.rows)}
        mine = np.array([position.get(r, -1) for r in own])

        def bound(node: Node, some: np.ndarray) -> np.ndarray:
            slack = norms[some] * self.longest * 1e-12 + 1e-6  # for the rounding of the sums
            most = np.floor(queries[some] @ node.centre + norms[some] * node.radius * (1 + 1e-9) + slack)
            return key(whole(most) if self.wide else most.astype(np.int64), np.int64(node.least))

        every = np.arange(len(queries))
        heap = [(0, 0, self.root, every, bound(self.root, every))]
        made = 0
        while heap:
            _, _, node, some, most = heapq.heappop(heap)
            live = (most >= kth[some]).astype(bool)
            some = some[live]
            if not len(some):
                continue
            if node.children:
                for child in node.children:
                    reach = bound(child, some)
                    live = (reach >= kth[some]).astype(bool)
                    if live.any():
                        made += 1
                        heapq.heappush(heap, (-int(reach.max()), made, child, some[live], reach[live]))
                continue
            ranks = self.order[node.lo : node.hi]
            keys = key(self.scores(queries[some], node), ranks)
            keys[ranks == mine[some, None]] = low
            better = ((keys > kth[some, None]) | (keys >= floors[some, None])).astype(bool).any(1)
            some, keys = some[better], keys[better]
            if len(some):
                both = np.hstack([best[some], keys])
                best[some] = np.sort(both, axis=1)[:, -k:] if self.wide else np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                kth[some] = np.maximum(best[some].min(1), floors[some])
        return np.sort(best, axis=1)[:, ::-1]


def whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, as Python integers."""
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def key(score: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Score and rank by id in one number, larger for a larger score, then for a smaller rank."""
    return score * _RANKS + (_RANKS - 1 - rank)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, row in enumerate(column.to_pylist()):
        out[i, : len(row)] = row
    return out


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with the ``cell`` of the nearest pivot and its distance ``away``."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # CELLS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, p = matrix(batch.column("v"), shared.value.shape[1]), shared.value
            cell = ((p**2).sum(1) - 2 * v @ p.T).argmin(1)
            away = np.sqrt(((v - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(away, pa.float64())], [*batch.schema.names, "cell", "away"])

    return rows.mapInArrow(run, "id long, v array<double>, asks boolean, row long, cell long, away double")


def trees(dealt: DataFrame, width: int, wide: bool) -> DataFrame:
    """Stored: each ``shard``'s ball tree."""

    def build(shard: pa.Table) -> pa.Table:
        tree = BallTree(shard["id"].to_numpy(), shard["row"].to_numpy(), matrix(shard["v"], width), wide)
        return pa.table({"shard": shard["shard"][:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return staged(dealt.select("shard", "id", "row", "v").groupBy("shard").applyInArrow(build, "shard long, tree binary"), "topk-trees")


def searched(built: DataFrame, asked: DataFrame, k: int, width: int) -> DataFrame:
    """``query``, ``query_id``, ``vec_id``, ``score`` (as decimal digits): each query's best in the shard it is sent to that reach its floor.

    ``asked``: shard, row, id, v, floor, floor_id. A shard's tree comes before its queries, which stream past it.
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("id", "long"), ("v", "array<double>"), ("floor", "string"), ("floor_id", "long"))]
    both = built.select("shard", "tree", *none).unionByName(asked.select("shard", F.lit(None).cast("binary").alias("tree"), "row", "id", "v", "floor", "floor_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for lo, hi in zip(starts, starts[1:]):  # rows of one shard
                some = batch.slice(lo, hi - lo)
                if hi > lo and some.column("tree")[0].is_valid:
                    tree = pickle.loads(some.column("tree")[0].as_py())
                    some = some.slice(1)
                if not len(some):
                    continue
                floors = np.full(len(some), (_WIDE_LOW if tree.wide else _LOW) + 1, object if tree.wide else np.int64)
                for i, (floor, last) in enumerate(zip(some.column("floor").to_pylist(), some.column("floor_id").to_pylist(), strict=True)):
                    if floor is not None:
                        floors[i] = key(int(floor), int(np.searchsorted(tree.ids, last, "right")))
                best = tree.search(matrix(some.column("v"), width), some.column("row").to_numpy(), k, floors)
                at, place = np.nonzero((best >= floors[:, None]).astype(bool))
                found = best[at, place]
                rank = (_RANKS - 1 - found % _RANKS).astype(np.int64)
                columns = [some.column("row").to_numpy()[at], some.column("id").to_numpy()[at], tree.ids[rank]]
                scores = pa.array([str(int(x)) for x in found // _RANKS], pa.string())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), scores], ["query", "query_id", "vec_id", "score"])

    dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("row").asc_nulls_first())
    return dealt.mapInArrow(run, "query long, query_id long, vec_id long, score string")


def sent(queries: DataFrame, pivots: np.ndarray, reach: np.ndarray, width: int, most: int | None) -> DataFrame:
    """``queries`` with the ``cells`` to visit now: the ``most`` (null: all) with the best bounds that reach the floor, but those of ``done``."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, radius = shared.value
        for batch in batches:
            v = matrix(batch.column("v"), width)
            norms = np.sqrt((v**2).sum(1))[:, None]
            bound = v @ p.T + norms * radius * (1 + 1e-9) + norms * (np.abs(p).sum(1) + radius) * 1e-12 + 1e-6
            floors = np.array([-np.inf if f is None else float(f) * (1 - np.sign(float(f)) * 1e-12) for f in batch.column("floor").to_pylist()])
            cells = []
            for row, floor, done in zip(bound, floors, batch.column("done").to_pylist(), strict=True):
                order = np.argsort(-row, kind="stable")
                cells.append([int(c) for c in order[row[order] >= floor] if c not in set(done)][:most])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], [*batch.schema.names, "cells"])

    return queries.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields) + ", cells array<long>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k highest inner products of each query row with all others."""
    fine = F.col(vector).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def floored(x: Column) -> Column:  # a double of that size is whole, and beyond what floor returns
        y = x.cast("double") * scale
        return F.when(F.abs(y) >= 2.0**53, y).otherwise(F.floor(y).cast("double"))

    rows = vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector), floored).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    told = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("most")).first()
    width, wide = told.width or 0, (told.most or 0) >= 2.0**43

    wanted = min(-(-max(told.n, 1) // SHARD), CELLS)
    chosen = rows.orderBy(F.xxhash64("row"), "row").limit(4 * wanted).select("v").collect()
    pivots = np.zeros((len(chosen), width))
    for i, row in enumerate(chosen):
        pivots[i, : len(row.v)] = row.v
    pivots = np.unique(pivots, axis=0) if len(chosen) else np.zeros((1, width))
    pivots = pivots[np.random.default_rng(3).permutation(len(pivots))[:wanted]]
    placed = staged(in_cells(rows, pivots), "topk-cells")
    sizes, reach = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for row in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("reach")).collect():  # CELLS rows at most
        sizes[row.cell], reach[row.cell] = row.n, row.reach
    shards = -(-sizes // SHARD)
    first = np.cumsum(shards) - shards
    of = lambda values, cell: F.element_at(F.array(*(F.lit(int(x)).cast("long") for x in values)), (cell + 1).cast("int"))
    shard = of(first, F.col("cell")) + F.pmod(F.xxhash64("row"), of(np.maximum(shards, 1), F.col("cell")))
    dealt = staged(placed.withColumn("shard", shard.cast("long")), "topk-dealt")
    built = trees(dealt, width, wide)

    queries = dealt.filter("asks").select("row", "id", "v", F.col("shard").alias("home"))
    none, no_cells = F.lit(None).cast("string").alias("floor"), F.array().cast("array<long>").alias("done")
    best = Window.partitionBy("query").orderBy(F.desc("value"), "vec_id")

    def kept(found: DataFrame) -> DataFrame:
        return found.withColumn("value", ordered(F.col("score"))).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("value")

    found = staged(searched(built, queries.select(F.col("home").alias("shard"), "row", "id", "v", none, F.lit(None).cast("long").alias("floor_id")), k, width), "topk-found")
    visits = queries.withColumn("done", no_cells)
    for most in (NEAR, None):
        floor = kept(found).filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("floor"), F.col("vec_id").alias("floor_id"))
        visits = staged(sent(visits.join(floor, "row", "left"), pivots, reach, width, most), "topk-visits")
        cells = visits.select("*", F.explode("cells").alias("cell"))
        to = F.sequence(of(first, F.col("cell")), of(first + shards - 1, F.col("cell")))
        away = cells.select("row", "id", "v", "home", "floor", "floor_id", F.explode(to).alias("shard")).filter("shard <> home")
        found = staged(found.unionByName(searched(built, away, k, width)), "topk-found")
        visits = visits.select("row", "id", "v", "home", F.concat("done", "cells").alias("done"))
    return kept(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", as_long(F.col("score")).alias("score"))


def ordered(score: Column) -> Column:
    """What decimal digits are sorted by to follow their numbers."""
    negative = F.startswith(score, F.lit("-"))
    digits = F.ltrim(score, F.lit("-"))
    size = F.when(negative, -F.length(digits)).otherwise(F.length(digits))
    return F.struct(size, F.when(negative, F.translate(digits, "0123456789", "9876543210")).otherwise(digits))


def as_long(score: Column) -> Column:
    """The 64-bit integer nearest to decimal digits."""
    nearest = F.when(F.startswith(score, F.lit("-")), -(1 << 63)).otherwise((1 << 63) - 1)
    return F.coalesce(score.try_cast("long"), nearest)
