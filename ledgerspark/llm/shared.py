"""Helpers that several corpus operators use: staged tables, tree merges, vectors as whole numbers and byte-level word splitting."""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is. Non-ASCII letters keep their case, as the contracts ask.
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))

#: Rows up to which a counted side is broadcast.
SMALL = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without that setting gets ``/tmp/checkpoints``; a cluster without it is an
    error, because a machine-local folder would lose the table with its executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


#: Folders of this session's staged tables that still exist.
_staged: set[str] = set()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.add(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads from now on."""
    for table in tables:
        folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
        _delete(table.sparkSession, [p for p in _staged if any(folder.endswith(p.split(":")[-1]) for folder in folders)])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _staged.discard(path)


def clear(spark: SparkSession) -> None:
    """Delete all staged tables of this session, once its results are written: they can't be read afterwards."""
    _delete(spark, list(_staged))


def if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """With a broadcast hint if it has at most ``rows`` rows, counted; as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores before it as no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def utf8(column: str) -> Column:
    """The text as UTF-8 bytes, null as empty, so that Python workers never decode it."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, ...]]:
    """Each batch as plain Python lists, one for each column."""
    for batch in batches:
        yield tuple(column.to_pylist() for column in batch.columns)


def merged(partials: DataFrame, combine, zero, fan_in: int = 16):
    """The pickled values of the only column, combined two at a time in a tree over the executors; ``zero`` if there are none.

    Rounds of merging go on until at most about ``fan_in`` values are left for the driver, whatever the number of partitions.
    """
    values = partials.rdd.map(lambda row: pickle.loads(row[0]))
    depth = max(2, math.ceil(math.log(max(values.getNumPartitions(), 2), fan_in)))
    return values.treeAggregate(zero, combine, combine, depth)


def vectors_of(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of the usable vectors in a list column and those vectors as doubles; null, null-holding and non-finite ones are left out."""
    ends, flat = column.offsets.to_numpy(), column.values
    entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    kept, out = [], []
    for at, fine in enumerate(column.is_valid().to_numpy(zero_copy_only=False)):
        one = entries[ends[at] : ends[at + 1]]
        if fine and np.isfinite(one).all():
            kept.append(at)
            out.append(one)
    return np.array(kept, np.int64), out


def filled(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """The vectors as rows of a matrix, shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, one in enumerate(vectors):
        out[i, : len(one)] = one
    return out


def floored(values: np.ndarray, scale: float, add: int = 0) -> np.ndarray:
    """floor(scale * values) + add, exact: 64-bit integers, or Python integers (dtype object) if one of them passes 2**53."""
    scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**53:
        return scaled.astype(np.int64) + add
    whole = [int(x * Fraction(scale) // 1) if not math.isfinite(y) else int(y) for x, y in zip(map(Fraction, values.ravel().tolist()), scaled.ravel().tolist(), strict=True)]
    return np.array(whole, object).reshape(values.shape) + add


def nearest_long(values: np.ndarray) -> list[int]:
    """Each whole number, or the 64-bit integer nearest to it."""
    return [min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in values]
