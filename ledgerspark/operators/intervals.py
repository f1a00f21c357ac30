"""Algebra of inclusive date ranges: one row for each range, ``start_date`` to ``end_date``, for each key.

Every operation is a window or an equi-join on the key; no days are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses whose whole range is known; 'gapped' is known but for its gaps; all others are unknown.
WHOLE = ("complete", "overlapping")


def merge(ranges: DataFrame, *keys: str) -> DataFrame:
    """Union of a key's ranges; those that touch, a day apart, become one."""
    order = Window.partitionBy(*keys).orderBy("start_date", "end_date")
    reach = F.max("end_date").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start_date") > F.date_add(reach, 1)), 1).otherwise(0)
    numbered = ranges.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order))
    return numbered.groupBy(*keys, "_island").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date")).drop("_island")


def known(statements: DataFrame, *keep: str, gaps_always: bool = False) -> DataFrame:
    """Known ranges of statements by status: whole, minus their ordered gaps, or none. ``gaps_always``: subtract gaps whatever the status."""
    gaps = F.col("missing")
    cut = F.lit(gaps_always) | (F.col("status") == "gapped")
    starts = F.concat(F.array("start_date"), F.transform(gaps, lambda g: F.date_add(g["end_date"], 1)))
    ends = F.concat(F.transform(gaps, lambda g: F.date_sub(g["start_date"], 1)), F.array("end_date"))
    pieces = F.arrays_zip(starts.alias("start_date"), ends.alias("end_date"))
    whole = F.array(F.struct("start_date", "end_date"))
    fits = F.lit(True) if gaps_always else F.col("status").isin(*WHOLE, "gapped")
    rows = statements.filter(fits).select(*keep, F.explode(F.when(cut, pieces).otherwise(whole)).alias("r"))
    return rows.select(*keep, "r.start_date", "r.end_date").filter("start_date <= end_date")


def clip(ranges: DataFrame, start: Column, end: Column) -> DataFrame:
    """The parts of the ranges within [start, end]."""
    clipped = ranges.withColumn("start_date", F.greatest("start_date", start)).withColumn("end_date", F.least("end_date", end))
    return clipped.filter("start_date <= end_date")


def sweep(ranges: DataFrame, *keys: str) -> DataFrame:
    """Each key's stretches between range edges: ``start_date``, ``end_date`` and how many ranges are ``active``. +1 where a range begins, -1 after it ends."""
    edges = ranges.select(*keys, F.col("start_date").alias("day"), F.lit(1).alias("step")).unionByName(
        ranges.select(*keys, F.date_add("end_date", 1).alias("day"), F.lit(-1).alias("step"))
    )
    order = Window.partitionBy(*keys).orderBy("day")
    swept = edges.groupBy(*keys, "day").agg(F.sum("step").alias("step"))
    swept = swept.withColumn("active", F.sum("step").over(order)).withColumn("end_date", F.date_sub(F.lead("day").over(order), 1))
    return swept.filter("end_date IS NOT NULL").select(*keys, F.col("day").alias("start_date"), "end_date", "active")


def in_all(ranges: DataFrame, sets: int, *keys: str) -> DataFrame:
    """Days that all of a key's ``sets`` merged range sets hold, merged: accounts covered together."""
    return merge(sweep(ranges, *keys).filter(F.col("active") >= sets).drop("active"), *keys)


def intersect(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Days in both sets of a key, merged; by a sweep over the edges of both, so ranges are never joined with ranges."""
    columns = [*keys, "start_date", "end_date"]
    return in_all(merge(left, *keys).select(columns).unionByName(merge(right, *keys).select(columns)), 2, *keys)


def complement(merged: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """Days of each key's one span (``span_start``, ``span_end``) that its merged ranges, already within the span, leave out."""
    order = Window.partitionBy(*keys).orderBy("start_date")
    both = spans.join(merged, list(keys), "left")
    before = F.coalesce(F.date_add(F.lag("end_date").over(order), 1), F.col("span_start"))
    until = F.when(F.col("start_date").isNull(), F.col("span_end")).otherwise(F.date_sub("start_date", 1))
    gaps = both.select(*keys, before.alias("gap_start"), until.alias("gap_end"))
    tails = both.groupBy(*keys).agg(F.date_add(F.max("end_date"), 1).alias("gap_start"), F.max("span_end").alias("gap_end"))
    return gaps.unionByName(tails).filter("gap_start <= gap_end").withColumnsRenamed({"gap_start": "start_date", "gap_end": "end_date"})


def overlapping_pairs(ranges: DataFrame, key: str, name: str, block: int = 32) -> DataFrame:
    """Pairs of a key's ranges that share days, the smaller ``name`` first: names, shared ``days`` and ``kind`` (exact or partial).

    Ranges meet in an equi-join on the blocks of days they touch; a pair counts in the block where its shared days begin.
    """
    at = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / block)
    touched = ranges.withColumn("_block", F.explode(F.sequence(at(F.col("start_date")), at(F.col("end_date")))))
    a, b = touched.alias("a"), touched.alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._block") == F.col("b._block")) & (F.col(f"a.{name}") < F.col(f"b.{name}")))
    first, last = F.greatest("a.start_date", "b.start_date"), F.least("a.end_date", "b.end_date")
    met = met.filter((first <= last) & (at(first) == F.col("a._block")))
    exact = (F.col("a.start_date") == F.col("b.start_date")) & (F.col("a.end_date") == F.col("b.end_date"))
    return met.select(F.col(f"a.{name}").alias("first_id"), F.col(f"b.{name}").alias("second_id"), (F.datediff(last, first) + 1).cast("long").alias("days"), F.when(exact, "exact").otherwise("partial").alias("kind"))


def days() -> Column:
    """Days of a range."""
    return F.datediff("end_date", "start_date") + 1


def indicator(ranges: DataFrame, start: Column, end: Column, accounts: int, *keys: str) -> DataFrame:
    """Day counts by class from merged ranges of each (key, account): full if all ``accounts`` cover a day, partial if some, else missing."""
    swept = sweep(clip(ranges, start, end), *keys).withColumn("n", days())
    counted = swept.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("active") >= accounts, F.col("n"))), F.lit(0)).cast("long").alias("full_days"),
        F.coalesce(F.sum(F.when((F.col("active") > 0) & (F.col("active") < accounts), F.col("n"))), F.lit(0)).cast("long").alias("partial_days"),
    )
    total = (F.datediff(end, start) + 1).cast("long")
    status = F.when(F.col("full_days") == total, "complete").when(F.col("full_days") + F.col("partial_days") > 0, "partial").otherwise("missing")
    return counted.withColumn("missing_days", total - F.col("full_days") - F.col("partial_days")).withColumn("status", status)


def statement_gaps(ranges: DataFrame, *keys: str) -> DataFrame:
    """Gaps inside the outer extent of a key's merged ranges."""
    order = Window.partitionBy(*keys).orderBy("start_date")
    after = ranges.withColumn("next", F.lead("start_date").over(order))
    return after.filter("next IS NOT NULL").select(*keys, F.date_add("end_date", 1).alias("start_date"), F.date_sub("next", 1).alias("end_date"))
