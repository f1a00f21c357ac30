"""Reads of two times: the day a fact is about, and the moment it was known.

A fact counts as of a day and a knowledge cutoff if its day is no later than the day, it was
recorded by the cutoff, and the batch that brought it had, by what was known then, the status
verified. Nothing is updated in place: statuses, labels and roles are histories, and their value
at a cutoff is the last by time, then id. So an earlier report can be made again at any time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AsOf:
    """``day``: of the facts. ``known``: until when they had to be recorded."""

    day: Column
    known: Column

    def latest(self, history: DataFrame, key: str, *values: str, at: str = "at", order: str = "id") -> DataFrame:
        """Each key's ``values`` at the cutoff: the last by ``at``, then ``order``. One aggregation, combined before its shuffle."""
        last = F.max_by(F.struct(*values), F.struct(at, order)).alias("_v")
        return history.filter(F.col(at) <= self.known).groupBy(key).agg(last).select(key, *(F.col(f"_v.{v}").alias(v) for v in values))

    def verified_batches(self, statuses: DataFrame) -> DataFrame:
        """``batch_id`` of batches verified at the cutoff (``statuses``: batch_id, status, at, id)."""
        return self.latest(statuses, "batch_id", "status").filter("status = 'verified'").select("batch_id")

    def facts(self, rows: DataFrame, statuses: DataFrame, day: str, recorded: str = "recorded_at") -> DataFrame:
        """The rows (with batch_id) that count; day and recording time are filtered first, and reach the scan."""
        return rows.filter((F.col(day) <= self.day) & (F.col(recorded) <= self.known)).join(self.verified_batches(statuses), "batch_id", "left_semi")

    def elapsed_coverage(self, coverage: DataFrame, statuses: DataFrame) -> DataFrame:
        """Statements that are over by the day."""
        return self.facts(coverage, statuses, "end_date")

    def begun_coverage(self, coverage: DataFrame, statuses: DataFrame) -> DataFrame:
        """Statements that have begun by the day, as far as it: a forecast knows no later day."""
        rows = self.facts(coverage, statuses, "start_date")
        return rows.withColumn("end_date", F.least("end_date", self.day))

    def pending(self, decisions: DataFrame) -> DataFrame:
        """Decisions of the model still pending at the cutoff, with a confidence and a model version, the least sure first.

        ``decisions``: txn_id, decision_id, source, status, confidence, model_version, at. A transaction's later decision replaces its earlier ones.
        """
        last = self.latest(decisions, "txn_id", "decision_id", "source", "status", "confidence", "model_version", order="decision_id")
        return last.filter("source = 'ml_model' AND status = 'pending' AND confidence IS NOT NULL AND model_version IS NOT NULL").drop("source", "status")


def analytics_facts(rows: DataFrame, accounts: DataFrame, categories: DataFrame, members: DataFrame) -> DataFrame:
    """Ledger rows with their account's owner, their category's name if there is one, and whether they belong to a confirmed recurrence.

    ``accounts``: account_id, profile_id. ``categories``: category_id, category_name. ``members``: txn_id.
    """
    marks = members.select("txn_id").distinct().withColumn("recurring", F.lit(True))
    joined = rows.join(accounts.select("account_id", "profile_id"), "account_id").join(categories.select("category_id", "category_name"), "category_id", "left")
    return joined.join(marks, "txn_id", "left").withColumn("recurring", F.coalesce("recurring", F.lit(False)))


def recurrence_facts(facts: DataFrame) -> DataFrame:
    """The facts that a recurrence may be built on."""
    return facts.filter(~F.col("role").isin("unknown", "excluded"))
