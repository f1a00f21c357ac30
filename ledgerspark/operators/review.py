"""Review of suggestions and statements: decisions are tables, and each step gives the tables as they are after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.suggestions import review


def confirm(ledger: DataFrame, suggestions: DataFrame, decisions: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger, suggestions and new audits after ``decisions`` (suggestion_id, accepted) of one moment, taken in the order of their ids; see ``suggestions.review``."""
    taken = review(ledger, suggestions, decisions.select(F.col("suggestion_id").alias("decision_id"), "suggestion_id", "accepted", at.alias("at")))
    return taken.ledger, taken.suggestions, taken.audits


def supersede(decisions: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Pending decisions of reviewed transactions become superseded."""
    seen = reviewed.select("txn_id").distinct().withColumn("_seen", F.lit(True))
    status = F.when((F.col("status") == "pending") & F.col("_seen"), "superseded").otherwise(F.col("status"))
    return decisions.join(seen, "txn_id", "left").withColumn("status", status).select(decisions.columns)


def reconciled(rows: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """``expected_closing``, ``difference`` (closing less what opening and ``movement`` make) and ``status`` of rows with both balances.

    A missing balance or an amount that could not be read (``unread``) makes it unavailable, with neither of the two.
    """
    money = lambda c: c.cast("decimal(38,2)")
    known = (F.col("unread") == 0) & F.col("opening_balance").isNotNull() & F.col("closing_balance").isNotNull()
    rows = rows.withColumn("expected_closing", F.when(known, money(F.col("opening_balance") + F.col("movement"))))
    rows = rows.withColumn("difference", money(F.col("closing_balance") - F.col("expected_closing")))
    return rows.withColumn("status", F.when(F.col("difference").isNull(), "unavailable").when(F.abs("difference") <= F.lit(tolerance).cast("decimal(18,2)"), "reconciled").otherwise("mismatch"))


def reconcile(balances: DataFrame, rows: DataFrame, key: str | list[str], tolerance: str = "0.01") -> DataFrame:
    """The ``reconciled`` balances with the sum of their rows' amounts (``movement``), zero without rows, and how many could not be read."""
    keys = [key] if isinstance(key, str) else key
    summed = rows.groupBy(*keys).agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,2)").alias("movement"), F.count_if(F.col("amount").isNull()).alias("unread"))
    both = balances.join(summed, keys, "left").na.fill({"unread": 0}).withColumn("movement", F.coalesce("movement", F.lit(0).cast("decimal(38,2)")))
    return reconciled(both, tolerance)


def violations(rows: DataFrame, coverage: DataFrame, key: str) -> DataFrame:
    """The first gate that a draft movement fails: unread date or amount, zero, outside the statement's dates, or in one of its gaps."""
    both = rows.join(coverage.select(key, "start_date", "end_date", "missing"), key, "left")
    in_gap = F.exists("missing", lambda g: F.col("txn_date").between(g["start_date"], g["end_date"]))
    rule = (
        F.when(F.col("txn_date").isNull(), "date_unread").when(F.col("amount").isNull(), "amount_unread").when(F.col("amount") == 0, "zero_amount")
        .when(~F.col("txn_date").between(F.col("start_date"), F.col("end_date")), "outside_statement").when(in_gap, "in_gap")
    )
    return both.withColumn("violation", rule).select(*rows.columns, "violation")
