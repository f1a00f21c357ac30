"""Approval of reviewed statements: gates in order, decisions on rows, and the rows and balances that come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import normalise as nm


def decided(rows: DataFrame, decisions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Statement rows with their decision and what it makes of date and amount.

    A correction's date and amount count; else an ambiguous slash date is read in the approval's
    format. ``rows``: statement_id, row_id, date_text, txn_date, amount, account_id, needs_review.
    """
    own = decisions.select("row_id", "decision", F.col("txn_date").alias("_date"), F.col("amount").alias("_amount"), F.col("account_id").alias("_account"))
    both = rows.join(own, "row_id", "left").join(approvals.select("statement_id", "date_format"), "statement_id", "left")
    corrected = F.col("_date").isNotNull() & ~F.col("_date").eqNullSafe(F.col("txn_date"))
    read, conflict = nm.confirmed_date(F.col("date_text"), F.col("date_format"))
    again = nm.ambiguous_date(F.col("date_text")) & ~corrected
    date = F.when(again, read).otherwise(F.coalesce("_date", "txn_date"))
    fault = F.when(F.col("needs_review") & F.col("decision").isNull(), "uncertain_row_unresolved")
    kept = F.coalesce(F.col("decision") != "reject", F.lit(True))
    fault = fault.when(kept & ~F.coalesce("_account", "account_id").eqNullSafe(F.col("account_id")), "protected_field_changed").when(kept & again & F.col("date_format").isNotNull(), conflict)
    return both.select("statement_id", "row_id", "account_id", "decision", date.alias("txn_date"), F.coalesce("_amount", "amount").alias("amount"), kept.alias("kept"), nm.ambiguous_date(F.col("date_text")).alias("ambiguous"), fault.alias("row_fault"))


def gates(statements: DataFrame, approvals: DataFrame, rows: DataFrame, decisions: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Each statement's first fault, null if it is approved, its rows approved and rejected, and the balance's difference.

    In order: another file, an unconfirmed date format or sign, a decision that is repeated or on an
    unknown row, an undecided uncertain row, a protected field changed, a date that does not fit the format, a row without
    amount, a row outside the statement's dates or in a gap, a difference that was not acknowledged.
    """
    of = decisions.groupBy("row_id").agg(F.count("*").alias("times"))
    named = rows.select("row_id", "statement_id")
    repeated = of.filter("times > 1").join(named, "row_id").groupBy("statement_id").agg(F.lit(True).alias("repeated"))
    unknown = decisions.join(named.select("row_id"), "row_id", "left_anti").groupBy("statement_id").agg(F.lit(True).alias("unknown"))
    final = decided(rows, decisions.dropDuplicates(["row_id"]), approvals).join(statements.select("statement_id", "start_date", "end_date", "missing"), "statement_id")
    outside = ~F.col("txn_date").between(F.col("start_date"), F.col("end_date")) | F.exists("missing", lambda g: F.col("txn_date").between(g["start_date"], g["end_date"]))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    fault = lambda name: any_of(F.col("row_fault") == name).alias(name)
    kept = F.col("kept")
    summed = final.groupBy("statement_id").agg(
        fault("uncertain_row_unresolved"), fault("protected_field_changed"), fault("date_format_conflict"), any_of(kept & (F.col("amount").isNull() | (F.col("amount") == 0) | F.col("txn_date").isNull())).alias("incomplete"),
        any_of(kept & outside).alias("outside"), any_of(F.col("ambiguous")).alias("ambiguous"), F.count_if(kept).alias("approved"), F.count_if(~kept).alias("rejected"), F.sum(F.when(kept, F.col("amount"))).cast("decimal(38,2)").alias("movement"),
    )
    said = approvals.select("statement_id", F.col("file_hash").alias("_hash"), "date_format", "sign_confirmed", "acknowledged")
    both = statements.join(said, "statement_id").join(summed, "statement_id", "left").join(repeated, "statement_id", "left").join(unknown, "statement_id", "left")
    both = both.na.fill(False, ["repeated", "unknown", "uncertain_row_unresolved", "protected_field_changed", "date_format_conflict", "incomplete", "outside", "ambiguous"]).na.fill(0, ["approved", "rejected"])
    gap = (F.col("closing_balance") - F.col("opening_balance") - F.coalesce("movement", F.lit(0))).cast("decimal(38,2)")
    both = both.withColumn("difference", gap)
    first = (
        F.when(F.col("_hash") != F.col("file_hash"), "file_changed").when(F.col("ambiguous") & F.col("date_format").isNull(), "date_format_unconfirmed").when(F.col("uses_debit_credit") & ~F.col("sign_confirmed"), "sign_convention_unconfirmed")
        .when(F.col("repeated"), "repeated_decision").when(F.col("unknown"), "unknown_row").when(F.col("uncertain_row_unresolved"), "uncertain_row_unresolved").when(F.col("protected_field_changed"), "protected_field_changed")
        .when(F.col("date_format_conflict"), "date_format_conflict").when(F.col("incomplete"), "incomplete_row").when(F.col("outside"), "outside_coverage")
        .when((F.abs("difference") > F.lit(tolerance).cast("decimal(18,2)")) & ~F.col("acknowledged"), "balance_mismatch_unacknowledged")
    )
    return both.select("statement_id", first.alias("fault"), "approved", "rejected", "difference")


def approved_rows(statements: DataFrame, approvals: DataFrame, rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of statements that pass every gate and were not rejected."""
    passed = gates(statements, approvals, rows, decisions).filter("fault IS NULL").select("statement_id")
    return decided(rows, decisions, approvals).filter("kept").join(passed, "statement_id", "left_semi").select("statement_id", "row_id", "account_id", "txn_date", "amount")


def statement_snapshots(statements: DataFrame) -> DataFrame:
    """Opening and closing balances of approved statements as observations of their first and last day."""
    each = F.explode(F.array(F.struct(F.col("start_date").alias("as_of_date"), F.col("opening_balance").alias("balance"), F.lit("statement_opening").alias("source")), F.struct(F.col("end_date").alias("as_of_date"), F.col("closing_balance").alias("balance"), F.lit("statement_closing").alias("source"))))
    return statements.select("statement_id", "account_id", each.alias("s")).select("statement_id", "account_id", "s.*").filter("balance IS NOT NULL")


def direct_review(ledger: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger and audits after actions (``txn_id``, ``action``): each gives its role where the sign allows it; ``needs_review`` changes nothing but is flagged."""
    both = ledger.join(actions, "txn_id", "left").withColumn("_role", nm.role_for_action(F.col("action"), F.col("amount")))
    fits = F.col("_role").isNotNull() & nm.role_sign_violation(F.col("_role"), F.col("amount")).isNull()
    changed = both.filter(fits & (F.col("_role") != F.col("role")))
    audits = changed.select("txn_id", F.col("role").alias("previous_role"), F.col("_role").alias("new_role"))
    return both.withColumn("role", F.when(fits, F.col("_role")).otherwise(F.col("role"))).withColumn("flagged", F.coalesce(F.col("action") == "needs_review", F.lit(False))).select(*ledger.columns, "flagged"), audits
