"""Rules that rows of the ledger's tables must keep, as a ``violation`` column: the first rule a row breaks, null if none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_broken(rows: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """``rules``: (broken, name), the first one that holds counts; unknown counts as kept."""
    broken = reduce(lambda c, r: c.when(F.coalesce(r[0], F.lit(False)), r[1]), rules, F.when(F.lit(False), ""))
    return rows.withColumn("violation", broken)


def transactions(rows: DataFrame) -> DataFrame:
    """Not zero, and the sign says the direction."""
    amount, direction = F.col("amount"), F.col("direction")
    return first_broken(rows, (amount.isNull() | (amount == 0), "zero_amount"), ((amount > 0) & (direction != "inflow"), "positive_not_inflow"), ((amount < 0) & (direction != "outflow"), "negative_not_outflow"))


def coverage(rows: DataFrame) -> DataFrame:
    """Bounds in order; gaps inside them, in order, apart; a complete statement has none and a gapped one some."""
    gaps = F.col("missing")
    outside = F.exists(gaps, lambda g: (g["start_date"] < F.col("start_date")) | (g["end_date"] > F.col("end_date")))
    out_of_order = F.exists(F.zip_with(gaps, F.slice(gaps, 2, 1_000_000), lambda a, b: b["start_date"] <= a["end_date"]), lambda x: x)
    return first_broken(
        rows, (F.col("end_date") < F.col("start_date"), "end_before_start"), ((F.col("status") == "complete") & (F.size(gaps) > 0), "complete_with_gaps"),
        ((F.col("status") == "gapped") & (F.size(gaps) == 0), "gapped_without_gaps"), (outside, "gap_outside"), (out_of_order, "gaps_out_of_order"),
    )


def daily_observations(rows: DataFrame) -> DataFrame:
    """Values on covered days only, and no negative spend."""
    valued = F.col("spend").isNotNull() & F.col("rows").isNotNull()
    return first_broken(rows, ((F.col("status") == "covered") != valued, "values_do_not_fit_status"), (F.col("spend") < 0, "negative_spend"))


def weekly_targets(rows: DataFrame) -> DataFrame:
    """Monday to Sunday, nothing negative."""
    bounds = (F.weekday("week_start") != 0) | (F.datediff("week_end", "week_start") != 6)
    return first_broken(rows, (bounds, "not_monday_to_sunday"), ((F.col("target") < 0) | (F.col("known_outflow") < 0), "negative_target"))


def folds(rows: DataFrame) -> DataFrame:
    """All training weeks of a fold come before its test weeks, and there are both."""
    none = (F.size("train_weeks") == 0) | (F.size("test_weeks") == 0)
    return first_broken(rows, (none, "empty"), (F.array_max("train_weeks") >= F.array_min("test_weeks"), "training_not_before_test"))


def import_summaries(rows: DataFrame) -> DataFrame:
    """Every row read is accepted, set aside or skipped, and the listed row numbers are as many as counted."""
    sums = F.col("accepted") + F.col("probable") + F.col("exact") != F.col("rows_read")
    listed = (F.size("probable_rows") != F.col("probable")) | (F.size("exact_rows") != F.col("exact"))
    review = (F.col("status") == "needs_review") != (F.col("probable") > 0)
    return first_broken(rows, (sums, "counts_do_not_add_up"), (listed, "listed_rows_differ"), (review, "status_does_not_fit"))


def freshness(rows: DataFrame) -> DataFrame:
    """Evidence and its age go together, freshness is the newest age, a range has its length, and warnings decide the mode."""
    apart = lambda a, b: F.col(a).isNull() != F.col(b).isNull()
    length = F.datediff("coverage_end", "coverage_start") + 1
    return first_broken(
        rows, (apart("latest_txn_date", "txn_age"), "transaction_without_age"), (apart("latest_balance_date", "balance_age"), "balance_without_age"),
        (~F.col("freshness").eqNullSafe(F.least("txn_age", "balance_age")), "not_the_newest_age"),
        (F.col("coverage_end").isNull() & ((F.col("coverage_days") != 0) | F.col("coverage_age").isNotNull()), "length_without_coverage"),
        (F.col("coverage_end").isNotNull() & ((F.col("coverage_days") != length) | F.col("coverage_age").isNull()), "wrong_coverage_length"),
        ((F.col("mode") == "active_forecasting") & (F.size("warnings") > 0), "active_with_warnings"), ((F.col("mode") == "archive") & (F.size("warnings") == 0), "archive_without_warnings"),
    )


def suggestions(rows: DataFrame) -> DataFrame:
    """A transfer has a transfer role and, if paired, the opposite one for another row; other kinds have their own role and no counterpart; only reviewed ones have a time."""
    transfer, paired = F.col("kind") == "transfer", F.col("counterpart_id").isNotNull()
    return first_broken(
        rows, (F.col("counterpart_id") == F.col("txn_id"), "paired_with_itself"), (transfer & ~F.col("suggested_role").isin("transfer_in", "transfer_out"), "transfer_without_transfer_role"),
        (transfer & (paired != F.col("counterpart_role").isNotNull()), "half_a_pair"), (transfer & paired & (F.col("counterpart_role") == F.col("suggested_role")), "same_role_twice"),
        (~transfer & (paired | F.col("counterpart_role").isNotNull()), "counterpart_of_a_single_row"), (~transfer & (F.col("suggested_role") != F.col("kind")), "role_does_not_fit_kind"),
        ((F.col("status") == "pending") == F.col("reviewed_at").isNotNull(), "review_time_does_not_fit_status"),
    )


def holdouts(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys that are in both parts: a split has none."""
    return train.select(key).distinct().join(test.select(key).distinct(), key, "left_semi").withColumn("violation", F.lit("in_both_parts"))


def currencies(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows whose currency is not their account's, and accounts of a profile with several currencies."""
    many = accounts.groupBy("profile_id").agg(F.count_distinct("currency").alias("n"))
    both = rows.join(accounts.select("account_id", "profile_id", F.col("currency").alias("_own")), "account_id").join(many, "profile_id")
    return first_broken(both, (F.col("currency") != F.col("_own"), "not_the_accounts_currency"), (F.col("n") > 1, "several_currencies")).drop("_own", "n")


def recurrences(rows: DataFrame) -> DataFrame:
    """Dates of a series in order and each once, the next one after the last, the confidence within 0 and 1."""
    ordered = F.array_sort(F.array_distinct("dates")) == F.col("dates")
    return first_broken(rows, (~ordered, "dates_out_of_order"), (F.col("next_date") <= F.array_max("dates"), "next_date_not_later"), (~F.col("confidence").between(0, 1), "confidence_out_of_range"))


def review_bindings(rows: DataFrame, key: str) -> DataFrame:
    """Reviews (``key``) whose rows name more than one file, account or currency."""
    counts = rows.groupBy(key).agg(*(F.count_distinct(c).alias(c) for c in ("file_hash", "account_id", "currency")))
    return first_broken(counts, *((F.col(c) > 1, f"several_{c}") for c in ("file_hash", "account_id", "currency"))).select(key, "violation")


def reconciliations(rows: DataFrame) -> DataFrame:
    """The difference is closing less opening and movement, and the status says whether it is within a penny."""
    off = F.col("closing_balance") - F.col("opening_balance") - F.col("movement")
    fits = F.when(F.col("difference").isNull(), "unavailable").when(F.abs("difference") <= 0.01, "reconciled").otherwise("mismatch")
    return first_broken(rows, (~F.col("difference").eqNullSafe(off), "wrong_difference"), (F.col("status") != fits, "status_does_not_fit"))


def observation_dates(rows: DataFrame) -> DataFrame:
    """A balance entered by hand is of the day it is recorded, or earlier."""
    return first_broken(rows, ((F.col("source") == "manual") & (F.col("as_of_date") > F.col("recorded_on")), "observed_after_recording"))


def statement_balances(rows: DataFrame) -> DataFrame:
    """A statement's parsed balances are among its evidence, and those confirmed are of the fields that its evidence names.

    ``evidence``: an array of structs of field (opening or closing) and amount, null where it could not be read. ``opening_balance``,
    ``closing_balance``: parsed, or null. ``confirmed``: a struct of both as the user confirmed them, null if not at all.
    """
    # one side as (field, amount) pairs: sets are compared as arrays without order or repeats
    pair = lambda field, amount: F.when(amount.isNotNull(), F.struct(F.lit(field).alias("field"), amount.cast("decimal(18,2)").alias("amount")))
    parsed = F.array_compact(F.array(pair("opening", F.col("opening_balance")), pair("closing", F.col("closing_balance"))))
    read = F.transform(F.filter("evidence", lambda e: e["amount"].isNotNull()), lambda e: F.struct(e["field"].alias("field"), e["amount"].cast("decimal(18,2)").alias("amount")))
    named = F.array_distinct(F.transform("evidence", lambda e: e["field"]))
    told = F.array_compact(F.array(*(F.when(F.col(f"confirmed.{f}").isNotNull(), F.lit(f)) for f in ("opening", "closing"))))
    differ = (F.size(F.array_except(told, named)) > 0) | (F.size(F.array_except(named, told)) > 0)
    return first_broken(
        rows, (F.size(F.array_except(parsed, read)) > 0, "balance_evidence_missing"), ((F.size(named) == 0) & F.col("confirmed").isNotNull(), "unexpected_balance_confirmation"),
        ((F.size(named) > 0) & F.col("confirmed").isNull(), "balances_unconfirmed"), ((F.size(named) > 0) & differ, "balance_fields_changed"),
    )


def confusion_matrices(rows: DataFrame) -> DataFrame:
    """``labels`` once each, ``matrix`` square over them without negative counts, and ``classes`` (category_id, support) in their order with the rows' sums."""
    size = F.size("labels")
    sums = F.transform("matrix", lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x))
    return first_broken(
        rows, (F.size(F.array_distinct("labels")) != size, "labels_not_unique"), ((F.size("matrix") != size) | F.exists("matrix", lambda r: F.size(r) != size), "matrix_not_square"),
        (F.exists("matrix", lambda r: F.exists(r, lambda x: x < 0)), "negative_count"), (F.transform("classes", lambda c: c["category_id"]) != F.col("labels"), "classes_not_in_label_order"),
        (F.transform("classes", lambda c: c["support"].cast("long")) != sums, "support_differs"),
    )


def evaluations(rows: DataFrame) -> DataFrame:
    """Dates of both parts in order, training before test where the split is by time, and both models' matrices over all test rows, the same ones.

    ``train_start``, ``train_end``, ``test_start``, ``test_end``, ``kind``, ``test_rows``, ``candidate`` and ``baseline`` (arrays of arrays of counts).
    """
    each = lambda c: F.transform(c, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x))
    total = lambda c: F.aggregate(each(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return first_broken(
        rows, (F.col("train_end") < F.col("train_start"), "training_dates"), (F.col("test_end") < F.col("test_start"), "test_dates"),
        ((F.col("kind") == "chronological") & (F.col("train_end") >= F.col("test_start")), "training_not_before_test"), (total("candidate") != F.col("test_rows"), "candidate_not_all_rows"),
        (total("baseline") != F.col("test_rows"), "baseline_not_all_rows"), (each("candidate") != each("baseline"), "different_test_rows"),
    )
