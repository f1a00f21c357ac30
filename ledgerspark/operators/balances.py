"""Latest balances, balance history by coverage island, and freshness of an account's data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators.contracts import first_broken
from ledgerspark.sources.store import Rejected, Store, Version

PRIORITY = {"manual": 4, "statement_closing": 3, "running_balance": 2, "statement_opening": 1}


def priority() -> Column:
    out = F.lit(0)
    for source, rank in PRIORITY.items():
        out = F.when(F.col("source") == source, rank).otherwise(out)
    return out


def latest(balances: DataFrame, as_of: Column) -> DataFrame:
    """Each account's newest verified balance: by date, source priority, id. One aggregation, no sort."""
    rows = balances.filter(F.col("verified") & (F.col("as_of_date") <= as_of))
    best = F.max(F.struct("as_of_date", priority().alias("p"), "snapshot_id", "balance", "source")).alias("b")
    return rows.groupBy("account_id").agg(best).select("account_id", "b.as_of_date", "b.snapshot_id", "b.balance", "b.source")


def daily_pick(balances: DataFrame) -> DataFrame:
    """One verified balance for each account and day, by source priority, then id."""
    best = F.max(F.struct(priority().alias("p"), "snapshot_id", "balance", "source")).alias("b")
    return balances.filter("verified").groupBy("account_id", "as_of_date").agg(best).select("account_id", "as_of_date", "b.snapshot_id", "b.balance", "b.source")


def history(picked: DataFrame, islands: DataFrame) -> DataFrame:
    """Each point with its segment: the coverage island it lies in, else a segment of its own.

    The island that can hold a point is the last one that starts no later: a running maximum over
    points and islands in date order, so nothing is joined by range.
    """
    points = picked.select("account_id", F.col("as_of_date").alias("day"), F.lit(1).alias("is_point"), "snapshot_id", "balance", F.lit(None).cast("struct<s:date,e:date>").alias("island"))
    edges = islands.select("account_id", F.col("start_date").alias("day"), F.lit(0).alias("is_point"), F.lit(None).cast("long").alias("snapshot_id"), F.lit(None).cast("decimal(18,2)").alias("balance"), F.struct(F.col("start_date").alias("s"), F.col("end_date").alias("e")).alias("island"))
    order = Window.partitionBy("account_id").orderBy("day", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    rows = points.unionByName(edges).withColumn("at", F.last("island", ignorenulls=True).over(order)).filter("is_point = 1")
    segment = F.when(F.col("at.e") >= F.col("day"), F.col("at.s"))
    return rows.select("account_id", F.col("day").alias("as_of_date"), "snapshot_id", "balance", segment.alias("segment_start"))


def freshness(ledger: DataFrame, newest: DataFrame, islands: DataFrame, as_of: Column, transaction_age: int, balance_age: int, coverage_age: int, island_days: int) -> DataFrame:
    """Ages of the evidence of each account, its last coverage island, and ``mode``: archive if anything warns."""
    txn = ledger.filter(F.col("txn_date") <= as_of).groupBy("account_id").agg(F.max("txn_date").alias("last_txn"))
    last = islands.groupBy("account_id").agg(F.max(F.struct("end_date", "start_date")).alias("i"))
    both = txn.join(newest.select("account_id", F.col("as_of_date").alias("last_balance")), "account_id", "full").join(last, "account_id", "full")
    age = lambda c: F.datediff(as_of, c).cast("long")
    rows = both.select(
        "account_id", age("last_txn").alias("transaction_age"), age("last_balance").alias("balance_age"), age("i.end_date").alias("coverage_age"),
        (F.datediff("i.end_date", "i.start_date") + 1).cast("long").alias("island_days"),
    )
    checks = [
        F.when(F.col("transaction_age").isNull(), "no_transactions").when(F.col("transaction_age") > transaction_age, "transactions_stale"),
        F.when(F.col("balance_age").isNull(), "no_balance").when(F.col("balance_age") > balance_age, "balance_stale"),
        F.when(F.col("coverage_age").isNull(), "no_coverage").when(F.col("coverage_age") > coverage_age, "coverage_stale"),
        F.when(F.col("island_days") < island_days, "coverage_short"),
    ]
    rows = rows.withColumn("freshness", F.least("transaction_age", "balance_age")).withColumn("warnings", F.array_join(F.array_compact(F.array(*checks)), ","))
    return rows.withColumn("mode", F.when(F.col("warnings") == "", "active").otherwise("archive"))


def manual_entries(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balances that a user enters, each with the first reason against it (``violation``): a day after its recording, then its account.

    ``entries``: account_id, balance, currency, as_of_date, recorded_at. ``accounts``: account_id, currency, active.
    """
    own = accounts.select("account_id", F.col("currency").alias("_currency"), F.col("active").alias("_active"), F.lit(True).alias("_exists"))
    return first_broken(
        entries.join(own, "account_id", "left"), (F.col("as_of_date") > F.col("recorded_at").cast("date"), "as_of_date_after_recording"), (F.col("_exists").isNull(), "account_not_found"),
        (~F.col("_active"), "account_inactive"), (F.col("_currency") != F.col("currency"), "account_currency_mismatch"),
    ).drop("_currency", "_active", "_exists")


def manual_snapshots(judged: DataFrame) -> DataFrame:
    """The entries that hold, as verified snapshots that no import brought."""
    return judged.filter("violation IS NULL").drop("violation").withColumns({"import_batch_id": F.lit(None).cast("long"), "source": F.lit("manual"), "verification_status": F.lit("verified")})


def record_manual(store: Store, entries: DataFrame) -> Version:
    """Append the entries to the store's balances, all of them or, if one doesn't hold, none."""

    def step(now: Version) -> dict:
        judged = manual_entries(entries, now.read("accounts"))
        if judged.filter("violation IS NOT NULL").limit(1).count():
            raise Rejected("an entry breaks a rule; see manual_entries")
        return {"append": {"balances": manual_snapshots(judged)}, "info": {"operation": "manual balances"}}

    return store.update(step)
