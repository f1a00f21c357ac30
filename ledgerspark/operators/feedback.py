"""Category feedback: one stream of the user's decisions folded into corrections, rules, decisions and the ledger.

``judge`` says of each feedback row whether it holds and what it changes; that log is all that the
tables follow from, so it is stored first and read by them. Feedback is known by its id: what is in
the log already is not judged again, and so a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions import text as tx
from ledgerspark.operators.contracts import first_broken
from ledgerspark.sources.store import Store, Version

#: What a new rule holds besides its category; null where it does not ask.
RULE = "rule_id string, merchant string, direction string, account_id long, phrase string, least double, most double, priority int"
LOG = ("feedback_id", "profile_id", "txn_id", "category_id", "corrected_at", "rule", "violation", "previous_category", "first")


def judge(feedback: DataFrame, ledger: DataFrame, accounts: DataFrame, categories: DataFrame, rules: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """LOG of the feedback that the log doesn't hold: the first reason against it, the category before it, and whether it is the transaction's first.

    ``feedback``: feedback_id, profile_id, txn_id, category_id, corrected_at and ``rule`` (a struct of RULE, null without a new
    rule). ``ledger``: txn_id, account_id, merchant, category_id; ``accounts``: account_id, profile_id; ``categories``: category_id, active;
    ``rules``: rule_id. Of several that make the same rule the first by time, then id, holds.
    """
    fresh = feedback.dropDuplicates(["feedback_id"])
    if log is not None:
        fresh = fresh.join(log.select("feedback_id"), "feedback_id", "left_anti")
    owned = ledger.join(accounts.select("account_id", F.col("profile_id").alias("_owner")), "account_id").select(
        "txn_id", "_owner", F.col("account_id").alias("_account"), F.col("merchant").alias("_merchant"), F.col("category_id").alias("_before")
    )
    usable = categories.filter("active").select("category_id", F.lit(True).alias("_usable"))
    taken = rules.select(F.col("rule_id").alias("_taken")).distinct()
    both = fresh.join(owned, "txn_id", "left").join(usable, "category_id", "left").join(taken, F.col("rule.rule_id") == F.col("_taken"), "left")
    makes = F.col("rule").isNotNull()
    other_shop = ~tx.rule_text(F.col("_merchant")).eqNullSafe(tx.rule_text(F.col("rule.merchant"))) | F.col("_merchant").isNull()
    told = first_broken(
        both, (~F.col("_owner").eqNullSafe(F.col("profile_id")), "transaction_scope_not_found"), (F.col("_usable").isNull(), "category_not_found"),
        (makes & (other_shop | (F.col("rule.account_id").isNotNull() & (F.col("rule.account_id") != F.col("_account")))), "feedback_rule_mismatch"),
        (makes & F.col("_taken").isNotNull(), "personal_rule_conflict"),
    )
    holds = F.col("violation").isNull()
    turn = Window.partitionBy(F.col("rule.rule_id"), F.when(holds & makes, 0).otherwise(F.xxhash64("feedback_id"))).orderBy("corrected_at", "feedback_id")  # rows that make no rule are spread
    told = told.withColumn("violation", F.when(holds & makes & (F.row_number().over(turn) > 1), "personal_rule_conflict").otherwise(F.col("violation")))
    of = Window.partitionBy("txn_id", holds).orderBy("corrected_at", "feedback_id")
    before = F.coalesce(F.lag("category_id").over(of), F.col("_before"))
    return told.withColumn("previous_category", F.when(holds, before)).withColumn("first", holds & (F.row_number().over(of) == 1)).select(*LOG)


def corrections(log: DataFrame) -> DataFrame:
    return log.filter("violation IS NULL").select(F.col("feedback_id").alias("correction_id"), "txn_id", "previous_category", F.col("category_id").alias("category"), F.col("corrected_at").alias("at"))


def new_rules(log: DataFrame) -> DataFrame:
    """The rules made, their texts normalised."""
    made = log.filter("violation IS NULL AND rule IS NOT NULL")
    texts = {"merchant", "phrase"}
    return made.select("profile_id", "category_id", *((tx.rule_text(F.col(f"rule.{c}")) if c in texts else F.col(f"rule.{c}")).alias(c) for c in (f.split()[0] for f in RULE.split(", "))), F.lit(True).alias("active"), F.col("corrected_at").alias("created_at"))


def assigned(ledger: DataFrame, log: DataFrame) -> DataFrame:
    """The ledger with the last category that each transaction was given."""
    last = log.filter("violation IS NULL").groupBy("txn_id").agg(F.max_by("category_id", F.struct("corrected_at", "feedback_id")).alias("_new"))
    return ledger.join(last, "txn_id", "left").withColumn("category_id", F.coalesce("_new", "category_id")).select(ledger.columns)


def superseded(decisions: DataFrame, log: DataFrame) -> DataFrame:
    """Pending decisions of corrected transactions, superseded at the first correction."""
    first = log.filter("first").select("txn_id", F.col("corrected_at").alias("_at"))
    now = (F.col("status") == "pending") & F.col("_at").isNotNull()
    both = decisions.join(first, "txn_id", "left")
    return both.withColumn("reviewed_at", F.when(now, F.col("_at")).otherwise(F.col("reviewed_at"))).withColumn("status", F.when(now, "superseded").otherwise(F.col("status"))).select(decisions.columns)


def results(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """What the user is told: each feedback with its violation, the category before, and how many pending decisions it superseded."""
    pending = decisions.filter("status = 'pending'").groupBy("txn_id").agg(F.count("*").alias("_n"))
    count = F.when(F.col("first"), F.coalesce("_n", F.lit(0))).otherwise(0).cast("long")
    return log.join(pending, "txn_id", "left").select("feedback_id", "txn_id", "violation", "previous_category", F.col("rule.rule_id").alias("rule_id"), count.alias("superseded"))


def commit(store: Store, feedback: DataFrame) -> Version:
    """All of it in one version of a store with the tables ledger, accounts, categories, rules, decisions, corrections and feedback_log."""

    def step(now: Version) -> dict:
        log = now.read("feedback_log") if "feedback_log" in now.tables else None
        ledger, accounts, categories, rules, decisions = (now.read(t) for t in ("ledger", "accounts", "categories", "rules", "decisions"))
        return {  # the log is written first, the others follow from what is stored of it
            "append": {
                "feedback_log": judge(feedback, ledger, accounts, categories, rules, log),
                "corrections": lambda done: corrections(done("feedback_log")),
                "rules": lambda done: new_rules(done("feedback_log")).select(rules.columns),
            },
            "replace": {"ledger": lambda done: assigned(ledger, done("feedback_log")), "decisions": lambda done: superseded(decisions, done("feedback_log"))},
            "info": {"operation": "feedback"},
        }

    return store.update(step)
