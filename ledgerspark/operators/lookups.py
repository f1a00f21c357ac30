"""The ledger store's lookups as DataFrames: each takes the tables it reads and returns rows a user of the store asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.session import cut


def by_id(table: DataFrame, key: str, value) -> DataFrame:
    """The one row of that id, or none: profiles, accounts, batches, rules, suggestions, transactions."""
    return table.filter(F.col(key) == F.lit(value))


def by_ids(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose id is among ``wanted``: categories of a rule set, accounts of a scope."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def accounts_of(accounts: DataFrame, profile) -> DataFrame:
    """A profile's accounts by name, then id."""
    return accounts.filter(F.col("profile_id") == F.lit(profile)).orderBy("name", "account_id")


def scope_gap(wanted: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """Ids asked for that are not among the owned: a scope is valid if there are none."""
    return wanted.select(key).distinct().join(owned.select(key), key, "left_anti")


def prior_uploads(batches: DataFrame) -> DataFrame:
    """Each batch with the first batch of its account that has the same file hash, and whether it repeats that one."""
    first = batches.groupBy("account_id", "file_hash").agg(F.min("batch_id").alias("first_batch_id"))
    return batches.join(first, ["account_id", "file_hash"]).withColumn("repeated", F.col("batch_id") > F.col("first_batch_id"))


def rows_of_batch(raw: DataFrame, batches: DataFrame) -> DataFrame:
    """Raw rows of the batches, in source order within each."""
    return by_ids(raw, "batch_id", batches).orderBy("batch_id", "row_number")


def coverage_of_batch(coverage: DataFrame, batches: DataFrame) -> DataFrame:
    return coverage.join(batches.select("batch_id"), "batch_id")


def of_profile(ledger: DataFrame, accounts: DataFrame, profile, wanted: DataFrame | None = None) -> DataFrame:
    """A profile's ledger rows, of the wanted ids only where these are given."""
    rows = ledger.join(accounts.filter(F.col("profile_id") == F.lit(profile)).select("account_id"), "account_id", "left_semi")
    return rows if wanted is None else by_ids(rows, "txn_id", wanted)


def unknown_candidates(ledger: DataFrame, accounts: DataFrame, profile) -> DataFrame:
    return of_profile(ledger, accounts, profile).filter("role = 'unknown'").orderBy("txn_date", "txn_id")


def active_rules(rules: DataFrame, profile) -> DataFrame:
    """A profile's personal rules that are switched on, the highest priority first."""
    return rules.filter((F.col("profile_id") == F.lit(profile)) & F.col("active")).orderBy(F.desc("priority"), "rule_id")


def review_queue(suggestions: DataFrame, ledger: DataFrame, accounts: DataFrame, batches: DataFrame, contexts: DataFrame) -> DataFrame:
    """Pending suggestions with their transaction, account and batch, and the statement context where there is one; the surest first."""
    rows = suggestions.filter("status = 'pending'").join(ledger.select("txn_id", "account_id", "batch_id", "txn_date", "amount"), "txn_id")
    rows = rows.join(accounts.select("account_id", "profile_id", "name"), "account_id").join(batches.select("batch_id", "file_hash"), "batch_id")
    return rows.join(contexts.select("batch_id", "institution"), "batch_id", "left").orderBy("profile_id", F.desc("confidence"), "suggestion_id")


def audits_of(audits: DataFrame, txn_id=None) -> DataFrame:
    """Role changes in the order they were made, of one transaction where it is given."""
    return (audits if txn_id is None else by_id(audits, "txn_id", txn_id)).orderBy("txn_id", "changed_at", "audit_id")


def insert_once(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The table with those new rows whose key it does not hold; of new rows with one key, one."""
    fresh = new.dropDuplicates(list(keys)).join(table.select(*keys).distinct(), list(keys), "left_anti")
    return table.unionByName(fresh.select(table.columns))


def assign_category(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """The ledger with the category of the decisions (txn_id, category_id) where there is one."""
    new = decisions.select("txn_id", F.col("category_id").alias("_new"))
    return ledger.join(new, "txn_id", "left").withColumn("category_id", F.coalesce("_new", "category_id")).drop("_new")


def forecast_facts(ledger: DataFrame, members: DataFrame, start: Column, end: Column, known_by: Column) -> DataFrame:
    """Expense rows of the period that were verified by then and belong to no confirmed recurrence."""
    confirmed = members.filter("status = 'confirmed'").select("txn_id").distinct()
    rows = ledger.filter((F.col("role") == "expense") & F.col("txn_date").between(start, end) & (F.col("verified_at") <= known_by))
    return rows.join(confirmed, "txn_id", "left_anti")


def bad_targets(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Rules whose category does not exist, is of another version, or is not active, with the first of these reasons."""
    known = categories.select("category_id", F.col("version").alias("_version"), F.col("active").alias("_active"))
    reason = F.when(F.col("_version").isNull(), "missing").when(F.col("_version") != F.col("version"), "other_version").when(~F.col("_active"), "inactive")
    return rules.join(known, "category_id", "left").select(*rules.columns, reason.alias("reason")).filter("reason IS NOT NULL")


def repeated_rules(rules: DataFrame) -> DataFrame:
    """Rule ids, and phrases within a kind, that occur more than once: a rule set has none."""
    ids = rules.groupBy(F.lit("rule_id").alias("field"), F.col("rule_id").alias("value")).count()
    phrases = rules.groupBy(F.lit("phrase").alias("field"), F.concat_ws(":", "kind", "phrase").alias("value")).count()
    return ids.unionByName(phrases).filter("count > 1")


def taxonomy_faults(categories: DataFrame) -> DataFrame:
    """Categories of a tree (``category_id``, ``parent_id``) that name no existing parent, or that lie on a cycle or below one.

    Every category points to its parent, and each round makes it point to where that one points: twice as far. After as many
    rounds as the number of categories has binary digits only those still point anywhere that never reach a root.
    """
    links = categories.select("category_id", "parent_id")
    known = links.select(F.col("category_id").alias("parent_id"))
    orphans = links.filter("parent_id IS NOT NULL").join(known, "parent_id", "left_anti")
    walk = cut(links.join(orphans.select("category_id"), "category_id", "left_anti").filter("parent_id IS NOT NULL"))
    for _ in range(categories.count().bit_length()):
        if walk.isEmpty():
            break
        onward = walk.select(F.col("category_id").alias("_id"), F.col("parent_id").alias("_parent"))
        walk = cut(walk.join(onward, F.col("parent_id") == F.col("_id")).select("category_id", F.col("_parent").alias("parent_id")))
    return orphans.select("category_id", F.lit("missing_parent").alias("fault")).unionByName(walk.select("category_id", F.lit("cycle").alias("fault"))).distinct()
