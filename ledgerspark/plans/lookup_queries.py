"""Queries on the store's lookups and joins; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import lookups
from ledgerspark.plans.bindings import LEDGER, ledger, read


def accounts(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").cast("long").alias("profile_id"), F.col("c_name").alias("name"))


ACCOUNTS = "accounts AS (SELECT c_custkey AS account_id, CAST(c_nationkey AS BIGINT) AS profile_id, c_name AS name FROM customer)"


def batches(spark, d):
    """Orders as uploads; files of one account and priority have the same bytes."""
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("account_id"), F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"), 256).alias("file_hash"))


BATCHES = "batches AS (SELECT o_orderkey AS batch_id, o_custkey AS account_id, sha256(CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority) AS file_hash FROM orders)"


def suggestions(spark, d):
    rows = ledger(spark, d).filter("txn_id % 3 = 0")
    status = F.when(F.col("txn_id") % 2 == 0, "pending").otherwise("confirmed")
    return rows.select((F.col("txn_id") + 1000000).alias("suggestion_id"), "txn_id", status.alias("status"), ((F.col("txn_id") % 100) / 100).alias("confidence"))


def accounts_of_profile(spark, d):
    return lookups.accounts_of(accounts(spark, d), 7)


def scope_check(spark, d):
    """Of the account ids divisible by 40, those that profile 7 does not own."""
    owned = lookups.accounts_of(accounts(spark, d), 7)
    return lookups.scope_gap(accounts(spark, d).filter("account_id % 40 = 0"), owned, "account_id")


def repeated_uploads(spark, d):
    return lookups.prior_uploads(batches(spark, d)).select("batch_id", "first_batch_id", "repeated")


def raw_rows_of_batches(spark, d):
    raw = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").cast("long").alias("row_number"))
    return lookups.rows_of_batch(raw, batches(spark, d).filter("batch_id % 50 = 0")).select("batch_id", "row_number")


def profile_ledger(spark, d):
    wanted = ledger(spark, d).filter("txn_id % 2 = 0").select("txn_id")
    return lookups.of_profile(ledger(spark, d), accounts(spark, d), 3, wanted).select("txn_id", "account_id", "amount")


def unknown_role_candidates(spark, d):
    return lookups.unknown_candidates(ledger(spark, d), accounts(spark, d), 3).select("txn_id", "txn_date")


def pending_review_queue(spark, d):
    rows = ledger(spark, d).withColumn("batch_id", F.col("txn_id"))
    contexts = batches(spark, d).filter("batch_id % 4 = 0").select("batch_id", F.concat(F.lit("bank "), (F.col("batch_id") % 9).cast("string")).alias("institution"))
    found = lookups.review_queue(suggestions(spark, d), rows, accounts(spark, d), batches(spark, d), contexts)
    return found.select("suggestion_id", "txn_id", "profile_id", "name", "file_hash", "institution", "confidence", "amount")


def role_audits(spark, d):
    audits = read(spark, d, "events").select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("txn_id"), F.col("event_type").alias("new_role"), F.col("ts").alias("changed_at"))
    return lookups.audits_of(audits, 5).select("audit_id", "txn_id", "new_role")


def flags_inserted_once(spark, d):
    have = read(spark, d, "events").filter("event_id % 2 = 0").select(F.col("user_id").alias("txn_id"), F.lit("needs_review").alias("flag")).distinct()
    new = read(spark, d, "events").select(F.col("user_id").alias("txn_id"), F.lit("needs_review").alias("flag"))
    return lookups.insert_once(have, new, "txn_id", "flag")


def categories_assigned(spark, d):
    rows = ledger(spark, d).select("txn_id", F.when(F.col("txn_id") % 3 == 0, "old").alias("category_id"))
    decided = rows.filter("txn_id % 5 = 0").select("txn_id", F.lit("new").alias("category_id"))
    return lookups.assign_category(rows, decided)


def forecast_facts(spark, d):
    """Rows are verified ten days after their date; a row in eleven belongs to a recurrence, every other one of these confirmed."""
    rows = ledger(spark, d).withColumn("verified_at", F.date_add("txn_date", 10))
    members = rows.filter("txn_id % 11 = 0").select("txn_id", F.when(F.col("txn_id") % 2 == 0, "confirmed").otherwise("pending").alias("status"))
    start, end, known = (F.lit(x).cast("date") for x in ("1995-01-01", "1997-12-31", "1997-06-30"))
    return lookups.forecast_facts(rows, members, start, end, known).select("txn_id", "txn_date", "amount")


def rule_targets(spark, d):
    rules = read(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.concat_ws("-", "p_brand", (F.col("p_partkey") % 3).cast("string")).alias("category_id"), (F.col("p_partkey") % 4 % 2).alias("version"))
    categories = read(spark, d, "part").filter("p_partkey % 3 <> 1").select(F.concat_ws("-", "p_brand", (F.col("p_partkey") % 3).cast("string")).alias("category_id")).distinct()
    categories = categories.select("category_id", F.lit(1).cast("long").alias("version"), (~F.endswith("category_id", F.lit("2"))).alias("active"))
    return lookups.bad_targets(rules, categories).select("rule_id", "reason")


def rule_identity(spark, d):
    rules = read(spark, d, "part").select((F.col("p_partkey") % 190).alias("rule_id"), F.element_at(F.split("p_name", " "), 1).alias("phrase"), F.when(F.col("p_partkey") % 2 == 0, "keyword").otherwise("alias").alias("kind"))
    return lookups.repeated_rules(rules.withColumn("rule_id", F.col("rule_id").cast("string")))


def taxonomy_validation(spark, d):
    """Parts as a tree of thousands: a part's parent is its number divided by four; 13 and 14 name each other, and multiples of 17 no one."""
    parent = F.when(F.col("p_partkey") == 13, 14).when(F.col("p_partkey") == 14, 13).when(F.col("p_partkey") % 17 == 0, -1).when(F.col("p_partkey") >= 4, F.floor(F.col("p_partkey") / 4))
    return lookups.taxonomy_faults(read(spark, d, "part").select(F.col("p_partkey").alias("category_id"), parent.cast("long").alias("parent_id")))


QUERIES = {
    "accounts_of_profile": (accounts_of_profile, f"WITH {ACCOUNTS} SELECT * FROM accounts WHERE profile_id = 7"),
    "scope_check": (scope_check, f"WITH {ACCOUNTS} SELECT account_id FROM accounts WHERE account_id % 40 = 0 AND profile_id <> 7"),
    "repeated_uploads": (
        repeated_uploads,
        f"WITH {BATCHES} SELECT batch_id, min(batch_id) OVER w AS first_batch_id, batch_id > min(batch_id) OVER w AS repeated FROM batches WINDOW w AS (PARTITION BY account_id, file_hash)",
    ),
    "raw_rows_of_batches": (raw_rows_of_batches, "SELECT l_orderkey AS batch_id, CAST(l_linenumber AS BIGINT) AS row_number FROM lineitem WHERE l_orderkey % 50 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)"),
    "profile_ledger": (profile_ledger, f"WITH {LEDGER} SELECT txn_id, account_id, amount FROM ledger WHERE profile_id = 3 AND txn_id % 2 = 0"),
    "unknown_role_candidates": (unknown_role_candidates, f"WITH {LEDGER} SELECT txn_id, txn_date FROM ledger WHERE profile_id = 3 AND role = 'unknown'"),
    "pending_review_queue": (
        pending_review_queue,
        f"""WITH {LEDGER}, {ACCOUNTS}, {BATCHES} SELECT l.txn_id + 1000000 AS suggestion_id, l.txn_id, l.profile_id, a.name, b.file_hash, CASE WHEN l.txn_id % 4 = 0 THEN 'bank ' || CAST(l.txn_id % 9 AS VARCHAR) END AS institution,
        CAST(l.txn_id % 100 AS DOUBLE) / 100 AS confidence, l.amount FROM ledger l JOIN accounts a ON l.account_id = a.account_id JOIN batches b ON b.batch_id = l.txn_id WHERE l.txn_id % 6 = 0""",
    ),
    "role_audits": (role_audits, "SELECT event_id AS audit_id, user_id AS txn_id, event_type AS new_role FROM events WHERE user_id = 5"),
    "flags_inserted_once": (flags_inserted_once, "SELECT DISTINCT user_id AS txn_id, 'needs_review' AS flag FROM events"),
    "categories_assigned": (categories_assigned, f"WITH {LEDGER} SELECT txn_id, CASE WHEN txn_id % 5 = 0 THEN 'new' WHEN txn_id % 3 = 0 THEN 'old' END AS category_id FROM ledger"),
    "forecast_facts": (
        forecast_facts,
        f"""WITH {LEDGER} SELECT txn_id, txn_date, amount FROM ledger WHERE role = 'expense' AND txn_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' AND txn_date + 10 <= DATE '1997-06-30'
        AND NOT (txn_id % 11 = 0 AND txn_id % 2 = 0)""",
    ),
    "rule_targets": (
        rule_targets,
        """WITH r AS (SELECT p_partkey AS rule_id, p_brand || '-' || CAST(p_partkey % 3 AS VARCHAR) AS category_id, p_partkey % 4 % 2 AS version FROM part),
        c AS (SELECT DISTINCT p_brand || '-' || CAST(p_partkey % 3 AS VARCHAR) AS category_id FROM part WHERE p_partkey % 3 <> 1)
        SELECT rule_id, CASE WHEN c.category_id IS NULL THEN 'missing' WHEN version <> 1 THEN 'other_version' ELSE 'inactive' END AS reason FROM r LEFT JOIN c ON r.category_id = c.category_id
        WHERE c.category_id IS NULL OR version <> 1 OR c.category_id LIKE '%2'""",
    ),
    "rule_identity": (
        rule_identity,
        """WITH r AS (SELECT CAST(p_partkey % 190 AS VARCHAR) AS rule_id, CASE WHEN p_partkey % 2 = 0 THEN 'keyword' ELSE 'alias' END || ':' || string_split(p_name, ' ')[1] AS phrase FROM part)
        SELECT 'rule_id' AS field, rule_id AS value, count(*) AS count FROM r GROUP BY rule_id HAVING count(*) > 1 UNION ALL SELECT 'phrase', phrase, count(*) FROM r GROUP BY phrase HAVING count(*) > 1""",
    ),
    "taxonomy_validation": (
        taxonomy_validation,
        """WITH RECURSIVE c AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 13 THEN 14 WHEN p_partkey = 14 THEN 13 WHEN p_partkey % 17 = 0 THEN -1 WHEN p_partkey >= 4 THEN p_partkey // 4 END AS parent FROM part),
        w AS (SELECT id, parent AS at, 0 AS n FROM c WHERE parent IS NOT NULL UNION ALL SELECT w.id, c.parent, n + 1 FROM w JOIN c ON w.at = c.id WHERE c.parent IS NOT NULL AND n < 16)
        SELECT id AS category_id, 'missing_parent' AS fault FROM c WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM c) UNION SELECT id, 'cycle' FROM w WHERE n = 16""",
    ),
}
