"""Queries on what changes the store, on grids of statement cells and on contracts; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import balances, contracts, feedback
from ledgerspark.plans.bindings import ACTIVITY, activity, read
from ledgerspark.sources import statement_text

_ENTRY = (
    "o_orderkey AS entry_id", "o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 10000000 ELSE 0 END AS account_id", "CAST(o_totalprice AS DECIMAL(18,2)) AS balance", "CASE WHEN o_orderkey % 7 = 0 THEN 'EUR' ELSE 'GBP' END AS currency",
)


def manual_balances(spark, d):
    """Every order as a balance its customer enters: some after their recording, some for accounts that don't exist, are closed or kept in another currency."""
    made = F.col("o_orderdate").cast("date")
    entries = read(spark, d, "orders").selectExpr("*", *_ENTRY).select("entry_id", "account_id", "balance", "currency", made.alias("as_of_date"), F.date_add(made, (F.col("entry_id") % 9 - 1).cast("int")).cast("timestamp").alias("recorded_at"))
    accounts = read(spark, d, "customer").selectExpr("c_custkey AS account_id", "CASE WHEN c_custkey % 5 = 0 THEN 'EUR' ELSE 'GBP' END AS currency", "c_custkey % 9 <> 0 AS active")
    judged = balances.manual_entries(entries, accounts)
    kept = balances.manual_snapshots(judged).select("entry_id", "source", "verification_status")
    return judged.select("entry_id", "violation").join(kept, "entry_id", "left")


def _feedback(spark, d):
    """Every third event corrects the one 2 before, every ninth with a rule for its merchant; ids, owners and categories are sometimes wrong."""
    events = read(spark, d, "events")
    rows = activity(spark, d).select("txn_id", "account_id", "merchant", F.when(F.col("txn_id") % 4 != 0, F.lit("misc")).alias("category_id"))
    accounts = events.selectExpr("user_id AS account_id", "user_id % 10 AS profile_id").distinct()
    target = events.selectExpr("event_id AS _id", "user_id % 10 AS _profile", "event_type AS _merchant")
    rule = F.when(F.col("event_id") % 9 == 0, F.struct(
        F.concat(F.lit("r"), (F.col("event_id") % 900).cast("string")).alias("rule_id"), F.when(F.col("event_id") % 27 == 0, "elsewhere").otherwise(F.upper("_merchant")).alias("merchant"), F.lit(None).cast("string").alias("direction"),
        F.lit(None).cast("long").alias("account_id"), F.lit(None).cast("string").alias("phrase"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"), F.lit(1).alias("priority"),
    ))
    given = events.filter("event_id % 3 = 0").withColumn("txn", F.col("event_id") - F.col("event_id") % 12).join(target, F.col("txn") == F.col("_id")).select(
        F.col("event_id").alias("feedback_id"), (F.col("_profile") + F.when(F.col("event_id") % 15 == 0, 1).otherwise(0)).alias("profile_id"), F.col("txn").alias("txn_id"),
        F.expr("CASE event_id % 7 WHEN 0 THEN 'old' WHEN 1 THEN 'ghost' ELSE event_type END").alias("category_id"), F.col("ts").cast("timestamp_ntz").alias("corrected_at"), rule.alias("rule"),
    )
    categories = spark.createDataFrame([("view", True), ("signup", True), ("purchase", True), ("click", True), ("error", True), ("old", False)], "category_id string, active boolean")
    rules = spark.createDataFrame([("r18",), ("r36",)], "rule_id string")
    return rows, feedback.judge(given, rows, accounts, categories, rules)


def category_feedback(spark, d):
    _, log = _feedback(spark, d)
    return log.select("feedback_id", "violation", "previous_category", "first")


def category_feedback_ledger(spark, d):
    rows, log = _feedback(spark, d)
    return feedback.assigned(rows, log).select("txn_id", "category_id")


_JUDGED = f"""{ACTIVITY}, led AS (SELECT txn_id, account_id, merchant, CASE WHEN txn_id % 4 <> 0 THEN 'misc' END AS category_id FROM activity),
  g AS (SELECT e.event_id AS feedback_id, t.user_id % 10 + CASE WHEN e.event_id % 15 = 0 THEN 1 ELSE 0 END AS profile_id, t.user_id % 10 AS owner, t.event_id AS txn_id, CASE e.event_id % 7 WHEN 0 THEN 'old' WHEN 1 THEN 'ghost' ELSE e.event_type END AS category,
    e.ts, e.event_id % 9 = 0 AS makes, CASE WHEN e.event_id % 9 = 0 THEN 'r' || (e.event_id % 900) END AS rule, e.event_id % 27 <> 0 AS fits, l.txn_id IS NOT NULL AS there, l.category_id AS before
    FROM events e JOIN events t ON t.event_id = e.event_id - e.event_id % 12 LEFT JOIN led l ON l.txn_id = t.event_id WHERE e.event_id % 3 = 0),
  h AS (SELECT *, CASE WHEN NOT there OR owner <> profile_id THEN 'transaction_scope_not_found' WHEN category IN ('old', 'ghost') THEN 'category_not_found' WHEN makes AND NOT fits THEN 'feedback_rule_mismatch' WHEN makes AND rule IN ('r18', 'r36') THEN 'personal_rule_conflict' END AS v FROM g),
  j AS (SELECT *, CASE WHEN v IS NULL AND makes AND row_number() OVER (PARTITION BY rule, v IS NULL ORDER BY ts, feedback_id) > 1 THEN 'personal_rule_conflict' ELSE v END AS violation FROM h),
  log AS (SELECT *, coalesce(lag(category) OVER w, before) AS prior, row_number() OVER w = 1 AS one FROM j WINDOW w AS (PARTITION BY txn_id, violation IS NULL ORDER BY ts, feedback_id))"""


def _grids(spark, d):
    """Each customer's orders as cells of two tables on a page, with titles above, headings repeated, page numbers and second lines; some second tables have no heading."""
    line = F.struct(F.col("o_orderkey").alias("o"), F.array(F.col("o_orderdate").cast("date").cast("string"), F.concat(F.lit(" "), "o_orderpriority"), F.when(F.col("o_orderkey") % 4 < 2, F.col("o_totalprice").cast("decimal(18,2)").cast("string")), F.when(F.col("o_orderkey") % 4 >= 2, F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).alias("cells"))
    own = read(spark, d, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 2).alias("t")).agg(F.sort_array(F.collect_list(line)).alias("lines"))  # a page holds one customer's orders
    cells = lambda *c: F.array(*(F.lit(x).cast("string") for x in c))
    extra = lambda condition, row: F.when(condition, F.array(row)).otherwise(F.array().cast("array<array<string>>"))
    body = F.flatten(F.transform("lines", lambda x: F.concat(
        F.array(x["cells"]), extra(x["o"] % 3 == 0, cells(None, "second line", "", None)), extra(x["o"] % 5 == 0, cells("", "Page 2 of 3", None)), extra(x["o"] % 7 == 0, cells("Date", "Description", "Paid out", "Paid in")), extra(x["o"] % 8 == 0, cells(None, "", None, " ")),
    )))
    titles = F.slice(F.array(cells("Statement", None), cells("Account", "1")), F.lit(1), (F.col("o_custkey") % 3).cast("int"))
    heads = extra((F.col("t") == 0) | (F.col("o_custkey") % 11 != 0), cells("Date", " Description", "Paid out", "Paid in "))
    tables = own.select("o_custkey", F.struct("t", F.concat(titles, heads, body).alias("grid")).alias("table"))
    return tables.groupBy(F.col("o_custkey").alias("page")).agg(F.transform(F.sort_array(F.collect_list("table")), lambda t: t["grid"]).alias("tables"))


def grid_statement_rows(spark, d):
    return statement_text.grid_rows(_grids(spark, d), "page").select("page", "row_number", "transaction_date", "description", "debit", "credit")


def contract_violations(spark, d):
    """Orders as daily observations, weekly targets and import summaries, some of them broken; how many break which rule."""
    orders = read(spark, d, "orders")
    key = F.col("o_orderkey")
    daily = orders.select(F.when(key % 3 == 0, "missing").otherwise("covered").alias("status"), F.when(key % 4 != 0, F.col("o_totalprice") * F.when(key % 10 == 1, -1).otherwise(1)).alias("spend"), F.lit(1).alias("rows"))
    start = F.date_add(F.col("o_orderdate").cast("date"), F.when(key % 6 == 0, 0).otherwise(-F.weekday(F.col("o_orderdate").cast("date"))).cast("int"))
    weekly = orders.select(start.alias("week_start"), F.date_add(start, F.when(key % 5 == 0, 7).otherwise(6)).alias("week_end"), (key % 11 - 1).alias("target"), F.lit(0).alias("known_outflow"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    imports = orders.select((key % 5).alias("accepted"), (key % 2).alias("probable"), (key % 3).alias("exact"), (key % 5 + key % 2 + key % 3 + F.when(key % 13 == 0, 1).otherwise(0)).alias("rows_read"), numbers(key % 2).alias("probable_rows"), numbers(key % 3 + F.when(key % 17 == 0, 1).otherwise(0)).alias("exact_rows"), F.when(key % 4 == 1, "imported").when(key % 2 == 1, "needs_review").otherwise("imported").alias("status"))
    told = [rows.groupBy("violation").agg(F.count("*").alias("rows")).withColumn("contract", F.lit(name)) for name, rows in (("daily", contracts.daily_observations(daily)), ("weekly", contracts.weekly_targets(weekly)), ("import", contracts.import_summaries(imports)))]
    return told[0].unionByName(told[1]).unionByName(told[2]).select("contract", F.coalesce("violation", F.lit("none")).alias("violation"), "rows")


def statement_balance_contracts(spark, d):
    """Orders as statements whose balances are named, read, parsed and confirmed by remainders of their keys."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    said = lambda condition, field, amount: F.when(condition, F.struct(F.lit(field).alias("field"), amount.alias("amount")))
    rows = read(spark, d, "orders").select(
        key.alias("statement_id"), F.array_compact(F.array(said(key % 3 != 0, "opening", price), said(key % 4 != 0, "closing", F.when(key % 5 != 0, price)))).alias("evidence"),
        F.when(key % 3 != 0, price + F.when(key % 7 == 0, 1).otherwise(0)).alias("opening_balance"), F.when((key % 4 != 0) & (key % 5 != 0), price).alias("closing_balance"),
        F.when(key % 5 != 1, F.struct(F.when(key % 3 != 0, price).alias("opening"), F.when((key % 4 != 0) | (key % 11 == 0), price).alias("closing"))).alias("confirmed"),
    )
    return contracts.statement_balances(rows).select("statement_id", "violation")


def confusion_matrix_contracts(spark, d):
    key = F.col("o_orderkey")
    counts = lambda *c: F.array(*(x.cast("long") if not isinstance(x, int) else F.lit(x).cast("long") for x in c))
    first = F.when(key % 19 == 0, -1).otherwise(key % 5)
    square = F.array(counts(first, 1), counts(2, key % 3))
    one = lambda label, n: F.struct(F.lit(label).alias("category_id"), n.cast("long").alias("support"))
    supports = (key % 5 + 1 + F.when(key % 7 == 0, 1).otherwise(0), key % 3 + 2)
    rows = read(spark, d, "orders").select(
        key.alias("evaluation_id"), F.when(key % 13 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("labels"),
        F.when(key % 17 == 0, F.concat(square, F.array(counts(0, 0)))).otherwise(square).alias("matrix"),
        F.when(key % 11 == 0, F.array(one("b", supports[0]), one("a", supports[1]))).otherwise(F.array(one("a", supports[0]), one("b", supports[1]))).alias("classes"),
    )
    return contracts.confusion_matrices(rows).select("evaluation_id", "violation")


QUERIES = {
    "manual_balances": (
        manual_balances,
        f"""WITH e AS (SELECT {", ".join(_ENTRY)}, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 1 AS INTEGER) AS told FROM orders),
        j AS (SELECT entry_id, CASE WHEN day > told THEN 'as_of_date_after_recording' WHEN c_custkey IS NULL THEN 'account_not_found' WHEN c_custkey % 9 = 0 THEN 'account_inactive' WHEN (c_custkey % 5 = 0) <> (currency = 'EUR') THEN 'account_currency_mismatch' END AS violation
          FROM e LEFT JOIN customer ON account_id = c_custkey) SELECT entry_id, violation, CASE WHEN violation IS NULL THEN 'manual' END AS source, CASE WHEN violation IS NULL THEN 'verified' END AS verification_status FROM j""",
    ),
    "category_feedback": (category_feedback, f"WITH {_JUDGED} SELECT feedback_id, violation, CASE WHEN violation IS NULL THEN prior END AS previous_category, violation IS NULL AND one AS first FROM log"),
    "category_feedback_ledger": (
        category_feedback_ledger,
        f"WITH {_JUDGED}, l AS (SELECT txn_id, arg_max(category, (ts, feedback_id)) AS category FROM log WHERE violation IS NULL GROUP BY txn_id) SELECT led.txn_id, coalesce(l.category, led.category_id) AS category_id FROM led LEFT JOIN l ON led.txn_id = l.txn_id",
    ),
    "grid_statement_rows": (
        grid_statement_rows,
        """SELECT o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS row_number, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS transaction_date,
        o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'second line' ELSE '' END AS description, CASE WHEN o_orderkey % 4 < 2 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS debit,
        CASE WHEN o_orderkey % 4 >= 2 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS credit FROM orders o
        WHERE o_orderkey % 2 = 0 OR o_custkey % 11 <> 0 OR EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey % 14 = 7 AND p.o_orderkey < o.o_orderkey)""",
    ),
    "contract_violations": (
        contract_violations,
        """WITH d AS (SELECT CASE WHEN (o_orderkey % 3 <> 0) <> (o_orderkey % 4 <> 0) THEN 'values_do_not_fit_status' WHEN o_orderkey % 4 <> 0 AND o_orderkey % 10 = 1 THEN 'negative_spend' ELSE 'none' END AS violation FROM orders),
        w AS (SELECT CASE WHEN (o_orderkey % 6 = 0 AND isodow(CAST(o_orderdate AS DATE)) <> 1) OR o_orderkey % 5 = 0 THEN 'not_monday_to_sunday' WHEN o_orderkey % 11 = 0 THEN 'negative_target' ELSE 'none' END AS violation FROM orders),
        i AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'counts_do_not_add_up' WHEN o_orderkey % 17 = 0 THEN 'listed_rows_differ' WHEN (o_orderkey % 2 = 1 AND o_orderkey % 4 <> 1) <> (o_orderkey % 2 > 0) THEN 'status_does_not_fit' ELSE 'none' END AS violation FROM orders)
        SELECT 'daily' AS contract, violation, count(*) AS rows FROM d GROUP BY 2 UNION ALL SELECT 'weekly', violation, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'import', violation, count(*) FROM i GROUP BY 2""",
    ),
    "statement_balance_contracts": (
        statement_balance_contracts,
        """SELECT o_orderkey AS statement_id, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0 THEN 'balance_evidence_missing' WHEN o_orderkey % 12 = 0 AND o_orderkey % 5 <> 1 THEN 'unexpected_balance_confirmation'
        WHEN o_orderkey % 12 <> 0 AND o_orderkey % 5 = 1 THEN 'balances_unconfirmed' WHEN o_orderkey % 12 <> 0 AND o_orderkey % 44 = 0 THEN 'balance_fields_changed' END AS violation FROM orders""",
    ),
    "confusion_matrix_contracts": (
        confusion_matrix_contracts,
        """SELECT o_orderkey AS evaluation_id, CASE WHEN o_orderkey % 13 = 0 THEN 'labels_not_unique' WHEN o_orderkey % 17 = 0 THEN 'matrix_not_square' WHEN o_orderkey % 19 = 0 THEN 'negative_count' WHEN o_orderkey % 11 = 0 THEN 'classes_not_in_label_order'
        WHEN o_orderkey % 7 = 0 THEN 'support_differs' END AS violation FROM orders""",
    ),
}
