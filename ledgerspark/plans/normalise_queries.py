"""Queries on normalised rows, contracts and approvals; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerspark.functions import normalise as nm
from ledgerspark.operators import approval, contracts
from ledgerspark.plans.bindings import LEDGER, ledger, read
from ledgerspark.plans.lookup_queries import accounts


def _text(*options, by="o_orderkey"):
    """One of the options by the row's number; None is null."""
    return F.element_at(F.array(*(F.lit(o) if isinstance(o, str) else F.lit(None).cast("string") if o is None else o for o in options)), (F.col(by) % len(options) + 1).cast("int"))


def source_rows(spark, d):
    """Orders as statement rows: dates in five spellings and one that is none, names inside what banks add, amounts in one column or two."""
    day, cents = F.col("o_orderdate").cast("date"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    blank, even = F.lit(None).cast("string"), F.col("o_orderkey") % 2 == 0
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("account_id"), F.lit("GBP").alias("account_currency"),
        _text(day.cast("string"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "dd-MM-yyyy"), F.date_format(day, "d MMM yyyy"), F.date_format(day, "d MMMM yyyy"), "31/02/1999").alias("transaction_date"), blank.alias("posting_date"),
        _text("CARD PAYMENT TO Corner Shop", "pos CORNER SHOP REF: AB1234", "Corner   Shop 12/03/2024", "corner shop STORE #1234", "Corner Shop Ltd", " - ", "Ｃｏｒｎｅｒ Shop\u0007").alias("description"),
        F.when(even, cents).alias("amount"), F.when(~even, cents).alias("debit"), blank.alias("credit"), F.when(F.col("o_orderkey") % 10 == 0, "n/a").alias("balance"),
        _text(None, " ", "gbp", "£", "USD").alias("currency"), _text(None, "", " x 1 ").alias("external_id"), blank.alias("transaction_type"),
    )


def normalised_rows(spark, d):
    return nm.normalise(source_rows(spark, d)).select("source_id", "txn_date", "merchant", "amount", "currency", "direction", "external_id", "error")


def review_roles(spark, d):
    """Roles after review actions, where the sign allows them."""
    rows = ledger(spark, d)
    actions = rows.filter("txn_id % 9 < 8").select("txn_id", _text("income", "expense", "refund", "reimbursement", "cash_withdrawal", "ignore_from_analytics", "internal_transfer", "needs_review", by="txn_id").alias("action"))
    after, _ = approval.direct_review(rows, actions)
    return after.select("txn_id", "role", "flagged")


def role_changes(spark, d):
    rows = ledger(spark, d)
    _, audits = approval.direct_review(rows, rows.select("txn_id", _text("income", "expense", by="txn_id").alias("action")))
    return audits


def ambiguous_dates(spark, d):
    text = F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy")
    value, error = nm.confirmed_date(text, F.lit("month_first"))
    return read(spark, d, "orders").select("o_orderkey", nm.ambiguous_date(text).alias("ambiguous"), value.alias("month_first"), error.alias("error"))


def month_day_occurrences(spark, d):
    days = nm.month_days(F.lit("2023-01-15").cast("date"), F.lit("2024-06-10").cast("date"), (F.col("account_id") % 31 + 1).cast("int"))
    return accounts(spark, d).select("account_id", F.explode(days).alias("day"))


def account_mentions(spark, d):
    text = F.concat(F.lit("Paid to customer 000000"), (F.col("c_custkey") % 30).cast("string"), F.lit(" by phone"))
    return read(spark, d, "customer").select("c_custkey", nm.mentions_account(text, F.concat(F.lit("000000"), (F.col("c_custkey") % 7).cast("string"))).alias("mentioned"))


def transaction_contract(spark, d):
    direction = F.when(F.col("txn_id") % 4 == 0, "outflow").otherwise("inflow")
    rows = ledger(spark, d).withColumn("direction", direction).withColumn("amount", F.when(F.col("txn_id") % 31 == 0, 0).otherwise(F.col("amount")).cast("decimal(18,2)"))
    return contracts.transactions(rows).select("txn_id", "violation")


def coverage_contract(spark, d):
    """Statements with none, one or two gaps, some outside, some out of order."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    gap = lambda a, b: F.struct(F.date_add(day, a).alias("start_date"), F.date_add(day, b).alias("end_date"))
    none = F.array().cast("array<struct<start_date:date,end_date:date>>")
    gaps = F.when(k % 4 == 0, none).when(k % 4 == 1, F.array(gap(3, 5))).when(k % 4 == 2, F.array(gap(3, 5), gap(5, 8))).otherwise(F.array(gap(3, 5), gap(20, 40)))
    rows = read(spark, d, "orders").select(k.alias("statement_id"), day.alias("start_date"), F.date_add(day, F.when(k % 7 == 0, -1).otherwise(30)).alias("end_date"), _text("complete", "gapped", "partial").alias("status"), gaps.alias("missing"))
    return contracts.coverage(rows).select("statement_id", "violation")


def suggestion_contract(spark, d):
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(
        k.alias("txn_id"), F.when(k % 3 == 0, k).when(k % 3 == 1, k + 1).alias("counterpart_id"), _text("transfer", "refund").alias("kind"), _text("transfer_in", "refund", "expense", "transfer_out").alias("suggested_role"),
        F.when(k % 3 < 2, _text("transfer_out", "transfer_in", None, "transfer_in", "transfer_out")).alias("counterpart_role"), _text("pending", "confirmed").alias("status"), F.when(k % 4 == 1, F.lit("2024-01-01")).alias("reviewed_at"),
    )
    return contracts.suggestions(rows).select("txn_id", "violation")


def currency_contract(spark, d):
    own = accounts(spark, d).withColumn("currency", F.when(F.col("account_id") % 50 == 0, "EUR").otherwise("GBP"))
    rows = ledger(spark, d).withColumn("currency", F.when(F.col("txn_id") % 40 == 0, "EUR").otherwise("GBP")).drop("profile_id")
    return contracts.currencies(rows, own).select("txn_id", "violation")


def _statements(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    none = F.array().cast("array<struct<start_date:date,end_date:date>>")
    gap = F.array(F.struct(F.date_add(day, 20).alias("start_date"), F.date_add(day, 24).alias("end_date")))
    return read(spark, d, "orders").select(
        k.alias("statement_id"), F.col("o_custkey").alias("account_id"), F.concat(F.lit("h"), k.cast("string")).alias("file_hash"), day.alias("start_date"), F.date_add(day, 100).alias("end_date"), F.when(k % 4 == 0, gap).otherwise(none).alias("missing"),
        F.lit(0).cast("decimal(18,2)").alias("opening_balance"), F.when(k % 5 != 4, F.col("o_totalprice").cast("decimal(18,2)")).alias("closing_balance"), (k % 3 == 0).alias("uses_debit_credit"),
    )


def _approvals(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        k.alias("statement_id"), F.concat(F.lit("h"), F.when(k % 13 == 0, -1).otherwise(k).cast("string")).alias("file_hash"), F.when(k % 5 != 0, "day_first").alias("date_format"), (k % 6 == 0).alias("sign_confirmed"), (k % 2 == 0).alias("acknowledged"),
    )


def _reviewed_rows(spark, d):
    """All lines of an order, numbered: line numbers repeat in the table."""
    day, row = F.col("l_shipdate").cast("date"), (F.col("l_orderkey") * 1000 + F.col("n")).alias("row_id")
    rows = read(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_extendedprice")))
    return rows.select(F.col("l_orderkey").alias("statement_id"), row, F.when(F.col("l_orderkey") % 7 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(day.cast("string")).alias("date_text"), day.alias("txn_date"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.lit(1).alias("account_id"), (F.col("n") == 3).alias("needs_review"))


def _decisions(spark, d):
    rows = _reviewed_rows(spark, d).filter("needs_review AND statement_id % 11 <> 0")
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    return rows.select("statement_id", "row_id", F.when(F.col("statement_id") % 2 == 0, "reject").otherwise("accept").alias("decision"), none("date", "txn_date"), none("decimal(18,2)", "amount"), F.when(F.col("statement_id") % 17 == 0, 2).alias("account_id"))


def statement_approval(spark, d):
    return approval.gates(_statements(spark, d), _approvals(spark, d), _reviewed_rows(spark, d), _decisions(spark, d))


def statement_snapshots(spark, d):
    return approval.statement_snapshots(_statements(spark, d)).select("statement_id", "as_of_date", "balance", "source")


_ACTION = "CASE txn_id % 8 WHEN 0 THEN 'income' WHEN 1 THEN 'expense' WHEN 2 THEN 'refund' WHEN 3 THEN 'reimbursement' WHEN 4 THEN 'cash_withdrawal' WHEN 5 THEN 'excluded' WHEN 6 THEN CASE WHEN amount > 0 THEN 'transfer_in' ELSE 'transfer_out' END END"
_FITS = "(CASE WHEN {0} IN ('income', 'transfer_in', 'refund', 'reimbursement') THEN amount > 0 WHEN {0} IN ('expense', 'transfer_out', 'cash_withdrawal') THEN amount < 0 ELSE {0} IS NOT NULL END)"
QUERIES = {
    "normalised_rows": (
        normalised_rows,
        """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 <> 5 THEN CAST(o_orderdate AS DATE) END AS txn_date, CASE o_orderkey % 7 WHEN 4 THEN 'Corner Shop LTD' WHEN 5 THEN '' ELSE 'Corner Shop' END AS merchant,
          CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS amount, CASE WHEN o_orderkey % 5 <> 4 THEN 'GBP' END AS currency, CASE WHEN o_orderkey % 3 = 2 THEN 'x 1' END AS external_id FROM orders)
        SELECT k AS source_id, txn_date, merchant, amount, currency, CASE WHEN amount > 0 THEN 'inflow' ELSE 'outflow' END AS direction, external_id,
        CASE WHEN txn_date IS NULL THEN 'invalid_date' WHEN merchant = '' THEN 'missing_description' WHEN currency IS NULL THEN 'unsupported_currency' WHEN k % 10 = 0 THEN 'invalid_balance' END AS error FROM r""",
    ),
    "review_roles": (
        review_roles,
        f"WITH {LEDGER}, a AS (SELECT *, CASE WHEN txn_id % 9 < 8 THEN {_ACTION} END AS new FROM ledger) SELECT txn_id, CASE WHEN {_FITS.format('new')} THEN new ELSE role END AS role, txn_id % 9 < 8 AND txn_id % 8 = 7 AS flagged FROM a",
    ),
    "role_changes": (
        role_changes,
        f"WITH {LEDGER}, a AS (SELECT *, CASE txn_id % 2 WHEN 0 THEN 'income' ELSE 'expense' END AS new FROM ledger) SELECT txn_id, role AS previous_role, new AS new_role FROM a WHERE {_FITS.format('new')} AND new <> role",
    ),
    "ambiguous_dates": (
        ambiguous_dates,
        """SELECT o_orderkey, day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS ambiguous, CASE WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END AS month_first,
        CASE WHEN day(o_orderdate) > 12 THEN 'date_format_conflict' END AS error FROM orders""",
    ),
    "month_day_occurrences": (
        month_day_occurrences,
        """WITH m AS (SELECT CAST(unnest(generate_series(DATE '2023-01-01', DATE '2024-06-01', INTERVAL 1 MONTH)) AS DATE) AS m), o AS (SELECT c_custkey AS account_id, CAST(m + CAST(least(c_custkey % 31 + 1, day(last_day(m))) - 1 AS INTEGER) AS DATE) AS day FROM customer, m)
        SELECT * FROM o WHERE day BETWEEN DATE '2023-01-15' AND DATE '2024-06-10'""",
    ),
    "account_mentions": (account_mentions, "SELECT c_custkey, starts_with(CAST(c_custkey % 30 AS VARCHAR), CAST(c_custkey % 7 AS VARCHAR)) AS mentioned FROM customer"),
    "transaction_contract": (
        transaction_contract,
        f"WITH {LEDGER} SELECT txn_id, CASE WHEN txn_id % 31 = 0 THEN 'zero_amount' WHEN amount > 0 AND txn_id % 4 = 0 THEN 'positive_not_inflow' WHEN amount < 0 AND txn_id % 4 <> 0 THEN 'negative_not_outflow' END AS violation FROM ledger",
    ),
    "coverage_contract": (
        coverage_contract,
        """SELECT o_orderkey AS statement_id, CASE WHEN o_orderkey % 7 = 0 THEN 'end_before_start' WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'complete_with_gaps' WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 = 0 THEN 'gapped_without_gaps'
        WHEN o_orderkey % 4 = 3 THEN 'gap_outside' WHEN o_orderkey % 4 = 2 THEN 'gaps_out_of_order' END AS violation FROM orders""",
    ),
    "suggestion_contract": (
        suggestion_contract,
        """WITH s AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey + 1 END AS other, o_orderkey % 2 = 0 AS transfer, CASE o_orderkey % 4 WHEN 0 THEN 'transfer_in' WHEN 1 THEN 'refund' WHEN 2 THEN 'expense' ELSE 'transfer_out' END AS role,
          CASE WHEN o_orderkey % 3 < 2 THEN CASE o_orderkey % 5 WHEN 0 THEN 'transfer_out' WHEN 1 THEN 'transfer_in' WHEN 3 THEN 'transfer_in' WHEN 4 THEN 'transfer_out' END END AS other_role FROM orders)
        SELECT k AS txn_id, CASE WHEN other = k THEN 'paired_with_itself' WHEN transfer AND role NOT LIKE 'transfer%' THEN 'transfer_without_transfer_role' WHEN transfer AND (other IS NULL) <> (other_role IS NULL) THEN 'half_a_pair'
        WHEN transfer AND other_role = role THEN 'same_role_twice' WHEN NOT transfer AND (other IS NOT NULL OR other_role IS NOT NULL) THEN 'counterpart_of_a_single_row' WHEN NOT transfer AND role <> 'refund' THEN 'role_does_not_fit_kind'
        WHEN (k % 2 = 0) = (k % 4 = 1) THEN 'review_time_does_not_fit_status' END AS violation FROM s""",
    ),
    "currency_contract": (
        currency_contract,
        f"""WITH {LEDGER}, m AS (SELECT CAST(c_nationkey AS BIGINT) AS profile_id FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey % 50 = 0) > 1)
        SELECT txn_id, CASE WHEN (txn_id % 40 = 0) <> (account_id % 50 = 0) THEN 'not_the_accounts_currency' WHEN profile_id IN (SELECT profile_id FROM m) THEN 'several_currencies' END AS violation FROM ledger""",
    ),
    "statement_approval": (
        statement_approval,
        """WITH r AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_extendedprice) AS n, CAST(l_shipdate AS DATE) AS day, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem),
        o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders),
        x AS (SELECT r.*, NOT (n = 3 AND r.k % 11 <> 0 AND r.k % 2 = 0) AS kept, n = 3 AND r.k % 11 = 0 AS open, n = 3 AND r.k % 11 <> 0 AND r.k % 17 = 0 AS moved, r.k % 7 = 0 AND day(r.day) <= 12 AND month(r.day) <> day(r.day) AS ambiguous,
          r.day NOT BETWEEN o.day AND o.day + 100 OR (r.k % 4 = 0 AND r.day BETWEEN o.day + 20 AND o.day + 24) AS outside FROM r JOIN o ON r.k = o.k),
        s AS (SELECT k, bool_or(open) AS open, bool_or(kept AND moved) AS moved, bool_or(kept AND outside) AS outside, bool_or(ambiguous) AS ambiguous, sum(CASE WHEN kept THEN 1 ELSE 0 END) AS approved, sum(CASE WHEN kept THEN 0 ELSE 1 END) AS rejected,
          sum(CASE WHEN kept THEN amount END) AS movement FROM x GROUP BY k),
        g AS (SELECT o.k, s.* EXCLUDE (k), CASE WHEN o.k % 5 <> 4 THEN CAST(total - coalesce(movement, 0) AS DECIMAL(38,2)) END AS difference FROM o LEFT JOIN s ON o.k = s.k)
        SELECT k AS statement_id, CASE WHEN k % 13 = 0 THEN 'file_changed' WHEN ambiguous AND k % 5 = 0 THEN 'date_format_unconfirmed' WHEN k % 3 = 0 AND k % 6 <> 0 THEN 'sign_convention_unconfirmed' WHEN open THEN 'uncertain_row_unresolved'
        WHEN moved THEN 'protected_field_changed' WHEN outside THEN 'outside_coverage' WHEN abs(difference) > 0.01 AND k % 2 <> 0 THEN 'balance_mismatch_unacknowledged' END AS fault,
        CAST(coalesce(approved, 0) AS BIGINT) AS approved, CAST(coalesce(rejected, 0) AS BIGINT) AS rejected, difference FROM g""",
    ),
    "statement_snapshots": (
        statement_snapshots,
        """SELECT o_orderkey AS statement_id, CAST(o_orderdate AS DATE) AS as_of_date, CAST(0 AS DECIMAL(18,2)) AS balance, 'statement_opening' AS source FROM orders
        UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE) + 100, CAST(o_totalprice AS DECIMAL(18,2)), 'statement_closing' FROM orders WHERE o_orderkey % 5 <> 4""",
    ),
}
