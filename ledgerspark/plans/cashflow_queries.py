"""Queries over the ledger's money: totals, rates, months, rankings; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import cashflow, intervals
from ledgerspark.plans.bindings import COVERAGE, COVERED, LEDGER, TOUCHED, coverage, ledger, profile_coverage, read

START, END = "1996-01-15", "1998-12-31"
_SUMS = """CAST(coalesce(sum(CASE WHEN role = 'income' THEN abs(amount) END), 0) AS DECIMAL(38,2)) AS income,
  CAST(coalesce(sum(CASE WHEN role = 'expense' THEN abs(amount) END), 0) AS DECIMAL(38,2)) AS expenses,
  CAST(coalesce(sum(CASE WHEN role = 'refund' THEN abs(amount) END), 0) AS DECIMAL(38,2)) AS refunds,
  CAST(coalesce(sum(CASE WHEN role = 'reimbursement' THEN abs(amount) END), 0) AS DECIMAL(38,2)) AS reimbursements,
  CAST(coalesce(sum(CASE WHEN role = 'cash_withdrawal' THEN abs(amount) END), 0) AS DECIMAL(38,2)) AS withdrawals,
  CAST(coalesce(sum(CASE WHEN role = 'transfer_in' THEN abs(amount) END), 0) AS DECIMAL(38,2)) AS transfers_in,
  CAST(coalesce(sum(CASE WHEN role = 'transfer_out' THEN abs(amount) END), 0) AS DECIMAL(38,2)) AS transfers_out,
  CAST(coalesce(sum(CASE WHEN role = 'unknown' THEN 1 ELSE 0 END), 0) AS BIGINT) AS unknown_rows, count(amount) AS rows"""
_NET = "CAST(income + refunds + reimbursements - expenses - withdrawals AS DECIMAL(38,2)) AS net"
_MONTHLY = f"""{LEDGER}, months AS (SELECT CAST(m AS DATE) AS month FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)) AS m)),
  inside AS (SELECT *, CAST(date_trunc('month', txn_date) AS DATE) AS month FROM ledger WHERE txn_date BETWEEN DATE '{START}' AND DATE '{END}'),
  sums AS (SELECT s.profile_id, s.month, {_SUMS} FROM (SELECT profile_id, month FROM (SELECT DISTINCT profile_id FROM inside) CROSS JOIN months) s
    LEFT JOIN inside i ON i.profile_id = s.profile_id AND i.month = s.month GROUP BY s.profile_id, s.month),
  monthly AS (SELECT *, {_NET} FROM sums)"""
_REPORT = f"""{_MONTHLY}, covered AS (SELECT profile_id, month, month <> DATE '1996-01-01' AS whole, CAST(last_day(month) - greatest(month, DATE '{START}') + 1 AS BIGINT) AS total,
    {COVERED.format("month")} AS f, {TOUCHED.format("month")} AS t FROM (SELECT DISTINCT profile_id FROM ledger) CROSS JOIN months),
  report AS (SELECT c.profile_id, c.month, whole, CASE WHEN f THEN 'complete' WHEN t THEN 'partial' ELSE 'missing' END AS status, CASE WHEN f THEN total ELSE 0 END AS full_days, CASE WHEN t AND NOT f THEN total ELSE 0 END AS partial_days,
    CASE WHEN t THEN 0 ELSE total END AS missing_days, CASE WHEN t THEN coalesce(income, 0) END AS income, CASE WHEN t THEN coalesce(expenses, 0) END AS expenses, CASE WHEN t THEN coalesce(net, 0) END AS net, CASE WHEN t THEN coalesce(rows, 0) END AS rows,
    CASE WHEN t THEN coalesce(unknown_rows, 0) END AS unknown_rows FROM covered c LEFT JOIN monthly m ON m.profile_id = c.profile_id AND m.month = c.month)"""


def role_totals(spark, d):
    return cashflow.totals(ledger(spark, d), "profile_id")


def savings_rate_by_account(spark, d):
    return cashflow.savings_rate(cashflow.totals(ledger(spark, d), "account_id")).select("account_id", "net", "reason", "savings_rate")


def line_category(spark, d):
    part = read(spark, d, "part")
    rows = read(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.select(
        F.when(F.col("l_orderkey") % 13 != 0, F.col("p_type")).alias("category_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.year("l_shipdate").cast("long").alias("year"),
    )


def category_spending(spark, d):
    return cashflow.category_spending(line_category(spark, d), "year")


def spending_cadence(spark, d):
    rows = ledger(spark, d)
    groups = rows.filter("role = 'expense'").groupBy("account_id", "merchant").agg(F.count("*").alias("n")).filter("n >= 3")
    members = rows.join(groups, ["account_id", "merchant"]).select("txn_id")
    return cashflow.cadence(rows, members)


def monthly_frame(spark, d):
    return cashflow.monthly(ledger(spark, d), cashflow.month_spine(START, END, spark), "profile_id")


def monthly_comparison(spark, d):
    spine = cashflow.month_spine(START, END, spark)
    rows = monthly_frame(spark, d).join(F.broadcast(spine.select("month", "whole")), "month")
    return cashflow.comparisons(rows, "profile_id").select("profile_id", "month", "reason", "income_change", "expenses_change", "net_change")


def monthly_report(spark, d):
    spine = cashflow.month_spine(START, END, spark)
    ranges = intervals.merge(profile_coverage(spark, d), "profile_id", "account_id")
    return cashflow.monthly_report(monthly_frame(spark, d), cashflow.month_coverage(ranges, spine, "profile_id", "account_id"), "profile_id")


def monthly_coverage_report(spark, d):
    shown = ("profile_id", "month", "status", "full_days", "partial_days", "missing_days", "income", "expenses", "net", "rows", "reason")
    return monthly_report(spark, d).select(*shown)


def monthly_comparison_covered(spark, d):
    return cashflow.comparisons(monthly_report(spark, d).drop("reason"), "profile_id").select("profile_id", "month", "reason", "net_change")


def largest_transactions(spark, d):
    return cashflow.largest(ledger(spark, d), 10).select("txn_id", "account_id", "txn_date", "role", cashflow.money(F.col("amount")).alias("amount"))


def covered_totals(spark, d):
    """Totals of 1997 by account; null where no statement known to be complete meets the year."""
    year = ledger(spark, d).filter("year(txn_date) = 1997")
    known = coverage(spark, d).filter("status IN ('complete', 'overlapping') AND start_date <= date'1997-12-31' AND end_date >= date'1997-01-01'")
    accounts = ledger(spark, d).select("account_id").distinct()
    summed = cashflow.totals(year, "account_id").select("account_id", "income", "expenses", "net")
    rows = accounts.join(known.select("account_id").distinct().withColumn("covered", F.lit(True)), "account_id", "left").join(summed, "account_id", "left")
    shown = {c: F.when(F.col("covered"), F.coalesce(c, F.lit(0)).cast("decimal(38,2)")) for c in ("income", "expenses", "net")}
    return rows.withColumns(shown).select("account_id", F.coalesce("covered", F.lit(False)).alias("covered"), *shown)


def ledger_quality(spark, d):
    """Rows that break a rule of the ledger: zero amounts, and signs that don't fit their role."""
    rows = ledger(spark, d)
    broken = (
        F.when(F.col("amount") == 0, "zero_amount")
        .when(F.col("role").isin("income", "transfer_in", "refund", "reimbursement") & (F.col("amount") < 0), "sign")
        .when(F.col("role").isin("expense", "transfer_out", "cash_withdrawal") & (F.col("amount") > 0), "sign")
    )
    return rows.withColumn("violation", F.coalesce(broken, F.lit("none"))).groupBy("role", "violation").agg(F.count("*").alias("rows"))


QUERIES = {
    "role_totals": (role_totals, f"WITH {LEDGER} SELECT *, {_NET} FROM (SELECT profile_id, {_SUMS} FROM ledger GROUP BY profile_id)"),
    "savings_rate_by_account": (
        savings_rate_by_account,
        f"""WITH {LEDGER}, t AS (SELECT *, {_NET} FROM (SELECT account_id, {_SUMS} FROM ledger GROUP BY account_id)),
        r AS (SELECT *, CASE WHEN unknown_rows > 0 THEN 'unresolved_financial_roles' WHEN income = 0 THEN 'no_income' END AS reason FROM t)
        SELECT account_id, net, reason, CASE WHEN reason IS NULL THEN
          CAST(CASE WHEN net < 0 THEN -1 ELSE 1 END * CAST((CAST(abs(net) * 100 AS HUGEINT) * 20000 + CAST(income * 100 AS HUGEINT)) // (2 * CAST(income * 100 AS HUGEINT)) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) END AS savings_rate FROM r""",
    ),
    "category_spending": (
        category_spending,
        """SELECT year, category_id, CAST(sum(amount) AS DECIMAL(38,2)) AS spend, count(*) AS rows FROM (
        SELECT CASE WHEN l_orderkey % 13 <> 0 THEN p_type END AS category_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(year(l_shipdate) AS BIGINT) AS year
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) GROUP BY year, category_id""",
    ),
    "spending_cadence": (
        spending_cadence,
        f"""WITH {LEDGER}, g AS (SELECT account_id, merchant FROM ledger WHERE role = 'expense' GROUP BY account_id, merchant HAVING count(*) >= 3),
        e AS (SELECT l.*, EXISTS (SELECT 1 FROM g WHERE g.account_id = l.account_id AND g.merchant = l.merchant) AS member FROM ledger l WHERE role = 'expense')
        SELECT account_id, CAST(coalesce(sum(CASE WHEN member THEN -amount END), 0) AS DECIMAL(38,2)) AS recurring,
        CAST(coalesce(sum(CASE WHEN NOT member THEN -amount END), 0) AS DECIMAL(38,2)) AS unclassified FROM e GROUP BY account_id""",
    ),
    "monthly_cash_flow": (monthly_frame, f"WITH {_MONTHLY} SELECT * FROM monthly"),
    "monthly_comparison": (
        monthly_comparison,
        f"""WITH {_MONTHLY}, l AS (SELECT *, month <> DATE '1996-01-01' AS whole, lag(month) OVER w AS pm, lag(month) OVER w <> DATE '1996-01-01' AS pwhole,
          lag(income) OVER w AS pi, lag(expenses) OVER w AS pe, lag(net) OVER w AS pn, lag(unknown_rows) OVER w AS pu FROM monthly WINDOW w AS (PARTITION BY profile_id ORDER BY month)),
        r AS (SELECT *, CASE WHEN NOT whole OR NOT pwhole THEN 'partial_calendar_month' WHEN unknown_rows > 0 OR pu > 0 THEN 'unresolved_financial_roles' END AS reason FROM l WHERE pm IS NOT NULL)
        SELECT profile_id, month, reason, CASE WHEN reason IS NULL THEN CAST(income - pi AS DECIMAL(38,2)) END AS income_change,
        CASE WHEN reason IS NULL THEN CAST(expenses - pe AS DECIMAL(38,2)) END AS expenses_change, CASE WHEN reason IS NULL THEN CAST(net - pn AS DECIMAL(38,2)) END AS net_change FROM r""",
    ),
    "monthly_coverage_report": (
        monthly_coverage_report,
        f"""WITH {_REPORT} SELECT profile_id, month, status, full_days, partial_days, missing_days, income, expenses, net, rows,
        CASE WHEN status <> 'complete' THEN 'incomplete_coverage' WHEN unknown_rows > 0 THEN 'unresolved_financial_roles' WHEN income = 0 THEN 'no_income' END AS reason FROM report""",
    ),
    "monthly_comparison_covered": (
        monthly_comparison_covered,
        f"""WITH {_REPORT}, l AS (SELECT *, lag(month) OVER w AS pm, lag(whole) OVER w AS pw, lag(status) OVER w AS ps, lag(unknown_rows) OVER w AS pu, lag(net) OVER w AS pn FROM report WINDOW w AS (PARTITION BY profile_id ORDER BY month)),
        r AS (SELECT *, CASE WHEN NOT whole OR NOT pw THEN 'partial_calendar_month' WHEN status <> 'complete' OR ps <> 'complete' THEN 'incomplete_coverage' WHEN unknown_rows > 0 OR pu > 0 THEN 'unresolved_financial_roles' END AS reason FROM l WHERE pm IS NOT NULL)
        SELECT profile_id, month, reason, CASE WHEN reason IS NULL THEN CAST(net - pn AS DECIMAL(38,2)) END AS net_change FROM r""",
    ),
    "largest_transactions": (
        largest_transactions,
        f"WITH {LEDGER} SELECT txn_id, account_id, txn_date, role, CAST(amount AS DECIMAL(38,2)) AS amount FROM ledger WHERE role <> 'excluded' ORDER BY abs(amount) DESC, txn_date, account_id, txn_id LIMIT 10",
    ),
    "covered_totals": (
        covered_totals,
        f"""WITH {LEDGER}, {COVERAGE}, k AS (SELECT DISTINCT account_id FROM coverage WHERE status IN ('complete', 'overlapping') AND start_date <= DATE '1997-12-31' AND end_date >= DATE '1997-01-01'),
        t AS (SELECT *, {_NET} FROM (SELECT account_id, {_SUMS} FROM ledger WHERE year(txn_date) = 1997 GROUP BY account_id)), a AS (SELECT DISTINCT account_id FROM ledger)
        SELECT a.account_id, k.account_id IS NOT NULL AS covered, CASE WHEN k.account_id IS NOT NULL THEN CAST(coalesce(income, 0) AS DECIMAL(38,2)) END AS income,
        CASE WHEN k.account_id IS NOT NULL THEN CAST(coalesce(expenses, 0) AS DECIMAL(38,2)) END AS expenses, CASE WHEN k.account_id IS NOT NULL THEN CAST(coalesce(net, 0) AS DECIMAL(38,2)) END AS net
        FROM a LEFT JOIN k ON a.account_id = k.account_id LEFT JOIN t ON a.account_id = t.account_id""",
    ),
    "ledger_quality": (
        ledger_quality,
        f"""WITH {LEDGER} SELECT role, CASE WHEN amount = 0 THEN 'zero_amount' WHEN role IN ('income', 'transfer_in', 'refund', 'reimbursement') AND amount < 0 THEN 'sign'
        WHEN role IN ('expense', 'transfer_out', 'cash_withdrawal') AND amount > 0 THEN 'sign' ELSE 'none' END AS violation, count(*) AS rows FROM ledger GROUP BY 1, 2""",
    ),
}
