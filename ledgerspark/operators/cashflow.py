"""Role-aware totals, monthly reports and rankings over a ledger; what isn't covered is null, not zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators import intervals

TOTALS = {
    "income": "income", "expense": "expenses", "refund": "refunds", "reimbursement": "reimbursements",
    "cash_withdrawal": "withdrawals", "transfer_in": "transfers_in", "transfer_out": "transfers_out",
}


def money(column: Column) -> Column:
    return column.cast("decimal(38,2)")


def role_sums() -> list[Column]:
    """Magnitude of each role's rows, and the rows without a role."""
    sums = [money(F.coalesce(F.sum(F.when(F.col("role") == role, F.abs("amount"))), F.lit(0))).alias(name) for role, name in TOTALS.items()]
    return [*sums, F.count_if(F.col("role") == "unknown").alias("unknown_rows"), F.count("*").alias("rows")]


def net() -> Column:
    return money(F.col("income") + F.col("refunds") + F.col("reimbursements") - F.col("expenses") - F.col("withdrawals"))


def totals(ledger: DataFrame, *keys: str) -> DataFrame:
    return ledger.groupBy(*keys).agg(*role_sums()).withColumn("net", net())


def savings_rate(summed: DataFrame, covered: Column | None = None) -> DataFrame:
    """Net over income in percent, half up to 2 places; else the first reason that applies."""
    reason = F.when(~covered, "incomplete_coverage") if covered is not None else F.when(F.lit(False), "")
    reason = reason.when(F.col("unknown_rows") > 0, "unresolved_financial_roles").when(F.col("income") == 0, "no_income")
    rate = F.round(F.try_divide(F.col("net").cast("decimal(18,2)"), F.col("income").cast("decimal(18,2)")) * 100, 2)
    return summed.withColumn("reason", reason).withColumn("savings_rate", F.when(F.col("reason").isNull(), rate).cast("decimal(18,2)"))


def category_spending(rows: DataFrame, *keys: str) -> DataFrame:
    """Spend and rows by category, the null category included."""
    return rows.groupBy(*keys, "category_id").agg(money(F.sum("amount")).alias("spend"), F.count("*").alias("rows"))


def cadence(ledger: DataFrame, recurring: DataFrame) -> DataFrame:
    """Expense split by whether a row belongs to a confirmed recurrence: an existence join on the row's id."""
    marks = recurring.select(F.col("txn_id").alias("_member")).distinct()
    rows = ledger.filter(F.col("role") == "expense").join(marks, F.col("txn_id") == F.col("_member"), "left")
    is_member = F.col("_member").isNotNull()
    return rows.groupBy("account_id").agg(
        money(F.coalesce(F.sum(F.when(is_member, -F.col("amount"))), F.lit(0))).alias("recurring"),
        money(F.coalesce(F.sum(F.when(~is_member, -F.col("amount"))), F.lit(0))).alias("unclassified"),
    )


def month_spine(start: str, end: str, spark) -> DataFrame:
    """Calendar months that meet [start, end], clipped, and whether they lie within it whole."""
    spine = spark.sql(f"SELECT explode(sequence(trunc(date'{start}', 'MM'), date'{end}', interval 1 month)) AS month")
    first, last = F.greatest("month", F.lit(start).cast("date")), F.least(F.last_day("month"), F.lit(end).cast("date"))
    return spine.select("month", first.alias("first_day"), last.alias("last_day")).withColumn(
        "whole", (F.col("first_day") == F.col("month")) & (F.col("last_day") == F.last_day("month"))
    )


def monthly(ledger: DataFrame, months: DataFrame, key: str) -> DataFrame:
    """Totals of each key and month; a month without rows has zeros, for keys that have any row in the period."""
    spans = months.agg(F.min("first_day").alias("lo"), F.max("last_day").alias("hi"))
    inside = ledger.join(F.broadcast(spans), F.col("txn_date").between(F.col("lo"), F.col("hi"))).withColumn("month", F.trunc("txn_date", "MM").cast("date"))
    summed = inside.groupBy(key, "month").agg(*role_sums())
    # months are a bounded list: each key's rows are repeated for them by an explode, not joined with all
    listed = months.agg(F.collect_list("month").alias("all_months"))
    spine = inside.select(key).distinct().join(F.broadcast(listed)).select(key, F.explode("all_months").alias("month"))
    names = [*TOTALS.values(), "unknown_rows", "rows"]
    filled = spine.join(summed, [key, "month"], "left").select(key, "month", *(F.coalesce(c, F.lit(0)).cast(summed.schema[c].dataType).alias(c) for c in names))
    return filled.withColumn("net", net())


def month_coverage(ranges: DataFrame, spine: DataFrame, key: str, account: str) -> DataFrame:
    """``key``, ``month``, ``full_days``, ``partial_days``, ``missing_days`` and ``status`` of each of a key's months, from merged ranges of its accounts.

    A day is full if all accounts of the key cover it. Ranges are cut at the ends of months, then swept month by month.
    """
    accounts = ranges.groupBy(key).agg(F.count_distinct(account).alias("accounts"))
    months = F.explode(F.sequence(F.trunc("start_date", "MM"), F.col("end_date"), F.expr("interval 1 month"))).alias("month")
    cut = ranges.select(key, account, "start_date", "end_date", months).join(F.broadcast(spine), "month")  # months of a period
    cut = cut.select(key, "month", F.greatest("start_date", "first_day").alias("start_date"), F.least("end_date", "last_day").alias("end_date")).filter("start_date <= end_date")
    swept = intervals.sweep(cut, key, "month").withColumn("n", intervals.days()).join(accounts, key)
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    counted = swept.groupBy(key, "month").agg(of(F.col("active") >= F.col("accounts")).alias("full_days"), of((F.col("active") > 0) & (F.col("active") < F.col("accounts"))).alias("partial_days"))
    listed = spine.agg(F.collect_list(F.struct("month", (F.datediff("last_day", "first_day") + 1).cast("long").alias("total"), "whole")).alias("m"))
    every = accounts.join(F.broadcast(listed)).select(key, F.explode("m").alias("m")).select(key, "m.*")
    rows = every.join(counted, [key, "month"], "left").na.fill(0, ["full_days", "partial_days"])
    status = F.when(F.col("full_days") == F.col("total"), "complete").when(F.col("full_days") + F.col("partial_days") > 0, "partial").otherwise("missing")
    return rows.select(key, "month", "whole", "full_days", "partial_days", (F.col("total") - F.col("full_days") - F.col("partial_days")).alias("missing_days"), status.alias("status"))


def monthly_report(months: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Months with their coverage: totals are null where nothing is covered, and the savings rate needs full coverage."""
    both = covered.join(months, [key, "month"], "left")
    names = [*TOTALS.values(), "net", "unknown_rows", "rows"]
    zero = lambda c: F.when(F.col("status") != "missing", F.coalesce(c, F.lit(0))).cast(months.schema[c].dataType)
    return savings_rate(both.withColumns({c: zero(c) for c in names}), F.col("status") == "complete")


def comparisons(months: DataFrame, key: str) -> DataFrame:
    """Change against the month before, or the reason why there is none; months with a coverage ``status`` must be complete."""
    order = Window.partitionBy(key).orderBy("month")
    before = {c: F.lag(c).over(order) for c in ("income", "expenses", "net", "unknown_rows", "whole")}
    uncovered = (F.col("status") != "complete") | (F.lag("status").over(order) != "complete") if "status" in months.columns else F.lit(False)
    reason = (
        F.when(~F.col("whole") | ~before["whole"], "partial_calendar_month")
        .when(uncovered, "incomplete_coverage")
        .when((F.col("unknown_rows") > 0) | (before["unknown_rows"] > 0), "unresolved_financial_roles")
    )
    rows = months.withColumn("previous_month", F.lag("month").over(order)).withColumn("reason", reason)
    changes = {f"{c}_change": F.when(F.col("reason").isNull(), money(F.col(c) - before[c])) for c in ("income", "expenses", "net")}
    return rows.withColumns(changes).filter("previous_month IS NOT NULL")


def largest(ledger: DataFrame, k: int = 10) -> DataFrame:
    """The k largest movements by size, then date, account and id; excluded rows don't count."""
    return ledger.filter(F.col("role") != "excluded").orderBy(F.desc(F.abs("amount")), "txn_date", "account_id", "txn_id").limit(k)
