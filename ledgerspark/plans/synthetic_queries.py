"""Queries on synthetic ledgers and running balances; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerspark.plans.bindings import ACTIVITY, activity, read
from ledgerspark.sources import synthetic


def holders(spark, d):
    """Customers as accounts: a profile each, a start in 2020, one to three years."""
    k = F.col("c_custkey")
    start = F.date_add(F.lit("2020-02-01").cast("date"), (k % 60).cast("int"))
    profile = F.element_at(F.array(*map(F.lit, ("student", "salaried", "irregular"))), (k % 3 + 1).cast("int"))
    return read(spark, d, "customer").select(k.alias("account_id"), profile.alias("profile"), start.alias("start_date"), synthetic.period_end(start, k % 3 + 1).alias("end_date"))


HOLDERS = """holders AS (SELECT c_custkey AS account_id, CASE c_custkey % 3 WHEN 0 THEN 'student' WHEN 1 THEN 'salaried' ELSE 'irregular' END AS profile, DATE '2020-02-01' + CAST(c_custkey % 60 AS INTEGER) AS start_date,
  CAST(DATE '2020-02-01' + CAST(c_custkey % 60 AS INTEGER) + to_years(CAST(c_custkey % 3 + 1 AS INTEGER)) AS DATE) - 1 AS end_date FROM customer)"""
_MONTHLY_ROWS = ", ".join(f"('{p}', '{s}', '{m}', '{r}', {a}, {day}, {rate})" for p, rows in synthetic.MONTHLY.items() for s, m, r, a, day, rate in rows)
_WEEKLY_ROWS = ", ".join(f"('{p}', '{s}', '{m}', '{r}', {a}, {day})" for p, (s, m, r, a, day) in synthetic.WEEKLY.items())


def synthetic_recurring(spark, d):
    return synthetic.recurring(holders(spark, d))


def synthetic_anomalies(spark, d):
    bought = activity(spark, d).select("account_id", "txn_date", "merchant", "amount")
    return synthetic.anomalies(holders(spark, d), bought)


def posting_dates(spark, d):
    day = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").select("o_orderkey", synthetic.posting_date(day).alias("posting_date"), synthetic.external_id(F.lit("salaried"), F.col("o_orderkey")).alias("external_id"))


def balance_breaks(spark, d):
    """Stored balances of which one in fifty is a penny off."""
    order = Window.partitionBy("account_id").orderBy("txn_date", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    stored = F.sum("amount").over(order) + F.when(F.col("txn_id") % 50 == 0, F.lit("0.01").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    rows = activity(spark, d).withColumn("balance", stored.cast("decimal(38,2)"))
    return synthetic.balance_breaks(rows).select("txn_id")


def synthetic_receipts(spark, d):
    return synthetic.receipts(holders(spark, d)).select("account_id", "txn_date", "merchant", "amount")


def synthetic_purchases(spark, d):
    """What each account buys at each shop over its period."""
    return synthetic.purchases(holders(spark, d)).groupBy("account_id", "merchant").agg(F.count("*").alias("rows"), F.sum("amount").cast("decimal(38,2)").alias("spent"), F.min("txn_date").alias("first_day"))


def _drawn(bound, *parts):
    return f"(CAST('0x' || substr(md5(concat_ws('|', '17', {', '.join(parts)})), 1, 12) AS BIGINT) % ({bound}))"


QUERIES = {
    "synthetic_recurring": (
        synthetic_recurring,
        f"""WITH {HOLDERS}, spec(profile, series, merchant, role, base, day, rate) AS (VALUES {_MONTHLY_ROWS}), week(profile, series, merchant, role, base, day) AS (VALUES {_WEEKLY_ROWS}),
        m AS (SELECT CAST(unnest(generate_series(DATE '2020-01-01', DATE '2023-12-01', INTERVAL 1 MONTH)) AS DATE) AS m), dd AS (SELECT CAST(unnest(generate_series(DATE '2020-01-01', DATE '2023-12-31', INTERVAL 1 DAY)) AS DATE) AS txn_date)
        SELECT account_id, h.profile, CAST(m + CAST(least(day, day(last_day(m))) - 1 AS INTEGER) AS DATE) AS txn_date, series, merchant, role, CAST(round(CAST(base AS DECIMAL(18,4)) * (1 + CAST(rate AS DECIMAL(9,4)) * (year(m) - year(start_date))), 2) AS DECIMAL(18,2)) AS amount
        FROM holders h JOIN spec ON spec.profile = h.profile, m WHERE CAST(m + CAST(least(day, day(last_day(m))) - 1 AS INTEGER) AS DATE) BETWEEN start_date AND end_date
        UNION ALL SELECT account_id, h.profile, txn_date, series, merchant, role, CAST(base AS DECIMAL(18,2)) FROM holders h JOIN week ON week.profile = h.profile JOIN dd ON txn_date BETWEEN start_date AND end_date AND isodow(txn_date) - 1 = day""",
    ),
    "synthetic_anomalies": (
        synthetic_anomalies,
        f"""WITH {HOLDERS}, {ACTIVITY}, f AS (SELECT account_id, txn_date, merchant, amount FROM activity WHERE amount < 0 QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY txn_date, merchant, amount) = 1)
        SELECT account_id, start_date + CAST(floor((end_date - start_date) / 2) AS INTEGER) AS txn_date, 'Example Travel' AS merchant, CAST(CASE profile WHEN 'student' THEN -480 WHEN 'salaried' THEN -1250 ELSE -780 END AS DECIMAL(18,2)) AS amount, 'unusually_large' AS anomaly FROM holders
        UNION ALL SELECT *, 'exact_duplicate' FROM f UNION ALL SELECT f.account_id, least(txn_date + 1, end_date), merchant || ' REPEAT', amount, 'probable_duplicate' FROM f JOIN holders h ON h.account_id = f.account_id""",
    ),
    "posting_dates": (
        posting_dates,
        """SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE isodow(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS posting_date, 'SAL-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS external_id FROM orders""",
    ),
    "balance_breaks": (
        balance_breaks,
        f"""WITH {ACTIVITY}, b AS (SELECT *, sum(amount) OVER (PARTITION BY account_id ORDER BY txn_date, txn_id ROWS UNBOUNDED PRECEDING) + CASE WHEN txn_id % 50 = 0 THEN 0.01 ELSE 0 END AS balance FROM activity)
        SELECT txn_id FROM (SELECT *, coalesce(lag(balance) OVER (PARTITION BY account_id ORDER BY txn_date, txn_id), 0) + amount AS due FROM b) WHERE due <> balance""",
    ),
    "synthetic_receipts": (
        synthetic_receipts,
        f"""WITH {HOLDERS}, m AS (SELECT *, CAST(unnest(generate_series(date_trunc('month', start_date), CAST(end_date AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM holders WHERE profile = 'irregular'),
        k AS (SELECT *, unnest(generate_series(1, {_drawn(4, "'count'", "account_id", "month")} + 1)) AS k FROM m),
        r AS (SELECT account_id, month + CAST({_drawn("day(last_day(month))", "'day'", "account_id", "month", "k")} AS INTEGER) AS txn_date, ['Fictional Client A', 'Fictional Client B', 'Fictional Client C'][{_drawn(3, "'client'", "account_id", "month", "k")} + 1] AS merchant,
          CAST(({_drawn(100001, "'amount'", "account_id", "month", "k")} + 25000) * 0.01 AS DECIMAL(18,2)) AS amount, start_date, end_date FROM k)
        SELECT account_id, txn_date, merchant, amount FROM r WHERE txn_date BETWEEN start_date AND end_date""",
    ),
    "synthetic_purchases": (
        synthetic_purchases,
        f"""WITH {HOLDERS}, t AS (SELECT account_id, profile, CAST(unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM holders),
        b AS (SELECT *, {_drawn(4, "'shop'", "account_id", "day")} AS shop FROM t WHERE {_drawn(10000, "'buys'", "account_id", "day")} < CASE profile WHEN 'student' THEN 4500 WHEN 'salaried' THEN 5500 ELSE 5000 END * CASE WHEN isodow(day) >= 6 THEN 1.2 ELSE 1.0 END),
        s(shop, name, lo, hi) AS (VALUES {", ".join(f"({i}, '{n}', {lo}, {hi})" for i, (n, lo, hi) in enumerate(synthetic.SHOPS))})
        SELECT account_id, name AS merchant, count(*) AS rows, CAST(sum(-CAST(({_drawn("hi - lo + 1", "'price'", "account_id", "day")} + lo) * 0.01 AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS spent, min(day) AS first_day FROM b JOIN s USING (shop) GROUP BY account_id, name""",
    ),
}
