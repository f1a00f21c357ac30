"""The relational test tables seen as a ledger: one definition for Spark, one for the SQL that checks it.

``ledger`` is orders with their customers, ``coverage`` and ``balances`` are orders as statements and
balance observations, ``activity`` is the event table as small bank movements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
OUTFLOWS = ("expense", "transfer_out", "cash_withdrawal")
INFLOWS = ("income", "transfer_in", "refund", "reimbursement")
ROLES = (*INFLOWS, *OUTFLOWS, "excluded", "unknown")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ROLE = """CASE WHEN o_orderkey % 17 = 0 THEN 'excluded'
  WHEN o_orderpriority = '1-URGENT' THEN 'income'
  WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'expense'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN 'transfer_in' WHEN 'O' THEN 'transfer_out' ELSE 'refund' END
  WHEN o_orderstatus = 'F' THEN 'reimbursement' WHEN o_orderstatus = 'O' THEN 'cash_withdrawal' ELSE 'unknown' END"""
_SIGN = """CASE WHEN role IN ('expense', 'transfer_out', 'cash_withdrawal') THEN -1
  WHEN role IN ('excluded', 'unknown') AND txn_id % 2 = 1 THEN -1 ELSE 1 END"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("c_nationkey").cast("long").alias("profile_id"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.col("o_orderpriority").alias("merchant"),
        F.expr(_ROLE).alias("role"),
        F.col("o_totalprice").cast(MONEY).alias("size"),
    )
    return rows.withColumn("amount", (F.expr(_SIGN) * F.col("size")).cast(MONEY)).drop("size")


LEDGER = f"""ledger AS (SELECT txn_id, account_id, profile_id, txn_date, merchant, role, CAST({_SIGN} * size AS DECIMAL(18,2)) AS amount FROM (
  SELECT o_orderkey AS txn_id, o_custkey AS account_id, CAST(c_nationkey AS BIGINT) AS profile_id, CAST(o_orderdate AS DATE) AS txn_date,
  o_orderpriority AS merchant, {_ROLE} AS role, CAST(o_totalprice AS DECIMAL(18,2)) AS size
  FROM orders JOIN customer ON o_custkey = c_custkey))"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements: account, inclusive dates, status, and one gap where gapped."""
    day = F.col("o_orderdate").cast("date")
    status = F.element_at(F.array(*map(F.lit, ("complete", "partial", "gapped", "overlapping", "unknown"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    gap = F.array(F.struct(F.date_add(day, 5).alias("start_date"), F.date_add(day, 9).alias("end_date")))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("statement_id"),
        F.col("o_custkey").alias("account_id"),
        day.alias("start_date"),
        F.date_add(day, (30 + F.col("o_orderkey") % 60).cast("int")).alias("end_date"),
        status.alias("status"),
        F.when(status == "gapped", gap).otherwise(F.array().cast("array<struct<start_date:date,end_date:date>>")).alias("missing"),
    )


COVERAGE = """coverage AS (SELECT o_orderkey AS statement_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS start_date,
  CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 60 AS INTEGER) AS end_date,
  CASE o_orderkey % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'gapped' WHEN 3 THEN 'overlapping' ELSE 'unknown' END AS status FROM orders)"""


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, ("manual", "statement_closing", "running_balance", "statement_opening"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("as_of_date"),
        F.col("o_totalprice").cast(MONEY).alias("balance"),
        source.alias("source"),
        (F.col("o_orderkey") % 11 != 0).alias("verified"),
    )


BALANCES = """balances AS (SELECT o_orderkey AS snapshot_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS as_of_date,
  CAST(o_totalprice AS DECIMAL(18,2)) AS balance,
  CASE o_orderkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'statement_closing' WHEN 2 THEN 'running_balance' ELSE 'statement_opening' END AS source,
  CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS priority, o_orderkey % 11 <> 0 AS verified FROM orders)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("event_type").isin("purchase", "click"), -1).otherwise(1)
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("txn_id"),
        F.col("user_id").alias("account_id"),
        (F.col("user_id") % 10).alias("profile_id"),
        F.col("ts").cast("date").alias("txn_date"),
        F.col("event_type").alias("merchant"),
        F.concat_ws(" ", F.when(F.col("event_id") % 3 == 0, "internal transfer").when(F.col("event_id") % 7 == 0, "refund issued"), "event_type", F.lit("ref"), (F.col("event_id") % 5).cast("string")).alias("description"),
        (sign * F.col("value").cast(MONEY)).cast(MONEY).alias("amount"),
    ).filter("amount <> 0")


ACTIVITY = """activity AS (SELECT * FROM (SELECT event_id AS txn_id, user_id AS account_id, user_id % 10 AS profile_id, CAST(ts AS DATE) AS txn_date, event_type AS merchant,
  CASE WHEN event_id % 3 = 0 THEN 'internal transfer ' WHEN event_id % 7 = 0 THEN 'refund issued ' ELSE '' END || event_type || ' ref ' || CAST(event_id % 5 AS VARCHAR) AS description,
  CAST(CASE WHEN event_type IN ('purchase', 'click') THEN -1 ELSE 1 END * CAST(value AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS amount FROM events) WHERE amount <> 0)"""


def profile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two accounts of each profile, covered month by month: the first but for every seventh month, the second but for every fifth."""
    month = F.explode(F.expr("sequence(date'1996-01-01', date'1999-12-01', interval 1 month)")).alias("start_date")
    rows = ledger(spark, sf_dir).select("profile_id").distinct().select("profile_id", F.explode(F.array(F.lit(7), F.lit(5))).alias("account_id")).select("*", month)
    covered = (F.col("profile_id") + F.year("start_date") * 12 + F.month("start_date")) % F.col("account_id") != 0
    return rows.filter(covered).withColumn("end_date", F.last_day("start_date"))


#: Whether a day of a profile is covered by both accounts, and by one of them.
COVERED = "((profile_id + year({0}) * 12 + month({0})) % 7 <> 0 AND (profile_id + year({0}) * 12 + month({0})) % 5 <> 0)"
TOUCHED = "((profile_id + year({0}) * 12 + month({0})) % 7 <> 0 OR (profile_id + year({0}) * 12 + month({0})) % 5 <> 0)"
