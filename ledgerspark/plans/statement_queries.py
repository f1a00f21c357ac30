"""Queries on statement pages made of orders and their lines; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerspark.plans.bindings import read
from ledgerspark.sources import statement_text


def pages(spark, d):
    """Each order as a page: a heading, its lines as movements, every second one continued on a further line, and a page number."""
    rows = read(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice")))
    day, cents = F.date_format(F.col("l_shipdate").cast("date"), "dd/MM/yyyy"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    line = F.concat(day, F.lit(" | part "), F.col("l_partkey").cast("string"), F.lit(" | "), cents, F.lit(" |"))
    line = F.when(F.col("n") % 2 == 0, F.concat(line, F.lit("\n | delivered late | |"))).otherwise(line)
    body = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    heading = F.when(F.col("l_orderkey") % 3 == 0, "Date | Details | Paid out | Paid in").otherwise("Txn Date | Narrative | Amount | Balance")
    opening = F.concat(F.lit("Opening balance: "), F.col("l_orderkey").cast("string"), F.lit(".50"))
    return body.select(F.col("l_orderkey").alias("page"), F.concat_ws("\n", opening, heading, "body", F.lit("Page 1 of 1")).alias("text"))


def statement_rows(spark, d):
    found = statement_text.table_rows(pages(spark, d), "page")
    return found.select("page", "row_number", "transaction_date", "description", F.coalesce("amount", "debit").alias("money"), F.col("debit").isNotNull().alias("is_debit"))


def statement_candidates(spark, d):
    found = statement_text.table_rows(pages(spark, d), "page")
    return statement_text.candidates(found, F.lit(1).cast("long"), F.lit("GBP"), "page").select("source_id", "txn_date", "amount", "direction", "error")


def statement_balance_evidence(spark, d):
    each = pages(spark, d).select((F.col("page") % 100).alias("document"), "page", "text")
    return statement_text.balance_evidence(each, "document", "page").select("document", "kind", "page", "line_number", "amount")


_LINES = """l AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_extendedprice) AS n, CAST(l_shipdate AS DATE) AS day, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS cents FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n) AS row_number FROM l)"""
QUERIES = {
    "statement_rows": (
        statement_rows,
        f"""WITH {_LINES} SELECT page, row_number, strftime(day, '%d/%m/%Y') AS transaction_date, 'part ' || l_partkey || CASE WHEN n % 2 = 0 THEN chr(10) || 'delivered late' ELSE '' END AS description, CAST(cents AS VARCHAR) AS money, page % 3 = 0 AS is_debit FROM r""",
    ),
    "statement_candidates": (
        statement_candidates,
        f"""WITH {_LINES} SELECT page || ':' || row_number AS source_id, day AS txn_date, CAST(CASE WHEN page % 3 = 0 THEN -cents ELSE cents END AS DECIMAL(18,2)) AS amount, CASE WHEN page % 3 = 0 THEN 'outflow' ELSE 'inflow' END AS direction, CAST(NULL AS VARCHAR) AS error FROM r""",
    ),
    "statement_balance_evidence": (
        statement_balance_evidence,
        "SELECT l_orderkey % 100 AS document, 'opening' AS kind, max(l_orderkey) AS page, 1 AS line_number, CAST(max(l_orderkey) + 0.5 AS DECIMAL(18,2)) AS amount FROM lineitem GROUP BY 1",
    ),
}
