"""A synthetic ledger: recurring series from calendars, daily purchases by seeded hashes, running balances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.functions.normalise import month_days


def unit(seed: int, *parts: str | Column) -> Column:
    """A number in [0, 1) that depends on its arguments alone, so reruns and lost tasks give the same rows."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 20)) / float(1 << 20)


def ledger(spark: SparkSession, accounts: int, start: str, end: str, seed: int = 17) -> DataFrame:
    """Salary and rent each month, groceries each week, and purchases on some days, more at weekends."""
    base = spark.range(accounts).withColumnRenamed("id", "account_id")
    period = lambda step: F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step}"))).alias("txn_date")
    money = lambda c: F.round(c, 2).cast("decimal(18,2)").alias("amount")
    years = F.floor(F.datediff("txn_date", F.lit(start).cast("date")) / 365)
    monthly = base.select("account_id", period("1 month"))
    parts = [
        monthly.select("account_id", "txn_date", F.lit("Employer Ltd").alias("merchant"), F.lit("income").alias("role"), money(2000 + 500 * unit(seed, "account_id"))),
        monthly.select("account_id", F.date_add("txn_date", 2).alias("txn_date"), F.lit("Landlord").alias("merchant"), F.lit("expense").alias("role"), money(-700 * (1 + 0.03 * years))),
        base.select("account_id", period("7 day")).select("account_id", "txn_date", F.lit("Grocer").alias("merchant"), F.lit("expense").alias("role"), money(-40 - 20 * unit(seed, "account_id", "txn_date"))),
    ]
    days = base.select("account_id", period("1 day")).filter(unit(seed + 1, "account_id", "txn_date") < F.when(F.weekday("txn_date") >= 5, 0.48).otherwise(0.4))
    parts.append(days.select("account_id", "txn_date", F.lit("Shop").alias("merchant"), F.lit("expense").alias("role"), money(-5 - 60 * unit(seed + 2, "account_id", "txn_date"))))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).filter(F.col("txn_date") <= F.lit(end).cast("date"))
    order = Window.partitionBy("account_id").orderBy("txn_date", "merchant", "amount")
    return rows.withColumn("txn_id", F.row_number().over(order)).withColumn("balance", F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(18,2)"))


#: Each profile's recurring payments, the library's own, as (series, merchant, role, amount, day of the month or weekday, yearly rise).
MONTHLY = {
    "student": (("maintenance", "Student Finance", "income", 850, 1, 0.0), ("rent", "Student Halls", "expense", -520, 3, 0.04), ("phone", "Mobile Network", "expense", -15, 12, 0.0)),
    "salaried": (("salary", "Employer Ltd", "income", 2600, 28, 0.03), ("rent", "Landlord", "expense", -950, 1, 0.03), ("energy", "Energy Supplier", "expense", -120, 15, 0.05)),
    "irregular": (("rent", "Landlord", "expense", -700, 1, 0.03), ("insurance", "Insurer", "expense", -65, 10, 0.02)),
}
WEEKLY = {"student": ("bus", "City Buses", "expense", -12, 0), "salaried": ("groceries", "Grocer", "expense", -68, 5), "irregular": ("groceries", "Grocer", "expense", -45, 5)}
# Fixed values of the domain: each profile's large purchase, and the clients that irregular income comes from.
LARGE = {"student": -480, "salaried": -1250, "irregular": -780}

CLIENTS = ("Fictional Client A", "Fictional Client B", "Fictional Client C")
#: Each profile's chance of a purchase on a weekday, in ten-thousandths, and what a weekend multiplies it by; shops with their least and most pence. The library's own.
DAILY = {"student": 4500, "salaried": 5500, "irregular": 5000}
WEEKEND = 1.2
#: Accounts of a task that makes their rows.
HELD = 2_000
SHOPS = (("Corner Shop", 250, 2500), ("Cafe Central", 180, 1200), ("High Street Books", 600, 4500), ("City Pharmacy", 300, 3500))


def period_end(start: Column, years: Column) -> Column:
    """The day before the anniversary, for one to three years; the 28th stands for a missing 29 February."""
    return F.when(years.between(1, 3), F.date_sub(F.add_months(start, (years * 12).cast("int")), 1))


def drifted(amount: Column, day: Column, start: Column, rate: Column) -> Column:
    """An amount after the yearly rises since the start's year, half up to a penny."""
    return F.round(amount * (1 + rate * F.greatest(F.year(day) - F.year(start), F.lit(0))), 2).cast("decimal(18,2)")


def posting_date(day: Column) -> Column:
    """The next day that is no weekend."""
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def external_id(profile: Column, sequence: Column) -> Column:
    return F.concat(F.upper(F.left(profile, F.lit(3))), F.lit("-"), F.lpad(sequence.cast("string"), 7, "0"))


def recurring(accounts: DataFrame) -> DataFrame:
    """Monthly and weekly rows of accounts (``account_id``, ``profile``, ``start_date``, ``end_date``) by their profile's lists."""
    spark = accounts.sparkSession
    monthly = [(p, *row) for p, rows in MONTHLY.items() for row in rows]
    weekly = [(p, *row) for p, row in WEEKLY.items()]
    kinds = "profile string, series string, merchant string, role string, base int, day int"
    by_month = accounts.join(F.broadcast(spark.createDataFrame(monthly, f"{kinds}, rate double")), "profile")
    by_month = by_month.withColumn("txn_date", F.explode(month_days(F.col("start_date"), F.col("end_date"), F.col("day"))))
    by_week = accounts.join(F.broadcast(spark.createDataFrame(weekly, kinds)), "profile").withColumn("rate", F.lit(0.0))
    first = F.date_add("start_date", F.pmod(F.col("day") - F.weekday("start_date"), F.lit(7)))
    by_week = by_week.withColumn("txn_date", F.explode(F.when(first <= F.col("end_date"), F.sequence(first, F.col("end_date"), F.expr("interval 7 day")))))
    rows = by_month.unionByName(by_week).withColumn("amount", drifted(F.col("base"), F.col("txn_date"), F.col("start_date"), F.col("rate")))
    return rows.select("account_id", "profile", "txn_date", "series", "merchant", "role", "amount")


def anomalies(accounts: DataFrame, purchases: DataFrame) -> DataFrame:
    """A large purchase in the middle of each account's period, and its first purchase again: on the same day as it is, and on the next under a longer text."""
    amounts = F.create_map(*(F.lit(x) for pair in LARGE.items() for x in pair))
    middle = F.date_add("start_date", F.floor(F.datediff("end_date", "start_date") / 2).cast("int"))
    large = accounts.select("account_id", middle.alias("txn_date"), F.lit("Example Travel").alias("merchant"), amounts[F.col("profile")].cast("decimal(18,2)").alias("amount"), F.lit("unusually_large").alias("anomaly"))
    first = purchases.filter("amount < 0").groupBy("account_id").agg(F.min(F.struct("txn_date", "merchant", "amount")).alias("f")).select("account_id", "f.*")
    exact = first.withColumn("anomaly", F.lit("exact_duplicate"))
    again = first.join(accounts.select("account_id", "end_date"), "account_id")
    again = again.select("account_id", F.least(F.date_add("txn_date", 1), "end_date").alias("txn_date"), F.concat("merchant", F.lit(" REPEAT")).alias("merchant"), "amount", F.lit("probable_duplicate").alias("anomaly"))
    return large.unionByName(exact).unionByName(again)


def balance_breaks(rows: DataFrame) -> DataFrame:
    """Rows (``account_id``, ``txn_date``, ``txn_id``, ``amount``, ``balance``) whose stored balance is not the one before plus their amount."""
    order = Window.partitionBy("account_id").orderBy("txn_date", "txn_id")
    due = F.coalesce(F.lag("balance").over(order), F.lit(0)) + F.col("amount")
    return rows.withColumn("due", due).filter(F.col("due") != F.col("balance"))


def spread(accounts: DataFrame) -> DataFrame:
    """The accounts in partitions of at most about ``HELD``: each becomes hundreds of rows, which one small input file would leave to one task."""
    return accounts.repartition(max(1, math.ceil(accounts.count() / HELD)), "account_id")


def draw(bound: Column | int, seed: int, *parts: str | Column) -> Column:
    """A whole number from 0 to below ``bound``, by the digest of the seed and the parts: any engine draws the same, in any order, again after a loss."""
    text = F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(bound) if isinstance(bound, int) else bound)


def receipts(accounts: DataFrame, seed: int = 17) -> DataFrame:
    """One to four receipts a month of accounts with irregular income, each on a drawn day of the month, from a drawn client, of 250.00 to 1,250.00.

    Every draw is keyed by account, month and number, so no task needs another's. What falls outside the account's period is left out.
    """
    month = F.explode(F.sequence(F.trunc("start_date", "MM"), F.col("end_date"), F.expr("interval 1 month"))).alias("month")
    months = spread(accounts.filter("profile = 'irregular'")).select("account_id", "profile", "start_date", "end_date", month).withColumn("month", F.col("month").cast("date"))
    each = months.withColumn("k", F.explode(F.sequence(F.lit(1), (draw(4, seed, F.lit("count"), "account_id", "month") + 1).cast("int"))))
    pick = lambda bound, what: draw(bound, seed, F.lit(what), "account_id", "month", "k")
    day = F.date_add("month", pick(F.day(F.last_day("month")).cast("long"), "day").cast("int"))
    client = F.element_at(F.array(*map(F.lit, CLIENTS)), (pick(len(CLIENTS), "client") + 1).cast("int"))
    amount = ((pick(100_001, "amount") + 25_000) / 100).cast("decimal(18,2)")
    rows = each.select("account_id", "profile", "start_date", "end_date", day.alias("txn_date"), F.lit("receipt").alias("series"), client.alias("merchant"), F.lit("income").alias("role"), amount.alias("amount"))
    return rows.filter("txn_date BETWEEN start_date AND end_date").drop("start_date", "end_date")


def purchases(accounts: DataFrame, seed: int = 17) -> DataFrame:
    """On each day of an account's period perhaps a purchase, likelier at weekends, at a drawn shop for a drawn price within its range."""
    chance = F.create_map(*(F.lit(x) for pair in DAILY.items() for x in pair))[F.col("profile")]
    days = spread(accounts).select("account_id", "profile", F.explode(F.sequence("start_date", "end_date")).alias("txn_date"))
    bought = days.filter(draw(10_000, seed, F.lit("buys"), "account_id", "txn_date") < chance * F.when(F.weekday("txn_date") >= 5, WEEKEND).otherwise(1.0))
    shop = F.element_at(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(lo).alias("least"), F.lit(hi).alias("most")) for n, lo, hi in SHOPS)), (draw(len(SHOPS), seed, F.lit("shop"), "account_id", "txn_date") + 1).cast("int"))
    named = bought.withColumn("shop", shop)
    price = draw((F.col("shop.most") - F.col("shop.least") + 1).cast("long"), seed, F.lit("price"), "account_id", "txn_date") + F.col("shop.least")
    return named.select("account_id", "profile", "txn_date", F.lit("purchase").alias("series"), F.col("shop.name").alias("merchant"), F.lit("expense").alias("role"), (-price / 100).cast("decimal(18,2)").alias("amount"))


def dataset(accounts: DataFrame, seed: int = 17) -> DataFrame:
    """Whole ledgers of accounts: recurring series, receipts, purchases and anomalies, numbered by date, with external ids and a running balance.

    An exact duplicate is a row printed twice: it carries the balance of the row it repeats, and the id that it has.
    """
    bought = purchases(accounts, seed)
    plain = recurring(accounts).unionByName(receipts(accounts, seed)).unionByName(bought).withColumn("anomaly", F.lit(None).cast("string"))
    odd = anomalies(accounts, bought).join(accounts.select("account_id", "profile"), "account_id").select("account_id", "profile", "txn_date", F.lit("anomaly").alias("series"), "merchant", F.lit("expense").alias("role"), "amount", "anomaly")
    order = Window.partitionBy("account_id").orderBy("txn_date", "merchant", "amount", F.col("anomaly").asc_nulls_first())
    twice = F.coalesce(F.col("anomaly") == "exact_duplicate", F.lit(False))
    rows = plain.unionByName(odd).withColumn("sequence", F.sum(F.when(twice, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    balance = F.sum(F.when(twice, F.lit(0)).otherwise(F.col("amount"))).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(18,2)")
    return rows.withColumn("balance", balance).withColumn("external_id", external_id(F.col("profile"), F.col("sequence")))
