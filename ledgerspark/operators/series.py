"""Recurring payments, and the weekly dataset and baselines of a spending forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the domain: a frequency's days, the shorter first.
FREQUENCIES = {"weekly": 7, "fortnightly": 14, "monthly": 30, "quarterly": 91, "annual": 365}


def recurring(ledger: DataFrame, keys: list[str], least: int, amount_tolerance: float, day_tolerance: int) -> DataFrame:
    """Series of ``keys`` with at least ``least`` rows on different days, like amounts and even gaps.

    The median gap picks the nearest frequency, the shorter on a tie; every gap must lie within the tolerance.
    """
    order = Window.partitionBy(*keys).orderBy("txn_date", "txn_id")
    rows = ledger.withColumn("gap", F.datediff("txn_date", F.lag("txn_date").over(order)))
    series = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct("txn_date").alias("days"), F.sum("amount").alias("total"), F.min("amount").alias("lo"), F.max("amount").alias("hi"),
        F.median("gap").alias("median_gap"), F.min("gap").alias("gap_lo"), F.max("gap").alias("gap_hi"), F.max("txn_date").alias("last_date"),
    )
    series = series.filter((F.col("n") >= least) & (F.col("days") == F.col("n")))
    mean = F.col("total").cast("double") / F.col("n")
    series = series.withColumn("amount_deviation", F.greatest(F.col("hi").cast("double") - mean, mean - F.col("lo").cast("double")) / F.abs(mean))
    options = F.array(*(F.struct(F.abs(F.col("median_gap") - d).alias("off"), F.lit(d).alias("interval_days"), F.lit(name).alias("frequency")) for name, d in FREQUENCIES.items()))
    series = series.withColumn("f", F.array_min(options)).withColumn("frequency", F.col("f.frequency")).withColumn("interval_days", F.col("f.interval_days").cast("long"))
    off = F.greatest(F.abs(F.col("gap_lo") - F.col("interval_days")), F.abs(F.col("gap_hi") - F.col("interval_days")))
    return series.filter((F.col("amount_deviation") <= amount_tolerance) & (off <= day_tolerance)).drop("f")


def step(date: Column, frequency: Column) -> Column:
    """The next expected day; months are clamped to their end."""
    return (
        F.when(frequency == "weekly", F.date_add(date, 7)).when(frequency == "fortnightly", F.date_add(date, 14)).when(frequency == "monthly", F.add_months(date, 1))
        .when(frequency == "quarterly", F.add_months(date, 3)).otherwise(F.add_months(date, 12))
    )


def expected(series: DataFrame, as_of: Column) -> DataFrame:
    """Expected days after the last one, a step at a time: those up to ``as_of`` were missed, and the next one follows."""
    steps = F.greatest(F.ceil(F.datediff(as_of, "last_date") / F.least("interval_days", F.lit(28))) + 1, F.lit(1)).cast("int")
    walk = F.aggregate(F.sequence(F.lit(1), steps), F.array("last_date"), lambda days, _: F.concat(days, F.array(step(F.element_at(days, -1), F.col("frequency")))))
    rows = series.withColumn("_days", F.slice(walk, 2, 100_000))
    missed = F.size(F.filter("_days", lambda d: d <= as_of)).cast("long")
    return rows.withColumn("missed", missed).withColumn("next_date", F.array_min(F.filter("_days", lambda d: d > as_of))).drop("_days")


def daily(rows: DataFrame, covered: DataFrame, start: str, end: str, key: str) -> DataFrame:
    """Every day of the period for each key of ``covered`` (merged ranges): spend and rows where the day is covered, zero without rows; nulls where it is not."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    spent = rows.filter(F.col("txn_date").between(first, last)).groupBy(key, "txn_date").agg(F.sum(-F.col("amount")).alias("spend"), F.count("*").alias("rows"))
    keys = covered.select(key).distinct()
    spine = keys.select(key, F.explode(F.sequence(first, last)).alias("txn_date"))
    clipped = covered.select(key, F.greatest("start_date", first).alias("a"), F.least("end_date", last).alias("b")).filter("a <= b")
    known = clipped.select(key, F.explode(F.sequence("a", "b")).alias("txn_date")).withColumn("known", F.lit(True))  # at most the spine's days
    both = spine.join(known, [key, "txn_date"], "left").join(spent, [key, "txn_date"], "left")
    value = lambda c, kind: F.when(F.col("known"), F.coalesce(c, F.lit(0))).cast(kind).alias(c)
    status = F.when(F.col("known"), "covered").otherwise("unknown").alias("status")
    return both.select(key, "txn_date", status, value("spend", "decimal(38,2)"), value("rows", "long"))


def weekly(days: DataFrame, key: str) -> DataFrame:
    """Monday weeks of which all seven days are covered."""
    weeks = days.withColumn("week_start", F.date_trunc("week", "txn_date").cast("date")).groupBy(key, "week_start").agg(F.count("spend").alias("n"), F.sum("spend").cast("decimal(38,2)").alias("target"))
    return weeks.filter("n = 7").drop("n")


def with_known_outflow(weeks: DataFrame, confirmed: DataFrame, key: str) -> DataFrame:
    """Each week with the sum of what confirmed series (``next_date``, ``expected_amount``) are expected to take in it."""
    due = confirmed.filter("expected_amount < 0").withColumn("week_start", F.date_trunc("week", "next_date").cast("date"))
    due = due.groupBy(key, "week_start").agg(F.sum(F.abs("expected_amount")).cast("decimal(38,2)").alias("known_outflow"))
    return weeks.join(due, [key, "week_start"], "left").withColumn("known_outflow", F.coalesce("known_outflow", F.lit(0).cast("decimal(38,2)")))


def confidence(series: DataFrame, as_of: Column, known: DataFrame, account: str, least: int) -> DataFrame:
    """Series with ``covered_missed`` and ``confidence``: the mean of three scores, less 0.15 for each expected day that was covered and stayed empty, within 0 and 1.

    Scores: how even the gaps are, how alike the amounts, how many rows there are. ``known``: merged ranges of each account.
    """
    rows = series.withColumn("_n", F.monotonically_increasing_id())
    steps = F.greatest(F.ceil(F.datediff(as_of, "last_date") / F.least("interval_days", F.lit(28))) + 1, F.lit(1)).cast("int")
    walk = F.aggregate(F.sequence(F.lit(1), steps), F.array("last_date"), lambda days, _: F.concat(days, F.array(step(F.element_at(days, -1), F.col("frequency")))))
    ranges = known.groupBy(account).agg(F.collect_list(F.struct("start_date", "end_date")).alias("_ranges"))  # one account's merged ranges
    rows = rows.join(ranges, account, "left").withColumn("_due", F.filter(walk, lambda d: (d > F.col("last_date")) & (d <= as_of)))
    missed = F.size(F.filter("_due", lambda d: F.exists("_ranges", lambda r: d.between(r["start_date"], r["end_date"]))))
    rows = rows.withColumn("covered_missed", F.when(F.col("_ranges").isNull(), 0).otherwise(missed).cast("long"))
    off = F.greatest(F.abs(F.col("gap_lo") - F.col("interval_days")), F.abs(F.col("gap_hi") - F.col("interval_days")))
    even, like = F.greatest(F.lit(0.0), 1 - off / F.greatest("interval_days", F.lit(1))), F.greatest(F.lit(0.0), 1 - F.col("amount_deviation"))
    enough = F.least(F.lit(1.0), F.col("n") / F.lit(max(least + 2, 1)))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (even + like + enough) / 3 - F.col("covered_missed") * 0.15))
    return rows.withColumn("confidence", F.round(sure, 6)).drop("_n", "_due", "_ranges")


def features(weeks: DataFrame, key: str) -> DataFrame:
    """Lags 1, 2, 4 and means of the 4 and 8 weeks before, where these eight are consecutive."""
    order = Window.partitionBy(key).orderBy("week_start")
    lag = {f"lag_{n}": F.lag("target", n).over(order) for n in (1, 2, 4)}
    mean = {f"mean_{n}": F.round(F.avg(F.col("target").cast("decimal(18,2)")).over(order.rowsBetween(-n, -1)), 6).cast("decimal(22,6)") for n in (4, 8)}
    rows = weeks.withColumns({**lag, **mean, "_first": F.lag("week_start", 8).over(order)})
    return rows.filter(F.datediff("week_start", "_first") == 56).drop("_first")


def baselines(rows: DataFrame, key: str, test_weeks: int) -> DataFrame:
    """MAE, RMSE and bias of simple forecasts on each key's last weeks: all-past mean, last four, the same week a year ago, zero."""
    order = Window.partitionBy(key).orderBy("week_start")
    back = Window.partitionBy(key).orderBy(F.desc("week_start"))
    target = F.col("target").cast("double")
    x = rows.withColumn("_last", F.row_number().over(back)).withColumn("t", target)
    train = x.filter(F.col("_last") > test_weeks)
    recent = train.groupBy(key).agg(F.avg("t").alias("historical_mean"), F.avg(F.when(F.col("_last") <= test_weeks + 4, F.col("t"))).alias("recent_mean"))
    year = x.select(F.col(key), F.date_add("week_start", 364).alias("week_start"), F.col("t").alias("year_ago"))
    test = x.filter(F.col("_last") <= test_weeks).join(recent, key).join(year, [key, "week_start"], "left")
    forecasts = {"historical_mean": F.col("historical_mean"), "recent_mean": F.col("recent_mean"), "seasonal_naive": F.coalesce("year_ago", "historical_mean"), "zero": F.lit(0.0)}
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("baseline"), v.alias("forecast")) for n, v in forecasts.items()))).alias("f")
    errors = test.select(key, "t", listed).select(key, "f.baseline", (F.col("f.forecast") - F.col("t")).alias("e"))
    return errors.groupBy(key, "baseline").agg(F.round(F.avg(F.abs("e")), 4).alias("mae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 4).alias("rmse"), F.round(F.avg("e"), 4).alias("bias"))
