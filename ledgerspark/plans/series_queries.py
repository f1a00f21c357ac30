"""Queries on recurring payments, forecasts, text and amounts; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerspark.functions import money as mn
from ledgerspark.functions import text as tx
from ledgerspark.operators import classifier, intervals, review, series
from ledgerspark.plans.bindings import ACTIVITY, COVERED, LEDGER, activity, coverage, ledger, profile_coverage, read

FROM, TO = "2024-01-01", "2024-01-28"
_WEEKLY = f"""spent AS (SELECT profile_id, txn_date, sum(-amount) AS spend, count(*) AS rows FROM ledger WHERE role = 'expense' AND txn_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-26' GROUP BY profile_id, txn_date),
  daily AS (SELECT s.profile_id, s.txn_date, CASE WHEN s.known THEN 'covered' ELSE 'unknown' END AS status, CASE WHEN s.known THEN CAST(coalesce(spend, 0) AS DECIMAL(38,2)) END AS spend, CASE WHEN s.known THEN coalesce(rows, 0) END AS rows
    FROM (SELECT *, {COVERED.format("txn_date")} AS known FROM (SELECT profile_id, CAST(unnest(generate_series(DATE '1996-01-01', DATE '1999-12-26', INTERVAL 1 DAY)) AS DATE) AS txn_date
    FROM (SELECT DISTINCT profile_id FROM ledger))) s LEFT JOIN spent p ON p.profile_id = s.profile_id AND p.txn_date = s.txn_date),
  weekly AS (SELECT profile_id, CAST(date_trunc('week', txn_date) AS DATE) AS week_start, CAST(sum(spend) AS DECIMAL(38,2)) AS target FROM daily GROUP BY 1, 2 HAVING count(spend) = 7)"""


def recurrence_series(spark, d):
    found = series.recurring(ledger(spark, d), ["account_id", "merchant", "role"], 3, 10.0, 1000)
    return found.select("account_id", "merchant", "role", "n", F.col("median_gap").cast("double").alias("median_gap"), "frequency", "interval_days", "last_date")


def recurrence_next_date(spark, d):
    found = series.recurring(ledger(spark, d), ["account_id", "merchant", "role"], 3, 10.0, 1000)
    return series.expected(found, F.lit("2001-12-31").cast("date")).select("account_id", "merchant", "role", "frequency", "missed", "next_date")


def recurrence_confidence(spark, d):
    found = series.recurring(ledger(spark, d), ["account_id", "merchant", "role"], 3, 10.0, 1000)
    known = intervals.merge(intervals.known(coverage(spark, d), "account_id"), "account_id")
    sure = series.confidence(found, F.lit("2001-12-31").cast("date"), known, "account_id", 3)
    return sure.select("account_id", "merchant", "role", "covered_missed", "confidence")


def forecast_known_outflow(spark, d):
    """Weeks with what monthly series of the profile, one in ten of its rows, take in them."""
    due = ledger(spark, d).filter("txn_id % 10 = 0").select("profile_id", F.col("txn_date").alias("next_date"), F.col("amount").alias("expected_amount"))
    return series.with_known_outflow(series.weekly(_days(spark, d), "profile_id"), due, "profile_id")


def _days(spark, d):
    ranges = intervals.merge(profile_coverage(spark, d), "profile_id", "account_id")
    covered = intervals.in_all(ranges, 2, "profile_id")
    return series.daily(ledger(spark, d).filter("role = 'expense'"), covered, "1996-01-01", "1999-12-26", "profile_id")


def forecast_daily_calendar(spark, d):
    return _days(spark, d)


def forecast_weekly_targets(spark, d):
    return series.weekly(_days(spark, d), "profile_id")


def forecast_features(spark, d):
    rows = series.features(series.weekly(_days(spark, d), "profile_id"), "profile_id")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("mean_4", "mean_8")})


def forecast_folds(spark, d):
    """Expanding folds: each week with the number of earlier ones and the first of them."""
    order = Window.partitionBy("profile_id").orderBy("week_start").rowsBetween(Window.unboundedPreceding, -1)
    weeks = series.weekly(_days(spark, d), "profile_id")
    return weeks.select("profile_id", "week_start", F.count("*").over(order).alias("train_weeks"), F.min("week_start").over(order).alias("train_start"))


def forecast_baselines(spark, d):
    return series.baselines(series.weekly(_days(spark, d), "profile_id"), "profile_id", 26)


def statement_reconciliation(spark, d):
    """Opening, movements and closing of each account's month: reconciled, off, or not available."""
    rows = activity(spark, d).withColumn("month", F.trunc("txn_date", "MM").cast("date"))
    summed = rows.groupBy("account_id", "month").agg(F.sum("amount").cast("decimal(38,2)").alias("total"), F.count("*").alias("rows"))
    opening, off = F.col("account_id").cast("decimal(38,2)"), F.when(F.col("account_id") % 3 == 0, F.lit(0.05)).otherwise(F.lit(0.0)).cast("decimal(38,2)")
    closing = F.when(F.col("account_id") % 5 != 0, opening + F.col("total") + off)
    stated = summed.select("account_id", "month", "rows", opening.alias("opening_balance"), closing.alias("closing_balance"))
    return review.reconcile(stated, rows, ["account_id", "month"]).select("account_id", "month", "movement", "rows", "difference", "status")


def running_balance(spark, d):
    order = Window.partitionBy("account_id").orderBy("txn_date", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    return activity(spark, d).select("txn_id", "account_id", F.sum("amount").over(order).cast("decimal(38,2)").alias("balance"))


def _spelled(spark, d):
    cents = F.col("value").cast("decimal(18,2)")
    grouped = F.format_number(F.col("value") * 1000, 2)
    kind = F.col("event_id") % 6
    spelled = (
        F.when(kind == 0, cents.cast("string")).when(kind == 1, F.concat(F.lit("("), cents.cast("string"), F.lit(")"))).when(kind == 2, F.concat(F.lit("£"), cents.cast("string"), F.lit(" DR")))
        .when(kind == 3, F.replace(cents.cast("string"), F.lit("."), F.lit(","))).when(kind == 4, grouped).otherwise(F.concat(cents.cast("string"), F.lit("x")))
    )
    return read(spark, d, "events").select("event_id", spelled.alias("spelled"))


def amount_parse(spark, d):
    return _spelled(spark, d).select("event_id", mn.parse_amount(F.col("spelled")).alias("amount"))


def date_parse(spark, d):
    day, kind = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    spelled = (
        F.when(kind == 0, day.cast("string")).when(kind == 1, F.date_format(day, "dd/MM/yyyy")).when(kind == 2, F.date_format(day, "dd-MM-yyyy"))
        .when(kind == 3, F.date_format(day, "dd MMM yyyy")).when(kind == 4, F.date_format(day, "d MMMM yyyy")).otherwise("31/02/1999")
    )
    return read(spark, d, "orders").select("o_orderkey", mn.parse_date(spelled).alias("parsed"))


def calendar_features(spark, d):
    day = F.col("o_orderdate").cast("date")
    parts = {"year": F.year(day), "month": F.month(day), "day": F.day(day), "weekday": F.weekday(day), "iso_week": F.weekofyear(day)}
    return read(spark, d, "orders").select("o_orderkey", *(c.cast("long").alias(n) for n, c in parts.items()), (F.weekday(day) >= 5).alias("is_weekend"))


def fingerprints(spark, d):
    key = tx.fingerprint(account=F.col("account_id"), date=F.col("txn_date").cast("string"), amount=F.col("amount").cast("string"), text=tx.matching(F.col("merchant")))
    return ledger(spark, d).select("txn_id", key.alias("fingerprint"))


def rule_text_ascii(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", tx.plain_words(F.col("text")).alias("words"))


def description_cleanup(spark, d):
    return read(spark, d, "part").select("p_partkey", tx.merchant_name(tx.clean(F.concat(F.upper("p_name"), F.lit(" ltd, #"), F.col("p_brand")))).alias("merchant"))


def _labelled(spark, d):
    """Parts with a category that their type tells in its first word, hidden among other words."""
    return read(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), F.element_at(F.split("p_type", " "), 1).alias("category_id"))


def category_model_holdout(spark, d):
    """Metrics of the categoriser and of the most frequent class on a chronological holdout, the last fifth of the parts."""
    rows = _labelled(spark, d)
    last = rows.agg(F.max("p_partkey")).first()[0]
    return classifier.evaluated(rows.filter(F.col("p_partkey") <= last * 0.8), rows.filter(F.col("p_partkey") > last * 0.8))


def category_model_terms(spark, d):
    """Words, pairs and character pieces of each part's text, counted."""
    words, pieces = classifier.terms(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", F.size(words).cast("long").alias("words"), F.size(pieces).cast("long").alias("pieces"))


_RECURRENCE = f"""WITH {LEDGER}, g AS (SELECT *, CAST(txn_date - lag(txn_date) OVER (PARTITION BY account_id, merchant, role ORDER BY txn_date, txn_id) AS BIGINT) AS gap FROM ledger),
  s AS (SELECT account_id, merchant, role, count(*) AS n, count(DISTINCT txn_date) AS days, CAST(sum(amount) AS DOUBLE) / count(*) AS mean, min(amount) AS lo, max(amount) AS hi, CAST(median(gap) AS DOUBLE) AS median_gap,
    min(gap) AS gap_lo, max(gap) AS gap_hi, max(txn_date) AS last_date FROM g GROUP BY account_id, merchant, role HAVING count(*) >= 3 AND count(DISTINCT txn_date) = count(*)),
  f AS (SELECT s.*, frequency, interval_days FROM s, (VALUES ('weekly', 7), ('fortnightly', 14), ('monthly', 30), ('quarterly', 91), ('annual', 365)) v(frequency, interval_days)
    QUALIFY row_number() OVER (PARTITION BY account_id, merchant, role ORDER BY abs(median_gap - interval_days), interval_days) = 1)"""
_FITS = "greatest(CAST(hi AS DOUBLE) - mean, mean - CAST(lo AS DOUBLE)) / abs(mean) <= 10.0 AND greatest(abs(gap_lo - interval_days), abs(gap_hi - interval_days)) <= 1000"
QUERIES = {
    "recurrence_series": (recurrence_series, f"{_RECURRENCE} SELECT account_id, merchant, role, n, median_gap, frequency, CAST(interval_days AS BIGINT) AS interval_days, last_date FROM f WHERE {_FITS}"),
    "recurrence_next_date": (recurrence_next_date, None),
    "recurrence_confidence": (recurrence_confidence, None),
    "forecast_known_outflow": (
        forecast_known_outflow,
        f"""WITH {LEDGER}, {_WEEKLY}, due AS (SELECT profile_id, CAST(date_trunc('week', txn_date) AS DATE) AS week_start, sum(-amount) AS o FROM ledger WHERE txn_id % 10 = 0 AND amount < 0 GROUP BY 1, 2)
        SELECT w.profile_id, w.week_start, target, CAST(coalesce(o, 0) AS DECIMAL(38,2)) AS known_outflow FROM weekly w LEFT JOIN due ON due.profile_id = w.profile_id AND due.week_start = w.week_start""",
    ),
    "forecast_daily_calendar": (forecast_daily_calendar, f"WITH {LEDGER}, {_WEEKLY} SELECT * FROM daily"),
    "forecast_weekly_targets": (forecast_weekly_targets, f"WITH {LEDGER}, {_WEEKLY} SELECT * FROM weekly"),
    "forecast_features": (
        forecast_features,
        f"""WITH {LEDGER}, {_WEEKLY}, x AS (SELECT *, lag(target, 1) OVER w AS lag_1, lag(target, 2) OVER w AS lag_2, lag(target, 4) OVER w AS lag_4, lag(week_start, 8) OVER w AS f8,
        sum(target) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS s4, sum(target) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS s8 FROM weekly WINDOW w AS (PARTITION BY profile_id ORDER BY week_start))
        SELECT profile_id, week_start, target, lag_1, lag_2, lag_4, CAST(s4 AS DOUBLE) / 4 AS mean_4, CAST(s8 AS DOUBLE) / 8 AS mean_8 FROM x WHERE week_start - f8 = 56""",
    ),
    "forecast_folds": (
        forecast_folds,
        f"""WITH {LEDGER}, {_WEEKLY} SELECT profile_id, week_start, count(*) OVER w AS train_weeks, min(week_start) OVER w AS train_start FROM weekly
        WINDOW w AS (PARTITION BY profile_id ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
    "forecast_baselines": (
        forecast_baselines,
        f"""WITH {LEDGER}, {_WEEKLY}, x AS (SELECT *, CAST(target AS DOUBLE) AS t, row_number() OVER (PARTITION BY profile_id ORDER BY week_start DESC) AS back FROM weekly),
        m AS (SELECT profile_id, avg(t) AS hm, avg(CASE WHEN back <= 30 THEN t END) AS rm FROM x WHERE back > 26 GROUP BY profile_id),
        e AS (SELECT x.profile_id, x.t, m.hm, m.rm, coalesce(y.t, m.hm) AS sn FROM x JOIN m ON x.profile_id = m.profile_id LEFT JOIN x y ON y.profile_id = x.profile_id AND y.week_start = x.week_start - 364 WHERE x.back <= 26),
        u AS (SELECT profile_id, 'historical_mean' AS baseline, hm - t AS e FROM e UNION ALL SELECT profile_id, 'recent_mean', rm - t FROM e UNION ALL SELECT profile_id, 'seasonal_naive', sn - t FROM e UNION ALL SELECT profile_id, 'zero', -t FROM e)
        SELECT profile_id, baseline, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e), 4) AS bias FROM u GROUP BY profile_id, baseline""",
    ),
    "statement_reconciliation": (
        statement_reconciliation,
        f"""WITH {ACTIVITY}, s AS (SELECT account_id, CAST(date_trunc('month', txn_date) AS DATE) AS month, CAST(sum(amount) AS DECIMAL(38,2)) AS movement, count(*) AS rows FROM activity GROUP BY 1, 2),
        g AS (SELECT *, CASE WHEN account_id % 5 <> 0 THEN CAST(CASE WHEN account_id % 3 = 0 THEN 0.05 ELSE 0 END AS DECIMAL(38,2)) END AS difference FROM s)
        SELECT *, CASE WHEN difference IS NULL THEN 'unavailable' WHEN abs(difference) <= 0.01 THEN 'reconciled' ELSE 'mismatch' END AS status FROM g""",
    ),
    "running_balance": (running_balance, f"WITH {ACTIVITY} SELECT txn_id, account_id, CAST(sum(amount) OVER (PARTITION BY account_id ORDER BY txn_date, txn_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS balance FROM activity"),
    "amount_parse": (
        amount_parse,
        """SELECT event_id, CAST(CASE event_id % 6 WHEN 1 THEN -CAST(value AS DECIMAL(18,2)) WHEN 2 THEN -CAST(value AS DECIMAL(18,2)) WHEN 4 THEN CAST(round(value * 1000, 2) AS DECIMAL(18,2)) WHEN 5 THEN NULL
        ELSE CAST(value AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount FROM events""",
    ),
    "date_parse": (date_parse, "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 5 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders"),
    "calendar_features": (
        calendar_features,
        """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(day(o_orderdate) AS BIGINT) AS day, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS weekday,
        CAST(weekofyear(o_orderdate) AS BIGINT) AS iso_week, isodow(o_orderdate) >= 6 AS is_weekend FROM orders""",
    ),
    "fingerprints": (
        fingerprints,
        f"""WITH {LEDGER} SELECT txn_id, sha256('{{"account":' || account_id || ',"amount":"' || amount || '","date":"' || txn_date || '","text":"' || trim(regexp_replace(lower(merchant), '[^a-z0-9_]+', ' ', 'g')) || '"}}') AS fingerprint FROM ledger""",
    ),
    "rule_text_ascii": (rule_text_ascii, "SELECT conv_id, turn, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS words FROM conversations"),
    "description_cleanup": (
        description_cleanup,
        """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' LTD ' || array_to_string(list_transform(string_split(trim(regexp_replace(p_brand, '[^A-Za-z0-9 ]', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS merchant FROM part""",
    ),
    "category_model_holdout": (category_model_holdout, None),
    "category_model_terms": (
        category_model_terms,
        """SELECT p_partkey, CAST(2 * len(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 2)) - 1 AS BIGINT) AS words,
        CAST(list_sum(list_transform(string_split(p_name, ' '), lambda w: greatest(length(w), 1) + greatest(length(w) - 1, 1) + greatest(length(w) - 2, 1))) AS BIGINT) AS pieces FROM part""",
    ),
}
