"""Queries on reviews: documents prepared for one, and suggestions, decisions and recurrences after one; with the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators import contracts, duplicates, lookups, preparation, review, suggestions, training, upserts
from ledgerspark.plans.bindings import ACTIVITY, LEDGER, activity, ledger, read
from ledgerspark.sources import csv_statements, statement_text

# --- documents: each order is one, of one page; every fourth was recognised, every third has two columns of money


def _documents(spark, d):
    """Opening balances are missing for every eleventh; closing ones are missing, right, off, unreadable, or stated twice. The first amount of every seventh can't be read."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice")
    rows = read(spark, d, "lineitem").withColumn("n", F.row_number().over(order))
    key, cents = F.col("l_orderkey"), F.col("l_extendedprice").cast("decimal(18,2)")
    day = F.date_format(F.col("l_shipdate").cast("date"), "dd/MM/yyyy")
    day = F.when(key % 2 == 0, day).otherwise(F.date_format(F.col("l_shipdate").cast("date"), "yyyy-MM-dd"))
    said = F.when((key % 7 == 0) & (F.col("n") == 1), "n/a").otherwise(cents.cast("string"))
    line = F.concat(day, F.lit(" | part "), F.col("l_partkey").cast("string"), F.lit(" | "), said, F.lit(" |"), F.when(F.col("n") % 2 == 0, "\n | delivered late | |").otherwise(""))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the order of the window before: nothing is sorted again
    body = rows.select(key.alias("document"), "n", F.array_join(F.collect_list(line).over(whole), "\n").alias("body"), F.sum(cents).over(whole).cast("decimal(18,2)").alias("sum")).filter("n = 1")
    key = F.col("document")
    closing = (key + 0.5).cast("decimal(18,2)") + F.when(key % 3 == 0, -F.col("sum")).otherwise(F.col("sum"))
    right = lambda off: F.concat(F.lit("Closing balance : "), (closing + F.lit(off).cast("decimal(18,2)")).cast("string"))
    last = F.when(key % 5 == 1, right("0.00")).when(key % 5 == 2, right("0.05")).when(key % 5 == 3, "closing balance: unknown").when(key % 5 == 4, F.concat(F.lit("Closing balance 1.00\n"), right("0.01")))
    opening = F.when(key % 11 != 0, F.concat(F.lit("Opening  balance: "), key.cast("string"), F.lit(".50")))
    heading = F.when(key % 3 == 0, "Date | Details | Paid out | Paid in").otherwise("Txn Date | Narrative | Amount | Balance")
    return body.select("document", F.concat_ws("\n", opening, heading, "body", last).alias("text"))


def _prepared(spark, d):
    pages = _documents(spark, d)
    found = statement_text.table_rows(pages, "document")
    lines = pages.select("document", F.posexplode(F.split("text", "\n")).alias("at", "text")).withColumn("line_number", F.col("at") + 1)
    sure = F.when((F.col("document") + F.col("line_number")) % 6 == 0, 0.8).otherwise(0.95)
    recognised = lines.filter("document % 4 = 0").select("document", F.col("line_number").alias("line"), "text", sure.alias("confidence"))
    confident = statement_text.recognised_lines(found.filter("document % 4 = 0"), recognised, "document").drop("line")
    plain = found.filter("document % 4 <> 0").withColumn("confidences", F.lit(None).cast(confident.schema["confidences"].dataType))
    source = F.when(F.col("document") % 4 == 0, "ocr_pdf").otherwise("digital_pdf")
    rows = preparation.rows(confident.unionByName(plain), F.lit(1).cast("long"), F.lit("GBP"), "document", "document", source)
    evidence = statement_text.balance_lines(lines.withColumn("page", F.lit(1)), "document", "page")
    return pages, rows, evidence


def review_rows(spark, d):
    _, rows, _ = _prepared(spark, d)
    return rows.select(F.col("document_id").alias("document"), F.col("row").alias("row_number"), "txn_date", "amount", "ambiguous_date", "sided", F.array_join("reasons", ",").alias("reasons"))


def review_documents(spark, d):
    """Every thirteenth document's closing balance was parsed a pound too high, which no line of it states."""
    pages, rows, evidence = _prepared(spark, d)
    parsed = pages.select("document").join(statement_text.summed_balances(evidence, "document", "page", "line_number"), "document", "left")
    parsed = parsed.withColumn("closing_balance", F.col("closing_balance") + F.when(F.col("document") % 13 == 0, 1).otherwise(0)).withColumn("closing_balance", F.col("closing_balance").cast("decimal(18,2)"))
    told = preparation.documents(parsed, rows, None, "document")
    return told.drop("unread", "opening_balance", "closing_balance")


_PAGES = """l AS (SELECT l_orderkey AS document, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_extendedprice) AS n, CAST(l_shipdate AS DATE) AS day, CAST(l_extendedprice AS DECIMAL(18,2)) AS cents FROM lineitem),
  o AS (SELECT *, n + (n - 1) // 2 + CASE WHEN document % 11 <> 0 THEN 2 ELSE 1 END AS place FROM l),
  p AS (SELECT *, min(place) OVER (PARTITION BY document, day) AS line FROM o),
  r AS (SELECT document, n AS row_number, day AS txn_date, CAST(CASE WHEN document % 7 = 0 AND n = 1 THEN NULL WHEN document % 3 = 0 THEN -cents ELSE cents END AS DECIMAL(18,2)) AS amount, cents,
    document % 2 = 0 AND day(day) <= 12 AND day(day) <> month(day) AS ambiguous_date, document % 3 = 0 AS sided, document % 7 = 0 AND n = 1 AS bad, document % 4 = 0 AND (document + line) % 6 = 0 AS low FROM p)"""


# --- suggestions: each event but every fourth is paired with the next one, so that three in a row share legs

_SUGGESTED = [
    "txn_id * 10 AS suggestion_id", "txn_id", "txn_id + 1 AS counterpart_id", "CASE WHEN (sign > 0) = (txn_id % 7 <> 0) THEN 'transfer_in' ELSE 'transfer_out' END AS suggested_role",
    "CASE WHEN next_sign > 0 THEN 'transfer_in' ELSE 'transfer_out' END AS counterpart_role", "CASE WHEN txn_id % 29 = 0 THEN 'rejected' ELSE 'pending' END AS status",
]
#: The moment of a decision in seconds of the day: neighbours are decided in any order.
_SECOND = "CAST((txn_id * 7919) % 1000 AS BIGINT)"


def _reviewed(spark, d):
    events = read(spark, d, "events").select(F.col("event_id").alias("txn_id"), F.when(F.col("event_type").isin("purchase", "click"), -1).otherwise(1).alias("sign"))
    rows = activity(spark, d).select("txn_id", F.when(F.col("txn_id") % 23 == 0, "income").otherwise("unknown").alias("role"), "amount")
    following = events.select((F.col("txn_id") - 1).alias("txn_id"), F.col("sign").alias("next_sign"))
    made = events.filter("txn_id % 4 <> 3").join(following, "txn_id", "left").selectExpr(*_SUGGESTED).withColumn("reviewed_at", F.lit(None).cast("long"))
    decided = events.filter("txn_id % 5 <> 4 AND (txn_id % 4 <> 3 OR txn_id % 40 = 3)").selectExpr("txn_id * 10 AS decision_id", "txn_id * 10 AS suggestion_id", "txn_id % 6 <> 5 AS accepted", f"{_SECOND} AS at")
    again = events.filter("txn_id % 4 <> 3 AND txn_id % 50 = 1").selectExpr("txn_id * 10 + 1 AS decision_id", "txn_id * 10 AS suggestion_id", "false AS accepted", "CAST(5000 AS BIGINT) AS at")
    return suggestions.review(rows, made, decided.unionByName(again))


def suggestion_outcomes(spark, d):
    return _reviewed(spark, d).outcomes.select("decision_id", "suggestion_id", "fault")


def suggestions_after_review(spark, d):
    return _reviewed(spark, d).suggestions.select("suggestion_id", "status", "reviewed_at")


def audits_after_review(spark, d):
    return _reviewed(spark, d).audits


def ledger_after_review(spark, d):
    return _reviewed(spark, d).ledger.groupBy("role").agg(F.count("*").alias("rows"))


#: Three suggestions in a row are edges of a path: those accepted are taken by turns, and one is out if its neighbour is in.
_REVIEWED = f"""{ACTIVITY}, e AS (SELECT event_id AS txn_id, CASE WHEN event_type IN ('purchase', 'click') THEN -1 ELSE 1 END AS sign FROM events),
  led AS (SELECT txn_id, CASE WHEN txn_id % 23 = 0 THEN 'income' ELSE 'unknown' END AS role, amount FROM activity),
  s AS (SELECT a.txn_id * 10 AS suggestion_id, a.txn_id, a.txn_id + 1 AS counterpart_id, a.txn_id // 4 AS block, a.txn_id % 4 AS p, CASE WHEN (a.sign > 0) = (a.txn_id % 7 <> 0) THEN 'transfer_in' ELSE 'transfer_out' END AS suggested_role,
    CASE WHEN b.sign > 0 THEN 'transfer_in' ELSE 'transfer_out' END AS counterpart_role, CASE WHEN a.txn_id % 29 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM e a LEFT JOIN e b ON b.txn_id = a.txn_id + 1 WHERE a.txn_id % 4 <> 3),
  d1 AS (SELECT txn_id * 10 AS decision_id, txn_id * 10 AS suggestion_id, txn_id % 6 <> 5 AS accepted, {_SECOND} AS moment, 1 AS nth FROM e WHERE txn_id % 5 <> 4 AND (txn_id % 4 <> 3 OR txn_id % 40 = 3)
    UNION ALL SELECT txn_id * 10 + 1, txn_id * 10, false, 5000, 2 FROM e WHERE txn_id % 4 <> 3 AND txn_id % 50 = 1),
  k AS (SELECT d1.*, s.block, s.p, s.txn_id, s.counterpart_id, s.suggested_role, s.counterpart_role, s.status, CASE WHEN NOT accepted THEN NULL WHEN a.txn_id IS NULL THEN 'transaction_not_found' WHEN a.role <> 'unknown' THEN 'stale_suggestion'
    WHEN (suggested_role = 'transfer_in') <> (a.amount > 0) THEN 'role_sign' WHEN b.txn_id IS NULL THEN 'transaction_not_found' WHEN b.role <> 'unknown' THEN 'stale_suggestion' WHEN (counterpart_role = 'transfer_in') <> (b.amount > 0) THEN 'role_sign' END AS barred
    FROM d1 LEFT JOIN s USING (suggestion_id) LEFT JOIN led a ON a.txn_id = s.txn_id LEFT JOIN led b ON b.txn_id = s.counterpart_id),
  able AS (SELECT *, row_number() OVER (PARTITION BY suggestion_id ORDER BY moment, decision_id) AS f FROM k WHERE status = 'pending' AND barred IS NULL),
  t AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY moment, decision_id) AS r FROM able WHERE f = 1 AND accepted),
  j AS (SELECT block, max(p) FILTER (r = 1) AS p1, max(p) FILTER (r = 2) AS p2, max(p) FILTER (r = 3) AS p3 FROM t GROUP BY block),
  i AS (SELECT *, p2 IS NOT NULL AND abs(p2 - p1) <> 1 AS in2 FROM j),
  applied AS (SELECT t.* FROM t JOIN i USING (block) WHERE r = 1 OR (r = 2 AND in2) OR (r = 3 AND abs(p3 - p1) <> 1 AND NOT (in2 AND abs(p3 - p2) = 1))),
  rivals AS (SELECT s.suggestion_id, min(row(a.moment, a.decision_id)) AS rival, min(a.moment) AS rival_at FROM s JOIN applied a ON s.block = a.block AND abs(s.p - a.p) = 1 WHERE s.status = 'pending' GROUP BY 1),
  outcomes AS (SELECT k.decision_id, k.suggestion_id, CASE WHEN k.status IS NULL THEN 'suggestion_not_found' WHEN k.status <> 'pending' OR coalesce(rival < row(k.moment, k.decision_id), false)
    OR EXISTS (SELECT 1 FROM able x WHERE x.suggestion_id = k.suggestion_id AND x.f = 1 AND row(x.moment, x.decision_id) < row(k.moment, k.decision_id)) THEN 'already_reviewed' ELSE k.barred END AS fault FROM k LEFT JOIN rivals USING (suggestion_id)),
  ended AS (SELECT s.suggestion_id, CASE WHEN s.status <> 'pending' THEN s.status WHEN a.suggestion_id IS NOT NULL THEN 'confirmed' WHEN rival IS NOT NULL OR x.suggestion_id IS NOT NULL THEN 'rejected' ELSE 'pending' END AS status,
    CASE WHEN s.status = 'pending' THEN CASE WHEN a.suggestion_id IS NOT NULL THEN a.moment WHEN x.suggestion_id IS NOT NULL THEN least(x.moment, rival_at) ELSE rival_at END END AS reviewed_at
    FROM s LEFT JOIN rivals USING (suggestion_id) LEFT JOIN applied a ON a.suggestion_id = s.suggestion_id LEFT JOIN (SELECT suggestion_id, moment FROM able WHERE f = 1 AND NOT accepted) x ON x.suggestion_id = s.suggestion_id),
  taken AS (SELECT txn_id, suggested_role AS new_role, suggestion_id, moment FROM applied UNION ALL SELECT counterpart_id, counterpart_role, suggestion_id, moment FROM applied)"""


# --- the rest of the reviews


def decisions_superseded(spark, d):
    """Every event decides on a transaction; those of every third transaction are reviewed."""
    rows = read(spark, d, "events").select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("txn_id"), F.when(F.col("event_id") % 4 == 0, "applied").otherwise("pending").alias("status"))
    return review.supersede(rows, rows.filter("txn_id % 3 = 0"))


def recurrences_reviewed(spark, d):
    """Customers as candidates, a third of them reviewed already; every other one is decided on now."""
    key = F.col("c_custkey")
    rows = read(spark, d, "customer").select(key.alias("series_id"), F.when(key % 3 == 0, "confirmed").when(key % 9 == 1, "cancelled").otherwise("pending").alias("status"))
    return upserts.review_recurrence(rows, rows.filter("series_id % 2 = 0").select("series_id", F.when(F.col("series_id") % 4 == 0, "cancelled").otherwise("confirmed").alias("decision")), ["series_id"])


def running_balance_snapshots(spark, d):
    """Orders as imported rows, two of seven accepted; every fifth states no balance, every other one a posting date."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = read(spark, d, "orders").select(key.alias("txn_id"), F.col("o_custkey").alias("account_id"), day.alias("txn_date"), F.when(key % 2 == 0, F.date_add(day, 2)).alias("posting_date"), F.when(key % 5 != 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("balance_after"))
    resolved = rows.select("txn_id", F.when(F.col("txn_id") % 7 < 2, "accepted").when(F.col("txn_id") % 7 == 2, "probable").otherwise("exact").alias("status"))
    return duplicates.balance_snapshots(resolved, rows)


def statement_periods(spark, d):
    """Orders as texts that state a period over two lines, in three spellings, or none."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    until = F.date_add(day, 30)
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("Bank\nStatement period: "), F.date_format(day, "dd/MM/yyyy"), F.lit("\n to "), F.date_format(until, "dd/MM/yyyy")))
        .when(key % 4 == 1, F.concat(F.lit("PERIOD from "), day.cast("string"), F.lit(" until "), until.cast("string"), F.lit(" page 1")))
        .when(key % 4 == 2, F.concat(F.lit("period "), F.date_format(day, "d MMM yyyy"), F.lit(" - "), F.date_format(until, "d MMM yyyy")))
    )
    return statement_text.period(read(spark, d, "orders").select(key.alias("statement_id"), text.alias("text")), "statement_id")


def recognised_lines(spark, d):
    """Words of conversations as recognised ones: lines with their text, number of words and mean confidence."""
    words = read(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.lit(1).alias("block"), (F.col("turn") % 2).alias("paragraph"), F.col("turn").alias("line"), F.posexplode(F.split("text", " ")).alias("position", "text"))
    lines = statement_text.words_to_lines(words.withColumn("confidence", F.col("position") % 8 / 8))
    return lines.select("page", "paragraph", "line", F.md5("text").alias("text_md5"), "words", F.round("confidence", 6).alias("confidence"))


def export_layouts(spark, d):
    """Each row of the ledger as the three layouts write it, its cells joined."""
    rows = ledger(spark, d)
    each = [rows.select("txn_id", F.lit(name).alias("layout"), F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in csv_statements.layout(name))).alias("cells")) for name in ("canonical", "debit_credit", "signed_amount")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def feature_texts(spark, d):
    rows = activity(spark, d)
    return rows.select("txn_id", training.feature_text(F.when(F.col("txn_id") % 5 != 0, F.upper("merchant")), F.when(F.col("txn_id") % 3 != 0, F.concat("description", F.lit(" & Co.")))).alias("feature"))


def coverage_of_batches(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.min(F.col("l_shipdate").cast("date")).alias("start_date"), F.max(F.col("l_shipdate").cast("date")).alias("end_date"))
    return lookups.coverage_of_batch(rows, read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("batch_id")))


def rows_by_ids(spark, d):
    """Parts that suppliers name by their nation, and the one row of a customer, an order and a part."""
    wanted = read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("p_partkey"))
    told = [lookups.by_ids(read(spark, d, "part"), "p_partkey", wanted).select(F.lit("parts").alias("of"), F.col("p_partkey").alias("id"))]
    told += [lookups.by_id(read(spark, d, table), key, 7).select(F.lit(table).alias("of"), F.col(key).alias("id")) for table, key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"))]
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])


def record_contracts(spark, d):
    """Orders as folds, freshness reports, recurrences, reconciliations, balances and evaluations, and customers' orders as reviews, some of them broken."""
    orders = read(spark, d, "orders")
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    weeks = lambda first, n: F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.date_add(first, 7 * i))).otherwise(F.array().cast("array<date>"))
    folds = orders.select(weeks(day, key % 5).alias("train_weeks"), weeks(F.date_add(day, F.when(key % 7 == 0, 7).otherwise(70)), key % 3).alias("test_weeks"))
    whole = lambda c: c.cast("int")
    fresh = orders.select(
        day.alias("latest_txn_date"), F.when(key % 10 != 0, whole(key % 4)).alias("txn_age"), day.alias("latest_balance_date"), whole(key % 6).alias("balance_age"),
        F.when(key % 10 != 0, F.least(whole(key % 4), whole(key % 6)) + F.when(key % 11 == 0, 1).otherwise(0)).otherwise(whole(key % 6)).alias("freshness"), day.alias("coverage_start"), F.when(key % 3 != 0, F.date_add(day, 9)).alias("coverage_end"),
        F.when((key % 3 != 0) | (key % 13 == 0), 10).otherwise(0).alias("coverage_days"), F.when(key % 3 != 0, 1).alias("coverage_age"), F.when(key % 2 == 0, "archive").otherwise("active_forecasting").alias("mode"),
        F.when((key % 2 == 0) | (key % 17 == 0), F.array(F.lit("stale"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    dates = F.when(key % 5 == 0, F.array(day, day)).otherwise(F.array(day, F.date_add(day, 30)))
    series = orders.select(dates.alias("dates"), F.date_add(day, F.when(key % 7 == 0, 30).otherwise(60)).alias("next_date"), (key % 12 / 10).alias("confidence"))
    money = lambda c: c.cast("decimal(18,2)")
    price = money(F.col("o_totalprice"))
    sums = orders.select(key, money(key % 100).alias("opening_balance"), price.alias("movement"), F.when(key % 5 != 0, money(price + key % 100 + F.when(key % 3 == 0, 0.02).otherwise(0))).alias("closing_balance"))
    off = money(F.when(F.col("closing_balance").isNull(), None).otherwise(F.when(key % 3 == 0, 0.02).otherwise(0) + F.when(key % 19 == 0, 1).otherwise(0)))
    sums = sums.withColumn("difference", off)
    sums = sums.withColumn("status", F.when(key % 23 == 0, "pending").when(F.col("difference").isNull(), "unavailable").when(F.abs("difference") <= 0.01, "reconciled").otherwise("mismatch"))
    seen = orders.select(F.when(key % 2 == 0, "manual").otherwise("statement").alias("source"), day.alias("as_of_date"), F.date_add(day, (key % 4 - 1).cast("int")).alias("recorded_on"))
    counts = lambda a, b: F.array(F.array((key % 5).cast("long"), F.lit(a).cast("long")), F.array(F.lit(b).cast("long"), F.lit(1).cast("long")))
    judged = orders.select(
        day.alias("train_start"), F.date_add(day, F.when(key % 6 == 0, -1).otherwise(20)).alias("train_end"), F.date_add(day, F.when(key % 7 == 0, 20).otherwise(21)).alias("test_start"), F.date_add(day, 40).alias("test_end"),
        F.when(key % 2 == 0, "unseen_merchant").otherwise("chronological").alias("kind"), (key % 5 + 6 + F.when(key % 11 == 0, 1).otherwise(0)).alias("test_rows"), counts(2, 3).alias("candidate"), F.when(key % 13 == 0, counts(3, 2)).otherwise(counts(2, 3)).alias("baseline"),
    )
    bound = orders.select(F.col("o_custkey"), F.when(key % 50 == 0, "b").otherwise("a").alias("file_hash"), F.lit(1).alias("account_id"), F.when(key % 70 == 0, "EUR").otherwise("GBP").alias("currency"))
    told = {
        "fold": contracts.folds(folds), "freshness": contracts.freshness(fresh), "recurrence": contracts.recurrences(series), "reconciliation": contracts.reconciliations(sums), "balance": contracts.observation_dates(seen),
        "evaluation": contracts.evaluations(judged), "review": contracts.review_bindings(bound, "o_custkey"),
    }
    return reduce(DataFrame.unionByName, [rows.groupBy("violation").agg(F.count("*").alias("rows")).select(F.lit(name).alias("contract"), F.coalesce("violation", F.lit("none")).alias("violation"), "rows") for name, rows in told.items()])


QUERIES = {
    "review_rows": (review_rows, f"WITH {_PAGES} SELECT document, row_number, txn_date, amount, ambiguous_date, sided, concat_ws(',', CASE WHEN bad THEN 'extraction_error' END, CASE WHEN low THEN 'low_ocr_confidence' END) AS reasons FROM r"),
    "review_documents": (
        review_documents,
        f"""WITH {_PAGES}, g AS (SELECT document, count(*) AS rows, count(*) FILTER (bad OR low) AS rows_to_review, count(*) FILTER (low) AS low_confidence, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS movement,
          bool_or(bad) AS unread, bool_or(ambiguous_date) AS confirm_date_format, bool_or(sided) AS confirm_signs, CAST(document + 0.5 + CASE WHEN document % 3 = 0 THEN -sum(cents) ELSE sum(cents) END AS DECIMAL(18,2)) AS whole FROM r GROUP BY document),
        b AS (SELECT *, CASE WHEN document % 11 <> 0 THEN CAST(document + 0.5 AS DECIMAL(38,2)) END AS opening, CASE document % 5 WHEN 1 THEN whole WHEN 2 THEN whole + 0.05 WHEN 4 THEN whole + 0.01 END AS said FROM g),
        c AS (SELECT *, said + CASE WHEN document % 13 = 0 THEN 1 ELSE 0 END AS closing FROM b),
        e AS (SELECT *, CASE WHEN NOT unread AND opening IS NOT NULL AND closing IS NOT NULL THEN CAST(opening + movement AS DECIMAL(38,2)) END AS expected_closing FROM c),
        f AS (SELECT *, CAST(closing - expected_closing AS DECIMAL(38,2)) AS difference FROM e)
        SELECT document, rows, rows_to_review, low_confidence, movement, confirm_date_format, confirm_signs, CAST(CASE WHEN document % 11 <> 0 THEN 1 ELSE 0 END + CASE document % 5 WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS BIGINT) AS balance_lines,
        CAST(CASE WHEN document % 5 = 3 THEN 1 ELSE 0 END AS BIGINT) AS unread_balances, expected_closing, difference, CASE WHEN difference IS NULL THEN 'unavailable' WHEN abs(difference) <= 0.01 THEN 'reconciled' ELSE 'mismatch' END AS status,
        CASE WHEN document % 13 = 0 AND closing IS NOT NULL THEN 'balance_evidence_missing' END AS violation FROM f""",
    ),
    "suggestion_outcomes": (suggestion_outcomes, f"WITH {_REVIEWED} SELECT * FROM outcomes"),
    "suggestions_after_review": (suggestions_after_review, f"WITH {_REVIEWED} SELECT * FROM ended"),
    "audits_after_review": (audits_after_review, f"WITH {_REVIEWED} SELECT txn_id, 'unknown' AS previous_role, new_role, suggestion_id, moment AS changed_at FROM taken"),
    "ledger_after_review": (ledger_after_review, f"WITH {_REVIEWED} SELECT coalesce(new_role, role) AS role, count(*) AS rows FROM led LEFT JOIN taken USING (txn_id) GROUP BY 1"),
    "decisions_superseded": (decisions_superseded, "SELECT event_id AS decision_id, user_id AS txn_id, CASE WHEN event_id % 4 = 0 THEN 'applied' WHEN user_id % 3 = 0 THEN 'superseded' ELSE 'pending' END AS status FROM events"),
    "recurrences_reviewed": (
        recurrences_reviewed,
        "SELECT c_custkey AS series_id, CASE WHEN c_custkey % 3 = 0 THEN 'confirmed' WHEN c_custkey % 9 = 1 THEN 'cancelled' WHEN c_custkey % 4 = 0 THEN 'cancelled' WHEN c_custkey % 2 = 0 THEN 'confirmed' ELSE 'pending' END AS status FROM customer",
    ),
    "running_balance_snapshots": (
        running_balance_snapshots,
        """SELECT o_orderkey AS txn_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS as_of_date, CAST(o_totalprice AS DECIMAL(18,2)) AS balance, 'running_balance' AS source
        FROM orders WHERE o_orderkey % 7 < 2 AND o_orderkey % 5 <> 0""",
    ),
    "statement_periods": (
        statement_periods,
        "SELECT o_orderkey AS statement_id, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS start_date, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) + 30 END AS end_date FROM orders",
    ),
    "recognised_lines": (
        recognised_lines,
        """WITH w AS (SELECT conv_id, turn, text, len(string_split(text, ' ')) AS words FROM conversations WHERE text IS NOT NULL)
        SELECT conv_id AS page, turn % 2 AS paragraph, turn AS line, md5(text) AS text_md5, CAST(words AS BIGINT) AS words, round(list_avg(list_transform(range(words), lambda i: CAST(i % 8 AS DOUBLE) / 8)), 6) AS confidence FROM w""",
    ),
    "export_layouts": (
        export_layouts,
        f"""WITH {LEDGER} SELECT txn_id, 'canonical' AS layout, concat(txn_id, '|', account_id, '|', txn_date, '|', merchant, '|', role, '|', amount) AS cells FROM ledger
        UNION ALL SELECT txn_id, 'debit_credit', concat(txn_date, '|', merchant, '|', CASE WHEN amount < 0 THEN -amount END, '|', CASE WHEN amount > 0 THEN amount END) FROM ledger
        UNION ALL SELECT txn_id, 'signed_amount', concat(txn_date, '|', merchant, '|', amount) FROM ledger""",
    ),
    "feature_texts": (
        feature_texts,
        f"""WITH {ACTIVITY} SELECT txn_id, CASE WHEN txn_id % 15 <> 0 THEN 'merchant ' || CASE WHEN txn_id % 5 <> 0 THEN replace(merchant, '_', ' ') ELSE 'missing' END || ' description ' || CASE WHEN txn_id % 3 <> 0 THEN replace(description, '_', ' ') || ' co' ELSE 'missing' END END AS feature FROM activity""",
    ),
    "coverage_of_batches": (
        coverage_of_batches,
        "SELECT l_orderkey AS batch_id, CAST(min(l_shipdate) AS DATE) AS start_date, CAST(max(l_shipdate) AS DATE) AS end_date FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    ),
    "rows_by_ids": (
        rows_by_ids,
        """SELECT 'parts' AS of, p_partkey AS id FROM part WHERE p_partkey IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey = 7
        UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'part', p_partkey FROM part WHERE p_partkey = 7""",
    ),
    "record_contracts": (
        record_contracts,
        """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), v AS (
        SELECT 'fold' AS contract, CASE WHEN k % 5 = 0 OR k % 3 = 0 THEN 'empty' WHEN k % 7 = 0 AND k % 5 >= 2 THEN 'training_not_before_test' END AS violation FROM o
        UNION ALL SELECT 'freshness', CASE WHEN k % 10 = 0 THEN 'transaction_without_age' WHEN k % 11 = 0 THEN 'not_the_newest_age' WHEN k % 3 = 0 AND k % 13 = 0 THEN 'length_without_coverage' WHEN k % 2 = 1 AND k % 17 = 0 THEN 'active_with_warnings' END FROM o
        UNION ALL SELECT 'recurrence', CASE WHEN k % 5 = 0 THEN 'dates_out_of_order' WHEN k % 7 = 0 THEN 'next_date_not_later' WHEN k % 12 = 11 THEN 'confidence_out_of_range' END FROM o
        UNION ALL SELECT 'reconciliation', CASE WHEN k % 5 <> 0 AND k % 19 = 0 THEN 'wrong_difference' WHEN k % 23 = 0 THEN 'status_does_not_fit' END FROM o
        UNION ALL SELECT 'balance', CASE WHEN k % 4 = 0 THEN 'observed_after_recording' END FROM o
        UNION ALL SELECT 'evaluation', CASE WHEN k % 6 = 0 THEN 'training_dates' WHEN k % 2 = 1 AND k % 7 = 0 THEN 'training_not_before_test' WHEN k % 11 = 0 THEN 'candidate_not_all_rows' WHEN k % 13 = 0 THEN 'different_test_rows' END FROM o
        UNION ALL SELECT 'review', CASE WHEN bool_or(k % 50 = 0) AND bool_or(k % 50 <> 0) THEN 'several_file_hash' WHEN bool_or(k % 70 = 0) AND bool_or(k % 70 <> 0) THEN 'several_currency' END FROM o GROUP BY c)
        SELECT contract, coalesce(violation, 'none') AS violation, count(*) AS rows FROM v GROUP BY 1, 2""",
    ),
}
