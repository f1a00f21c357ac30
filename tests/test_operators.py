"""Operators on small literal tables with known results."""

import datetime as dt
from decimal import Decimal

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerspark.functions import money, text
from ledgerspark.operators import balances, cashflow, intervals, matching, review, series
from ledgerspark.sources import csv_statements, statement_text, store, synthetic

D = dt.date
RANGE = "k int, start_date date, end_date date"


def day(n):
    return D(2026, 1, 1) + dt.timedelta(days=n)


def days_of(rows):
    return {r.start_date + dt.timedelta(days=i) for r in rows for i in range((r.end_date - r.start_date).days + 1)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9)), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9)), min_size=1, max_size=8))
def test_interval_algebra(spark, a, b):
    """Merging keeps the days and is idempotent; intersection and complement are those of the sets of days."""
    frame = lambda x: spark.createDataFrame([(1, day(s), day(s + n)) for s, n in x], RANGE)
    left, right = intervals.merge(frame(a), "k"), intervals.merge(frame(b), "k")
    got = left.collect()
    assert days_of(got) == days_of(frame(a).collect()) and sorted(got) == sorted(intervals.merge(left, "k").collect())
    ordered = sorted(got, key=lambda r: r.start_date)
    assert all((y.start_date - x.end_date).days > 1 for x, y in zip(ordered, ordered[1:], strict=False))
    assert days_of(intervals.intersect(left, right, "k").collect()) == days_of(got) & days_of(right.collect())
    span = spark.createDataFrame([(1, day(0), day(60))], "k int, span_start date, span_end date")
    rest = days_of(intervals.complement(left, span, "k").collect())
    assert rest == {day(i) for i in range(61)} - days_of(got)


def test_indicator_of_two_accounts(spark):
    rows = spark.createDataFrame([(1, D(2026, 1, 1), D(2026, 1, 31)), (1, D(2026, 1, 15), D(2026, 1, 31))], RANGE)
    got = intervals.indicator(rows, F.lit("2026-01-01").cast("date"), F.lit("2026-01-31").cast("date"), 2, "k").first()
    assert (got.full_days, got.partial_days, got.missing_days, got.status) == (17, 14, 0, "partial")


def test_known_ranges_by_status(spark):
    gap = [(D(2026, 1, 4), D(2026, 1, 6))]
    rows = [(1, D(2026, 1, 1), D(2026, 1, 10), "gapped", gap), (1, D(2026, 1, 9), D(2026, 1, 12), "overlapping", []), (1, D(2026, 1, 20), D(2026, 1, 25), "partial", [])]
    frame = spark.createDataFrame(rows, f"{RANGE}, status string, missing array<struct<start_date:date,end_date:date>>")
    got = sorted(intervals.merge(intervals.known(frame, "k"), "k").collect())
    assert [(r.start_date.day, r.end_date.day) for r in got] == [(1, 3), (7, 12)]


def test_totals_and_rate(spark):
    rows = [("income", 2000), ("expense", -600), ("refund", 50), ("reimbursement", 20), ("cash_withdrawal", -30), ("excluded", 80)]
    frame = spark.createDataFrame([(1, r, Decimal(a)) for r, a in rows], "k int, role string, amount decimal(18,2)")
    total = cashflow.savings_rate(cashflow.totals(frame, "k")).first()
    assert total.net == 1440 and total.savings_rate == Decimal("72.00")
    rows = [("income", 100), ("expense", -25), ("refund", 10), ("excluded", 80)]
    frame = spark.createDataFrame([(1, r, Decimal(a)) for r, a in rows], "k int, role string, amount decimal(18,2)")
    assert cashflow.savings_rate(cashflow.totals(frame, "k")).first().savings_rate == Decimal("85.00")
    unknown = frame.unionByName(spark.createDataFrame([(1, "unknown", Decimal(1))], frame.schema))
    assert cashflow.savings_rate(cashflow.totals(unknown, "k")).first().reason == "unresolved_financial_roles"


def test_balance_history_starts_a_segment_at_a_gap(spark):
    points = spark.createDataFrame([(1, day(1), 1, Decimal(5)), (1, day(8), 2, Decimal(6)), (1, day(15), 3, Decimal(7))], "account_id long, as_of_date date, snapshot_id long, balance decimal(18,2)")
    islands = spark.createDataFrame([(1, day(0), day(5)), (1, day(12), day(20))], "account_id long, start_date date, end_date date")
    got = {r.snapshot_id: r.segment_start for r in balances.history(points, islands).collect()}
    assert got == {1: day(0), 2: None, 3: day(12)}


def test_duplicate_scores_fall_with_the_days(spark):
    rows = [(1, n, day(n), Decimal("9.99"), "Shop") for n in range(3)]
    frame = spark.createDataFrame(rows, "account_id long, txn_id long, txn_date date, amount decimal(18,2), merchant string")
    pairs = matching.duplicate_candidates(frame)
    got = sorted((r.days, r.score, r.status) for r in matching.duplicate_scores(pairs, F.lit(1.0)).collect())
    assert got == [(1, 0.85, "probable"), (1, 0.85, "probable"), (2, 0.75, "probable")]
    alike = matching.duplicate_scores(pairs, text.similarity("first_text", "second_text")).select("similarity").distinct().collect()
    assert [r[0] for r in alike] == [1.0]


def test_duplicate_candidates_of_any_amount(spark):
    """Every pair of an account within two days is a candidate; only those of one amount are scored."""
    rows = [(1, 1, day(0), Decimal("9.99"), "Shop"), (1, 2, day(1), Decimal("5.00"), "Cafe"), (1, 3, day(4), Decimal("9.99"), "Shop"), (2, 4, day(0), Decimal("9.99"), "Shop")]
    pairs = matching.duplicate_candidates(spark.createDataFrame(rows, "account_id long, txn_id long, txn_date date, amount decimal(18,2), merchant string"))
    assert [(r.first_id, r.second_id, r.days) for r in pairs.collect()] == [(1, 2, 1)]
    assert matching.duplicate_scores(pairs, F.lit(1.0)).count() == 0


def test_similarity_of_repeated_texts_is_taken_once(monkeypatch):
    import difflib

    plain, taken = difflib.SequenceMatcher, []
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *a, **k: taken.append(a) or plain(*a, **k))
    left, right = pd.Series(["corner shop", None] * 500), pd.Series(["corner shp", "x"] * 500)
    got = pd.concat(text.similarity.func(iter([(left, right)] * 2)))
    assert sorted(set(got.round(3))) == [0.0, 0.952] and len(got) == 2000 and len(taken) == 2


def test_transfer_pairs_are_one_to_one(spark):
    rows = [(1, 1, day(0), -500, "internal transfer"), (2, 2, day(1), 500, "transfer in"), (3, 3, day(0), 500, "internal transfer"), (4, 1, day(2), -500, "x")]
    frame = spark.createDataFrame([(t, 9, a, d, Decimal(m), x) for t, a, d, m, x in rows], "txn_id long, profile_id long, account_id long, txn_date date, amount decimal(18,2), description string")
    scored = matching.transfer_confidence(matching.transfer_candidates(frame), text.similarity("out_text", "in_text"))
    assert sorted((r.out_id, r.in_id) for r in matching.transfer_pairs(scored).collect()) == [(1, 3), (4, 2)]


def test_rules_that_disagree_need_review(spark):
    rows = spark.createDataFrame([(1, "inflow", "monthly rent paid"), (2, "outflow", "parent rent"), (3, "inflow", "trent")], "txn_id long, direction string, text string")
    rules = spark.createDataFrame([("a", "rent", "housing", None, 1), ("b", "paid", "bills", None, 1), ("c", "rent", "home", "outflow", 1)], "rule_id string, phrase string, category_id string, direction string, priority int")
    got = {r.txn_id: r.category_id for r in matching.best_rule(rows.select("txn_id"), "txn_id", matching.keyword_matches(rows, rules)).collect()}
    assert got == {1: "needs_review", 2: "home", 3: None}


def test_months_are_stepped_one_at_a_time(spark):
    frame = spark.createDataFrame([(D(2024, 1, 31), "monthly", 30)], "last_date date, frequency string, interval_days long")
    got = series.expected(frame, F.lit("2024-03-01").cast("date")).first()
    assert (got.missed, got.next_date) == (1, D(2024, 3, 29))


def test_forecast_features(spark):
    weeks = [(1, D(2026, 1, 5) + dt.timedelta(weeks=i), Decimal(10 * i)) for i in range(10)]
    got = sorted(series.features(spark.createDataFrame(weeks, "k int, week_start date, target decimal(38,2)"), "k").collect())
    assert len(got) == 2 and (got[0].lag_1, got[0].lag_2, got[0].lag_4, got[0].mean_4, got[0].mean_8) == (70, 60, 40, 55, 35)


def test_amounts_and_dates(spark):
    amounts = {"1,234.56": "1234.56", "1.234,56": "1234.56", "(12.50)": "-12.50", "£3 DR": "-3.00", "5,00": "5.00", "1,234": "1234.00", "-7": "-7.00", "1'000.5": "1000.50", "1,234.565": "1234.56", "12.3456": None, "abc": None, "": None, "1,2,3": None}
    frame = spark.createDataFrame([(k,) for k in amounts], "t string").select("t", money.parse_amount(F.col("t")).alias("a"))
    assert {r.t: None if r.a is None else str(r.a) for r in frame.collect()} == amounts
    dates = {"2026-02-03": D(2026, 2, 3), "03/02/2026": D(2026, 2, 3), "3 FEB 2026": D(2026, 2, 3), "3 February 2026": D(2026, 2, 3), "31/02/2026": None}
    frame = spark.createDataFrame([(k,) for k in dates], "t string").select("t", money.parse_date(F.col("t")).alias("d"))
    assert {r.t: r.d for r in frame.collect()} == dates


def test_text(spark):
    row = spark.createDataFrame([("ACME  stores ltd, (uk) O'neil-smith",)], "t string").select(text.merchant_name(F.col("t")).alias("m"), text.nfkc_casefold(F.lit("Ｓtraße")).alias("c")).first()
    assert row.m == "Acme Stores LTD UK O'neil-smith" and row.c == "strasse"


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Date;Amount\n2026-01-01;caf\xe9\n2026-01-02;2\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes(b"Date,Date \n1,2\n")
    (tmp_path / "c.csv").write_bytes(b"a,b\n1\n")
    (tmp_path / "d.csv").write_bytes("a\tb\n1\t2\n".encode("utf-16"))
    rows = csv_statements.read(spark, str(tmp_path))
    got = sorted((r.path[-5:], r.row_number, r.error) for r in rows.collect())
    assert got == [("a.csv", 2, None), ("a.csv", 3, None), ("b.csv", None, "repeated_heading"), ("c.csv", None, "ragged"), ("d.csv", 2, None)]
    plan = {field: found[0] for field, found in csv_statements.suggest(["Date", "Amount", "Other"]).items() if found}
    assert plan == {"transaction_date": "Date", "amount": "Amount"}
    assert [r.amount for r in csv_statements.mapped(rows, plan).orderBy("path", "row_number").collect()][:2] == ["café", "2"]
    assert csv_statements.preview(rows, 2).count() == 2


def test_statement_text(spark):
    page = "Statement period: 01/02/2026 to 28/02/2026\nOpening balance: 100.00\n03/02/2026 | Coffee shop | -3.50 | 96.50\nClosing balance 96.50\n05/02/2026  no amount here"
    frame = spark.createDataFrame([(1, page)], "k int, text string")
    assert statement_text.period(frame, "k").first()[1:] == (D(2026, 2, 1), D(2026, 2, 28))
    found = statement_text.balances(frame, "k").first()
    assert (found.opening_balance, found.closing_balance) == (100, Decimal("96.50"))
    rows = statement_text.rows(frame, "k")
    assert [(r.description, r.amount) for r in rows.collect()] == [("Coffee shop", Decimal("-3.50"))]
    assert review.reconcile(statement_text.balances(frame, "k"), rows, "k").first().status == "reconciled"
    words = spark.createDataFrame([(1, 1, 1, 1, 2, "two", 0.5), (1, 1, 1, 1, 1, "one", 1.0)], "page int, block int, paragraph int, line int, position int, text string, confidence double")
    assert statement_text.words_to_lines(words).first()[4:] == (0.75, 2, "one two")


def test_statement_tables(spark):
    """Headings, repeated ones, page numbers, continuations, dated lines without a heading, and recognised lines."""
    text_ = "03/02/2026  Early shop  -1.00\nDate  Description  Amount  Balance\n04/02/2026  Coffee  -3.50  96.50\n  with milk\nDate  Description  Amount  Balance\n2\nPage 2 of 3\n05/02/2026  Rent | x\n06/02/2026  Pay  10.00  106.50"
    found = statement_text.table_rows(spark.createDataFrame([(1, text_), (2, ""), (3, None)], "page int, text string"), "page")
    got = sorted((r.row_number, r.transaction_date, r.description, r.amount, r.balance) for r in found.collect())
    assert got == [(1, "03/02/2026", "Early shop", "-1.00", None), (2, "04/02/2026", "Coffee", "-3.50", "96.50"), (3, "06/02/2026", "Pay", "10.00", "106.50")]
    lines = spark.createDataFrame([(1, 1, "x", 0.9), (1, 2, "04/02/2026 coffee", 0.5), (1, 3, "06/02/2026 pay", 0.95)], "page int, line int, text string, confidence double")
    seen = {r.row_number: r for r in statement_text.recognised_lines(found, lines, "page").collect()}
    assert (seen[1].line, seen[2].line, seen[3].line) == (1, 2, 3) and [c.field for c in seen[1].confidences] == ["transaction_date", "description", "amount"]
    rows = statement_text.recognised_lines(found, lines, "page").withColumn("error", F.when(F.col("row_number") == 3, "invalid_date"))
    assert {r.row_number: r.reasons for r in statement_text.review_reasons(rows).collect()} == {1: [], 2: ["low_ocr_confidence"], 3: ["extraction_error"]}


def test_single_row_roles(spark):
    from ledgerspark.operators import rules

    rows = [("Internal move", 5), ("xfer out", -5), ("REFUND shop", 5), ("refund shop", -5), ("expenses repayment May", 5), ("shop", 5)]
    role, sure = rules.single_row_role(F.col("t"), F.col("a"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string, a int").select(role, sure).collect()]
    assert got == [("transfer_in", 0.55), ("transfer_out", 0.55), ("refund", 0.8), (None, None), ("reimbursement", 0.8), (None, None)]


def test_layouts_and_names(spark):
    fault = csv_statements.layout_fault
    heads = ["Date", "Text", "In", "Out", "Sum"]
    base = {"transaction_date": "Date", "description": "Text"}
    assert fault({**base, "amount": "Sum"}, heads) is None and fault({**base, "debit": "Out", "credit": "In"}, heads) is None
    assert [fault(m, heads) for m in (base, {"amount": "Sum"}, {**base, "debit": "Out"}, {**base, "amount": "text"}, {**base, "amount": "None"})] == ["amount_layout", "missing_field", "amount_layout", "heading_twice", "unknown_heading"]
    names = spark.createDataFrame([("C:\\x\\a.CSV",), ("/b/c.csv ",), ("d.pdf",), (".csv",)], "p string").select(csv_statements.safe_name(F.col("p")).alias("n")).collect()
    assert [r.n for r in names] == ["a.CSV", "c.csv", None, None]


def test_confirming_assigns_both_legs_and_rejects_rivals(spark):
    ledger = spark.createDataFrame([(1, "unknown"), (2, "unknown"), (3, "income")], "txn_id long, role string")
    made = spark.createDataFrame([(10, 1, 2, "transfer_out", "transfer_in", "pending"), (11, 1, 3, "transfer_out", "transfer_in", "pending"), (12, 3, None, "refund", None, "pending")], "suggestion_id long, txn_id long, counterpart_id long, suggested_role string, counterpart_role string, status string")
    decisions = spark.createDataFrame([(10, True)], "suggestion_id long, accepted boolean")
    after, state, audits = review.confirm(ledger, made, decisions, F.lit("2026-01-01").cast("timestamp"))
    assert {r.txn_id: r.role for r in after.collect()} == {1: "transfer_out", 2: "transfer_in", 3: "income"}
    assert {r.suggestion_id: r.status for r in state.collect()} == {10: "confirmed", 11: "rejected", 12: "pending"}
    assert audits.count() == 2


def test_store_commits_all_or_nothing(spark, tmp_path):
    good = spark.range(3)
    where = store.write_all(spark, {"a": good, "b": good}, str(tmp_path / "s"))
    assert spark.read.parquet(f"{where}/b").count() == 3
    bad = good.select(F.raise_error(F.lit("no")).alias("x"))
    try:
        store.write_all(spark, {"a": good, "b": bad}, str(tmp_path / "s"))
        raise AssertionError("should fail")
    except Exception as error:
        assert "should fail" not in str(error)
    assert [p.name for p in (tmp_path / "s").iterdir() if p.name != "_staging"] == [where.rsplit("/", 1)[1]]
    assert store.append_new(spark.range(2), spark.range(4), "id").count() == 2


def test_synthetic_ledger_is_reproducible(spark):
    make = lambda: sorted(map(tuple, synthetic.ledger(spark, 2, "2025-01-01", "2025-12-31").collect()))
    rows = make()
    assert rows == make() and len(rows) > 400
    for name in ("canonical", "debit_credit", "signed_amount"):
        assert synthetic.ledger(spark, 1, "2025-01-01", "2025-02-01").select(*csv_statements.layout(name)).count() > 5


def test_streams(spark, tmp_path):
    from ledgerspark.streaming import ingest

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 1, Decimal(2), dt.datetime(2026, 1, 1)), (2, 1, Decimal(3), dt.datetime(2026, 1, 9)), (2, 1, Decimal(3), dt.datetime(2026, 1, 9))], "txn_id long, account_id long, amount decimal(18,2), ts timestamp")
    rows.write.parquet(source)
    stream = ingest.files(spark, source, rows.schema)
    for n in range(2):
        ingest.append_batches(stream, target, str(tmp_path / f"c{n}"), "txn_id").awaitTermination()
    assert spark.read.parquet(target).count() == 2
    for n in range(2):
        ingest.append_batches(stream, f"{target}-by-day", str(tmp_path / f"d{n}"), "txn_id", by="ts").awaitTermination()
    assert sorted((r.txn_id, str(r["_day"])) for r in spark.read.parquet(f"{target}-by-day").collect()) == [(1, "2026-01-01"), (2, "2026-01-09")]
    query = ingest.daily_spend(stream).writeStream.format("memory").queryName("spend").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.spend for r in spark.sql("SELECT spend FROM spend").collect()] == [2]


def test_taxonomies_of_any_depth(spark):
    from ledgerspark.operators import lookups

    rows = [(0, None), *((i, i - 1) for i in range(1, 40)), (100, 101), (101, 102), (102, 100), (103, 100), (200, 999), (201, 200), (300, 300)]
    got = sorted(map(tuple, lookups.taxonomy_faults(spark.createDataFrame(rows, "category_id long, parent_id long")).collect()))
    assert got == [(100, "cycle"), (101, "cycle"), (102, "cycle"), (103, "cycle"), (200, "missing_parent"), (300, "cycle")]


def test_quoted_delimiters_and_review_thresholds(spark):
    rows, reason = csv_statements.parse(b'"Date; posted; or; not",Description,Amount\n1,2,3\n')
    assert reason is None and len(rows[0][1]) == 3
    frame = spark.createDataFrame([(1, "ocr_pdf", None, [("amount", 0.84)]), (2, "ocr_pdf", None, [("amount", 0.85)]), (3, "digital_pdf", "bad", [("amount", 0.1)])], "id int, source string, error string, confidences array<struct<field:string,confidence:double>>")
    got = {r.id: r.reasons for r in statement_text.review_reasons(frame, F.col("source")).collect()}
    assert got == {1: ["low_ocr_confidence"], 2: [], 3: ["extraction_error"]}


def test_grids_of_cells(spark):
    tables = [
        [["Title"], None, ["Date", "Description", None, "Amount"], ["1/1/2026", "A", "x", "5", "cut off"], [None, " and more ", None, None], ["Page 1"], ["3", "of 4"], ["", " ", None]],
        [["no heading"], ["1/1/2026", "lost", "", "1"]],
        [[" DATE", "description", "money in", "money out"], ["", "still A"], ["2/1/2026", None, "7"], ["Date", "Description", "Amount"], ["", "", "", "9.50"], ["", "", "", "9"]],
    ]
    frame = spark.createDataFrame([("p", tables), ("q", None), ("r", [])], "page string, tables array<array<array<string>>>")
    got = sorted(map(tuple, statement_text.grid_rows(frame, "page").select("row_number", "transaction_date", "description", "amount", "credit", "debit").collect()))
    assert got == [(1, "1/1/2026", "A\nand more\nstill A", "5", None, None), (2, "2/1/2026", None, None, "7", None), (3, None, None, None, None, "9.50")]


def test_synthetic_datasets(spark):
    accounts = spark.createDataFrame([(1, "student", D(2025, 1, 15), D(2025, 6, 14)), (2, "irregular", D(2025, 1, 1), D(2025, 12, 31))], "account_id long, profile string, start_date date, end_date date")
    rows = synthetic.dataset(accounts).collect()
    assert sorted(map(str, rows)) == sorted(map(str, synthetic.dataset(accounts.repartition(7)).collect()))
    months = {}
    for r in rows:
        if r.series == "receipt":
            months.setdefault(r.txn_date.month, []).append(r)
            assert Decimal(250) <= r.amount <= Decimal(1250) and r.merchant in synthetic.CLIENTS
    assert set(months) == set(range(1, 13)) and {len(v) for v in months.values()} <= {1, 2, 3, 4}
    for account in (1, 2):
        own = sorted((r for r in rows if r.account_id == account), key=lambda r: (r.txn_date, r.merchant, r.amount, r.anomaly is not None, r.anomaly or ""))
        total = Decimal(0)
        for r in own:
            total += 0 if r.anomaly == "exact_duplicate" else r.amount
            assert r.balance == total
        twin = next(r for r in own if r.anomaly == "exact_duplicate")
        assert any(r.anomaly is None and (r.external_id, r.balance) == (twin.external_id, twin.balance) for r in own)
        weekend = sum(r.series == "purchase" and r.txn_date.weekday() >= 5 for r in own)
        assert 0 < weekend < sum(r.series == "purchase" for r in own)


def test_evaluations(spark):
    from ledgerspark.operators import contracts

    fine = (D(2026, 1, 1), D(2026, 1, 9), D(2026, 1, 10), D(2026, 1, 20), "chronological", 4, [[1, 1], [0, 2]], [[2, 0], [2, 0]])
    cases = [fine, (D(2026, 1, 10), *fine[1:]), (*fine[:3], D(2026, 1, 9), *fine[4:]), (fine[0], D(2026, 1, 10), *fine[2:]), (fine[0], D(2026, 1, 10), *fine[2:4], "unseen_merchant", *fine[5:]), (*fine[:5], 5, *fine[6:]), (*fine[:7], [[1, 0], [2, 0]]), (*fine[:7], [[3, 0], [1, 0]])]
    schema = "train_start date, train_end date, test_start date, test_end date, kind string, test_rows long, candidate array<array<long>>, baseline array<array<long>>"
    got = [r.violation for r in contracts.evaluations(spark.createDataFrame(cases, schema)).collect()]
    assert got == [None, "training_dates", "test_dates", "training_not_before_test", None, "candidate_not_all_rows", "baseline_not_all_rows", "different_test_rows"]


def test_synthetic_rows_are_made_by_many_tasks(spark, monkeypatch):
    """One small file of accounts doesn't leave all of their rows to one task; the rows are the same however they are dealt."""
    rows = [(n, ("student", "irregular")[n % 2], day(0), day(300)) for n in range(40)]
    accounts = spark.createDataFrame(rows, "account_id long, profile string, start_date date, end_date date").coalesce(1)
    told = lambda df: sorted(map(str, df.collect()))
    whole = [told(make(accounts)) for make in (synthetic.purchases, synthetic.receipts)]
    monkeypatch.setattr(synthetic, "HELD", 5)
    for make, same, tasks in ((synthetic.purchases, whole[0], 8), (synthetic.receipts, whole[1], 4)):
        assert make(accounts).rdd.getNumPartitions() == tasks and told(make(accounts)) == same


def test_links_by_rule_are_those_of_all_suggestions(spark, tmp_path):
    """A crowd of legs of one owner and few sizes and accounts: the links of every pair's suggestion, without the pairs."""
    import random

    from ledgerspark.operators import transfers
    from ledgerspark.plans import evidence_queries

    rng = random.Random(4)
    kinds = ("purchase", "view", "click", "signup")
    rows = [(i, dt.datetime(2024, 1, rng.randint(1, 9)), rng.choice((1, 7, 11, 21, 31, 2)), rng.choice(kinds), float(rng.choice((3, 5, 8)))) for i in range(0, 1500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    d = str(tmp_path)
    want = transfers.links(evidence_queries.suggested(spark, d), evidence_queries.banked(spark, d))
    got = evidence_queries.transfer_links(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 200
    # legs of two accounts only, so that the smallest id is often the leg's own account's
    legs = [(i, i % 2 if i < 40 else 0, 1, dt.date(2024, 1, 1 + i % 6), Decimal(5 if i % 3 else -5), "transfer_in" if i % 3 else "transfer_out", "GBP") for i in range(90)]
    ledger = spark.createDataFrame(legs, "txn_id long, account_id long, profile_id long, txn_date date, amount decimal(18,2), role string, currency string")
    found = dict(map(tuple, transfers.links_by_rule(ledger, F.lit(0), lambda a, b: a == b, 3).collect()))
    assert found and all(found[i] != a for i, a, *_ in legs if i in found)
    assert set(found) == {x[0] for x in legs for y in legs if x[4] == -y[4] and x[1] != y[1] and abs((x[3] - y[3]).days) <= 3}


def test_rule_text_is_known_to_be_empty_without_python(spark):
    """Every character that folds to something else, with what stands beside it; and no Python worker for the reasons of exclusion."""
    import sys
    import unicodedata

    from ledgerspark.plans import evidence_queries

    odd = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Co", "Cs") and unicodedata.normalize("NFKC", c).casefold() != c]
    texts = [*odd, *map(chr, range(1, 0x3400)), "-- !", "", "\uff9e\uff9f", "- \u2122", "e\u0301", "\u0301", " \u3099", "\u30ab\u3099", "<\u0338", None]
    rows = spark.createDataFrame([(t,) for t in texts if t is None or not 0xD800 <= ord(t[:1] or " ") < 0xE000], "t string")
    told = rows.select("t", text.has_rule_text(F.col("t")).alias("has"), (F.coalesce(text.rule_text(F.col("t")), F.lit("")) != "").alias("want"))
    assert told.filter("has <> want").collect() == [] and told.filter("has").count() > 1000
    plan = evidence_queries.training_exclusions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_cells_between_pipes_and_headings_within_a_page(spark):
    """Blanks around pipes go, empty cells stay in place; a heading holds until the next, whatever its case."""
    page = "Txn  Date|Narrative  |  Amount |Balance\n01/02/2024|   shop |   5.00|\n  |   late   |  |\nDATE | Details | Paid Out | Paid in\n02/02/2024 |a  b| | 7.00 |\nPage 1 of 2\n03/02/2024 | updated transaction | 1.00 | |"
    got = statement_text.table_rows(spark.createDataFrame([(1, page)], "page long, text string"), "page").orderBy("row_number").collect()
    assert [(r.transaction_date, r.description, r.amount, r.debit, r.credit, r.lines) for r in got] == [
        ("01/02/2024", "shop\nlate", "5.00", None, None, [1, 2]),
        ("02/02/2024", "a  b", None, None, "7.00", [4]),
        ("03/02/2024", "updated transaction", None, "1.00", None, [6]),
    ]
    texts = ["a b", " a  b ", "a\tb", " a​b", "", " ", "x", " x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.clean(F.col("t")).alias("c"), F.expr(r"trim(regexp_replace(regexp_replace(t, '\\p{C}', ' '), '\\s+', ' '))").alias("w"))
    assert rows.filter("c <> w").collect() == []
