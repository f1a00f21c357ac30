"""Reviews against plain versions: decisions taken one by one, and documents prepared for a review."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import preparation, review, suggestions
from ledgerspark.plans import review_queries
from ledgerspark.sources import statement_text

DIR = "/root/testdata/sf0.001"
MADE = "suggestion_id long, txn_id long, counterpart_id long, suggested_role string, counterpart_role string, status string, reviewed_at long"


def one_by_one(ledger, made, decisions):
    """The plain version: a loop over the decisions in order, with everything in dictionaries."""
    role, amount = {t: r for t, r, _ in ledger}, {t: a for t, _, a in ledger}
    state = {m[0]: [m[5], m[6]] for m in made}
    of = {m[0]: m for m in made}
    fits = lambda r, a: a > 0 if r == "transfer_in" else a < 0
    faults, audits = {}, []
    for decision, suggestion, accepted, at in sorted(decisions, key=lambda x: (x[3], x[0])):
        fault = None
        if suggestion not in of:
            fault = "suggestion_not_found"
        elif state[suggestion][0] != "pending":
            fault = "already_reviewed"
        elif accepted:
            _, a, b, ra, rb, *_ = of[suggestion]
            for txn, new in ((a, ra), (b, rb)):
                if fault is None and txn is not None:
                    fault = "transaction_not_found" if txn not in role else "stale_suggestion" if role[txn] != "unknown" else None if fits(new, amount[txn]) else "role_sign"
        faults[decision] = fault
        if fault is None and accepted:
            state[suggestion] = ["confirmed", at]
            for txn, new in ((a, ra), (b, rb)):
                if txn is not None:
                    audits.append((txn, role[txn], new, suggestion, at))
                    role[txn] = new
            for other, m in of.items():
                if other != suggestion and state[other][0] == "pending" and {m[1], m[2]} & ({a, b} - {None}):
                    state[other] = ["rejected", at]
        elif fault is None:
            state[suggestion] = ["rejected", at]
    return faults, role, state, sorted(audits)


@pytest.mark.parametrize("seed", range(3))
def test_decisions_as_one_by_one(spark, seed):
    draw = random.Random(seed)
    ledger = [(t, draw.choice(["unknown"] * 9 + ["income"]), Decimal(draw.choice([-5, 5]))) for t in range(30)]
    role_of = lambda t: draw.choice(["transfer_in", "transfer_out"]) if t is None or t >= 30 or draw.random() < 0.1 else "transfer_in" if ledger[t][2] > 0 else "transfer_out"
    made = []
    for n in range(40):
        a, b = draw.randrange(31), draw.choice([None, draw.randrange(31), draw.randrange(31)])
        made.append((n, a, b if b != a else None, role_of(a), role_of(b), draw.choice(["pending"] * 8 + ["confirmed"]), None))
    decisions = [(n, draw.randrange(42), draw.random() < 0.8, draw.randrange(20)) for n in range(60)]
    got = suggestions.review(
        spark.createDataFrame(ledger, "txn_id long, role string, amount decimal(18,2)"), spark.createDataFrame(made, MADE), spark.createDataFrame(decisions, "decision_id long, suggestion_id long, accepted boolean, at long")
    )
    faults, role, state, audits = one_by_one(ledger, made, decisions)
    assert {r.decision_id: r.fault for r in got.outcomes.collect()} == faults
    assert {r.txn_id: r.role for r in got.ledger.collect()} == role
    assert {r.suggestion_id: [r.status, r.reviewed_at] for r in got.suggestions.collect()} == state
    assert sorted(map(tuple, got.audits.collect())) == audits


def test_a_path_accepted_from_end_to_end(spark):
    """Every other suggestion of a path takes effect, though each is a rival of the next."""
    ledger = spark.range(9).select(F.col("id").alias("txn_id"), F.lit("unknown").alias("role"))
    made = spark.range(8).select(F.col("id").alias("suggestion_id"), F.col("id").alias("txn_id"), (F.col("id") + 1).alias("counterpart_id"), F.lit("transfer_in").alias("suggested_role"), F.lit("transfer_out").alias("counterpart_role"), F.lit("pending").alias("status"))
    _, state, audits = review.confirm(ledger, made, made.select("suggestion_id", F.lit(True).alias("accepted")), F.lit(1))
    assert {r.suggestion_id: r.status for r in state.collect()} == {i: "rejected" if i % 2 else "confirmed" for i in range(8)}
    assert audits.count() == 8


def test_reviews_without_decisions(spark):
    ledger = spark.createDataFrame([(1, "unknown")], "txn_id long, role string")
    made = spark.createDataFrame([(1, 1, None, "refund", None, "pending", None)], MADE)
    got = suggestions.review(ledger, made, spark.createDataFrame([], "decision_id long, suggestion_id long, accepted boolean, at long"))
    assert got.outcomes.count() == 0 and got.audits.count() == 0
    assert got.ledger.first().role == "unknown" and got.suggestions.first().status == "pending"


def test_prepared_documents(spark):
    text = "Opening balance: 10.00\nDate | Description | Amount\n03/04/2026 | Shop | -2.00\n13/04/2026 | Pay | x\nClosing balance :8.00\nclosing balance: soon"
    pages = spark.createDataFrame([(1, text), (2, "Opening balance 1.00\nClosing balance 1.00"), (3, None), (4, "")], "doc int, text string")
    found = statement_text.table_rows(pages, "doc")
    empty = F.lit(None).cast("array<struct<field:string,confidence:double>>")
    rows = preparation.rows(found.withColumn("confidences", empty), F.lit(1), F.lit("GBP"), "doc", "doc", F.lit("digital_pdf"))
    assert sorted((r.row, r.ambiguous_date, r.sided, tuple(r.reasons)) for r in rows.collect()) == [(1, True, False, ()), (2, False, False, ("extraction_error",))]
    lines = pages.select("doc", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line_number", "text"))
    evidence = statement_text.balance_lines(lines, "doc", "page")
    told = sorted((r.kind, r.issue or "", r.amount) for r in evidence.filter("doc = 1").collect())
    assert told == [("closing", "", 8), ("closing", "invalid_closing_balance", None), ("opening", "", 10)]
    stated = spark.createDataFrame([(1, Decimal(10), Decimal(8)), (2, Decimal(1), Decimal(1)), (3, None, None), (4, Decimal(7), None)], "doc int, opening_balance decimal(18,2), closing_balance decimal(18,2)")
    got = {r.doc: r for r in preparation.documents(stated, rows, evidence, "doc").collect()}
    assert [(got[i].rows, got[i].rows_to_review, got[i].status, got[i].difference, got[i].violation, got[i].confirm_date_format) for i in (1, 2, 3, 4)] == [
        (2, 1, "unavailable", None, None, True), (0, 0, "reconciled", 0, None, False), (0, 0, "unavailable", None, None, False), (0, 0, "unavailable", None, "balance_evidence_missing", False),
    ]
    assert (got[1].balance_lines, got[1].unread_balances, got[1].unread) == (3, 1, 1)
    summed = stated.join(statement_text.summed_balances(evidence, "doc"), "doc", "left")  # the lines are read once
    assert {r.doc: r for r in preparation.documents(summed, rows, None, "doc").collect()} == got
    with pytest.raises(ValueError, match="above zero"):
        preparation.rows(found, F.lit(1), F.lit("GBP"), "doc", "doc", F.lit("ocr_pdf"), 0)


def test_documents_are_made_few_times_and_read_by_compiled_code(spark, capsys):
    """Documents are derived for their rows, recognised lines and balances; no generated method is too large for the JVM to compile."""
    told = review_queries.review_documents(spark, DIR)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 5
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        review_queries.review_documents(spark, DIR).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(sizes) > 10 and max(sizes) < 8000


def test_recognised_lines_keep_rows_without_any(spark):
    """A row of a page of which no line was recognised stays, and so does one without a date."""
    text = "Date | Description | Amount\n03/04/2026 | Shop | -2.00\n | Fee | -1.00"
    found = statement_text.table_rows(spark.createDataFrame([(1, text), (2, text)], "page int, text string"), "page")
    lines = spark.createDataFrame([(1, 2, "03/04/2026 Shop -2.00", 0.9), (1, 3, "Fee -1.00", 0.5)], "page int, line int, text string, confidence double")
    got = statement_text.recognised_lines(found, lines, "page")
    assert got.columns == [*found.columns, "line", "confidences"]
    assert sorted((r.page, r.row_number, r.line, tuple((c.field, c.confidence) for c in r.confidences)) for r in got.collect()) == [
        (1, 1, 2, (("transaction_date", 0.9), ("description", 0.9), ("amount", 0.9))), (1, 2, 2, (("description", 0.9), ("amount", 0.9))),
        (2, 1, None, (("transaction_date", None), ("description", None), ("amount", None))), (2, 2, None, (("description", None), ("amount", None))),
    ]


def test_reconciling_signs(spark):
    """The difference is what the statement says too much; unread amounts and missing balances leave none."""
    stated = spark.createDataFrame([(1, Decimal(10), Decimal(15)), (2, Decimal(10), None), (3, Decimal(1), Decimal(1)), (4, Decimal(0), Decimal(0))], "k int, opening_balance decimal(18,2), closing_balance decimal(18,2)")
    rows = spark.createDataFrame([(1, Decimal(3)), (2, Decimal(1)), (4, None)], "k int, amount decimal(18,2)")
    got = {r.k: (r.movement, r.expected_closing, r.difference, r.status) for r in review.reconcile(stated, rows, "k").collect()}
    assert got == {1: (3, 13, 2, "mismatch"), 2: (1, None, None, "unavailable"), 3: (0, 1, 0, "reconciled"), 4: (0, None, None, "unavailable")}
