"""Queries that match rows with rows or rules: duplicates, transfers, categories; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions import text as tx
from ledgerspark.operators import duplicates, matching
from ledgerspark.plans.bindings import ACTIVITY, LEDGER, activity, ledger, read

#: Keyword rules of the query: (rule_id, phrase, category, direction, priority).
KEYWORDS = [
    ("k1", "the", "common", None, 1), ("k2", "and", "common", None, 1), ("k3", "of the", "pair", None, 5), ("k4", "in", "place", "inflow", 3),
    ("k5", "for", "purpose", "outflow", 3), ("k6", "to", "place", None, 2), ("k7", "or", "choice", None, 2),
]
_KEYWORD_ROWS = ", ".join(f"('{r}', '{p}', '{c}', {'NULL' if d is None else repr(d)}, {n}, {len(p.split())}, {len(p)})" for r, p, c, d, n in KEYWORDS)
_TEXTS = """texts AS (SELECT doc_id AS txn_id, CASE WHEN doc_id % 2 = 0 THEN 'inflow' ELSE 'outflow' END AS direction,
  trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS text FROM documents)"""
_CLOSE = """near AS (SELECT a.account_id, a.txn_id AS first_id, b.txn_id AS second_id, CAST(abs(a.txn_date - b.txn_date) AS BIGINT) AS days, a.amount AS first_amount, b.amount AS second_amount,
  a.merchant AS first_text, b.merchant AS second_text FROM ledger a JOIN ledger b ON a.account_id = b.account_id AND a.txn_id < b.txn_id AND abs(a.txn_date - b.txn_date) <= 2)"""
_NEAR = f"""{_CLOSE[:-1]}
  AND round(a.amount / 100000, 0) = round(b.amount / 100000, 0))"""
_TRANSFERS = """pairs AS (SELECT a.profile_id, a.txn_id AS out_id, b.txn_id AS in_id, CAST(abs(a.txn_date - b.txn_date) AS BIGINT) AS days, a.description AS out_text, b.description AS in_text
  FROM activity a JOIN activity b ON a.profile_id = b.profile_id AND a.amount < 0 AND b.amount = -a.amount AND a.account_id <> b.account_id AND abs(a.txn_date - b.txn_date) <= 3)"""


def _rounded(spark, d):
    """The binding has no equal amounts to speak of, so its amounts are rounded to 100,000."""
    return ledger(spark, d).withColumn("amount", F.round(F.col("amount") / 100000, 0).cast("decimal(18,2)"))


def duplicate_candidates(spark, d):
    return matching.duplicate_candidates(ledger(spark, d)).select("account_id", "first_id", "second_id", "days")


def duplicate_scores_exact_text(spark, d):
    rows = _rounded(spark, d)
    alike = (F.col("first_text") == F.col("second_text")).cast("double")
    return matching.duplicate_scores(matching.duplicate_candidates(rows), alike).select("first_id", "second_id", "score", "status")


def duplicate_scores(spark, d):
    rows = _rounded(spark, d)
    return matching.duplicate_scores(matching.duplicate_candidates(rows), tx.similarity("first_text", "second_text")).select("first_id", "second_id", "score", "status")


def import_resolution(spark, d):
    rows = activity(spark, d).withColumn("amount", F.floor(F.col("amount") / 5).cast("decimal(18,2)"))
    none = F.lit(None).cast("string")
    return duplicates.resolve(rows.select("txn_id", F.col("txn_id").cast("string").alias("source_fingerprint"), "account_id", "txn_date", "amount", F.col("merchant").alias("text"), none.alias("external_id")))


def transfer_candidates(spark, d):
    return matching.transfer_candidates(activity(spark, d)).select("out_id", "in_id", "days")


def transfer_confidence_equal_text(spark, d):
    pairs = matching.transfer_candidates(activity(spark, d))
    scored = matching.transfer_confidence(pairs, (F.col("out_text") == F.col("in_text")).cast("double"))
    return scored.select("out_id", "in_id", "confidence")


def transfer_pairs_greedy(spark, d):
    pairs = matching.transfer_candidates(activity(spark, d))
    return matching.transfer_pairs(matching.transfer_confidence(pairs, tx.similarity("out_text", "in_text")))


def role_language_flags(spark, d):
    rows = activity(spark, d)
    transfer, refund = tx.has_word(F.col("description"), tx.TRANSFER_WORDS), tx.has_word(F.col("description"), tx.REFUND_WORDS)
    suggestion = F.when(transfer, F.when(F.col("amount") > 0, "transfer_in").otherwise("transfer_out")).when(refund & (F.col("amount") > 0), "refund")
    confidence = F.when(transfer, 0.55).when(refund & (F.col("amount") > 0), 0.8)
    return rows.select("txn_id", transfer.alias("transfer"), refund.alias("refund"), suggestion.alias("suggestion"), confidence.cast("double").alias("confidence"))


def keyword_frame(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("txn_id"), F.when(F.col("doc_id") % 2 == 0, "inflow").otherwise("outflow").alias("direction"), tx.rule_text(F.col("text")).alias("text"))
    rules = spark.createDataFrame(KEYWORDS, "rule_id string, phrase string, category_id string, direction string, priority int")
    return matching.best_rule(rows.select("txn_id"), "txn_id", matching.keyword_matches(rows, rules)).drop("fields")


def merchant_mapping(spark, d):
    """Aliases by exact normalised name: a broadcast of a short list."""
    aliases = spark.createDataFrame([("purchase", "shopping"), ("click", "advertising"), ("sign up", "fees"), ("signup", "fees")], "alias string, category_id string")
    rows = activity(spark, d).withColumn("alias", tx.plain_words(F.col("merchant")))
    return rows.join(F.broadcast(aliases), "alias", "left").groupBy("merchant", "category_id").agg(F.count("*").alias("rows"))


def category_precedence(spark, d):
    """A correction beats a personal rule, which beats the merchant's mapping; what is left needs review."""
    rows = activity(spark, d)
    correction = F.when(F.col("txn_id") % 19 == 0, "corrected")
    personal = F.when((F.col("merchant") == "purchase") & (F.abs("amount") > 50), "big_shopping")
    mapped = F.when(F.col("merchant").isin("purchase", "click"), "shopping")
    source = F.when(correction.isNotNull(), "correction").when(personal.isNotNull(), "personal_rule").when(mapped.isNotNull(), "merchant").otherwise("needs_review")
    return rows.select("txn_id", source.alias("source"), F.coalesce(correction, personal, mapped).alias("category_id"))


def latest_label_as_of(spark, d):
    history = read(spark, d, "events").select("event_id", (F.col("user_id")).alias("txn_id"), F.col("event_type").alias("label"), "ts")
    return matching.latest_as_of(history, "txn_id", "label", "ts", "event_id", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


def unresolved_transfers_as_of(spark, d):
    pairs = matching.transfer_candidates(activity(spark, d)).filter("out_date <= date'2024-01-15'")
    return pairs.select(F.explode(F.array("out_id", "in_id")).alias("txn_id")).distinct()


def classification_metrics(spark, d):
    """Per-class precision, recall and F1 of a fixed guess, undefined as zero."""
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.when(F.col("l_quantity") > 30, "N").when(F.col("l_discount") > 0.05, "A").otherwise("R").alias("guess"))
    cells = rows.groupBy("label", "guess").agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("actual"), F.lit(0).alias("predicted")), F.struct(F.col("guess").alias("c"), F.lit(0).alias("actual"), F.lit(1).alias("predicted")))).alias("s")
    hit = F.when((F.col("label") == F.col("guess")) & (F.col("s.actual") == 1), F.col("n"))
    by = cells.select("label", "guess", "n", sides).groupBy(F.col("s.c").alias("class")).agg(F.sum(F.col("n") * F.col("s.actual")).alias("support"), F.sum(F.col("n") * F.col("s.predicted")).alias("predicted"), F.coalesce(F.sum(hit), F.lit(0)).alias("hits"))
    p, r = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return by.select("class", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


QUERIES = {
    "duplicate_candidates": (duplicate_candidates, f"WITH {LEDGER}, {_CLOSE} SELECT account_id, first_id, second_id, days FROM near"),
    "duplicate_scores_exact_text": (
        duplicate_scores_exact_text,
        f"""WITH {LEDGER}, {_NEAR}, s AS (SELECT first_id, second_id, round(0.4 + CASE days WHEN 0 THEN 0.25 WHEN 1 THEN 0.2 ELSE 0.1 END + CASE WHEN first_text = second_text THEN 0.25 ELSE 0 END, 3) AS score
          FROM near WHERE round(first_amount / 100000, 0) = round(second_amount / 100000, 0)) SELECT first_id, second_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.75 THEN 'probable' ELSE 'unique' END AS status FROM s""",
    ),
    "duplicate_scores": (duplicate_scores, None),
    "import_resolution": (import_resolution, None),
    "transfer_candidates": (transfer_candidates, f"WITH {ACTIVITY}, {_TRANSFERS} SELECT out_id, in_id, days FROM pairs"),
    "transfer_confidence_equal_text": (
        transfer_confidence_equal_text,
        f"""WITH {ACTIVITY}, {_TRANSFERS} SELECT out_id, in_id, CAST(round(least(0.99, 0.72 + 0.02 * (3 - days) + CASE WHEN out_text = in_text THEN 0.12 ELSE 0 END
        + CASE WHEN out_text LIKE 'internal transfer %' AND in_text LIKE 'internal transfer %' THEN 0.07 ELSE 0 END), 4) AS DOUBLE) AS confidence FROM pairs""",
    ),
    "transfer_pairs_greedy": (transfer_pairs_greedy, None),
    "role_language_flags": (
        role_language_flags,
        f"""WITH {ACTIVITY}, f AS (SELECT txn_id, amount, description LIKE 'internal transfer %' AS transfer, description LIKE 'refund issued %' AS refund FROM activity)
        SELECT txn_id, transfer, refund, CASE WHEN transfer THEN CASE WHEN amount > 0 THEN 'transfer_in' ELSE 'transfer_out' END WHEN refund AND amount > 0 THEN 'refund' END AS suggestion,
        CAST(CASE WHEN transfer THEN 0.55 WHEN refund AND amount > 0 THEN 0.8 END AS DOUBLE) AS confidence FROM f""",
    ),
    "keyword_rules": (
        keyword_frame,
        f"""WITH {_TEXTS}, rules(rule_id, phrase, category_id, direction, priority, words, chars) AS (VALUES {_KEYWORD_ROWS}),
        m AS (SELECT txn_id, rule_id, category_id, row(priority, CASE WHEN r.direction IS NULL THEN 0 ELSE 1 END, words, chars) AS rnk FROM texts t JOIN rules r
          ON contains(' ' || t.text || ' ', ' ' || r.phrase || ' ') AND (r.direction IS NULL OR r.direction = t.direction)),
        b AS (SELECT txn_id, max(rnk) AS rnk FROM m GROUP BY txn_id),
        f AS (SELECT m.txn_id, CASE WHEN count(DISTINCT category_id) = 1 THEN min(rule_id) END AS rule_id, CASE WHEN count(DISTINCT category_id) = 1 THEN min(category_id) ELSE 'needs_review' END AS category_id FROM m JOIN b ON m.txn_id = b.txn_id AND m.rnk = b.rnk GROUP BY m.txn_id)
        SELECT t.txn_id, f.rule_id, f.category_id FROM texts t LEFT JOIN f ON t.txn_id = f.txn_id""",
    ),
    "merchant_mapping": (
        merchant_mapping,
        f"WITH {ACTIVITY} SELECT merchant, CASE merchant WHEN 'purchase' THEN 'shopping' WHEN 'click' THEN 'advertising' WHEN 'signup' THEN 'fees' END AS category_id, count(*) AS rows FROM activity GROUP BY 1, 2",
    ),
    "category_precedence": (
        category_precedence,
        f"""WITH {ACTIVITY} SELECT txn_id, CASE WHEN txn_id % 19 = 0 THEN 'correction' WHEN merchant = 'purchase' AND abs(amount) > 50 THEN 'personal_rule' WHEN merchant IN ('purchase', 'click') THEN 'merchant' ELSE 'needs_review' END AS source,
        CASE WHEN txn_id % 19 = 0 THEN 'corrected' WHEN merchant = 'purchase' AND abs(amount) > 50 THEN 'big_shopping' WHEN merchant IN ('purchase', 'click') THEN 'shopping' END AS category_id FROM activity""",
    ),
    "latest_label_as_of": (
        latest_label_as_of,
        "SELECT user_id AS txn_id, event_type AS label FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    ),
    "unresolved_transfers_as_of": (
        unresolved_transfers_as_of,
        f"""WITH {ACTIVITY}, early AS (SELECT a.txn_id AS out_id, b.txn_id AS in_id FROM activity a JOIN activity b ON a.profile_id = b.profile_id AND a.amount < 0 AND b.amount = -a.amount
          AND a.account_id <> b.account_id AND abs(a.txn_date - b.txn_date) <= 3 WHERE a.txn_date <= DATE '2024-01-15') SELECT out_id AS txn_id FROM early UNION SELECT in_id FROM early""",
    ),
    "classification_metrics": (
        classification_metrics,
        """WITH g AS (SELECT l_returnflag AS label, CASE WHEN l_quantity > 30 THEN 'N' WHEN l_discount > 0.05 THEN 'A' ELSE 'R' END AS guess FROM lineitem), c AS (SELECT label AS class FROM g UNION SELECT guess FROM g),
        s AS (SELECT class, (SELECT count(*) FROM g WHERE label = class) AS support, (SELECT count(*) FROM g WHERE guess = class) AS predicted, (SELECT count(*) FROM g WHERE guess = class AND label = class) AS hits FROM c)
        SELECT class, support, round(CASE WHEN predicted = 0 THEN 0 ELSE CAST(hits AS DOUBLE) / predicted END, 6) AS precision, round(CASE WHEN support = 0 THEN 0 ELSE CAST(hits AS DOUBLE) / support END, 6) AS recall,
        round(CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0 * CAST(hits AS DOUBLE) / (support + predicted) END, 6) AS f1 FROM s""",
    ),
}
