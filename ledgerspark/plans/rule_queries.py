"""Queries on categories by rule tables and on suggestions as of a day; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import matching, rules
from ledgerspark.plans.bindings import ACTIVITY, activity

#: Personal rules of the queries: profile, rule, category, priority, active, merchant, direction, account, phrase, least, most.
PERSONAL = [
    (1, "p1", "shopping", 1, True, "Purchase", None, None, None, None, None), (1, "p2", "big", 1, True, "purchase", None, None, None, 50.0, None), (1, "p3", "spent", 1, True, "PURCHASE!", "outflow", None, None, None, None),
    (1, "p4", "off", 9, False, "purchase", None, None, None, None, None), (2, "p5", "savings", 2, True, "signup", None, None, "Internal  TRANSFER", None, None), (2, "p6", "moved", 2, True, "signup", "inflow", None, None, None, None),
    (3, "p7", "range", 3, True, "view", None, None, None, 5.0, 40.0), (3, "p8", "one", 3, True, "view", None, 13, None, None, None), (3, "p9", "range", 3, True, "view", "inflow", None, None, None, None),
    (4, "pa", "none", 5, True, None, "inflow", None, None, None, None), (5, "pb", "gone", 5, True, "purchase", "inflow", None, None, None, None), (6, "pc", "small", 1, True, "click", None, None, None, None, 20.0),
]
ALIASES = [("Click", "a1", "adverts"), ("purchase", "a2", "goods")]
KEYWORDS = [("w1", "Refund issued", "refunds", None, 2), ("w2", "ref 3", "three", None, 1), ("w3", "ref 2", "two", "inflow", 1), ("w4", "internal transfer", "moves", None, 1), ("w5", "transfer signup", "joins", None, 1)]
_literal = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v)
_VALUES = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in PERSONAL)


def personal_rules(spark):
    return spark.createDataFrame(PERSONAL, "profile_id long, rule_id string, category_id string, priority int, active boolean, merchant string, direction string, account_id long, phrase string, least double, most double")


def personal_rule_matches(spark, d):
    found = rules.personal_matches(activity(spark, d), personal_rules(spark))
    return found.select("txn_id", "rule_id", F.array_join("fields", ",").alias("fields"))


def _decisions(spark, d):
    rows = activity(spark, d)
    corrections = rows.filter("txn_id % 19 = 0").select("txn_id", F.lit("corrected").alias("category_id"), (F.col("txn_id") + 1).alias("correction_id"))
    aliases = spark.createDataFrame(ALIASES, "alias string, rule_id string, category_id string")
    keywords = spark.createDataFrame(KEYWORDS, "rule_id string, phrase string, category_id string, direction string, priority int")
    return rules.categorise(rows, corrections, personal_rules(spark), aliases, keywords)


def rule_decisions(spark, d):
    return _decisions(spark, d).withColumn("fields", F.array_join("fields", ","))


def rule_decisions_changed(spark, d):
    """Against stored decisions that lack every fifth row and name another category in every seventh."""
    now = _decisions(spark, d)
    stored = now.filter("txn_id % 5 <> 0").withColumn("category_id", F.when(F.col("txn_id") % 7 == 0, "other").otherwise(F.col("category_id")))
    return rules.changed(stored, now).select("txn_id")


def unresolved_suggestions_as_of(spark, d):
    """Both rows of transfer suggestions made by 15 January and not reviewed by then: suggested on the outflow's day, reviewed so many days later as its number says."""
    pairs = matching.transfer_candidates(activity(spark, d))
    made = pairs.select("out_id", "in_id", F.col("out_date").alias("created_at"), F.when(F.col("out_id") % 3 != 0, F.date_add("out_date", (F.col("out_id") % 10).cast("int"))).alias("reviewed_at"))
    return matching.unresolved_as_of(made, F.lit("2024-01-15").cast("date"))


_BEST = f"""{ACTIVITY}, p(profile_id, rule_id, category_id, priority, active, merchant, direction, account_id, phrase, least, most) AS (VALUES {_VALUES}),
  w AS (SELECT *, trim(regexp_replace(lower(merchant), '[^a-z0-9]+', ' ', 'g')) AS shop, trim(regexp_replace(lower(phrase), '[^a-z0-9]+', ' ', 'g')) AS words FROM p WHERE active AND merchant IS NOT NULL),
  m AS (SELECT a.txn_id, rule_id, category_id, priority, w.direction IS NOT NULL AS d, w.account_id IS NOT NULL AS o, words IS NOT NULL AS t, least IS NOT NULL OR most IS NOT NULL AS s
    FROM activity a JOIN w ON a.profile_id = w.profile_id AND a.merchant = shop WHERE (w.direction IS NULL OR (w.direction = 'inflow') = (a.amount > 0)) AND (w.account_id IS NULL OR w.account_id = a.account_id)
    AND (words IS NULL OR contains(' ' || a.description || ' ', ' ' || words || ' ')) AND (least IS NULL OR abs(a.amount) >= least) AND (most IS NULL OR abs(a.amount) <= most)),
  n AS (SELECT *, (priority, 1 + d::INT + o::INT + t::INT + s::INT) AS rnk, 'merchant' || CASE WHEN d THEN ',direction' ELSE '' END || CASE WHEN o THEN ',account' ELSE '' END || CASE WHEN t THEN ',description' ELSE '' END || CASE WHEN s THEN ',amount' ELSE '' END AS fields FROM m)"""
_DECIDED = f"""{_BEST}, f AS (SELECT txn_id, count(DISTINCT category_id) > 1 AS many, min(category_id) AS category, arg_min(rule_id, rule_id) AS rule, arg_min(fields, rule_id) AS fields,
    'merchant' || CASE WHEN bool_or(d) THEN ',direction' ELSE '' END || CASE WHEN bool_or(o) THEN ',account' ELSE '' END || CASE WHEN bool_or(t) THEN ',description' ELSE '' END || CASE WHEN bool_or(s) THEN ',amount' ELSE '' END AS every
    FROM (SELECT *, max(rnk) OVER (PARTITION BY txn_id) AS top FROM n) WHERE rnk = top GROUP BY txn_id),
  x AS (SELECT a.*, f.txn_id IS NOT NULL AS personal, many, category, rule, fields, every, merchant IN ('click', 'purchase') AS mapped,
    description LIKE 'refund issued %' AS k1, description LIKE '% ref 3' AS k2, description LIKE '% ref 2' AND amount > 0 AS k3, description LIKE 'internal transfer %' AS k4, description LIKE '%transfer signup %' AS k5 FROM activity a LEFT JOIN f USING (txn_id)),
  y AS (SELECT *, CASE WHEN txn_id % 19 = 0 THEN 1 WHEN personal AND many THEN 3 WHEN personal THEN 2 WHEN mapped THEN 4 WHEN k1 THEN 5 WHEN k3 THEN 6 WHEN k4 THEN 7 WHEN k2 THEN 9 ELSE 10 END AS c FROM x),
  decided AS (SELECT txn_id, CASE c WHEN 1 THEN 'corrected' WHEN 2 THEN category WHEN 4 THEN CASE merchant WHEN 'click' THEN 'adverts' ELSE 'goods' END WHEN 5 THEN 'refunds' WHEN 6 THEN 'two' WHEN 7 THEN 'moves' WHEN 9 THEN 'three' ELSE 'needs_review' END AS category_id,
    CASE c WHEN 1 THEN 'transaction_decision' WHEN 2 THEN 'personal_rule' WHEN 4 THEN 'merchant_mapping' WHEN 3 THEN 'needs_review' WHEN 10 THEN 'needs_review' ELSE 'keyword_rule' END AS source,
    CASE c WHEN 1 THEN 'transaction_decision_preserved' WHEN 2 THEN 'personal_rule_match' WHEN 3 THEN 'ambiguous_personal_rules' WHEN 4 THEN 'merchant_mapping_match' WHEN 10 THEN 'no_deterministic_match' ELSE 'keyword_rule_match' END AS code,
    CASE c WHEN 1 THEN CAST(txn_id + 1 AS VARCHAR) WHEN 2 THEN rule WHEN 4 THEN CASE merchant WHEN 'click' THEN 'a1' ELSE 'a2' END WHEN 5 THEN 'w1' WHEN 6 THEN 'w3' WHEN 7 THEN 'w4' WHEN 9 THEN 'w2' END AS rule_id,
    CASE c WHEN 2 THEN fields WHEN 3 THEN every WHEN 4 THEN 'merchant' WHEN 5 THEN 'description' WHEN 6 THEN 'direction,description' WHEN 7 THEN 'description' WHEN 9 THEN 'description' ELSE '' END AS fields FROM y)"""
QUERIES = {
    "personal_rule_matches": (personal_rule_matches, f"WITH {_BEST} SELECT txn_id, rule_id, fields FROM n"),
    "rule_decisions": (rule_decisions, f"WITH {_DECIDED} SELECT * FROM decided"),
    "rule_decisions_changed": (rule_decisions_changed, f"WITH {_DECIDED} SELECT txn_id FROM decided WHERE txn_id % 5 = 0 OR txn_id % 7 = 0"),
    "unresolved_suggestions_as_of": (
        unresolved_suggestions_as_of,
        f"""WITH {ACTIVITY}, s AS (SELECT a.txn_id AS out_id, b.txn_id AS in_id, a.txn_date AS made, CASE WHEN a.txn_id % 3 <> 0 THEN a.txn_date + CAST(a.txn_id % 10 AS INTEGER) END AS reviewed FROM activity a JOIN activity b
          ON a.profile_id = b.profile_id AND a.amount < 0 AND b.amount = -a.amount AND a.account_id <> b.account_id AND abs(a.txn_date - b.txn_date) <= 3),
        o AS (SELECT * FROM s WHERE made <= DATE '2024-01-15' AND (reviewed IS NULL OR reviewed > DATE '2024-01-15')) SELECT out_id AS txn_id FROM o UNION SELECT in_id FROM o""",
    ),
}
