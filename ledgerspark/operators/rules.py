"""Categories by rule tables: corrections, personal rules, merchant aliases and keywords, in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import text as tx
from ledgerspark.operators import matching

# Fixed values of the domain: what can decide, the strongest first; and why it did.
SOURCES = ("transaction_decision", "personal_rule", "merchant_mapping", "keyword_rule", "ml_model", "needs_review")
CODES = {
    "transaction_decision": "transaction_decision_preserved", "personal_rule": "personal_rule_match", "merchant_mapping": "merchant_mapping_match", "keyword_rule": "keyword_rule_match",
    "needs_review": "no_deterministic_match",
}
AMBIGUOUS = {"personal_rule": "ambiguous_personal_rules", "keyword_rule": "ambiguous_keyword_rules"}
# Fixed values of the domain: facts that a rule can ask for, in their order.
FIELDS = ("merchant", "direction", "account", "description", "amount")


def in_order(fields: Column) -> Column:
    """The facts in their fixed order."""
    return F.filter(F.array(*map(F.lit, FIELDS)), lambda f: F.array_contains(fields, f))


def direction(amount: Column) -> Column:
    return F.when(amount > 0, "inflow").otherwise("outflow")


def personal_matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows that meet all conditions of an active rule of their profile: ``rule_id``, ``category_id``, ``fields`` it asked for and ``rank``.

    ``rules``: profile_id, rule_id, category_id, priority, active, merchant, and direction, account_id, phrase, least, most
    or null. A rule is anchored to a merchant: one without never matches, and rows and rules meet in an equi-join on profile
    and merchant. The rank is the priority, then the number of facts asked for; the bounds of the amount are one fact.
    """
    own = rules.filter("active").select("profile_id", tx.rule_text(F.col("merchant")).alias("_merchant"), *(F.col(c).alias(f"r_{c}") for c in rules.columns if c not in ("profile_id", "merchant", "active")))
    own = F.broadcast(own) if own.limit(matching.FEW + 1).count() <= matching.FEW else own
    r = lambda c: F.col(f"r_{c}")
    size = F.abs("amount")
    asked = {
        "merchant": F.lit(True), "direction": r("direction").isNotNull(), "account": r("account_id").isNotNull(), "description": r("phrase").isNotNull(), "amount": r("least").isNotNull() | r("most").isNotNull(),
    }
    met = rows.withColumn("_merchant", tx.rule_text(F.col("merchant"))).join(own, ["profile_id", "_merchant"]).filter(
        (r("direction").isNull() | (r("direction") == direction(F.col("amount")))) & (r("account_id").isNull() | (r("account_id") == F.col("account_id")))
        & (r("least").isNull() | (size >= r("least"))) & (r("most").isNull() | (size <= r("most")))
        & (r("phrase").isNull() | tx.has_phrase(tx.rule_text(F.col("description")), tx.rule_text(r("phrase"))))
    )
    fields = F.array_compact(F.array(*(F.when(asked[f], F.lit(f)) for f in FIELDS)))
    return met.select("txn_id", r("rule_id").alias("rule_id"), r("category_id").alias("category_id"), fields.alias("fields"), F.struct(r("priority").alias("priority"), F.size(fields).alias("fields")).alias("rank"))


def alias_matches(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows whose merchant is, normalised, an alias (``alias``, ``rule_id``, ``category_id``)."""
    known = aliases.select(tx.rule_text(F.col("alias")).alias("alias"), "rule_id", "category_id")
    known = F.broadcast(known) if known.limit(matching.FEW + 1).count() <= matching.FEW else known
    met = rows.select("txn_id", tx.rule_text(F.col("merchant")).alias("alias")).join(known, "alias")
    return met.select("txn_id", "rule_id", "category_id", F.array(F.lit("merchant")).alias("fields"), F.struct(F.lit(1).alias("priority")).alias("rank"))


def categorise(rows: DataFrame, corrections: DataFrame, personal: DataFrame, aliases: DataFrame, keywords: DataFrame) -> DataFrame:
    """One decision for each row: ``category_id``, ``source``, ``code``, ``rule_id`` and ``fields``.

    ``corrections`` (txn_id, category_id, correction_id) hold the latest of each transaction. The strongest source that has
    a match decides; if its best-ranked matches name several categories, or none has one, the category is needs_review.
    """
    described = rows.withColumn("text", tx.rule_text(F.col("description"))).withColumn("direction", direction(F.col("amount")))
    phrases = keywords.withColumn("phrase", tx.rule_text(F.col("phrase")))
    found = {
        "personal_rule": personal_matches(rows, personal), "merchant_mapping": alias_matches(rows, aliases), "keyword_rule": matching.keyword_matches(described, phrases),
    }
    told = lambda source: F.struct(F.lit(source).alias("tier"), "category_id", "rule_id", "fields").alias(source)
    explicit = corrections.withColumn("rule_id", F.col("correction_id").cast("string")).withColumn("fields", F.array().cast("array<string>"))
    out = rows.select("txn_id").join(explicit.select("txn_id", told("transaction_decision")), "txn_id", "left")
    for source, matches in found.items():
        best = matching.best_rule(matches.select("txn_id").distinct(), "txn_id", matches)
        out = out.join(best.select("txn_id", told(source)), "txn_id", "left")
    out = out.withColumn("d", F.coalesce("transaction_decision", *found)).select("txn_id", "d.*")
    unsure = F.col("tier").isin(*AMBIGUOUS) & (F.col("category_id") == "needs_review") & F.col("rule_id").isNull()
    lookup = lambda names, key: F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key)
    return out.select(
        "txn_id",
        F.coalesce("category_id", F.lit("needs_review")).alias("category_id"),
        F.when(F.col("tier").isNull() | unsure, "needs_review").otherwise(F.col("tier")).alias("source"),
        F.when(F.col("tier").isNull(), CODES["needs_review"]).when(unsure, lookup(AMBIGUOUS, F.col("tier"))).otherwise(lookup(CODES, F.col("tier"))).alias("code"),
        "rule_id",
        in_order(F.coalesce("fields", F.array().cast("array<string>"))).alias("fields"),
    )


def changed(before: DataFrame, after: DataFrame, key: str = "txn_id") -> DataFrame:
    """Decisions that differ from the stored ones in any column that both have, nulls being equal, or are new."""
    both = [c for c in after.columns if c != key and c in before.columns]
    same = before.select(key, *both).withColumn("_known", F.lit(True)).withColumnsRenamed({c: f"_{c}" for c in both})
    equal = F.coalesce("_known", F.lit(False))
    for c in both:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return after.join(same, key, "left").filter(~equal).select(*after.columns)


def single_row_role(description: Column, amount: Column) -> tuple[Column, Column]:
    """The role a row's own words suggest, and how sure: transfer, then refund, then reimbursement; the last two for money coming in."""
    transfer, refund = tx.has_word(description, tx.TRANSFER_WORDS), tx.has_word(description, tx.REFUND_WORDS)
    back = F.lit(False)
    for phrase in tx.REIMBURSEMENT_PHRASES:
        back = back | F.contains(tx.plain_words(description), F.lit(phrase))
    role = F.when(transfer, F.when(amount > 0, "transfer_in").otherwise("transfer_out")).when(refund & (amount > 0), "refund").when(back & (amount > 0), "reimbursement")
    return role, F.when(transfer, 0.55).when((refund | back) & (amount > 0), 0.8)
