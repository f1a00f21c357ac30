"""The categoriser's training data as of a cutoff, its snapshots, its holdouts, and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import text as tx
from ledgerspark.operators.asof import AsOf

# Fixed values of the domain: reasons that bar a transaction from training, in the order in which they are asked.
REASONS = (
    "transaction_after_cutoff", "verified_after_cutoff", "source_lineage_mismatch", "unconfirmed_source_row", "untrusted_document", "duplicate_evidence", "no_authoritative_label", "needs_review_label",
    "category_not_found", "category_inactive", "taxonomy_mismatch", "unresolved_financial_role", "excluded_financial_role", "needs_review_flag", "unresolved_transfer", "empty_feature_text",
)
# Fixed values of the domain: issues that say a row repeats another, and sources that are documents.
DUPLICATE_ISSUES = ("exact_duplicate", "probable_duplicate")
DOCUMENTS = ("digital_pdf", "ocr_pdf")


def first_reason(conditions: dict[str, Column]) -> Column:
    """The first of REASONS whose condition holds, null if none does: an eligible row. A condition that is null does not hold."""
    return F.coalesce(*(F.when(conditions[reason], F.lit(reason)) for reason in REASONS))


def issue_codes(issues: Column) -> Column:
    """The codes of the objects in a JSON list; of anything else none."""
    found = F.get_json_object(issues, "$[*].code")  # a list of strings, or the only one in quotes
    listed = F.from_json(found, "array<string>")
    return F.coalesce(F.when(F.startswith(found, F.lit("[")), listed).when(found.isNotNull(), F.array(F.regexp_replace(found, '^"|"$', ""))), F.array().cast("array<string>"))


def candidates(ledger: DataFrame, raw: DataFrame, batches: DataFrame) -> DataFrame:
    """Ledger rows with the lineage of their source: their raw row's review, its issues, and its batch.

    ``ledger``: txn_id, account_id, raw_id, ...; ``raw``: raw_id, batch_id, source_type, review_status, issues (JSON);
    ``batches``: batch_id, account_id, source_type, verification_status.
    """
    source = raw.select("raw_id", "batch_id", F.col("source_type").alias("row_source"), "review_status", issue_codes(F.col("issues")).alias("issue_codes"))
    batch = batches.select("batch_id", F.col("account_id").alias("batch_account"), F.col("source_type").alias("batch_source"), "verification_status")
    return ledger.join(source, "raw_id").join(batch, "batch_id")


def as_of(rows: DataFrame, corrections: DataFrame, audits: DataFrame, flags: DataFrame, suggestions: DataFrame, categories: DataFrame, taxonomy: str, at: AsOf) -> DataFrame:
    """Each of ``candidates`` with the ``category`` and ``role`` known at the cutoff, when the category was decided, and the ``reason`` that bars it, or null.

    ``corrections`` (txn_id, category, at, id), ``audits`` (txn_id, role, at, id), ``flags`` (txn_id, at), ``suggestions`` (kind,
    txn_id, counterpart_id, created_at, reviewed_at), ``categories`` (category_id, active, taxonomy_version).
    """
    labels = at.latest(corrections.withColumn("decided_at", F.col("at")), "txn_id", "category", "decided_at")
    roles = at.latest(audits, "txn_id", "role")
    flagged = flags.filter(F.col("at") <= at.known).select("txn_id").distinct().withColumn("_flagged", F.lit(True))
    open_ = suggestions.filter((F.col("kind") == "transfer") & (F.col("created_at") <= at.known) & (F.col("reviewed_at").isNull() | (F.col("reviewed_at") > at.known)))
    legs = open_.select(F.explode(F.array("txn_id", "counterpart_id")).alias("txn_id")).filter("txn_id IS NOT NULL").distinct().withColumn("_open", F.lit(True))
    known = categories.select(F.col("category_id").alias("category"), F.col("active").alias("_active"), F.col("taxonomy_version").alias("_taxonomy"), F.lit(True).alias("_exists"))
    both = rows.join(labels, "txn_id", "left").join(roles, "txn_id", "left").join(flagged, "txn_id", "left").join(legs, "txn_id", "left").join(known, "category", "left")
    c = F.col
    reason = first_reason({
        "transaction_after_cutoff": c("txn_date") > at.day,
        "verified_after_cutoff": c("verified_at") > at.known,
        "source_lineage_mismatch": ~c("account_id").eqNullSafe(c("batch_account")) | ~c("row_source").eqNullSafe(c("batch_source")),
        "unconfirmed_source_row": ~c("review_status").eqNullSafe("confirmed"),
        "untrusted_document": (c("batch_source").isin(*DOCUMENTS) & ~c("verification_status").eqNullSafe("verified"))
        | ((c("batch_source") == "csv") & ~F.coalesce(c("verification_status").isin("verified", "needs_review"), F.lit(False))),
        "duplicate_evidence": F.arrays_overlap("issue_codes", F.array(*map(F.lit, DUPLICATE_ISSUES))),
        "no_authoritative_label": c("category").isNull(),
        "needs_review_label": c("category") == "needs_review",
        "category_not_found": c("_exists").isNull(),
        "category_inactive": ~c("_active"),
        "taxonomy_mismatch": ~c("_taxonomy").eqNullSafe(taxonomy),
        "unresolved_financial_role": F.coalesce(c("role"), F.lit("unknown")) == "unknown",
        "excluded_financial_role": c("role") == "excluded",
        "needs_review_flag": c("_flagged"),
        "unresolved_transfer": c("_open"),
        "empty_feature_text": ~(tx.has_rule_text(c("merchant")) | tx.has_rule_text(c("description"))),
    })
    return both.withColumn("role", F.coalesce("role", F.lit("unknown"))).withColumn("reason", reason).drop("_flagged", "_open", "_active", "_taxonomy", "_exists")


def exclusions(rows: DataFrame) -> DataFrame:
    """``place`` of each reason that occurs, in the order of REASONS, the reason and its ``rows``."""
    place = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    return rows.filter("reason IS NOT NULL").groupBy(place.alias("place"), "reason").agg(F.count("*").alias("rows"))


EXAMPLE = ("txn_id", "txn_date", "verified_at", "merchant", "description", "merchant_group", "category", "decided_at")


def examples(rows: DataFrame) -> DataFrame:
    """The eligible rows as examples, each with the digest of its content. Their order is by txn_date, verified_at, txn_id."""
    group = F.nullif(tx.rule_text(F.coalesce("merchant", F.lit(""))), F.lit(""))
    kept = rows.filter("reason IS NULL").withColumn("merchant_group", group).select(*EXAMPLE)
    return kept.withColumn("digest", tx.fingerprint(**{c: F.col(c).cast("string") for c in EXAMPLE}))


def snapshot_digest(examples_: DataFrame) -> DataFrame:
    """One row: ``rows`` and the ``digest`` of a set of examples.

    Examples are ordered by what they hold, so a set has one order and needs no sort: the digests are added up in four parts
    of 60 bits each, before the shuffle, and the sums hashed. Equal sets have equal digests, whatever their partitions.
    """
    part = lambda k: F.sum(F.conv(F.substring("digest", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)"))
    sums = [F.coalesce(part(k), F.lit(0).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return examples_.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("digest"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """``txn_id`` and ``change`` (added, removed or changed) of the examples that differ between two snapshots: what a retraining learns anew."""
    old, new = before.select("txn_id", F.col("digest").alias("_old")), after.select("txn_id", F.col("digest").alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return old.join(new, "txn_id", "full").select("txn_id", change.alias("change")).filter("change IS NOT NULL")


def feature_text(merchant: Column, description: Column) -> Column:
    """What the model reads; null for a row without any text."""
    said = [F.coalesce(tx.rule_text(c), F.lit("")) for c in (merchant, description)]
    shown = [F.when(c == "", "missing").otherwise(c) for c in said]
    return F.when((said[0] != "") | (said[1] != ""), F.concat_ws(" ", F.lit("merchant"), shown[0], F.lit("description"), shown[1]))


def chronological(rows: DataFrame, boundary: Column) -> tuple[DataFrame, DataFrame]:
    return rows.filter(F.col("txn_date") <= boundary), rows.filter(F.col("txn_date") > boundary)


def unseen_groups(rows: DataFrame, group: str, share: float, seed: int = 17) -> DataFrame:
    """``held_out``: whether the row's group is among the share kept apart. A group is whole on one side, by a seeded hash of it."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(1 << 20)) / float(1 << 20)
    return rows.withColumn("held_out", place < share)


def class_metrics(cells: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of each class from (label, guess, n); undefined is zero."""
    actual = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("guess"), F.col("n")).otherwise(0)).alias("hits"))
    guessed = cells.groupBy(F.col("guess").alias("class")).agg(F.sum("n").alias("predicted"))
    rows = actual.join(guessed, "class", "full").na.fill(0)
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.select(
        "class", "support", rate(F.col("hits"), F.col("predicted")).alias("precision"), rate(F.col("hits"), F.col("support")).alias("recall"),
        rate(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def overall_metrics(classes: DataFrame) -> DataFrame:
    """Macro means over all classes, and means weighted by support."""
    names = ("precision", "recall", "f1")
    weighted = [F.coalesce(F.try_divide(F.sum(F.col(n) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(f"weighted_{n}") for n in names]
    return classes.agg(*(F.avg(n).alias(f"macro_{n}") for n in names), *weighted)
