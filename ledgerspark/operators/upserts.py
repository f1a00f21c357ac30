"""Tables after a run: recurrence candidates, category decisions and feedback, each as a whole new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISION = ("category_id", "source", "status", "confidence", "model_version", "rule_id", "reason_code")


def recurrence(existing: DataFrame, found: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Found series enter as pending; a pending one is refreshed; a confirmed one stays as it is, and a cancelled one suppresses what is found again."""
    new = found.select(*keys, *(F.col(v).alias(f"_new_{v}") for v in values), F.lit(True).alias("_found"))
    both = existing.join(new, keys, "full")
    refresh = F.col("_found") & (F.coalesce("status", F.lit("pending")) == "pending")
    out = [F.when(refresh, F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    return both.select(*keys, *out, F.coalesce("status", F.lit("pending")).alias("status"))


def review_recurrence(candidates: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Pending candidates take their decision (confirmed or cancelled); reviewed ones can't be reviewed again."""
    both = candidates.join(decisions.select(*keys, F.col("decision").alias("_decision")), keys, "left")
    status = F.when(F.col("status") == "pending", F.coalesce("_decision", "status")).otherwise(F.col("status"))
    return both.withColumn("status", status).select(candidates.columns)


def append_decisions(log: DataFrame, proposed: DataFrame, order: Column) -> DataFrame:
    """The proposed decisions that differ, nulls compared as values, from the latest of their transaction."""
    latest = log.groupBy("txn_id").agg(F.max_by(F.struct(*DECISION), order).alias("_last"))
    both = proposed.join(latest, "txn_id", "left")
    same = F.lit(True)
    for name in DECISION:
        same = same & F.col(f"_last.{name}").eqNullSafe(F.col(name))
    return both.filter(F.col("_last").isNull() | ~same).select(proposed.columns)


def hybrid(rows: DataFrame, threshold: float) -> DataFrame:
    """Rule first; else the model's category, applied from the threshold on and pending below it."""
    unmatched = F.col("rule_category").isNull() | (F.col("rule_category") == "needs_review")
    status = F.when(~unmatched, "applied").when(F.col("model_category").isNull(), "needs_review").when(F.col("model_confidence") >= threshold, "applied").otherwise("pending")
    source = F.when(~unmatched, F.col("rule_source")).when(F.col("model_category").isNotNull(), "model").otherwise("none")
    return rows.withColumn("category_id", F.when(unmatched, F.col("model_category")).otherwise(F.col("rule_category"))).withColumn("source", source).withColumn("status", status)


def feedback(assigned: DataFrame, corrections: DataFrame, order: Column) -> DataFrame:
    """Assigned categories after the user's corrections, the last of each transaction."""
    last = corrections.groupBy("txn_id").agg(F.max_by("new_category", order).alias("_new"))
    return assigned.join(last, "txn_id", "left").withColumn("category_id", F.coalesce("_new", "category_id")).select(assigned.columns)


def new_statement_gaps(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Gaps of the statements after an import that no earlier gap contained."""
    old = before.select(F.col(key).alias("_k"), F.col("start_date").alias("_s"), F.col("end_date").alias("_e"))
    inside = (F.col(key) == F.col("_k")) & (F.col("_s") <= F.col("start_date")) & (F.col("_e") >= F.col("end_date"))
    return after.join(old, inside, "left_anti")


def payday_distance(dates: DataFrame, date: str, days: list[int]) -> DataFrame:
    """Days since the last and until the next payday; a payday is clamped to its month's end and may be the date itself."""
    months = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda m: F.add_months(F.trunc(F.col(date), "MM"), m))
    paydays = F.flatten(F.transform(months, lambda m: F.array(*(F.least(F.date_add(m.cast("date"), d - 1), F.last_day(m)) for d in days))))
    last = F.array_max(F.filter(paydays, lambda p: p <= F.col(date)))
    following = F.array_min(F.filter(paydays, lambda p: p >= F.col(date)))
    return dates.withColumn("days_since_payday", F.datediff(date, last).cast("long")).withColumn("days_to_payday", F.datediff(following, date).cast("long"))
