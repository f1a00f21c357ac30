"""Decisions on role suggestions, as if they were taken one after the other, computed for all of them at once.

A decision finds its suggestion pending or it has no effect. One accepted gives both legs their roles
and rejects every other pending suggestion that touches a leg, so an accepted suggestion bars those
after it that share a leg with it, and no others: a chain of three may keep its first and its last.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.normalise import role_sign_violation
from ledgerspark.session import cut


class Reviewed(NamedTuple):
    """``outcomes``: each decision with its ``fault``, null if it took effect; the tables as they are after it; and the new audits."""

    outcomes: DataFrame
    ledger: DataFrame
    suggestions: DataFrame
    audits: DataFrame


def _legs(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each leg of a suggestion, with the role it would take."""
    leg = lambda txn, role: F.struct(F.col(txn).alias("leg"), F.col(role).alias("new_role"))
    both = F.explode(F.array(leg("txn_id", "suggested_role"), leg("counterpart_id", "counterpart_role"))).alias("l")
    return rows.select("suggestion_id", *more, both).select("suggestion_id", *more, "l.*").filter("leg IS NOT NULL")


def settled(accepted: DataFrame) -> DataFrame:
    """Of accepted suggestions (``turn``: their order, and their legs) those that take effect: no earlier one that does shares a leg.

    In each round what is first at all its legs takes effect, and what shares a leg with it goes. Suggestions that
    share no leg are settled in the first round; a chain of n that was accepted from end to end takes n / 2. Rounds are written to the
    checkpoint folder; nothing is gathered.
    """
    done, left = [], cut(accepted)
    while True:
        legs = _legs(left, "turn")
        first = legs.groupBy("leg").agg(F.min("turn").alias("first"))
        ahead = legs.join(first, "leg").groupBy("suggestion_id").agg(F.every(F.col("first") == F.col("turn")).alias("ahead")).filter("ahead")
        won = cut(left.join(ahead.select("suggestion_id"), "suggestion_id", "left_semi"))
        done.append(won)
        taken = _legs(won).select("leg").distinct()
        lost = _legs(left).join(taken, "leg", "left_semi").select("suggestion_id").distinct()
        left = cut(left.join(lost, "suggestion_id", "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)


def review(ledger: DataFrame, suggestions: DataFrame, decisions: DataFrame) -> Reviewed:
    """The tables after ``decisions`` (decision_id, suggestion_id, accepted, at), taken by ``at``, then ``decision_id``.

    ``ledger``: txn_id, role, and amount where signs are to be checked. ``suggestions``: suggestion_id, txn_id, counterpart_id (or null),
    suggested_role, counterpart_role, status, and reviewed_at where it is kept. Faults, the first that holds: suggestion_not_found;
    already_reviewed, be it by an earlier decision or as the rival of one; then, for an acceptance, of the row and then of its counterpart: transaction_not_found,
    stale_suggestion (its role is no longer unknown), role_sign. A decision with a fault changes nothing, so a later one can still take effect.
    Without decisions the tables stay as they are.
    """
    made = suggestions.select("suggestion_id", "txn_id", "counterpart_id", "suggested_role", "counterpart_role", "status")
    amount = F.col("amount") if "amount" in ledger.columns else F.lit(None).cast("decimal(18,2)")
    side = lambda s: ledger.select(F.col("txn_id").alias(f"{s}_id"), F.col("role").alias(f"{s}_role"), amount.alias(f"{s}_amount"))
    turn = F.struct("at", "decision_id").alias("turn")
    known = decisions.select("suggestion_id", "accepted", turn).join(made, "suggestion_id", "left")
    known = known.join(side("a"), F.col("txn_id") == F.col("a_id"), "left").join(side("b"), F.col("counterpart_id") == F.col("b_id"), "left")
    bars = []
    for s, there, role in (("a", F.lit(True), "suggested_role"), ("b", F.col("counterpart_id").isNotNull(), "counterpart_role")):
        bars += [(there & F.col(f"{s}_id").isNull(), "transaction_not_found"), (there & (F.col(f"{s}_role") != "unknown"), "stale_suggestion")]
        bars += [(there & F.col(f"{s}_amount").isNotNull() & role_sign_violation(F.col(role), F.col(f"{s}_amount")).isNotNull(), "role_sign")]
    barred = F.coalesce(*(F.when(F.col("accepted") & condition, name) for condition, name in bars))
    told = cut(known.select("suggestion_id", "turn", "accepted", *made.columns[1:], barred.alias("barred")))

    # the first decision that could take effect ends its suggestion: it does, or a rival did before it
    able = told.filter("status = 'pending' AND barred IS NULL")
    first = able.groupBy("suggestion_id").agg(F.min(F.struct("turn", "accepted")).alias("first")).select("suggestion_id", "first.*")
    wanted = made.join(first.filter("accepted").select("suggestion_id", "turn"), "suggestion_id")
    applied = settled(wanted)
    taken = cut(_legs(applied, "turn"))
    rivals = _legs(made.filter("status = 'pending'")).join(taken.select("leg", F.col("suggestion_id").alias("by"), F.col("turn").alias("rival")), "leg").filter("by <> suggestion_id")
    rivals = rivals.groupBy("suggestion_id").agg(F.min("rival").alias("rival"))

    ends = first.select("suggestion_id", F.col("turn").alias("own"), F.col("accepted").alias("_accepted")).join(rivals, "suggestion_id", "full")
    ends = cut(ends.join(applied.select("suggestion_id", F.lit(True).alias("_applied")), "suggestion_id", "left"))
    over = (F.col("status") != "pending") | F.coalesce(F.col("rival") < F.col("turn"), F.lit(False)) | F.coalesce(F.col("own") < F.col("turn"), F.lit(False))
    fault = F.when(F.col("status").isNull(), "suggestion_not_found").when(over, "already_reviewed").otherwise(F.col("barred"))
    outcomes = told.join(ends, "suggestion_id", "left").select("turn.decision_id", "suggestion_id", "accepted", "turn.at", fault.alias("fault"))

    closed = F.when(F.col("_applied") | ~F.col("_accepted"), F.least(F.col("own.at"), F.coalesce("rival.at", "own.at"))).otherwise(F.col("rival.at"))
    status = F.when(F.col("_applied"), "confirmed").when(closed.isNotNull(), "rejected").otherwise(F.col("status"))
    after = suggestions.join(ends, "suggestion_id", "left")
    values = {"status": F.when(F.col("status") == "pending", status).otherwise(F.col("status"))}
    if "reviewed_at" in suggestions.columns:
        values["reviewed_at"] = F.when(F.col("status") == "pending", closed).otherwise(F.col("reviewed_at"))
    after = after.withColumns(values).select(suggestions.columns)

    roles = taken.select(F.col("leg").alias("txn_id"), "new_role", F.col("suggestion_id").alias("_by"), F.col("turn.at").alias("_at"))
    both = ledger.join(roles, "txn_id", "left")
    audits = both.filter("new_role IS NOT NULL").select("txn_id", F.col("role").alias("previous_role"), "new_role", F.col("_by").alias("suggestion_id"), F.col("_at").alias("changed_at"))
    return Reviewed(outcomes, both.withColumn("role", F.coalesce("new_role", "role")).select(ledger.columns), after, audits)
