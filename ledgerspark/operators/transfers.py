"""Confirmed transfers between accounts, and cash flow of scopes with or without the transfers inside them.

A scope is a set of accounts looked at together. Its account view shows every movement; its
consolidated view hides both legs of a confirmed transfer whose other account is in the scope too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators.cashflow import money

#: Rows of scopes up to which they are broadcast, once counted.
FEW = 100_000
VIEWS = ("account", "consolidated")
_TRANSFERS = ("transfer_in", "transfer_out")


def links(suggestions: DataFrame, ledger: DataFrame) -> DataFrame:
    """``txn_id`` and ``counterpart_account``: the legs of confirmed transfers that still hold.

    ``suggestions``: suggestion_id, kind, status, txn_id, counterpart_id, suggested_role, counterpart_role. Both legs must
    have the roles they were confirmed with, one in and one out, in different accounts, in one currency, of opposite
    amounts. Of several suggestions for a leg the smallest id counts. Suggestions meet the ledger by the legs' ids.
    """
    paired = suggestions.filter("kind = 'transfer' AND status = 'confirmed' AND counterpart_id IS NOT NULL")
    leg = lambda side: ledger.select(F.col("txn_id").alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in ("account_id", "role", "currency", "amount")))
    met = paired.join(leg("a"), F.col("txn_id") == F.col("a_id")).join(leg("b"), F.col("counterpart_id") == F.col("b_id"))
    holds = (
        (F.col("a_role") == F.col("suggested_role")) & (F.col("b_role") == F.col("counterpart_role"))
        & F.col("a_role").isin(*_TRANSFERS) & F.col("b_role").isin(*_TRANSFERS) & (F.col("a_role") != F.col("b_role"))
        & (F.col("a_account_id") != F.col("b_account_id")) & (F.col("a_currency") == F.col("b_currency")) & (F.col("a_amount") == -F.col("b_amount"))
    )
    legs = met.filter(holds).select("suggestion_id", F.explode(F.array(
        F.struct(F.col("a_id").alias("txn_id"), F.col("b_account_id").alias("other")), F.struct(F.col("b_id").alias("txn_id"), F.col("a_account_id").alias("other")),
    )).alias("leg"))
    return legs.groupBy(F.col("leg.txn_id").alias("txn_id")).agg(F.min_by("leg.other", "suggestion_id").alias("counterpart_account"))


def _least_two(legs: DataFrame, *keys: str) -> DataFrame:
    """Of each group the smallest id, and the smallest id of any other account."""
    each = legs.groupBy(*keys, "account_id").agg(F.min("txn_id").alias("txn_id"))
    return each.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("txn_id"))).filter("_place <= 2").drop("_place")


def links_by_rule(ledger: DataFrame, kind: Column, confirmed: Callable[[Column, Column], Column], days: int) -> DataFrame:
    """``links`` of all pairs of an owner's legs that a rule confirms, where the pairs themselves are too many to be made.

    ``ledger``: txn_id, account_id, profile_id, txn_date, amount, role, currency. ``kind`` is one of a fixed number of kinds of a leg, and
    ``confirmed`` says, by the kinds of an outflow and an inflow, whether their suggestion is a confirmed transfer. Suggestions are in
    the order of the outflow's id, then the inflow's, so a leg's first one names the smallest id it can meet. That is, for each day and
    kind, the smallest in reach or, where this is of the leg's own account, the smallest of another: two legs stand for any number.
    """
    keys, amount = ("profile_id", "currency", "size"), F.col("amount")
    moved = ledger.filter(((F.col("role") == "transfer_out") & (amount < 0)) | ((F.col("role") == "transfer_in") & (amount > 0)))
    legs = moved.select("txn_id", "account_id", "profile_id", "currency", F.abs("amount").alias("size"), (amount < 0).alias("out"), F.col("txn_date").alias("day"), kind.alias("kind"))
    first = _least_two(legs, *keys, "out", "day", "kind")
    reach = first.withColumn("day", F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))))
    each = _least_two(reach, *keys, "out", "day", "kind")
    offers = each.groupBy(*keys, (~F.col("out")).alias("out"), "day").agg(F.collect_list(F.struct("txn_id", "account_id", "kind")).alias("offers"))  # two of a kind at most
    own = F.col("kind")
    suits = lambda o: (o["account_id"] != F.col("account_id")) & F.when(F.col("out"), confirmed(own, o["kind"])).otherwise(confirmed(o["kind"], own))
    met = legs.join(offers, [*keys, "out", "day"]).select("txn_id", F.array_min(F.filter("offers", suits)).alias("other")).filter("other IS NOT NULL")
    return met.groupBy("txn_id").agg(F.min("other").alias("other")).select("txn_id", F.col("other.account_id").alias("counterpart_account"))


def in_scopes(ledger: DataFrame, linked: DataFrame, scopes: DataFrame) -> DataFrame:
    """The rows of each scope's accounts (``scopes``: scope_id, account_id), ``internal`` if a confirmed transfer's other account is in the scope."""
    scopes = scopes.select("scope_id", "account_id").distinct()
    few = scopes.limit(FEW + 1).count() <= FEW
    sized = lambda df: F.broadcast(df) if few else df
    rows = ledger.join(linked, "txn_id", "left").join(sized(scopes), "account_id")
    other = scopes.select(F.col("scope_id").alias("_scope"), F.col("account_id").alias("_account"), F.lit(True).alias("_inside"))
    both = rows.join(sized(other), (F.col("scope_id") == F.col("_scope")) & (F.col("counterpart_account") == F.col("_account")), "left")
    internal = F.coalesce("_inside", F.lit(False)) & F.col("role").isin(*_TRANSFERS)
    return both.withColumn("internal", internal).drop("_scope", "_account", "_inside", "counterpart_account")


def totals(rows: DataFrame) -> DataFrame:
    """Totals of each scope in both views, from ``in_scopes``: one aggregation gives both."""
    amount, role = F.col("amount"), F.col("role")
    of = lambda condition, value=None: money(F.coalesce(F.sum(F.when(condition, amount if value is None else value)), F.lit(0)))
    sums = {
        "income": of(role == "income"), "expenses": of(role == "expense", -amount), "refunds": of(role == "refund"), "reimbursements": of(role == "reimbursement"), "withdrawals": of(role == "cash_withdrawal", -amount),
        **{f"{r}_{i}": of((role == r) & (F.col("internal") == bool(i)), amount if r == "transfer_in" else -amount) for r in _TRANSFERS for i in (0, 1)},
        **{f"{r}_inflow": of((role == r) & (amount > 0)) for r in ("unknown", "excluded")}, **{f"{r}_outflow": of((role == r) & (amount <= 0), -amount) for r in ("unknown", "excluded")},
        "rows": F.count("*"), "unknown_rows": F.count_if(role == "unknown"), "excluded_rows": F.count_if(role == "excluded"), "matched_internal": F.count_if("internal"),
    }
    summed = rows.groupBy("scope_id").agg(*(c.alias(n) for n, c in sums.items())).withColumn("view", F.explode(F.array(*map(F.lit, VIEWS))))
    shown = lambda r: money(F.col(f"{r}_0") + F.when(F.col("view") == "account", F.col(f"{r}_1")).otherwise(0))
    moved = summed.withColumn("transfers_in", shown("transfer_in")).withColumn("transfers_out", shown("transfer_out"))
    net = money(F.col("income") + F.col("refunds") + F.col("reimbursements") - F.col("expenses") - F.col("withdrawals"))
    moved = moved.withColumn("net", net).withColumn("net_transfers", money(F.col("transfers_in") - F.col("transfers_out")))
    return moved.drop(*(f"{r}_{i}" for r in _TRANSFERS for i in (0, 1)))


def with_coverage(summed: DataFrame, status: DataFrame) -> DataFrame:
    """Totals with the ``basis`` that their scope's coverage allows (``status``: scope_id, status); what isn't covered at all has none.

    A covered scope without a movement has zeros.
    """
    zeros = [c for c in summed.columns if c not in ("scope_id", "view")]
    every = status.select("scope_id", "status", F.explode(F.array(*map(F.lit, VIEWS))).alias("view"))
    both = every.join(summed, ["scope_id", "view"], "left")
    seen = F.col("status") != "missing"
    filled = {c: F.when(seen, F.coalesce(c, F.lit(0).cast(summed.schema[c].dataType))) for c in zeros}
    basis: Column = F.when(F.col("status") == "complete", "complete_period").when(seen, "observed_only")
    return both.withColumns(filled).withColumn("basis", basis)
