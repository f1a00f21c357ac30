"""From a source row's text to a ledger row: cleaning, dates, amounts, roles. What can't be read is named in ``error``, never raised."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerspark.functions import money as mn
from ledgerspark.functions import text as tx

# Fixed values of the domain: what banks put around a merchant's name, each removed once, in this order.
BANK_NOISE = (
    r"(?i)^(?:CARD PAYMENT(?: TO)?|DEBIT CARD(?: PURCHASE)?|POS(?: PURCHASE)?|CONTACTLESS(?: PAYMENT)?|DIRECT DEBIT(?: TO)?|FASTER PAYMENT(?: TO)?|BANK CREDIT(?: FROM)?)(?:\s+|$)",
    r"(?i)\s+(?:REF(?:ERENCE)?|AUTH(?:ORISATION)?|CARD)\s*[:#]?\s*[A-Z0-9-]{4,}$",
    r"\s+\d{2}[/-]\d{2}[/-]\d{2,4}$",
    r"(?i)\s+(?:STORE\s*)?#?\d{3,8}$",
)
# Fixed values of the domain: the role that a review action gives; a transfer's depends on the sign.
ACTION_ROLES = {
    "income": "income", "expense": "expense", "refund": "refund", "reimbursement": "reimbursement",
    "cash_withdrawal": "cash_withdrawal", "ignore_from_analytics": "excluded",
}
INFLOW_ROLES, OUTFLOW_ROLES = ("income", "transfer_in", "refund", "reimbursement"), ("expense", "transfer_out", "cash_withdrawal")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def clean(text: Column) -> Column:
    """NFKC, control characters as spaces, single spaces, ends trimmed."""
    odd = text.rlike(r"[^\x00-\x7F]")  # ASCII is as it is
    return tx.clean(F.when(odd, nfkc(F.when(odd, text))).otherwise(text))


def strip_bank_noise(cleaned: Column) -> Column:
    for pattern in BANK_NOISE:
        cleaned = F.regexp_replace(cleaned, pattern, "")
    return F.regexp_replace(F.regexp_replace(cleaned, r"\s+", " "), r"^[ ,:;-]+|[ ,:;-]+$", "")


def optional_text(text: Column) -> Column:
    """The cleaned text, null where it is blank."""
    return F.nullif(tx.clean(text), F.lit(""))


def currency(text: Column, account_currency: Column) -> tuple[Column, Column]:
    """Currency and error: blank takes the account's; only GBP, in letters or as its sign, is read."""
    blank = text.isNull() | (tx.clean(text) == "")
    known = F.upper(F.replace(tx.clean(text), F.lit(" "), F.lit(""))).isin("GBP", "£")
    return F.when(blank, account_currency).when(known, "GBP"), F.when(~blank & ~known, "unsupported_currency")


def ambiguous_date(text: Column) -> Column:
    """Whether day and month of a slash date could change places: both at most 12, and different."""
    day, month, _ = slash_parts(text)
    return F.coalesce((day <= 12) & (month <= 12) & (day != month), F.lit(False))


def slash_parts(text: Column) -> list[Column]:
    pattern = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
    return [F.nullif(F.regexp_extract(F.trim(text), pattern, i), F.lit("")).cast("int") for i in (1, 2, 3)]


def confirmed_date(text: Column, date_format: Column) -> tuple[Column, Column]:
    """A slash date read as ``day_first`` or ``month_first``, and the conflict where it can't be; two-digit years are 1969 to 2068."""
    first, second, year = slash_parts(text)
    year = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
    day, month = F.when(date_format == "day_first", first).otherwise(second), F.when(date_format == "day_first", second).otherwise(first)
    value = F.when(date_format.isin("day_first", "month_first"), F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"))
    return value, F.when(value.isNull(), "date_format_conflict")


def month_days(start: Column, end: Column, day: Column) -> Column:
    """The days of the period that are the ``day`` of their month, the last one in shorter months: an array."""
    months = F.sequence(F.trunc(start, "MM"), end, F.expr("interval 1 month"))
    days = F.transform(months, lambda m: F.date_add(m.cast("date"), F.least(day, F.dayofmonth(F.last_day(m.cast("date")))) - 1))
    return F.filter(days, lambda d: d.between(start, end))


def role_for_action(action: Column, amount: Column) -> Column:
    """The role a review action gives a row; null for an action that gives none."""
    mapped = F.create_map(*(F.lit(x) for pair in ACTION_ROLES.items() for x in pair))
    return F.when(action == "internal_transfer", F.when(amount > 0, "transfer_in").otherwise("transfer_out")).otherwise(F.try_element_at(mapped, action))


def role_sign_violation(role: Column, amount: Column) -> Column:
    """The reason why an amount's sign does not fit the role; null if it does."""
    return F.when(role.isin(*INFLOW_ROLES) & (amount <= 0), "inflow_role_needs_positive_amount").when(role.isin(*OUTFLOW_ROLES) & (amount >= 0), "outflow_role_needs_negative_amount")


def mentions_account(description: Column, name: Column) -> Column:
    """Whether an account's name, of four characters and more, occurs in the description."""
    short = tx.plain_words(name)
    return (F.length(short) >= 4) & F.contains(tx.plain_words(description), short)


def suggestion_key(kind: Column, *ids: Column) -> Column:
    """One key for a suggestion whichever way round its rows are named."""
    return F.sha2(F.concat_ws("|", kind, F.array_sort(F.array(*(i.cast("string") for i in ids)))), 256)


def normalise(rows: DataFrame, *keep: str) -> DataFrame:
    """Ledger rows from source rows (``account_id``, ``account_currency``, ``source_id`` and the texts of their cells), with the first ``error`` of each.

    Columns of text: transaction_date, posting_date, description, amount, debit, credit, balance,
    currency, external_id, transaction_type. A row with an error keeps what could be read,
    and every row the columns of ``keep``, whose names are none of those above or below.
    """
    raw = ("transaction_date", "posting_date", "description", "amount", "debit", "credit", "balance", "currency", "external_id", "transaction_type")
    once = lambda name, **parts: F.explode(F.array(F.struct(*(c.alias(n) for n, c in parts.items())))).alias(name)
    # a row of its own for cleaned texts and for values: what is used several times is not computed again; the description
    # has its own, for the JVM leaves generated methods beyond 8,000 bytes uncompiled
    texts = rows.select("*", once("_t", text=strip_bank_noise(clean(F.col("description")))))
    texts = texts.select("*", once("_c", **{c: tx.clean(F.col(c)) for c in ("transaction_date", "posting_date", "amount", "debit", "credit", "balance")}))
    c = lambda name: F.col(f"_c.{name}")
    read = {"date": mn.parse_date(c("transaction_date")), "posting": mn.parse_date(c("posting_date")), **{k: mn.parse_amount(c(k)) for k in ("amount", "debit", "credit", "balance")}}
    # values are made before their row is: Spark reads a lambda inside explode without compiling what stands around it
    made = texts.select("*", F.struct(*(v.alias(k) for k, v in read.items())).alias("_made"))
    cleaned = made.select("*", F.explode(F.array("_made")).alias("_v")).withColumn("_text", F.col("_t.text"))
    blank = lambda name: c(name).isNull() | (c(name) == "")
    date, posting, one, debit, credit, balance = (F.col(f"_v.{k}") for k in read)
    amount, amount_error = mn.signed(one, debit, credit)
    unit, unit_error = currency(F.col("currency"), F.col("account_currency"))
    unread = lambda name, value: ~blank(name) & value.isNull()
    error = (
        F.when(date.isNull(), "invalid_date").when(F.coalesce(F.col("_text"), F.lit("")) == "", "missing_description")
        .when(unread("amount", one) | unread("debit", debit) | unread("credit", credit), "invalid_amount").when(amount_error.isNotNull(), amount_error).when(amount == 0, "zero_amount")
        .when(unit_error.isNotNull(), unit_error).when(unread("posting_date", posting), "invalid_posting_date").when(unread("balance", balance), "invalid_balance")
    )
    merchant = tx.merchant_name(F.col("_text"))
    source = tx.fingerprint(source=F.col("source_id").cast("string"), **{name: F.col(name) for name in raw})
    canonical = tx.fingerprint(account_id=F.col("account_id").cast("string"), transaction_date=date.cast("string"), amount=amount.cast("string"), currency=unit, description=tx.matching(merchant))
    return cleaned.select(
        "source_id", "account_id", date.alias("txn_date"), posting.alias("posting_date"), F.col("_text").alias("description"), merchant.alias("merchant"), amount.alias("amount"), balance.alias("balance_after"), unit.alias("currency"),
        F.when(amount > 0, "inflow").when(amount < 0, "outflow").alias("direction"), F.lit("unknown").alias("role"), optional_text(F.col("external_id")).alias("external_id"), optional_text(F.col("transaction_type")).alias("transaction_type"),
        source.alias("source_fingerprint"), F.when(error.isNull(), canonical).alias("canonical_fingerprint"), error.alias("error"), *keep,
    )
