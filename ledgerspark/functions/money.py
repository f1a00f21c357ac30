"""Amounts and dates from text; what can't be read is null, never an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain: date spellings, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "d MMM yyyy", "d MMMM yyyy")
#: How a text of each format begins: a format that doesn't fit costs an exception, so only the one that can is tried.
_SHAPES = (r"^\d{4}-", r"^\d\d/", r"^\d\d-", r"^\d{1,2} [A-Za-z]{3} ", r"^\d{1,2} [A-Za-z]{4,} ")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parse_date(text: Column) -> Column:
    text = F.trim(text)  # cheaper again than once in a lambda, which isn't compiled
    return F.coalesce(*(F.when(text.rlike(shape), F.try_to_date(text, f)) for f, shape in zip(DATE_FORMATS, _SHAPES, strict=True)))


def parse_amount(text: Column) -> Column:
    """Signed amount: brackets and DR are negative, currency signs and apostrophes go, one decimal mark, thousands in groups of three.

    Half-even to two places. A lone mark with a tail of three digits parts thousands; with one or two, it is the decimal mark.
    A plain number is read as it is, and nothing is asked of a missing one: the rest is a lambda, which isn't compiled.
    """
    other = once(F.upper(F.regexp_replace(F.trim(text), r"[\s'’£]|GBP", "")), _amount)
    return F.when(text.rlike(r"^[0-9]+\.[0-9]{1,2}\z"), text.try_cast("decimal(18,2)")).when(text.isNotNull(), other)


def _amount(raw: Column) -> Column:
    negative = raw.rlike(r"^\(.*\)$") | raw.endswith("DR") | raw.startswith("-") | raw.endswith("-")
    value = once(F.regexp_replace(raw, r"^[(+-]+|[)+-]+$|CR$|DR$", ""), lambda body: F.bround(_number(body).try_cast("decimal(24,6)"), 2))
    return once(value, lambda v: F.when(negative, -v).otherwise(v).try_cast("decimal(18,2)"))


def _number(body: Column) -> Column:
    """The digits with a point as the decimal mark, null where marks don't part a number."""
    comma, dot = F.instr(body, ",") > 0, F.instr(body, ".") > 0
    last_is_comma = F.length(F.substring_index(body, ",", -1)) < F.length(F.substring_index(body, ".", -1))
    return (
        F.when(comma & dot & last_is_comma & body.rlike(r"^[0-9]{1,3}(\.[0-9]{3})*,[0-9]+$"), F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & dot & body.rlike(r"^[0-9]{1,3}(,[0-9]{3})*\.[0-9]+$"), F.replace(body, F.lit(","), F.lit("")))
        .when(comma & ~dot & body.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$"), F.replace(body, F.lit(","), F.lit("")))
        .when(comma & ~dot & body.rlike(r"^[0-9]+,[0-9]{1,2}$"), F.replace(body, F.lit(","), F.lit(".")))
        .when(dot & ~comma & body.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), F.replace(body, F.lit("."), F.lit("")))
        .when(dot & ~comma & body.rlike(r"^[0-9]+\.[0-9]{1,2}$"), body)
        .when(~comma & ~dot & body.rlike("^[0-9]+$"), body)
    )


def signed(amount: Column, debit: Column, credit: Column) -> tuple[Column, Column]:
    """Amount and error from one signed or two unsigned columns: debits are negative, both at once is a conflict."""
    has_debit, has_credit = F.coalesce(debit != 0, F.lit(False)), F.coalesce(credit != 0, F.lit(False))
    error = F.when(has_debit & has_credit, "conflicting_amounts").when(amount.isNull() & ~has_debit & ~has_credit, "missing_amount")
    value = F.when(amount.isNotNull(), amount).when(has_debit, -F.abs(debit)).when(has_credit, F.abs(credit))
    return F.when(error.isNull(), value), error
