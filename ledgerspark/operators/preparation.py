"""Preparing the review of statement documents: what of each row and each document a user has to look at. Nothing is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.normalise import ambiguous_date
from ledgerspark.operators.review import reconciled
from ledgerspark.sources import statement_text

#: Confidence below which a recognised field has to be reviewed.
LEAST = 0.85
SIDES = (("opening", "opening_balance"), ("closing", "closing_balance"))


def rows(found: DataFrame, account: Column, currency: Column, document: str, page: str, source: Column, least: float = LEAST) -> DataFrame:
    """Rows of ``table_rows`` or ``grid_rows``, read, with their ``reasons`` for review, and whether their dates are ambiguous or their amounts have sides.

    ``source``: the kind of each row's document. ``found`` has ``confidences`` (see ``recognised_lines``), null where
    the document was not recognised. Each row stays one row; nothing is joined or shuffled.
    """
    if not 0 < least <= 1:
        raise ValueError("the least confidence is above zero and at most one")
    sided = F.col("debit").isNotNull() | F.col("credit").isNotNull()
    dated = ambiguous_date(F.col("transaction_date")) | ambiguous_date(F.col("posting_date"))
    kept = {"document_id": F.col(document), "page_id": F.col(page), "row": F.col("row_number"), "source_type": source, "ambiguous_date": dated, "sided": sided}
    read = statement_text.candidates(found.withColumns(kept), account, currency, page, *kept, "lines", "confidences")
    return statement_text.review_reasons(read, F.col("source_type"), least)


def documents(stated: DataFrame, prepared: DataFrame, evidence: DataFrame | None, key: str = "document_id", tolerance: str = "0.01") -> DataFrame:
    """One row for each document: its rows, what is to be confirmed, its reconciliation, and the ``violation`` of balances without evidence.

    ``stated``: ``key``, opening_balance and closing_balance as parsed, or null. ``prepared``: from ``rows``. ``evidence``: ``balance_lines`` with
    ``key``, or None where ``stated`` comes from ``summed_balances``, which has read them. A document without rows has zero of them and a movement of zero; one without balances can't be reconciled.
    Rows and evidence are aggregated by document before they meet it, so a document of any size is one row of each join.
    """
    counts = prepared.groupBy(F.col("document_id").alias(key)).agg(
        F.count("*").alias("rows"), F.count_if(F.size("reasons") > 0).alias("rows_to_review"), F.count_if(F.array_contains("reasons", "low_ocr_confidence")).alias("low_confidence"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,2)").alias("movement"), F.count_if(F.col("amount").isNull()).alias("unread"),
        F.some("ambiguous_date").alias("confirm_date_format"), F.some("sided").alias("confirm_signs"),
    )
    if evidence is not None:
        stated = stated.select(key, *(c for _, c in SIDES)).join(statement_text.summed_balances(evidence, key), key, "left")
    # a balance that was parsed is among the lines that state one
    said = [F.when(F.col(c).isNotNull(), ~F.array_contains("proven", F.struct(F.lit(kind).alias("kind"), F.col(c).cast("decimal(18,2)").alias("amount")))) for kind, c in SIDES]
    unproven = F.when(F.col("proven").isNull(), F.coalesce(*(c for _, c in SIDES)).isNotNull()).otherwise(F.coalesce(said[0], F.lit(False)) | F.coalesce(said[1], F.lit(False)))
    both = stated.select(key, *(c for _, c in SIDES), "balance_lines", "unread_balances", unproven.alias("_unproven")).join(counts, key, "left")
    both = both.select(key, *(c for _, c in SIDES), *(c for c in counts.columns if c != key), "balance_lines", "unread_balances", "_unproven")
    zeros = ("rows", "rows_to_review", "low_confidence", "movement", "unread", "balance_lines", "unread_balances")
    both = both.withColumns({c: F.coalesce(c, F.lit(0).cast(both.schema[c].dataType)) for c in zeros} | {c: F.coalesce(c, F.lit(False)) for c in ("confirm_date_format", "confirm_signs")})
    return reconciled(both, tolerance).withColumn("violation", F.when(F.col("_unproven"), "balance_evidence_missing")).drop("_unproven")
