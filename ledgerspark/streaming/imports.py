"""Duplicates of imported rows resolved as a stream: what an account accepted in the last days is its state.

A row is compared, in id order, with the rows its account accepted before it, whichever micro-batch
brought them, by the rules of ``operators.duplicates``; so a stream that is cut anywhere gives the
statuses of one import. The state of an account holds accepted rows for ``days`` behind its newest
one; a row repeated later than that is told by its key when the store is written. Rows of an account
in one micro-batch are in one task's memory: bound the batch, by ``maxFilesPerTrigger``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from datetime import date, timedelta
from difflib import SequenceMatcher
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerspark.operators.duplicates import ALIKE, AMOUNT_POINTS, DAY_POINTS, DUPLICATE_DAYS, OTHER_ID, PROBABLE, TEXT_POINTS

_STATE = "ids array<long>, days array<date>, amounts array<string>, texts array<string>, sources array<string>, externals array<string>"
_SLIM = ("txn_id", "txn_date", "amount", "text", "source_fingerprint", "external_id")


class Fact(NamedTuple):
    """What is compared of a row."""

    txn_id: int
    day: date
    amount: str
    text: str | None
    source: str | None
    external: str | None


def scored(new: Fact, old: Fact) -> tuple[float, str]:
    """Score and status of two rows of an account."""
    if new.source is not None and new.source == old.source:
        return 1.0, "exact"
    both = new.external is not None and old.external is not None
    if both and new.external.lower() == old.external.lower():
        return 1.0, "exact"
    apart = abs((new.day - old.day).days)
    points = (AMOUNT_POINTS if new.amount == old.amount else 0) + (DAY_POINTS[apart] if apart <= DUPLICATE_DAYS else 0)
    alike = SequenceMatcher(None, new.text or "", old.text or "", autojunk=False).ratio()
    points = round(min(points + (alike * TEXT_POINTS if alike >= ALIKE else 0), OTHER_ID if both else 1.0), 3)
    return points, "probable" if points >= PROBABLE else "unique"


class Accepted:
    """An account's accepted rows, found by source, external id, or amount."""

    def __init__(self, rows: list[Fact]) -> None:
        self.rows: dict[int, Fact] = {}
        self._by: dict[tuple, list[int]] = defaultdict(list)
        for row in rows:
            self.add(row)

    def add(self, row: Fact) -> None:
        self.rows[row.txn_id] = row
        for key in self._keys(row):
            self._by[key].append(row.txn_id)

    @staticmethod
    def _keys(row: Fact) -> list[tuple]:
        """Rows that share none can't be more than unique: without the same amount the points stay below the threshold."""
        keys = [("amount", row.amount, row.day)]
        keys += [("source", row.source)] if row.source is not None else []
        return keys + ([("external", row.external.lower())] if row.external is not None else [])

    def status(self, new: Fact) -> str:
        keys = self._keys(new)[1:] + [("amount", new.amount, new.day + timedelta(d)) for d in range(-DUPLICATE_DAYS, DUPLICATE_DAYS + 1)]
        found = [(*scored(new, self.rows[i]), -i) for i in {i for k in keys for i in self._by.get(k, ())}]
        best = max(((points, first, status) for points, status, first in found if status != "unique"), default=None)
        return "exact" if any(s == "exact" for _, s, _ in found) else best[2] if best else "accepted"


def resolve(rows: DataFrame, days: int = 30) -> DataFrame:
    """A stream of ``account_id``, ``txn_id`` and ``status`` (exact, probable or accepted) of the stream's rows: FACTS of ``operators.duplicates``."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = Accepted([Fact(*row) for row in zip(*state.get, strict=True)] if state.exists else [])
        fresh = [Fact(*row) for frame in frames for row in frame[list(_SLIM)].astype(object).where(frame[list(_SLIM)].notna(), None).itertuples(index=False)]
        out = []
        for row in sorted(fresh):
            status = kept.status(row)
            if status == "accepted":
                kept.add(row)
            out.append((key[0], row.txn_id, status))
        newest = max((r.day for r in kept.rows.values()), default=None)
        last = [r for r in kept.rows.values() if r.day >= newest - timedelta(days)] if newest else []
        state.update(tuple(map(list, zip(*last, strict=True))) if last else ([],) * 6)
        yield pd.DataFrame(out, columns=["account_id", "txn_id", "status"])

    slim = rows.select("account_id", F.col("txn_id").cast("long").alias("txn_id"), "txn_date", F.col("amount").cast("decimal(18,2)").cast("string").alias("amount"), "text", "source_fingerprint", "external_id")
    kind = rows.schema["account_id"].dataType.simpleString()
    return slim.groupBy("account_id").applyInPandasWithState(fold, f"account_id {kind}, txn_id long, status string", _STATE, "append", GroupStateTimeout.NoTimeout)
