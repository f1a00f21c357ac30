"""Queries over statement coverage and balances; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import balances as bal
from ledgerspark.operators import intervals
from ledgerspark.plans.bindings import BALANCES, COVERAGE, LEDGER, balances, coverage, ledger

LO, HI, AS_OF = "1996-01-15", "1998-12-31", "1998-06-30"
#: Known pieces of each statement: whole, or around the one gap, five to nine days in.
_KNOWN = f"""{COVERAGE}, known AS (SELECT account_id, start_date, end_date FROM coverage WHERE status IN ('complete', 'overlapping')
  UNION ALL SELECT account_id, start_date, start_date + 4 FROM coverage WHERE status = 'gapped'
  UNION ALL SELECT account_id, start_date + 10, end_date FROM coverage WHERE status = 'gapped' AND start_date + 10 <= end_date)"""


def _merged(source: str, out: str) -> str:
    return f"""{out} AS (SELECT account_id, min(start_date) AS start_date, max(end_date) AS end_date FROM (
      SELECT *, sum(opens) OVER (PARTITION BY account_id ORDER BY start_date, end_date ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN reach IS NULL OR start_date > reach + 1 THEN 1 ELSE 0 END AS opens FROM (
          SELECT *, max(end_date) OVER (PARTITION BY account_id ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}))) GROUP BY account_id, island)"""


_CLIPPED = f"""clipped AS (SELECT account_id, greatest(start_date, DATE '{LO}') AS start_date, least(end_date, DATE '{HI}') AS end_date FROM known
  WHERE greatest(start_date, DATE '{LO}') <= least(end_date, DATE '{HI}'))"""


def _day(text):
    return F.lit(text).cast("date")


def _ranges(df):
    return df.select("account_id", "start_date", "end_date")


def coverage_merge(spark, d):
    return intervals.merge(_ranges(coverage(spark, d)), "account_id")


def coverage_known_ranges(spark, d):
    return intervals.merge(intervals.known(coverage(spark, d), "account_id"), "account_id")


def coverage_clip(spark, d):
    return intervals.merge(intervals.clip(intervals.known(coverage(spark, d), "account_id"), _day(LO), _day(HI)), "account_id")


def coverage_intersection(spark, d):
    rows = coverage(spark, d)
    known = intervals.merge(intervals.known(rows, "account_id"), "account_id")
    partial = intervals.merge(_ranges(rows.filter("status = 'partial'")), "account_id")
    return intervals.intersect(known, partial, "account_id")


def coverage_missing(spark, d):
    spans = coverage(spark, d).select("account_id").distinct().withColumn("span_start", _day(LO)).withColumn("span_end", _day(HI))
    return intervals.complement(coverage_clip(spark, d), spans, "account_id")


def coverage_indicator(spark, d):
    """By pairs of neighbouring accounts: days that both, one or none of them cover."""
    pair = F.floor(F.col("account_id") / 2).cast("long")
    rows = coverage_clip(spark, d).withColumn("pair", pair)
    return intervals.indicator(rows, _day(LO), _day(HI), 2, "pair")


def coverage_gap_analysis(spark, d):
    return intervals.statement_gaps(coverage_merge(spark, d), "account_id").withColumn("days", intervals.days().cast("long"))


def statement_overlap_pairs(spark, d):
    """Pairs of an account's statements that overlap, with the days they share."""
    return intervals.overlapping_pairs(coverage(spark, d).select("account_id", "statement_id", "start_date", "end_date"), "account_id", "statement_id")


def balance_latest(spark, d):
    return bal.latest(balances(spark, d), _day(AS_OF))


def balance_daily_pick(spark, d):
    return bal.daily_pick(balances(spark, d))


def balance_history_segments(spark, d):
    islands = coverage_known_ranges(spark, d)
    return bal.history(bal.daily_pick(balances(spark, d)), islands)


def freshness_assessment(spark, d):
    """Statements that ended by the day count, 45 days of age are allowed, and an island has 30 days at least."""
    ended = coverage(spark, d).filter(F.col("end_date") <= _day(AS_OF))
    islands = intervals.merge(intervals.known(ended, "account_id"), "account_id")
    return bal.freshness(ledger(spark, d), bal.latest(balances(spark, d), _day(AS_OF)), islands, _day(AS_OF), 45, 45, 45, 30)


QUERIES = {
    "coverage_merge": (coverage_merge, f"WITH {COVERAGE}, {_merged('coverage', 'm')} SELECT * FROM m"),
    "coverage_known_ranges": (coverage_known_ranges, f"WITH {_KNOWN}, {_merged('known', 'm')} SELECT * FROM m"),
    "coverage_clip": (coverage_clip, f"WITH {_KNOWN}, {_CLIPPED}, {_merged('clipped', 'm')} SELECT * FROM m"),
    "coverage_intersection": (
        coverage_intersection,
        f"""WITH {_KNOWN}, partials AS (SELECT * FROM coverage WHERE status = 'partial'), {_merged('known', 'k')}, {_merged('partials', 'p')},
        x AS (SELECT k.account_id, greatest(k.start_date, p.start_date) AS start_date, least(k.end_date, p.end_date) AS end_date FROM k JOIN p
          ON k.account_id = p.account_id AND k.start_date <= p.end_date AND p.start_date <= k.end_date), {_merged('x', 'm')} SELECT * FROM m""",
    ),
    "coverage_missing": (
        coverage_missing,
        f"""WITH {_KNOWN}, {_CLIPPED}, {_merged('clipped', 'm')}, a AS (SELECT DISTINCT account_id FROM coverage),
        g AS (SELECT account_id, coalesce(lag(end_date) OVER (PARTITION BY account_id ORDER BY start_date) + 1, DATE '{LO}') AS start_date, start_date - 1 AS end_date FROM m
          UNION ALL SELECT account_id, max(end_date) + 1, DATE '{HI}' FROM m GROUP BY account_id
          UNION ALL SELECT account_id, DATE '{LO}', DATE '{HI}' FROM a WHERE account_id NOT IN (SELECT account_id FROM m)) SELECT * FROM g WHERE start_date <= end_date""",
    ),
    "coverage_indicator": (
        coverage_indicator,
        f"""WITH {_KNOWN}, {_CLIPPED}, {_merged('clipped', 'm')}, day AS (SELECT account_id // 2 AS pair, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day FROM m),
        c AS (SELECT pair, day, count(*) AS n FROM day GROUP BY pair, day), s AS (SELECT pair, CAST(sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) AS BIGINT) AS full_days,
          CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS partial_days FROM c GROUP BY pair), t AS (SELECT CAST(DATE '{HI}' - DATE '{LO}' + 1 AS BIGINT) AS total)
        SELECT pair, full_days, partial_days, total - full_days - partial_days AS missing_days, CASE WHEN full_days = total THEN 'complete' WHEN full_days + partial_days > 0 THEN 'partial' ELSE 'missing' END AS status FROM s, t""",
    ),
    "coverage_gap_analysis": (
        coverage_gap_analysis,
        f"""WITH {COVERAGE}, {_merged('coverage', 'm')}, n AS (SELECT *, lead(start_date) OVER (PARTITION BY account_id ORDER BY start_date) AS nxt FROM m)
        SELECT account_id, end_date + 1 AS start_date, nxt - 1 AS end_date, CAST(nxt - end_date - 1 AS BIGINT) AS days FROM n WHERE nxt IS NOT NULL""",
    ),
    "statement_overlap_pairs": (
        statement_overlap_pairs,
        f"""WITH {COVERAGE} SELECT a.statement_id AS first_id, b.statement_id AS second_id, CAST(least(a.end_date, b.end_date) - greatest(a.start_date, b.start_date) + 1 AS BIGINT) AS days,
        CASE WHEN a.start_date = b.start_date AND a.end_date = b.end_date THEN 'exact' ELSE 'partial' END AS kind FROM coverage a JOIN coverage b
        ON a.account_id = b.account_id AND a.statement_id < b.statement_id AND a.start_date <= b.end_date AND b.start_date <= a.end_date""",
    ),
    "balance_latest": (
        balance_latest,
        f"""WITH {BALANCES} SELECT account_id, as_of_date, snapshot_id, balance, source FROM balances WHERE verified AND as_of_date <= DATE '{AS_OF}'
        QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY as_of_date DESC, priority DESC, snapshot_id DESC) = 1""",
    ),
    "balance_daily_pick": (
        balance_daily_pick,
        f"""WITH {BALANCES} SELECT account_id, as_of_date, snapshot_id, balance, source FROM balances WHERE verified
        QUALIFY row_number() OVER (PARTITION BY account_id, as_of_date ORDER BY priority DESC, snapshot_id DESC) = 1""",
    ),
    "balance_history_segments": (
        balance_history_segments,
        f"""WITH {_KNOWN}, {BALANCES}, {_merged('known', 'm')}, p AS (SELECT account_id, as_of_date, snapshot_id, balance FROM balances WHERE verified
          QUALIFY row_number() OVER (PARTITION BY account_id, as_of_date ORDER BY priority DESC, snapshot_id DESC) = 1)
        SELECT p.account_id, p.as_of_date, p.snapshot_id, p.balance, m.start_date AS segment_start FROM p LEFT JOIN m ON p.account_id = m.account_id AND p.as_of_date BETWEEN m.start_date AND m.end_date""",
    ),
    "freshness_assessment": (
        freshness_assessment,
        f"""WITH {LEDGER}, {BALANCES}, {COVERAGE}, ended AS (SELECT * FROM coverage WHERE end_date <= DATE '{AS_OF}'),
        known AS (SELECT account_id, start_date, end_date FROM ended WHERE status IN ('complete', 'overlapping') UNION ALL SELECT account_id, start_date, start_date + 4 FROM ended WHERE status = 'gapped'
          UNION ALL SELECT account_id, start_date + 10, end_date FROM ended WHERE status = 'gapped' AND start_date + 10 <= end_date), {_merged('known', 'm')},
        i AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY end_date DESC, start_date DESC) = 1),
        t AS (SELECT account_id, max(txn_date) AS lt FROM ledger WHERE txn_date <= DATE '{AS_OF}' GROUP BY account_id),
        b AS (SELECT account_id, max(as_of_date) AS lb FROM balances WHERE verified AND as_of_date <= DATE '{AS_OF}' GROUP BY account_id),
        a AS (SELECT account_id FROM t UNION SELECT account_id FROM b UNION SELECT account_id FROM i),
        r AS (SELECT a.account_id, CAST(DATE '{AS_OF}' - lt AS BIGINT) AS transaction_age, CAST(DATE '{AS_OF}' - lb AS BIGINT) AS balance_age,
          CAST(DATE '{AS_OF}' - i.end_date AS BIGINT) AS coverage_age, CAST(i.end_date - i.start_date + 1 AS BIGINT) AS island_days
          FROM a LEFT JOIN t ON a.account_id = t.account_id LEFT JOIN b ON a.account_id = b.account_id LEFT JOIN i ON a.account_id = i.account_id),
        w AS (SELECT *, CASE WHEN transaction_age IS NULL OR (balance_age IS NOT NULL AND balance_age < transaction_age) THEN balance_age ELSE transaction_age END AS freshness, concat_ws(',',
          CASE WHEN transaction_age IS NULL THEN 'no_transactions' WHEN transaction_age > 45 THEN 'transactions_stale' END, CASE WHEN balance_age IS NULL THEN 'no_balance' WHEN balance_age > 45 THEN 'balance_stale' END,
          CASE WHEN coverage_age IS NULL THEN 'no_coverage' WHEN coverage_age > 45 THEN 'coverage_stale' END, CASE WHEN island_days < 30 THEN 'coverage_short' END) AS warnings FROM r)
        SELECT *, CASE WHEN warnings = '' THEN 'active' ELSE 'archive' END AS mode FROM w""",
    ),
}
