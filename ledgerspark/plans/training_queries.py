"""Queries on training data, decisions and statement imports; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import intervals, training, upserts
from ledgerspark.plans.bindings import ACTIVITY, COVERAGE, activity, coverage, read
from ledgerspark.plans.coverage_queries import _merged

def unseen_merchant_split(spark, d):
    """Parts by brand: each brand is whole on one side."""
    rows = training.unseen_groups(read(spark, d, "part"), "p_brand", 0.2)
    return rows.groupBy("p_brand").agg(F.count_distinct("held_out").alias("sides"), F.count("*").alias("rows"))


def overall_metrics(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.when(F.col("l_quantity") > 25, "N").otherwise("A").alias("guess"))
    found = training.overall_metrics(training.class_metrics(rows.groupBy("label", "guess").agg(F.count("*").alias("n"))))
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


def recurrence_upsert(spark, d):
    """Customers as stored series, and those with an order of 1999 as found again or new."""
    stored = read(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("series"), F.lit(0).cast("long").alias("n"), F.element_at(F.array(*map(F.lit, ("pending", "confirmed", "cancelled"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("status"))
    found = read(spark, d, "orders").filter("year(o_orderdate) = 1999").groupBy(F.col("o_custkey").alias("series")).agg(F.count("*").alias("n"))
    return upserts.recurrence(stored, found, ["series"], ["n"])


def import_new_gaps(spark, d):
    """Statements of even id are there already; the gaps that importing the others leaves or makes."""
    rows = coverage(spark, d)
    ranges = lambda x: intervals.merge(x.select("account_id", "start_date", "end_date"), "account_id")
    before = intervals.statement_gaps(ranges(rows.filter("statement_id % 2 = 0")), "account_id")
    after = intervals.statement_gaps(ranges(rows), "account_id")
    return upserts.new_statement_gaps(before, after, "account_id")


def payday_distances(spark, d):
    dates = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return upserts.payday_distance(dates, "day", [1, 15, 28])


def hybrid_decisions(spark, d):
    rows = activity(spark, d).select(
        "txn_id", F.when(F.col("merchant") == "purchase", "shopping").when(F.col("merchant") == "view", "needs_review").alias("rule_category"), F.lit("merchant").alias("rule_source"),
        F.when(F.col("txn_id") % 4 != 0, F.col("merchant")).alias("model_category"), ((F.col("txn_id") % 10) / 10).alias("model_confidence"),
    )
    return upserts.hybrid(rows, 0.6).select("txn_id", "category_id", "source", "status")


QUERIES = {
    "unseen_merchant_split": (unseen_merchant_split, "SELECT p_brand, CAST(1 AS BIGINT) AS sides, count(*) AS rows FROM part GROUP BY p_brand"),
    "overall_metrics": (
        overall_metrics,
        """WITH g AS (SELECT l_returnflag AS label, CASE WHEN l_quantity > 25 THEN 'N' ELSE 'A' END AS guess FROM lineitem), k AS (SELECT label AS class FROM g UNION SELECT guess FROM g),
        s AS (SELECT class, (SELECT count(*) FROM g WHERE label = class) AS support, (SELECT count(*) FROM g WHERE guess = class) AS predicted, (SELECT count(*) FROM g WHERE guess = class AND label = class) AS hits FROM k),
        m AS (SELECT support, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE CAST(hits AS DOUBLE) / predicted END AS p, CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE CAST(hits AS DOUBLE) / support END AS r,
          CASE WHEN support + predicted = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * hits / (support + predicted) END AS f FROM s)
        SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(p * support) / sum(support), 6) AS weighted_precision,
        round(sum(r * support) / sum(support), 6) AS weighted_recall, round(sum(f * support) / sum(support), 6) AS weighted_f1 FROM m""",
    ),
    "recurrence_upsert": (
        recurrence_upsert,
        """WITH s AS (SELECT c_custkey AS series, CAST(0 AS BIGINT) AS n, CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'cancelled' END AS status FROM customer WHERE c_custkey % 2 = 0),
        f AS (SELECT o_custkey AS series, count(*) AS n FROM orders WHERE year(o_orderdate) = 1999 GROUP BY o_custkey)
        SELECT coalesce(s.series, f.series) AS series, CASE WHEN f.n IS NOT NULL AND coalesce(s.status, 'pending') = 'pending' THEN f.n ELSE s.n END AS n, coalesce(s.status, 'pending') AS status FROM s FULL JOIN f ON s.series = f.series""",
    ),
    "import_new_gaps": (
        import_new_gaps,
        f"""WITH {COVERAGE}, early AS (SELECT * FROM coverage WHERE statement_id % 2 = 0), {_merged('early', 'a')}, {_merged('coverage', 'b')},
        ga AS (SELECT account_id, end_date + 1 AS s, nxt - 1 AS e FROM (SELECT *, lead(start_date) OVER (PARTITION BY account_id ORDER BY start_date) AS nxt FROM a) WHERE nxt IS NOT NULL),
        gb AS (SELECT account_id, end_date + 1 AS start_date, nxt - 1 AS end_date FROM (SELECT *, lead(start_date) OVER (PARTITION BY account_id ORDER BY start_date) AS nxt FROM b) WHERE nxt IS NOT NULL)
        SELECT * FROM gb WHERE NOT EXISTS (SELECT 1 FROM ga WHERE ga.account_id = gb.account_id AND ga.s <= gb.start_date AND ga.e >= gb.end_date)""",
    ),
    "payday_distances": (
        payday_distances,
        """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), p AS (SELECT day, CAST(date_trunc('month', day) + to_months(m) AS DATE) + d - 1 AS pay FROM days, (VALUES (-1), (0), (1)) a(m), (VALUES (1), (15), (28)) b(d))
        SELECT day, CAST(day - max(CASE WHEN pay <= day THEN pay END) AS BIGINT) AS days_since_payday, CAST(min(CASE WHEN pay >= day THEN pay END) - day AS BIGINT) AS days_to_payday FROM p GROUP BY day""",
    ),
    "hybrid_decisions": (
        hybrid_decisions,
        f"""WITH {ACTIVITY}, x AS (SELECT txn_id, CASE merchant WHEN 'purchase' THEN 'shopping' WHEN 'view' THEN 'needs_review' END AS rc, CASE WHEN txn_id % 4 <> 0 THEN merchant END AS mc, txn_id % 10 / 10.0 AS conf FROM activity),
        y AS (SELECT *, rc IS NULL OR rc = 'needs_review' AS u FROM x) SELECT txn_id, CASE WHEN u THEN mc ELSE rc END AS category_id, CASE WHEN NOT u THEN 'merchant' WHEN mc IS NOT NULL THEN 'model' ELSE 'none' END AS source,
        CASE WHEN NOT u THEN 'applied' WHEN mc IS NULL THEN 'needs_review' WHEN conf >= 0.6 THEN 'applied' ELSE 'pending' END AS status FROM y""",
    ),
}
