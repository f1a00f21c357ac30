"""Queries without SQL against plain Python: import outcomes, greedy transfer pairs, next expected dates, the model's holdout."""

import calendar
import datetime
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ledgerspark import catalogue
from ledgerspark.operators import classifier, duplicates
from ledgerspark.plans import bindings, duplicate_queries

DIR = "/root/testdata/sf0.001"


def alike(a, b):
    return SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


def plain_pair(new, old):
    """Score and status by the rule, pair by pair."""
    if new.source_fingerprint == old.source_fingerprint:
        return 1.0, "exact"
    if new.account_id != old.account_id:
        return 0.0, "unique"
    ids = new.external_id is not None and old.external_id is not None
    if ids and new.external_id.lower() == old.external_id.lower():
        return 1.0, "exact"
    score = 0.4 * (new.amount == old.amount) + {0: 0.25, 1: 0.2, 2: 0.1}.get(abs((new.txn_date - old.txn_date).days), 0)
    if (r := alike(new.text, old.text)) >= 0.6:
        score += 0.25 * r
    score = round(min(score, 0.7 if ids else 1.0), 3)
    return score, "probable" if score >= 0.75 else "unique"


def plain_outcomes(rows):
    accepted, out = {}, {}
    for new in sorted(rows, key=lambda r: r.txn_id):
        found = [(*plain_pair(new, old), -old.txn_id) for old in accepted.get(new.account_id, [])]
        found = [(score, at, status) for score, status, at in found if status != "unique"]
        out[new.txn_id] = "exact" if any(f[2] == "exact" for f in found) else max(found)[2] if found else "accepted"
        if out[new.txn_id] == "accepted":
            accepted.setdefault(new.account_id, []).append(new)
    return out


def test_import_outcomes(spark):
    rows = duplicate_queries.imported(spark, DIR)
    want = plain_outcomes(rows.collect())
    assert {r.txn_id: r.status for r in duplicates.resolve(rows).collect()} == want
    assert set(want.values()) == {"accepted", "probable", "exact"}
    told = {r.batch_id: r for r in duplicates.summary(duplicates.resolve(rows), rows).collect()}
    assert all(r.rows_read == r.accepted + r.probable + r.exact and len(r.exact_rows) == r.exact for r in told.values())


def test_similar_text_is_probable(spark):
    """Same amount and day reach the threshold from a similarity of 0.6 on; other external ids cap the score."""
    day = datetime.date(2024, 1, 5)
    rows = [(1, "a", 1, day, 5, "corner shop london", None), (2, "b", 1, day, 5, "corner shop londn", None), (3, "c", 1, day, 5, "else entirely", None), (4, "d", 1, day, 5, "corner shop london", "x"), (5, "e", 1, day, 5, "corner shop london", "y"), (6, "f", 2, day, 5, "corner shop london", None)]
    df = spark.createDataFrame(rows, "txn_id long, source_fingerprint string, account_id long, txn_date date, amount int, text string, external_id string")
    got = {(r.new_txn_id, r.old_txn_id): (r.score, r.status) for r in duplicates.assess(duplicates.pairs(df, df)).collect()}
    facts = {r.txn_id: r for r in df.collect()}
    assert got == {(a, b): plain_pair(facts[a], facts[b]) for a, b in got} and len(got) == 20
    assert got[2, 1][1] == "probable" and got[3, 1][1] == "unique" and got[5, 4] == (0.7, "unique")
    assert {r.txn_id: r.status for r in duplicates.resolve(df).collect()} == plain_outcomes(df.collect())


def crowded():
    """40 rows of few days, amounts, texts, sources and ids, some of them null, in two accounts."""
    rng = random.Random(3)
    one = lambda *of: rng.choice(of)
    rows = [(i, one("a", "b", "c", None), one(1, 2), one(datetime.date(2024, 1, 1), datetime.date(2024, 1, 2), datetime.date(2024, 1, 4), None), one(5, 6, None), one("corner shop", "corner shp", "other", None), one("x", "X", None, None, f"z{i}")) for i in range(-4, 36)]
    return [(i, s if rng.random() < 0.3 else f"s{i}", *r) for i, s, *r in rows]


def test_best_match_without_pairs(spark, monkeypatch):
    """The best of all pairs, found from classes: no join gives more rows than classes and rows need."""
    df = spark.createDataFrame(crowded(), "txn_id long, source_fingerprint string, account_id long, txn_date date, amount int, text string, external_id string")
    want = sorted(map(tuple, duplicates.best(duplicates.assess(duplicates.pairs(df, df))).collect()))
    assert sorted(map(tuple, duplicates.best_of(df, df).collect())) == want and {w[3] for w in want} == {"probable", "exact"}
    few, most = df.filter("txn_id % 3 = 0"), df.filter("txn_id % 3 <> 0")
    want = sorted(map(tuple, duplicates.best(duplicates.assess(duplicates.pairs(few, most))).collect()))
    assert sorted(map(tuple, duplicates.best_of(few, most).collect())) == want and want
    monkeypatch.setattr(duplicates, "pairs", None)
    assert duplicate_queries.duplicate_best_match(spark, DIR).count() > 0


def test_outcomes_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "pairs", None)
    dated = [r for r in crowded() if r[3] is not None and r[4] is not None and r[1] is not None]
    df = spark.createDataFrame(dated, "txn_id long, source_fingerprint string, account_id long, txn_date date, amount int, text string, external_id string")
    want = plain_outcomes(df.collect())
    assert {r.txn_id: r.status for r in duplicates.resolve(df).collect()} == want and set(want.values()) == {"accepted", "probable", "exact"}


def test_assessments_score_classes_not_pairs(spark, monkeypatch):
    """All pairs with their scores and reasons, though arrays of equal rows are scored, however small these arrays are; one table and two."""
    df = spark.createDataFrame(crowded(), "txn_id long, source_fingerprint string, account_id long, txn_date date, amount int, text string, external_id string")
    few, most = df.filter("txn_id % 3 = 0"), df.filter("txn_id % 3 <> 0")
    want = [sorted(map(tuple, duplicates.assess(duplicates.pairs(new, old)).collect())) for new, old in ((df, df), (few, most))]
    assert {w[3] for w in want[0]} == {"unique", "probable", "exact"}
    monkeypatch.setattr(duplicates, "pairs", None)
    for held, meeting in ((1_000, 8), (2, 1), (1, 2)):
        monkeypatch.setattr(duplicates, "HELD", held)
        monkeypatch.setattr(duplicates, "MEETING", meeting)
        assert [sorted(map(tuple, duplicates.assessments(new, old).collect())) for new, old in ((df, df), (few, most))] == want
    assert duplicate_queries.duplicate_assessments(spark, DIR).count() > 0


def test_a_pair_is_found_once(spark):
    """Rows of one source, external id and amount meet in all three joins and are one pair."""
    df = spark.createDataFrame(crowded(), "txn_id long, source_fingerprint string, account_id long, txn_date date, amount int, text string, external_id string")
    found = [(r.new_txn_id, r.old_txn_id) for r in duplicates.pairs(df, df).collect()]
    assert len(found) == len(set(found)) > 0
    plan = duplicates.pairs(df, df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # pairs aren't shuffled to tell them apart


def test_greedy_transfers(spark):
    larger = DIR.replace("0.001", "0.01")  # the smallest tables have no pair
    rows = bindings.activity(spark, larger).collect()
    by = {}
    for r in rows:
        if r.amount > 0:
            by.setdefault((r.profile_id, r.amount), []).append(r)
    words = {"transfer", "xfer", "savings", "internal"}
    taken, want = set(), {}
    for o in sorted((r for r in rows if r.amount < 0), key=lambda r: (r.txn_date, r.txn_id)):
        free = []
        for i in by.get((o.profile_id, -o.amount), []):
            days = abs((o.txn_date - i.txn_date).days)
            if i.txn_id in taken or i.account_id == o.account_id or days > 3:
                continue
            r = alike(o.description, i.description)
            both = all(words & set(x.description.split()) for x in (o, i))
            free.append((round(min(0.99, 0.72 + 0.02 * (3 - days) + (min(0.12, 0.12 * r) if r >= 0.45 else 0) + 0.07 * both), 4), i.txn_id))
        if free:
            confidence, best = max(free)
            taken.add(best)
            want[o.txn_id] = (best, confidence)
    got = {r.out_id: (r.in_id, r.confidence) for r in catalogue.queries()["transfer_pairs_greedy"](spark, larger).collect()}
    assert got == want and want


def test_next_expected_dates(spark):
    last = {(r.account_id, r.merchant, r.role): r for r in catalogue.queries()["recurrence_series"](spark, DIR).collect()}
    as_of = datetime.date(2001, 12, 31)

    def step(day, frequency):
        if frequency in ("weekly", "fortnightly"):
            return day + datetime.timedelta(7 if frequency == "weekly" else 14)
        month = day.month - 1 + {"monthly": 1, "quarterly": 3, "annual": 12}[frequency]
        year, month = day.year + month // 12, month % 12 + 1
        return day.replace(year=year, month=month, day=min(day.day, calendar.monthrange(year, month)[1]))

    got = catalogue.queries()["recurrence_next_date"](spark, DIR).collect()
    assert len(got) == len(last)
    for r in got:
        one, missed = last[r.account_id, r.merchant, r.role], 0
        day = step(one.last_date, one.frequency)
        while day <= as_of:
            missed, day = missed + 1, step(day, one.frequency)
        assert (r.next_date, r.missed) == (day, missed)


def test_recurrence_confidence(spark):
    """The score by hand, on two series of one account: a clean monthly one, and one that was missed on covered days."""
    day = datetime.date
    from ledgerspark.operators import series

    rows = [("gym", 3, 30, 30, 30, 30, 0.0, "monthly", day(2024, 3, 1)), ("box", 3, 7, 7, 6, 9, 0.25, "weekly", day(2024, 3, 1))]
    df = spark.createDataFrame([(1, *r) for r in rows], "account_id long, merchant string, n long, interval_days long, median_gap int, gap_lo int, gap_hi int, amount_deviation double, frequency string, last_date date")
    known = spark.createDataFrame([(1, day(2024, 3, 1), day(2024, 3, 20))], "account_id long, start_date date, end_date date")
    got = {r.merchant: (r.covered_missed, r.confidence) for r in series.confidence(df, F.lit("2024-03-31").cast("date"), known, "account_id", 3).collect()}
    assert got["gym"] == (0, round((1 + 1 + 0.6) / 3, 6))
    assert got["box"] == (2, round((1 - 2 / 7 + 0.75 + 0.6) / 3 - 0.3, 6))  # due on the 8th, 15th, 22nd and 29th


def test_the_model_beats_the_most_frequent_class(spark):
    of = {r.model: r for r in catalogue.queries()["category_model_holdout"](spark, "/root/testdata/sf0.01").collect()}
    assert of["candidate"].macro_f1 > of["baseline"].macro_f1 and of["candidate"].weighted_f1 > 0.9


def test_model_guards_and_storage(spark, tmp_path):
    from ledgerspark.operators import classifier

    rows = spark.createDataFrame([(i, f"{'rent flat' if i % 2 else 'food shop'} number {i % 7}", "home" if i % 2 else "food") for i in range(60)], "id long, text string, category_id string")
    train, test = rows.filter("id < 48"), rows.filter("id >= 48")
    assert classifier.guard(train, test) is None and classifier.guard(train.limit(3), test) == "too_few_training_samples"
    assert classifier.guard(train.filter("category_id = 'home'"), test) == "one_class_training_split" and classifier.guard(train, test.limit(1)) == "too_few_test_samples"
    model = classifier.fit(train)
    got = classifier.predict(model, test.drop("category_id").unionByName(spark.createDataFrame([(99, None)], "id long, text string"))).collect()
    assert len(got) == 13 and all(r.guess == ("home" if r.id % 2 else "food") and r.confidence > 0.5 for r in got if r.id < 99)
    classifier.save(model, str(tmp_path / "m"), "v1")
    assert classifier.digest(classifier.load(spark, str(tmp_path / "m"), "v1")) == classifier.digest(model)
    for wrong in ("v2",):
        try:
            classifier.load(spark, str(tmp_path / "m"), wrong)
            raise AssertionError("should fail")
        except ValueError:
            pass


def test_training_rows_are_not_broadcast(spark):
    """A small file of rows looks smaller than the classes' weights; the rows must not go through the driver for that."""
    rows = spark.read.parquet(f"{DIR}/part.parquet").select(F.col("p_name").alias("text"), F.col("p_type").alias("category_id"))
    weighed = classifier.balanced(classifier.featured(rows))
    plan = weighed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan
    assert abs(weighed.agg(F.sum("weight")).first()[0] - rows.count()) < 1e-6
