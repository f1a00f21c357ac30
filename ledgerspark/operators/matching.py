"""Duplicates, transfer pairs, category rules: candidates by equi-joins, then scores, then choices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import text as tx

#: Days within which rows may be the same payment, and within which a transfer's legs lie.
DUPLICATE_DAYS, TRANSFER_DAYS = 2, 3
PROBABLE = 0.75


def near_days(left: DataFrame, right: DataFrame, keys: list[str], days: int, date: str = "txn_date", tasks: int | None = None) -> DataFrame:
    """Pairs equal in ``keys`` and at most ``days`` apart: a join on the key and a block of days, each right row put in its block and the two beside it.

    ``tasks``: how many the join has, by default what its input's size gives.
    """
    width = days + 1
    block = F.floor(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) / width)
    a = left.withColumn("_block", block)
    b = right.withColumn("_block", F.explode(F.array(block - 1, block, block + 1)))
    if tasks:
        a, b = (df.repartition(tasks, *keys, "_block") for df in (a, b))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_block"]]
    return a.alias("a").join(b.alias("b"), [*on, F.abs(F.datediff(f"a.{date}", f"b.{date}")) <= days])


def duplicate_candidates(rows: DataFrame) -> DataFrame:
    """Pairs of one account's rows at most two days apart, the later id second."""
    met = near_days(rows, rows, ["account_id"], DUPLICATE_DAYS).filter("a.txn_id < b.txn_id")
    gap = F.abs(F.datediff("a.txn_date", "b.txn_date"))
    return met.select(
        F.col("a.account_id").alias("account_id"), F.col("a.txn_id").alias("first_id"), F.col("b.txn_id").alias("second_id"), gap.cast("long").alias("days"),
        F.col("a.amount").alias("first_amount"), F.col("b.amount").alias("second_amount"), F.col("a.merchant").alias("first_text"), F.col("b.merchant").alias("second_text"),
    )


def duplicate_scores(pairs: DataFrame, alike: Column) -> DataFrame:
    """0.4 for the amount, up to 0.25 for the date, 0.25 times the similarity from 0.6 on; probable from 0.75 on.

    Only pairs with the same amount can reach the threshold, so similarity is asked for these alone.
    """
    day = F.element_at(F.array(F.lit(0.25), F.lit(0.2), F.lit(0.1)), (F.col("days") + 1).cast("int"))
    scored = pairs.filter("first_amount = second_amount").withColumn("similarity", alike)
    score = F.lit(0.4) + day + F.when(F.col("similarity") >= 0.6, F.col("similarity") * 0.25).otherwise(0.0)
    return scored.withColumn("score", F.round(score, 3)).withColumn("status", F.when(F.col("score") >= PROBABLE, "probable").otherwise("unique"))


def transfer_candidates(rows: DataFrame) -> DataFrame:
    """Outflow and inflow of one owner's different accounts, equal in size, at most three days apart."""
    outs = rows.filter("amount < 0").withColumn("size", -F.col("amount"))
    ins = rows.filter("amount > 0").withColumn("size", F.col("amount"))
    met = near_days(outs, ins, ["profile_id", "size"], TRANSFER_DAYS).filter("a.account_id <> b.account_id")
    return met.select(
        F.col("a.profile_id").alias("profile_id"), F.col("a.size").alias("size"), F.col("a.txn_id").alias("out_id"), F.col("b.txn_id").alias("in_id"),
        F.col("a.txn_date").alias("out_date"), F.abs(F.datediff("a.txn_date", "b.txn_date")).cast("long").alias("days"),
        F.col("a.description").alias("out_text"), F.col("b.description").alias("in_text"),
    )


def transfer_confidence(pairs: DataFrame, alike: Column) -> DataFrame:
    """0.72, 0.02 for each day under three, up to 0.12 for similar text, 0.07 for transfer language in both; 0.99 at most."""
    words = tx.has_word(F.col("out_text"), tx.TRANSFER_WORDS) & tx.has_word(F.col("in_text"), tx.TRANSFER_WORDS)
    near = F.when(alike >= 0.45, F.least(F.lit(0.12), alike * 0.12)).otherwise(0.0)
    return pairs.withColumn("confidence", F.round(F.least(F.lit(0.99), 0.72 + 0.02 * (3 - F.col("days")) + near + F.when(words, 0.07).otherwise(0.0)), 4))


def transfer_pairs(scored: DataFrame) -> DataFrame:
    """One to one: outflows by date and id each take the free inflow of the highest confidence, then id.

    Pairs share owner and size: rows are dealt by these and stream through sorted partitions, best
    candidate first, and a fold holds the inflows taken in the last days, later ones being out of reach.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, served, taken = None, None, {}
        for frame in frames:
            out = []
            for profile, size, day, out_id, in_id, confidence in zip(*(frame[c] for c in frame.columns), strict=True):
                if key != (profile, size):
                    key, served, taken = (profile, size), None, {}
                if out_id == served or in_id in taken:
                    continue
                served, taken[in_id] = out_id, day
                if len(taken) > 1_000:
                    taken = {i: d for i, d in taken.items() if day - d <= 2 * TRANSFER_DAYS}
                out.append((out_id, in_id, confidence))
            yield pd.DataFrame(out, columns=["out_id", "in_id", "confidence"])

    day = F.datediff("out_date", F.lit("1970-01-01").cast("date")).alias("day")
    slim = scored.select("profile_id", F.col("size").cast("string").alias("size"), day, "out_id", "in_id", "confidence").repartition("profile_id", "size")
    ranked = slim.sortWithinPartitions("profile_id", "size", "day", "out_id", F.desc("confidence"), F.desc("in_id"))
    return ranked.mapInPandas(fold, "out_id long, in_id long, confidence double")


#: Rules up to which a counted rule table is broadcast, and first words up to which a pattern finds them in a text.
FEW, HEADS = 100_000, 200


def best_rule(rows: DataFrame, id_col: str, matches: DataFrame) -> DataFrame:
    """Each row with ``rule_id``, ``category_id`` and ``fields`` of its best-ranked matches; several categories at that rank need review.

    ``matches``: the id, rule_id, category_id, fields and a ``rank`` struct; a match may come more than once. They are
    read once: two aggregations, both combined before the shuffle, by rank and then by the highest rank. Fields are those
    of the rule chosen, the smallest id, or of all finalists where these disagree.
    """
    lone = F.col("low") == F.col("high")
    at = matches.groupBy(id_col, "rank").agg(
        F.min("rule_id").alias("rule_id"), F.min("category_id").alias("low"), F.max("category_id").alias("high"),
        F.min_by("fields", "rule_id").alias("own"), F.flatten(F.collect_set("fields")).alias("every"),
    )
    top = at.groupBy(id_col).agg(F.max_by(F.struct("rule_id", "low", "high", "own", "every"), "rank").alias("best")).select(id_col, "best.*")
    chosen = top.select(
        id_col, F.when(lone, F.col("rule_id")).alias("rule_id"), F.when(lone, F.col("low")).otherwise("needs_review").alias("category_id"),
        F.when(lone, F.col("own")).otherwise(F.array_distinct("every")).alias("fields"),
    )
    return rows.join(chosen, id_col, "left")


def keyword_matches(rows: DataFrame, rules: DataFrame, text: str = "text", key: str = "txn_id") -> DataFrame:
    """Rows that hold a rule's phrase as whole words and fit its direction.

    ``text`` and phrases are normalised by ``rule_text``. A text is turned into runs of as many words as the longest
    phrase has, and a run meets the phrases by its first word: neither the text nor its row is copied, and rules are
    broadcast once counted. A phrase that stands in the text several times matches as often; ``best_rule`` takes that.
    """
    heads = rules.filter(F.length("phrase") > 0).select(*(F.col(c).alias(f"r_{c}") for c in rules.columns)).withColumn("_words", F.size(F.split("r_phrase", " ")))
    heads = heads.withColumn("_head", F.substring_index("r_phrase", " ", 1))
    told = heads.agg(F.count("*").alias("n"), F.coalesce(F.max("_words"), F.lit(1)).alias("most"), F.count_distinct("_head").alias("heads")).first()
    if 0 < told.heads <= HEADS:
        one = "|".join(sorted(r._head for r in heads.select("_head").distinct().collect()))  # letters and digits only
        runs = F.regexp_extract_all(F.col(text), F.lit(f"(?<![^ ])(?=((?:{one})(?![^ ])(?: [^ ]+){{0,{told.most - 1}}}))"), F.lit(1))
    else:
        runs = words = F.split(F.col(text), " ")
        for later in range(2, told.most + 1):  # each word with those after it, an array at a time
            runs = F.zip_with(runs, F.slice(words, later, 1 << 30), lambda run, word: F.concat_ws(" ", run, word))
    each = rows.select(key, "direction", F.explode(F.array_distinct(runs)).alias("_run")).withColumn("_head", F.substring_index("_run", " ", 1))
    met = each.join(F.broadcast(heads) if told.n <= FEW else heads, "_head").filter(
        F.startswith(F.concat("_run", F.lit(" ")), F.concat("r_phrase", F.lit(" "))) & (F.col("r_direction").isNull() | (F.col("r_direction") == F.col("direction")))
    )
    rank = F.struct(F.col("r_priority").alias("priority"), F.col("r_direction").isNotNull().cast("int").alias("directed"), F.col("_words").alias("words"), F.length("r_phrase").alias("chars"))
    fields = F.when(F.col("r_direction").isNull(), F.array(F.lit("description"))).otherwise(F.array(F.lit("direction"), F.lit("description")))
    return met.select(key, F.col("r_rule_id").alias("rule_id"), F.col("r_category_id").alias("category_id"), fields.alias("fields"), rank.alias("rank"))


def latest_as_of(history: DataFrame, key: str, value: str, at: str, order: str, cutoff: Column) -> DataFrame:
    """The value each key had at the cutoff: the last by time, then id."""
    known = history.filter(F.col(at) <= cutoff)
    return known.groupBy(key).agg(F.max_by(value, F.struct(at, order)).alias(value))


def unresolved_as_of(suggestions: DataFrame, cutoff: Column) -> DataFrame:
    """Both rows of suggestions (``out_id``, ``in_id``) that were made by the cutoff and not reviewed by then."""
    open_ = suggestions.filter((F.col("created_at") <= cutoff) & (F.col("reviewed_at").isNull() | (F.col("reviewed_at") > cutoff)))
    return open_.select(F.explode(F.array("out_id", "in_id")).alias("txn_id")).filter("txn_id IS NOT NULL").distinct()
