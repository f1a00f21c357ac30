"""Benchmark decontamination by a positional inverted index of the training texts.

A window is ``size`` consecutive words of a benchmark item, or a whole shorter item. The corpus
frequency of every benchmark term ranks a window's terms; postings (term, text, positions) are
stored for the three rarest terms of any window and for no others. A window's list for its rarest
term, moved back by the term's offset, gives possible starts; the lists of the next two terms,
moved likewise, are intersected with it by joins on (term, text), within ``SLOP`` words: these are the
proximity matches. Those that meet exactly are compared word by word with the text: the phrase matches.

Texts are known by their MD5 digest, so copies are indexed and verified once. The sides of joins
that follow the benchmark's size are broadcast only after their rows are counted, and joined by
shuffle beyond ``shared.SMALL`` rows; terms are sifted in the workers by a broadcast set only up to
``TERMS`` terms, else by a join.

Nulls: a null text has no words; a null id is carried along; items without an id or without words
take no part. Repeated rows each give a row; a repeated item id counts once. An empty table gives
an empty result and an empty benchmark no hits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.shared import columns_of, if_small, staged, unused, utf8

TERMS = 500_000
#: Words by which the rarest terms of a window may lie out of place in a proximity match.
SLOP = 3
#: Words as the contract has them, for Spark; and each byte as its lower-cased self or a space.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def windows(benchmark: DataFrame, item_col: str = "item_id", text: str = "text", size: int = 13) -> DataFrame:
    """``item`` (string) and ``win`` (the window's words, space-joined), each pair once."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    words = benchmark.filter(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words")
    )
    last = F.greatest(F.size("words") - size, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("words", i + 1, size), " "))
    return words.filter(F.size("words") > 0).select("item", F.explode(runs).alias("win")).distinct()


def _sifter(terms: DataFrame):
    """A broadcast of the terms, as bytes, for the workers; None if there are too many."""
    if terms.limit(TERMS + 1).count() > TERMS:
        return None
    return terms.sparkSession.sparkContext.broadcast(frozenset(r[0].encode() for r in terms.collect()))


def term_counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """``term`` and its number of occurrences ``n`` in all texts, for the terms that occur."""
    wanted = _sifter(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            names = pa.array([t.decode(errors="replace") for t in seen], pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        for (texts,) in columns_of(batches):
            for one in texts:
                words = one.translate(FOLD).split()
                seen.update(words if wanted is None else filter(wanted.value.__contains__, words))
                if len(seen) > TERMS:
                    yield out()
                    seen.clear()
        yield out()

    partial = docs.select(utf8(text).alias("text")).mapInArrow(count, "term string, n long")
    total = partial.groupBy("term").agg(F.sum("n").alias("n"))
    return total.join(terms, "term", "left_semi") if wanted is None else total


def rarest_terms(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window that can occur with its three rarest (term, offset); a shorter one repeats its rarest."""
    # counts of the benchmark's terms only, so broadcast once counted: a frequent term is no hot key
    placed = wins.select("win", F.posexplode(F.split("win", " ")).alias("offset", "term")).join(if_small(counts), "term", "left")
    ranked = placed.groupBy("win").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("ranked")
    )
    ranked = ranked.filter(F.col("ranked")[0]["n"] > 0)
    pick = [F.coalesce(F.get("ranked", F.lit(i)), F.col("ranked")[0]) for i in range(3)]
    return ranked.select("win", *(p[f].alias(f"{f}{i}") for i, p in enumerate(pick, 1) for f in ("term", "offset")))


def build_index(docs: DataFrame, id_col: str, text: str, terms: DataFrame) -> DataFrame:
    """Stored: ``id``, ``digest``, ``n_words`` and the ``postings`` (term, positions) of ``terms`` in each row's text."""
    wanted = _sifter(terms)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posting = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))
        for batch in batches:
            digests, sizes, postings = [], [], []
            for one in batch.column(1).to_pylist():
                words = one.translate(FOLD).split()
                found: dict[bytes, list[int]] = defaultdict(list)
                for at, word in enumerate(words):
                    if wanted is None or word in wanted.value:
                        found[word].append(at)
                digests.append(hashlib.md5(one, usedforsecurity=False).digest())
                sizes.append(len(words))
                postings.append([{"term": t.decode(errors="replace"), "positions": p} for t, p in found.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(postings, posting)],
                ["id", "digest", "n_words", "postings"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), utf8(text).alias("text"))
    return staged(
        rows.mapInArrow(index, f"id {kind}, digest binary, n_words long, postings array<struct<term:string,positions:array<int>>>"),
        "positional-index",
    )


def candidates(index: DataFrame, anchors: DataFrame, slop: int = SLOP) -> DataFrame:
    """``win``, ``digest``, ``start``, ``exact``: where the lists of a window's three rarest terms meet within ``slop`` words, and whether exactly.

    The rarest term's positions give the starts; the others' are kept by blocks of as many words as a place may vary over, so a
    start looks at two blocks at most, however often a text repeats the term. A start may come from both; they are one in the end.
    """
    wide = 2 * int(slop) + 1
    postings = (
        index.select("digest", F.explode("postings").alias("p"))
        .select("digest", "p.term", "p.positions")
        .dropDuplicates(["digest", "term"])
    )
    found = postings.join(if_small(anchors), F.col("term") == F.col("term1")).select(
        "digest", "win", "term2", "offset2", "term3", "offset3", F.explode("positions").alias("at"), "offset1"
    )
    found = found.withColumn("start", F.col("at") - F.col("offset1")).drop("at", "offset1").filter("start >= 0")
    spots = postings.select("digest", "term", F.explode("positions").alias("at")).withColumn("block", F.floor(F.col("at") / wide))
    blocks = spots.groupBy("digest", "term", "block").agg(F.collect_list("at").alias("spots"))
    for i in (2, 3):
        place = F.col("start") + F.col(f"offset{i}")
        reach = F.array_distinct(F.array(F.floor((place - slop) / wide), F.floor((place + slop) / wide)))
        other = blocks.withColumnRenamed("term", f"term{i}")
        met = found.withColumn("block", F.explode(reach)).join(other, ["digest", f"term{i}", "block"])
        near = F.expr(f"exists(spots, p -> abs(p - start - offset{i}) <= {int(slop)})")
        found = met.filter(near).withColumn(f"exact{i}", F.expr(f"array_contains(spots, start + offset{i})")).drop("spots", "block")
    return found.groupBy("win", "digest", "start").agg(F.bool_or(F.expr("exact2 AND exact3")).alias("exact"))


def _prepare(docs: DataFrame, benchmark: DataFrame, id_col: str, text: str, item_col: str, item_text: str, size: int):
    pairs = staged(windows(benchmark, item_col, item_text, size), "benchmark-windows")
    wins = pairs.select("win").distinct()
    terms = wins.select(F.explode(F.split("win", " ")).alias("term")).distinct()
    anchors = staged(rarest_terms(wins, staged(term_counts(docs, text, terms), "benchmark-terms")), "benchmark-anchors")
    rare = anchors.select(F.explode(F.array("term1", "term2", "term3")).alias("term")).distinct()
    return pairs, anchors, build_index(docs, id_col, text, rare)


def _hits(docs: DataFrame, near: DataFrame, text: str) -> DataFrame:
    """``digest``, ``n_hit`` and the ``wins`` that occur, for each text with an occurrence among the candidates ``near``."""
    found = near.filter("exact").groupBy("digest").agg(F.collect_list(F.struct("start", "win")).alias("found"))
    found = staged(found, "benchmark-candidates")
    wanted = found.select("digest")
    rows = docs.filter(F.col(text).isNotNull()).select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"), utf8(text).alias("text"))
    texts = rows.join(if_small(wanted), "digest", "left_semi").dropDuplicates(["digest"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, int, list[str]]] = []
            for digest, one, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, seen = one.translate(FOLD).split(), set()
                hit = bytearray(len(words))
                for place in places:
                    start, win = place["start"], place["win"].encode()
                    n = win.count(b" ") + 1
                    if b" ".join(words[start : start + n]) == win:
                        hit[start : start + n] = b"\x01" * n
                        seen.add(place["win"])
                if seen:
                    out.append((digest, sum(hit), sorted(seen)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "n_hit", "wins"])

    return texts.join(found, "digest").select("digest", "text", "found").mapInArrow(verify, "digest binary, n_hit long, wins array<string>")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    share: int = 20,
    slop: int = SLOP,
) -> DataFrame:
    """One row for each document: id, ``digest``, ``n_words``, ``n_hit``, ``items`` (sorted as strings), ``near_items``, ``contaminated``.

    Contaminated: some word is hit, and at least one of ``share`` words. ``near_items``: the items with
    a proximity match, those of ``items`` included.
    """
    pairs, anchors, index = _prepare(docs, benchmark, id_col, text, item_col, item_text, size)
    near = staged(candidates(index, anchors, slop), "benchmark-candidates")
    hits = staged(_hits(docs, near, text), "benchmark-hits")
    of = if_small(pairs)
    named = lambda found, name: found.join(of, "win").groupBy("digest").agg(F.sort_array(F.collect_set("item")).alias(name))
    told = named(near.select("digest", "win").distinct(), "near_items")
    told = told.join(hits.select("digest", "n_hit"), "digest", "left").join(named(hits.select("digest", F.explode("wins").alias("win")), "items"), "digest", "left")
    told = staged(told, "benchmark-told")  # stored, so that the join of a hot text's copies can be split
    none = F.array().cast("array<string>")
    return index.select("id", "digest", "n_words").join(told, "digest", "left").select(
        F.col("id").alias(id_col),
        "digest",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"),
        F.expr(f"coalesce(n_hit, 0) > 0 AND {int(share)} * coalesce(n_hit, 0) >= n_words").alias("contaminated"),
    )


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 13
) -> DataFrame:
    """id, ``item``, ``start``: where a window's three rarest terms lie within ``slop`` words of their places."""
    pairs, anchors, index = _prepare(docs, benchmark, id_col, text, item_col, item_text, size)
    found = candidates(index, anchors, slop).join(if_small(pairs), "win").select("digest", "item", "start").distinct()
    return index.select("id", "digest").join(found, "digest").select(F.col("id").alias(id_col), "item", "start")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns; whether one is depends on its text alone."""
    bad = contamination(docs, benchmark, id_col, text, **options).filter("contaminated").select("digest").distinct()
    (key,) = unused(docs, "digest")
    bad = if_small(staged(bad, "contaminated").withColumnRenamed("digest", key))
    own = F.unhex(F.md5(F.coalesce(docs[text], F.lit("")).cast("binary")))
    return docs.join(bad, own == bad[key], "left_anti")
