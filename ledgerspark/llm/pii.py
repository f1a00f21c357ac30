"""Personal data by pattern, and terms that give protected entities away.

Four kinds are found by pattern, leftmost and without overlap, with the checks of their kind. The
patterns are written so that every position is tried in constant time: runs are taken possessively
and can't be entered in the middle, which gives the same matches as the plain patterns.

Terms are sanitised by what they disclose, on two levels, both counted by distinct texts.

Words and single entities: each valid match names a protected entity. Words of letters within
``REACH`` places of a match are counted with its entity; those seen with one entity in at least
``SUPPORT`` texts are counted over all texts of the corpus. Where P(entity | term) reaches ``share``
and the pointwise mutual information reaches ``bits``, the term reveals the entity.

Shapes and protected classes: an opaque token (16 characters and more with a digit in it, or 9 digits
and more) hardly ever occurs twice, so it is counted as its shape: its alphabet and length. What it
reveals is the class of the place it is found in: the value given to a name (``name = "..."``), or
one of the four kinds, where a valid match lies within the token. A shape is a disclosing term if
P(class | shape), by texts, reaches ``share`` and its mutual information with the class reaches
``part`` of the class's own information, -log2 of its share of all words of the distinct texts. No list of names is used: that
40 hexadecimal digits are a credential follows from where the corpus puts them. Each token of such
a shape is then a span, wherever it stands.

Every occurrence of a disclosing term, outside the spans found by pattern, is a span of kind
``term``. ``sanitise`` generalises: patterns to their kind, shapes to their alphabet, words to TERM.

DataFrame functions only. Texts are known by their MD5 digest, so copies count and are searched
once. Positions are running sums of the lengths between and within matches, one window for each
text. The disclosing terms are broadcast only after they are counted, else joined by shuffle.

Nulls: a null text is empty; a null id is carried along. Repeated rows each give a row. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.shared import if_small, staged, unused

KINDS = ("email", "ip", "card", "phone")
#: kind: (a cheap test, the pattern). ``\G`` lets a match follow the one before inside a run; the look-behinds bar other mid-run starts.
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][ 0-9-]{11}", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
REACH, NEAR, SUPPORT = 6, 120, 3
SHARE, BITS, PART = 0.8, 4.0, 0.8
#: Opaque tokens: from their own start on, so in constant time for each character. Numbers may be cut by single marks.
OPAQUE = {"opaque": (r"[0-9]", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?:[A-Za-z0-9+/_-]{16,}+={0,2}+|[0-9]{9,}+)(?![A-Za-z0-9+/_=@-])")}
#: What stands between the last letter of a name and the value given to it.
GIVEN = r"[=:](?<=[\p{L}\p{N}_][\"'\]]? {0,3}[=:])[=>]? {0,3}[\"'(\[]{0,2}"


def digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.split(F.reverse(number), "")
    doubled = F.transform(reverse, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def is_valid(kind: Column, value: Column) -> Column:
    """The checks of each kind; evaluated for matches only."""
    parts_fit = F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", parts_fit)
        .when(kind == "card", luhn(digits(value)))
        .when(kind == "phone", F.length(digits(value)).between(9, 15))
        .otherwise(True)
    )


def positioned(matches: DataFrame) -> DataFrame:
    """Spans from ``digest``, ``kind``, ``gaps`` (n, tail, head of the text between matches) and ``values``.

    One row for each match: ``start``, ``end``, ``value``, and the text ``before`` and ``after`` it.
    """
    order = Window.partitionBy("digest", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    n = F.size("values")
    each = F.arrays_zip(F.slice("gaps", 1, n).alias("gap"), "values", F.slice("gaps", 2, n).alias("next"))
    rows = matches.select("digest", "kind", F.posexplode(each).alias("i", "m"))  # a row carries its own gaps only
    rows = rows.select("digest", "kind", "i", F.col("m.values").alias("value"), F.col("m.gap").alias("gap"), F.col("m.next.head").alias("after"))
    end = F.sum(F.col("gap.n") + F.length("value")).over(order)
    return rows.select(
        "digest", "kind", "value", F.col("gap.tail").alias("before"), "after", end.cast("long").alias("end")
    ).withColumn("start", F.col("end") - F.length("value"))


def pattern_matches(docs: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """``digest``, ``kind``, ``gaps``, ``values`` of each distinct text and kind with a match."""

    def one(kind: str) -> Column:
        cheap, pattern = patterns[kind]
        gaps = F.transform(
            F.split(F.col(text), pattern, -1),
            lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(NEAR)).alias("tail"), F.left(g, F.lit(NEAR)).alias("head")),
        )
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.when(F.col(text).rlike(cheap) & F.col(text).rlike(pattern), F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), found.alias("values")))

    rows = docs.select(digest(text).alias("digest"), F.explode(F.array_compact(F.array(*map(one, patterns)))).alias("m"))
    return rows.select("digest", "m.*").groupBy("digest", "kind").agg(F.first("gaps").alias("gaps"), F.first("values").alias("values"))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stored: the valid spans of each distinct text that has any."""
    spans = positioned(pattern_matches(docs, text, PATTERNS))
    return staged(spans.filter(is_valid(F.col("kind"), F.col("value"))), "pii-spans")


def words_near(spans: DataFrame) -> DataFrame:
    """``digest``, ``entity``, ``term``: whole words of letters, lower-cased, within REACH places of a span."""
    plain = r"^[\"'(\[]*\p{L}{3,}[\"')\].,;:!?]*$"
    before = F.split("before", r"\s+")
    before = F.when(F.length("before") < NEAR, before).otherwise(F.slice(before, 2, NEAR))  # the first may be cut
    after = F.split("after", r"\s+")
    after = F.when(F.length("after") < NEAR, after).otherwise(F.reverse(F.slice(F.reverse(after), 2, NEAR)))
    near = F.concat(F.slice(F.reverse(before), 1, REACH + 1), F.slice(after, 1, REACH + 1))
    words = F.transform(F.filter(near, lambda w: w.rlike(plain)), lambda w: F.lower(F.regexp_extract(w, r"\p{L}+", 0)))
    entity = F.concat_ws(":", "kind", F.when(F.col("kind").isin("card", "phone"), digits(F.col("value"))).otherwise(F.lower("value")))
    return spans.select("digest", entity.alias("entity"), F.explode(F.array_distinct(words)).alias("term")).distinct()


def disclosing_terms(docs: DataFrame, spans: DataFrame, text: str = "text", share: float = SHARE, bits: float = BITS) -> tuple[DataFrame, DataFrame]:
    """The terms that reveal an entity, and the distinct texts they occur in: (``term``), (``digest``, ``term``); both stored."""
    near = words_near(spans)
    # a term occurs in at least as many texts as it is seen in near any entity: most pairs can't reach the share and go at once
    places = near.groupBy("term").agg(F.count_distinct("digest").alias("places"))
    pairs = near.groupBy("term", "entity").agg(F.count("*").alias("together")).filter(F.col("together") >= SUPPORT)
    pairs = staged(pairs.join(places, "term").filter(F.col("together") / F.col("places") >= share), "pii-pairs")
    wanted = pairs.select("term").distinct()
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    rows = docs.select(digest(text).alias("digest"), F.explode(words).alias("term")).join(if_small(wanted), "term", "left_semi").distinct()
    rows = staged(rows, "pii-terms")
    texts = docs.select(digest(text).alias("digest")).distinct().count()
    entities = spans.groupBy(F.concat_ws(":", "kind", F.when(F.col("kind").isin("card", "phone"), digits(F.col("value"))).otherwise(F.lower("value"))).alias("entity"))
    entities = entities.agg(F.count_distinct("digest").alias("with_entity"))
    judged = pairs.join(rows.groupBy("term").agg(F.count("*").alias("with_term")), "term").join(entities, "entity")
    gain = F.log2(F.col("together") * float(texts) / (F.col("with_term") * F.col("with_entity")))
    told = judged.filter((F.col("together") / F.col("with_term") >= share) & (gain >= bits)).select("term").distinct()
    told = staged(told, "pii-disclosing")
    return told, rows.join(if_small(told), "term", "left_semi")


def alphabet(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]++$"), "digits").when(value.rlike("^[0-9a-f-]++$|^[0-9A-F-]++$"), "hex").otherwise("key")


def opaque_tokens(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """Stored: ``digest``, ``start``, ``end``, ``shape``, ``label`` and ``class`` (null: no protected place) of each opaque token.

    A token that overlaps a valid match has that match's kind as its class.
    """
    tokens = positioned(pattern_matches(docs, text, OPAQUE))
    value = F.col("value")
    shape = F.concat_ws(":", alphabet(value), F.length(value))
    given = F.when(F.col("before").rlike(f"{GIVEN}$"), "given")
    tokens = tokens.select("digest", "start", "end", shape.alias("shape"), F.upper(alphabet(value)).alias("label"), given.alias("class"))
    lies = spans.groupBy("digest").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))  # one text's valid matches
    own = tokens.select("digest").distinct()
    lies = lies.join(if_small(own), "digest", "left_semi")
    both = tokens.join(lies, "digest", "left")
    over = F.filter("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    kind = F.get(F.transform(over, lambda s: s["kind"]), F.lit(0))
    return staged(both.withColumn("base", kind.isNotNull()).withColumn("class", F.coalesce(kind, "class")).drop("spans"), "pii-opaque")


def disclosing_shapes(docs: DataFrame, tokens: DataFrame, spans: DataFrame, text: str = "text", share: float = SHARE, part: float = PART) -> DataFrame:
    """Stored: the ``shape``s that reveal a protected class; there are no more shapes than lengths and alphabets that occur in SUPPORT texts."""
    words = F.length(text) - F.length(F.replace(F.col(text), F.lit(" "))) + 1
    by_text = docs.filter(F.col(text).isNotNull()).select(digest(text).alias("digest"), words.alias("words"), F.regexp_count(text, F.lit(rf"{GIVEN}\S")).alias("given")).distinct()
    told = by_text.agg(F.sum("words").alias("words"), F.sum("given").alias("given")).first()
    classes = spans.groupBy(F.col("kind").alias("class")).agg(F.count("*").alias("places"))
    classes = classes.unionByName(classes.sparkSession.createDataFrame([("given", told.given or 0)], "class string, places long"))
    found = tokens.groupBy("shape").agg(F.count_distinct("digest").alias("with_shape")).filter(F.col("with_shape") >= SUPPORT)
    pairs = tokens.filter("class IS NOT NULL").groupBy("shape", "class").agg(F.count_distinct("digest").alias("together"))
    judged = pairs.join(found, "shape").join(F.broadcast(classes), "class")  # five classes
    held = F.col("together") / F.col("with_shape")
    own = F.log2(float(max(told.words or 1, 1)) / F.col("places"))
    told = judged.filter((held >= share) & (F.col("together") >= SUPPORT) & (F.log2(held) + own >= part * own))
    return staged(told.select("shape").distinct(), "pii-shapes")


def shape_spans(docs: DataFrame, spans: DataFrame, text: str = "text", share: float = SHARE, part: float = PART) -> DataFrame:
    """Each token of a disclosing shape outside the base spans: ``digest``, ``start``, ``end``, ``label``."""
    tokens = opaque_tokens(docs, spans, text)
    shapes = disclosing_shapes(docs, tokens, spans, text, share, part)
    return tokens.filter("NOT base").join(if_small(shapes), "shape", "left_semi").select("digest", "start", "end", "label")


def term_spans(docs: DataFrame, hits: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """Every occurrence of a disclosing term, outside the base spans: ``digest``, ``start``, ``end``."""
    word = {"term": (r"\p{L}", r"\p{L}+")}
    terms = hits.groupBy("digest").agg(F.collect_set("term").alias("terms"))
    held = docs.select(digest(text).alias("digest"), F.col(text).alias("text")).join(if_small(terms.select("digest")), "digest", "left_semi")
    found = positioned(pattern_matches(held, "text", word)).join(terms, "digest").filter(F.array_contains("terms", F.lower("value")))
    both = found.select("digest", "start", "end", F.lit(False).alias("base")).unionByName(
        spans.join(if_small(terms.select("digest")), "digest", "left_semi").select("digest", "start", "end", F.lit(True).alias("base"))
    )
    own = Window.partitionBy("digest").orderBy("start", F.desc("base"))
    until = F.max(F.when(F.col("base"), F.col("end"))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    onward = F.min(F.when(F.col("base"), F.col("start"))).over(own.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("until", until).withColumn("onward", onward)
    clear = (F.coalesce("until", F.lit(0)) <= F.col("start")) & (F.coalesce("onward", "end") >= F.col("end"))
    return both.filter(~F.col("base") & clear).select("digest", "start", "end")


def spans_by_text(docs: DataFrame, text: str = "text", share: float = SHARE, bits: float = BITS, part: float = PART) -> DataFrame:
    """``digest`` and ``spans``: (rank of the kind, start, end, label) sorted, of each distinct text that has any."""
    base = base_spans(docs, text)
    _, hits = disclosing_terms(docs, base, text, share, bits)
    rank = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), -1))
    term = F.lit(len(KINDS)).alias("rank")
    every = base.select("digest", rank.alias("rank"), "start", "end", F.upper("kind").alias("label"))
    every = every.unionByName(term_spans(docs, hits, base, text).select("digest", term, "start", "end", F.lit("TERM").alias("label")))
    every = every.unionByName(shape_spans(docs, base, text, share, part).select("digest", term, "start", "end", "label"))
    return every.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("rank", "start", "end", "label"))).alias("spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = SHARE, bits: float = BITS, part: float = PART) -> DataFrame:
    """One row for each document: id and its ``spans``, an array of (rank, start, end, label)."""
    found = staged(spans_by_text(docs, text, share, bits, part), "pii-by-text")  # stored, so that the join of a hot text's copies can be split
    rows = docs.select(F.col(id_col).alias("id"), digest(text).alias("digest")).join(found, "digest", "left")
    return rows.select(F.col("id").alias(id_col), F.coalesce("spans", F.array().cast("array<struct<rank:int,start:long,end:long,label:string>>")).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = SHARE, bits: float = BITS, part: float = PART) -> DataFrame:
    """The documents, with each span of their text replaced by ``[LABEL]``; a span that begins inside another is part of it."""
    own, key, spans = unused(docs, "own_digest", "digest", "spans")
    found = staged(spans_by_text(docs, text, share, bits, part), "pii-by-text").toDF(key, spans)
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["label"])))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], F.substring(F.col(text), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("["), s["label"], F.lit("]"))
        inside = s["start"] < state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(inside, state["out"]).otherwise(more).alias("out"))

    cleaned = F.aggregate(by_start, start, step, lambda s: F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.length(text))))
    both = docs.withColumn(own, digest(text)).join(found, F.col(own) == F.col(key), "left")
    return both.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(cleaned)).select(docs.columns)
