"""Line deduplication with a log-template tree of fixed depth.

A line is cut into tokens, and tokens with a digit become ``<*>``. The tree's path is the token
count and the ``LEAD`` leading tokens; below that, a line of at least ``LONG`` tokens belongs to three
templates, in each of which one third of the tail is generalised to a variable field. So two lines
share a template if they have as many tokens, begin alike, and differ within one of the three thirds
of the rest. Each line but the shortest, of fewer than ``LEAST`` tokens, has the template of all it holds.

Long lines are also cut into passages, after each stop that ends at least ``STRETCH`` characters
without one. Where a cut falls depends on those characters only, so a passage repeated inside
otherwise different lines is cut alike from its first long sentence on. A passage of at least
``STRETCH`` characters has the template of all it holds, one with a line of the same content.

A template recurs if it occurs in two documents, or in ``SHORT_DOCS`` for a short line, which
may recur by chance. A line or passage with a recurring template stays in the document with the
smallest id that has it (of texts that share that id, in one) and is dropped from all others, so that
one copy of everything remains.

DataFrame functions only. Templates are 96-bit hashes; their documents are counted with map-side
combining, and a hot template is split by adaptive execution where lines meet the recurring ones.
A document is known by its id and its text's hash; repeated rows are the same document and are
counted once.

Nulls: a null text stays null; a null id comes after all others. Empty lines have no template and
stay. A text that holds the control character U+0001 is cut into lines only. Other columns are
carried along, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.shared import staged, unused

LEAD, LONG, LEAST, THIRDS, STRETCH = 3, 8, 3, 3, 40
SHORT_DOCS = 5
MARK = "\x01"
#: The end of a passage, with the white space after it: a stop after STRETCH characters without one.
CUT = rf"[.!?][\"')]{{0,2}}[ \t]++(?<=[^.!?\n]{{{STRETCH}}}[.!?][\"')]{{0,2}}[ \t]{{1,4}})"
#: A token with a digit in it; taken possessively from its start, so in constant time for each character.
VARIABLE = rf"(?<![^\s{MARK}])[^\s0-9{MARK}]*+[0-9][^\s{MARK}]*+"


def cut(text: Column) -> Column:
    """The text with a mark after each passage that ends within a line; without any, if it has marks of its own."""
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, " ")).otherwise(F.regexp_replace(text, CUT, f"$0{MARK}"))


def plain_spaces(text: Column) -> Column:
    """Blanks for all white space but line ends."""
    return F.when(text.rlike("[\t\r\f\x0b]"), F.translate(text, "\t\r\f\x0b", "    ")).otherwise(text)


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def key(short: Column | bool, *parts: Column) -> Column:
    short = F.lit(short) if isinstance(short, bool) else short
    return F.struct(F.xxhash64(short, *parts).alias("a"), F.hash(short, *parts).alias("b"), short.alias("short"))


def templates(line: Column, words: Column, single: Column) -> Column:
    """The templates (a, b, short) of a line with these tokens; that of all it holds only where the line is a ``single`` passage, else its passages stand for it."""
    n = F.size(words)
    width = F.ceil((n - LEAD) / THIRDS).cast("int")
    thirds = [key(False, F.lit(k), n, F.slice(words, F.lit(1), LEAD + (k - 1) * width), F.slice(words, LEAD + 1 + k * width, n)) for k in range(1, THIRDS + 1)]
    whole = key(n < LONG, F.trim(line))
    return F.when((n >= LONG) & single, F.array(whole, *thirds)).when(n >= LONG, F.array(*thirds)).otherwise(F.array(whole))


def parsed(docs: DataFrame, apart: bool) -> DataFrame:
    """Stored, for ``docs`` (id, text): ``id``, ``h``, a line's position ``i``, its templates ``ts``, and the template of each of its passages (null: too short, or the line is one passage).

    ``h`` tells texts of one id ``apart``, and is 0 where ids do not repeat.
    """

    def once(value: Column) -> Column:  # a row of its own for the value: several uses do not compute it again
        return F.explode(F.array(value))

    h = F.xxhash64("text") if apart else F.lit(0).cast("long")
    rows = docs.select("id", h.alias("h"), once(cut(plain_spaces(F.col("text")))).alias("t"))
    general = F.when(F.col("t").rlike("[0-9]"), F.regexp_replace("t", VARIABLE, "<*>")).otherwise(F.col("t"))
    rows = rows.select("id", "h", F.posexplode(F.split(general, "\n", -1)).alias("i", "line"))
    rows = rows.select("*", once(tokens(F.replace(F.col("line"), F.lit(MARK), F.lit("")))).alias("words")).filter(F.size("words") >= LEAST)
    several = F.contains("line", F.lit(MARK))
    passages = F.when(several, F.transform(F.split("line", MARK), lambda p: F.when(F.length(p) >= STRETCH, key(False, F.trim(p)))))
    return staged(rows.select("id", "h", "i", templates(F.col("line"), F.col("words"), ~several).alias("ts"), passages.alias("passages")), "line-templates")


def counted_once(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, bool]:
    """``id`` and ``text`` of each row with a text, repeated rows once; and whether ids repeat."""
    own = docs.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    repeated = staged(own.groupBy("id").count().filter("count > 1").select(F.col("id").alias("r")), "line-repeated")
    if repeated.isEmpty():
        return own, False
    same = own["id"].eqNullSafe(repeated["r"])
    return own.join(repeated, same, "left_anti").unionByName(own.join(repeated, same, "left_semi").dropDuplicates()), True


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """``id``, ``h`` and what to leave out of that document: positions ``i`` of lines, with ``j``, of passages in lines (null: the whole line); and whether ``h`` tells texts apart."""
    own, apart = counted_once(docs, id_col, text)
    rows = parsed(own, apart)
    # a line's own templates, then its passages'
    whole = rows.select("id", "h", "i", F.lit(None).cast("int").alias("j"), F.explode("ts").alias("t"))
    part = rows.filter("passages IS NOT NULL").select("id", "h", "i", F.posexplode("passages").alias("j", "t")).filter("t IS NOT NULL")
    every = whole.unionByName(part).select("id", "h", "i", "j", "t.a", "t.b", "t.short")
    # two documents have a template if one comes after the first, by id, then by text: no count is needed
    doc = F.when(F.col("id").isNotNull(), F.struct("id", "h") if apart else F.col("id"))
    found = every.filter("NOT short").groupBy("a", "b").agg(F.min(doc).alias("first"), F.max(doc).alias("last"), F.bool_or(F.col("id").isNull()).alias("nameless"))
    recurring = found.filter(F.col("first").isNotNull() & ((F.col("first") < F.col("last")) | F.col("nameless"))).select("a", "b", "first")
    counts = every.filter("short").select("a", "b", "id", "h").distinct().groupBy("a", "b").agg(F.min(doc).alias("first"), F.count("*").alias("docs"))
    recurring = recurring.unionByName(counts.filter(F.col("docs") >= SHORT_DOCS).select("a", "b", "first"))
    met = every.drop("short").join(recurring, ["a", "b"]).filter((F.col("first") < doc) | (F.col("id").isNull() & F.col("first").isNotNull()))
    return met.groupBy("id", "h").agg(F.collect_set(F.struct("i", "j")).alias("drop")), apart


def marked(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text deduplicated, and ``_n_lines``, ``_n_dropped`` (lines left out whole) and ``_n_cut`` (passages left out of others) added, in place of columns of these names."""
    added = ["_n_lines", "_n_dropped", "_n_cut"]
    own, key_id, key_h, drop = unused(docs, "own_h", "id", "h", "drop")
    drops, apart = dropped_lines(docs, id_col, text)
    drops = drops.toDF(key_id, key_h, drop).hint("shuffle_hash")
    both = docs.withColumn(own, F.xxhash64(text) if apart else F.lit(0).cast("long")).join(drops, F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(own) == F.col(key_h)), "left")
    # the lines and those that go, in a row of their own: what is done for each line does not cut the text again
    parts_of = F.struct(F.split(text, "\n", -1).alias("lines"), F.transform(F.filter(drop, lambda d: d["j"].isNull()), lambda d: d["i"]).alias("gone"))
    (cut_up,) = unused(both, "cut_up")
    both = both.select("*", F.explode(F.array(parts_of)).alias(cut_up))
    lines, gone = F.col(f"{cut_up}.lines"), F.col(f"{cut_up}.gone")

    def shortened(i: Column) -> Column:
        some = F.transform(F.filter(drop, lambda d: (d["i"] == i) & d["j"].isNotNull()), lambda d: d["j"])
        parts = F.split(cut(F.get(lines, i)), MARK)
        kept = F.filter(parts, lambda p, j: ~F.array_contains(some, j))
        return F.when(F.size(some) == 0, F.get(lines, i)).otherwise(F.rtrim(F.array_join(kept, "")))

    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    cleaned = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, shortened), "\n"))
    cuts = F.size(F.filter(drop, lambda d: d["j"].isNotNull() & ~F.array_contains(gone, d["i"])))
    return both.select(
        *(F.col(c) for c in docs.columns if c != text and c not in added),
        cleaned.alias(text),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(added[0]),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(added[1]),
        F.when(F.col(drop).isNull(), 0).otherwise(cuts).cast("long").alias(added[2]),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with repeated lines and passages left out; ``length`` names a column that holds the text's length in characters."""
    names = {c: unused(docs, c)[0] for c in docs.columns if c in ("_n_lines", "_n_dropped", "_n_cut")}  # own columns of these names are kept
    found = marked(docs.withColumnsRenamed(names), id_col, text)
    if length and length in docs.columns:
        size = F.when(F.col("_n_dropped") + F.col("_n_cut") > 0, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length))
        found = found.withColumn(length, size)
    return found.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))
