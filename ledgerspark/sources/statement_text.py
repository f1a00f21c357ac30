"""Statement text, from a digital page or from recognised words: period, balances and lines, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.money import once, parse_amount, parse_date
from ledgerspark.functions.normalise import normalise
from ledgerspark.sources.csv_statements import ALIASES

_DATE = r"([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4})"


def words_to_lines(words: DataFrame) -> DataFrame:
    """Recognised words (page, block, paragraph, line, position, text, confidence) to lines with their mean confidence."""
    grouped = words.groupBy("page", "block", "paragraph", "line").agg(
        F.array_sort(F.collect_list(F.struct("position", "text"))).alias("w"), F.avg("confidence").alias("confidence"), F.count("*").alias("words")
    )
    return grouped.withColumn("text", F.array_join(F.col("w.text"), " ")).drop("w")


def period(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Start and end of the statement's period, where the text states both."""
    flat = F.regexp_replace(F.col(text), r"\s+", " ")
    pattern = rf"(?i)(?:statement )?period:? (?:from )?{_DATE} (?:to|-|until) {_DATE}"
    return pages.select(key, parse_date(F.regexp_extract(flat, pattern, 1)).alias("start_date"), parse_date(F.regexp_extract(flat, pattern, 2)).alias("end_date"))


#: A line that states a balance.
_BALANCE = r"(?i)\b(opening|closing)\s+balance\s*:?\s*(.+?)\s*$"


def balance_lines(lines: DataFrame, key: str, page: str, text: str = "text") -> DataFrame:
    """Every line (``key``, ``page``, ``line_number``, ``text``, perhaps ``confidence``) that states a balance, with its ``amount`` or the ``issue`` that it can't be read."""
    lines = lines.filter(F.contains(F.lower(text), F.lit("balance")))  # few lines are worth the patterns
    trimmed = F.trim(text)
    kind, raw = F.lower(F.regexp_extract(trimmed, _BALANCE, 1)), F.regexp_extract(trimmed, _BALANCE, 2)
    more = [c for c in ("confidence",) if c in lines.columns]
    found = lines.select(key, page, "line_number", *more, kind.alias("kind"), raw.alias("raw_amount"), trimmed.alias("raw")).filter("kind <> ''").withColumn("amount", parse_amount(F.col("raw_amount")))
    return found.withColumn("issue", F.when(F.col("amount").isNull(), F.concat(F.lit("invalid_"), "kind", F.lit("_balance"))))


def stated_balances(evidence: DataFrame, key: str, *order: str) -> DataFrame:
    """Opening and closing balance of each document: the last of its ``balance_lines`` of that kind that can be read."""
    of = lambda k, c: F.when((F.col("kind") == k) & F.col("amount").isNotNull(), c)
    return evidence.groupBy(key).agg(*(F.max_by(of(k, F.col("amount")), of(k, F.struct(*order))).alias(f"{k}_balance") for k in ("opening", "closing")))


def summed_balances(evidence: DataFrame, key: str, *order: str) -> DataFrame:
    """``stated_balances`` with what their lines prove: ``balance_lines``, ``unread_balances``, and the different balances read (``proven``), in one pass."""
    of = lambda k, c: F.when((F.col("kind") == k) & F.col("amount").isNotNull(), c)
    last = [F.max_by(of(k, F.col("amount")), of(k, F.struct(*order))).alias(f"{k}_balance") for k in ("opening", "closing")] if order else []
    read = F.when(F.col("amount").isNotNull(), F.struct("kind", F.col("amount").cast("decimal(18,2)").alias("amount")))
    return evidence.groupBy(key).agg(*last, F.count("*").alias("balance_lines"), F.count("issue").alias("unread_balances"), F.collect_set(read).alias("proven"))


def balances(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Opening and closing balance of each text that states one: the last line of its kind that can be read wins."""
    lines = pages.select(key, F.lit(1).alias("_page"), F.posexplode(F.split(text, "\n")).alias("line_number", "_line"))
    return stated_balances(balance_lines(lines, key, "_page", "_line").filter("amount IS NOT NULL"), key, "line_number")


def rows(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Movements: lines that begin with a date and split, at pipes or wide gaps, into date, description, amount and perhaps a balance."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n")).alias("line_number", "line"))
    parts = F.split(F.trim("line"), r"\s*\|\s*|\s{2,}")
    cut = lines.withColumn("parts", parts).filter(F.size("parts").between(3, 4) & parse_date(F.col("parts")[0]).isNotNull())
    return cut.select(key, "line_number", parse_date(F.col("parts")[0]).alias("txn_date"), F.col("parts")[1].alias("description"), parse_amount(F.col("parts")[2]).alias("amount"), parse_amount(F.get("parts", F.lit(3))).alias("balance"))


#: A page number alone on a line.
_PAGE = r"(?i)^(?:page\s+)?\d+(?:\s*(?:of|/)\s*\d+)?$"
_MONEY = ("amount", "debit", "credit", "balance")
#: A pipe with the blanks around it, however many; and the words that names of a date begin with.
_PIPE = r"(?:(?<! ) +)?\| *"
_HEADED = "|".join(sorted({name.split(" ")[0] for name in ALIASES["transaction_date"]}))


def _fields(parts: Column) -> Column:
    """The field of each cell by the headings' aliases, null for others; each field once."""
    known = F.create_map(*(F.lit(x) for field, names in ALIASES.items() for name in names for x in (name, field)))
    named = F.transform(parts, lambda c: F.try_element_at(known, F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))))
    return once(named, lambda each: F.transform(each, lambda f, i: F.when(F.array_position(each, f) == i + 1, f)))


def _heads() -> Column:
    """Whether ``fields`` name a date, a description, and an amount or a debit and a credit."""
    has = lambda f: F.array_contains(F.array_compact("fields"), f)
    return has("transaction_date") & has("description") & (has("amount") | (has("debit") & has("credit")))


def table_rows(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Movements of statement pages with a heading line: one row each, its cells as text by field, and its lines.

    A line is cut at pipes, else at gaps of two blanks. One whose cells name a date, a description, and
    an amount or a debit and a credit, is a heading; it holds until the page's next one. Headings repeated,
    page numbers and lines without description or amount are left out. A line with a description only
    continues the row before it. Lines before any heading count if they begin with a date and have three
    or four cells: date, description, amount, balance.

    ``key`` names a page. One window over a page's lines; nothing is collected but the lines of one row.
    """
    lines = pages.select(key, F.posexplode(F.split(text, "\r?\n")).alias("at", "line")).select(key, "at", F.trim("line").alias("line")).filter((F.col("line") != "") & ~F.col("line").rlike(_PAGE))
    parts = F.when(F.contains("line", F.lit("|")), F.split("line", _PIPE)).otherwise(F.filter(F.split("line", r"\s{2,}"), lambda c: c != ""))
    # only a line with a word that a date's name begins with is looked at as a heading
    cells = lines.select(key, "at", parts.alias("parts"), F.lower("line").rlike(_HEADED).alias("headed"))
    cells = cells.withColumn("fields", F.when(F.col("headed"), _fields(F.col("parts"))))
    cells = cells.withColumn("heads", F.col("headed") & _heads())
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("plan", F.last(F.when(F.col("heads"), _places(F.col("fields"))), ignorenulls=True).over(order)).filter("NOT heads")
    default = _places(F.array(*map(F.lit, ("transaction_date", "description", "amount", "balance"))))
    dated = F.size("parts").between(3, 4) & parse_date(F.get("parts", F.lit(0))).isNotNull()
    cells = cells.withColumn("plan", F.when(F.col("plan").isNull() & dated, default).otherwise(F.col("plan"))).filter("plan IS NOT NULL")
    cells = _by_field(cells, key).filter("description IS NOT NULL").filter(F.col("follows") | F.coalesce("amount", "debit", "credit").isNotNull())
    return _rows(cells, key)


def _places(fields: Column) -> Column:
    """The cell of each field, from 0; -1 for fields that are not named."""
    return F.struct(*((F.coalesce(F.array_position(fields, f), F.lit(0)).cast("int") - 1).alias(f) for f in ALIASES))


def _by_field(cells: DataFrame, key: str) -> DataFrame:
    """Cells (``parts``) under the headings in force (``plan``, from ``_places``) as a column for each field, and whether the line ``follows`` the row before: a description without date and money."""
    value = lambda f: F.nullif(F.get("parts", F.col(f"plan.{f}")), F.lit(""))
    # a row of its own for the values: what is used several times is not computed again
    named = cells.select(key, "at", F.explode(F.array(F.struct(*(value(f).alias(f) for f in ALIASES)))).alias("_v")).select(key, "at", "_v.*")
    money = F.coalesce(*_MONEY).isNotNull()
    return named.withColumn("follows", F.col("description").isNotNull() & F.col("transaction_date").isNull() & ~money)


def _rows(cells: DataFrame, key: str) -> DataFrame:
    """Rows with the lines that follow them joined, numbered within the page; a line before any row is left out."""
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("row_number", F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(order)).filter("row_number > 0")
    # each row has one line that doesn't follow, its first: it is given what the row's lines have, without grouping them anew
    row = Window.partitionBy(key, "row_number").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    text_of = F.nullif(F.array_join(F.collect_list("description").over(row), "\n"), F.lit("")).alias("description")
    first = [F.first(f, ignorenulls=True).over(row).alias(f) for f in ALIASES if f != "description"]
    return cells.select(key, "row_number", text_of, *first, F.collect_list("at").over(row).alias("lines"), "follows").filter("NOT follows").drop("follows")


def grid_rows(pages: DataFrame, key: str, tables: str = "tables") -> DataFrame:
    """Movements of pages whose tables were recognised as grids: ``tables`` is an array of tables, each an array of rows of cells.

    A table's heading is its first row whose cells name a date, a description and money; what is above it, and a table without one,
    is left out, and so are headings repeated, page numbers and empty rows. Rows are cut or filled to the heading's width. A row with
    a description only continues the one before it, be it in the table before; any other row counts, and rows are numbered over the
    page's tables. Only a page's rows are ever together.
    """
    rows = pages.select(key, F.posexplode(tables).alias("table", "grid")).select(key, "table", F.posexplode("grid").alias("row", "raw"))
    parts = F.transform(F.coalesce("raw", F.array().cast("array<string>")), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    cells = rows.select(key, F.struct("table", "row").alias("at"), parts.alias("parts")).withColumn("fields", _fields(F.col("parts"))).withColumn("heads", _heads())
    order = Window.partitionBy(key, "at.table").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("plan", F.first(F.when(F.col("heads"), F.col("fields")), ignorenulls=True).over(order)).filter("plan IS NOT NULL AND NOT heads")
    cells = cells.withColumn("parts", F.slice("parts", F.lit(1), F.size("plan"))).withColumn("plan", _places(F.col("plan")))
    said = F.filter("parts", lambda c: c != "")
    return _rows(_by_field(cells.filter((F.size(said) > 0) & ~F.array_join(said, " ").rlike(_PAGE)), key), key)


def candidates(found: DataFrame, account: Column, currency: Column, key: str, *keep: str) -> DataFrame:
    """Rows of ``table_rows`` as ledger rows with the reason why one can't be read, keyed by page and row; with the columns of ``keep``."""
    named = found.withColumns({"source_id": F.concat_ws(":", F.col(key).cast("string"), F.col("row_number").cast("string")), "account_id": account, "account_currency": currency})
    return normalise(named, *keep)


def recognised_lines(found: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Rows of ``table_rows`` with the recognised line (``key``, ``line``, ``text``, ``confidence``) that holds their date: the first, else the one of the row's number; and each field's confidence and text."""
    said = lines.select(key, "line", F.lower("text").alias("_text"), "confidence")
    own = found.select(key, "row_number", F.lower("transaction_date").alias("_date"), F.struct(*found.columns).alias("_row"))
    held = own.join(said, key, "left")  # lines of one page
    match = F.contains(F.col("_text"), F.col("_date"))
    order = F.struct(F.when(match, 0).otherwise(1), F.when(match, F.col("line")).otherwise(F.abs(F.col("line") - F.col("row_number"))), "line")
    # a row comes with its best line: it is not made again to be joined with it
    best = held.groupBy(key, "row_number").agg(F.first("_row").alias("_row"), F.min_by(F.struct("line", "confidence"), order).alias("m")).select("_row.*", "m")
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col("m.confidence").alias("confidence"), v.alias("value")) for f, v in (("transaction_date", F.col("transaction_date")), ("description", F.col("description")), ("amount", F.coalesce("amount", "debit", "credit")), ("balance_after", F.col("balance")))))
    return best.select(*found.columns, F.col("m.line").alias("line"), F.filter(each, lambda x: x["value"].isNotNull()).alias("confidences"))


def review_reasons(rows: DataFrame, source: Column | None = None, least: float = 0.85) -> DataFrame:
    """``reasons`` for review: ``extraction_error`` where the row can't be read, ``low_ocr_confidence`` where a field of a recognised page is below ``least``.

    ``source``: the kind of document, where not all were recognised; only ``ocr_pdf`` has confidences that count.
    """
    low = F.exists("confidences", lambda c: c["confidence"] < least) & (F.lit(True) if source is None else source == "ocr_pdf")
    return rows.withColumn("reasons", F.array_compact(F.array(F.when(F.col("error").isNotNull(), "extraction_error"), F.when(low, "low_ocr_confidence"))))


def balance_evidence(pages: DataFrame, key: str, page: str, text: str = "text") -> DataFrame:
    """Opening and closing balance of each document with the page and line that states it, the last of its kind."""
    lines = pages.select(key, page, F.posexplode(F.split(text, "\n")).alias("at", "_line")).select(key, page, (F.col("at") + 1).alias("line_number"), "_line")
    last = F.max(F.struct(F.col(page).alias("page"), "line_number", "amount", "raw")).alias("e")
    return balance_lines(lines, key, page, "_line").filter("amount IS NOT NULL").groupBy(key, "kind").agg(last).select(key, "kind", "e.*")
