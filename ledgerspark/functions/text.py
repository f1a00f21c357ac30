"""Text normalisation as column expressions; the three Arrow functions have no Spark equivalent."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Fixed values of the domain: legal suffixes that are written in capitals.
SUFFIXES = ("atm", "gb", "ltd", "plc", "uk")
# Fixed values of the domain: words and phrases that tell a role.
TRANSFER_WORDS = ("transfer", "xfer", "savings", "internal")
REFUND_WORDS = ("refund", "refunded", "reversal", "reversed", "chargeback")
REIMBURSEMENT_PHRASES = ("reimbursement", "reimbursed", "expense repayment", "expenses repayment")


@F.pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """NFKC, then full case folding."""
    return text.str.normalize("NFKC").str.casefold()


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full case folding."""
    return text.str.casefold()


@F.pandas_udf(DoubleType())
def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of matching characters by longest matching blocks, 0 to 1; a task keeps those of the last texts, which pairs of rows repeat."""
    from difflib import SequenceMatcher
    from functools import lru_cache

    ratio = lru_cache(1 << 16)(lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio())
    for left, right in batches:
        yield pd.Series(map(ratio, left.fillna(""), right.fillna("")), dtype="float64")


def clean(text: Column) -> Column:
    """Control characters become spaces, runs of white space one, ends trimmed."""
    odd = text.rlike("[^ -~]|  ")  # else there is nothing to replace
    return F.when(odd, F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{C}", " "), r"\s+", " "))).otherwise(F.trim(text))


def folded(text: Column, how=casefold) -> Column:
    """Case folding; only texts that aren't ASCII are sent to the Arrow function, the others are lower-cased in the JVM."""
    odd = text.rlike(r"[^\x00-\x7F]")
    return F.when(odd, how(F.when(odd, text))).otherwise(F.lower(text))


def plain_words(text: Column) -> Column:
    """ASCII words of the case-folded text, one space between: what roles and account names are told by."""
    return F.trim(F.regexp_replace(folded(text), "[^a-z0-9]+", " "))


def rule_text(text: Column) -> Column:
    """Letters and digits of any script after NFKC and case folding, all else as one space: what category rules compare."""
    return F.trim(F.regexp_replace(folded(text, nfkc_casefold), r"[^\p{L}\p{N}]+", " "))


@cache
def _word_class() -> str:
    """A character class of what becomes a letter or digit by NFKC and case folding: letters and digits, but for those that fold otherwise."""
    own = lambda c: unicodedata.category(c)[0] in "LN"
    more, less = [], []
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if unicodedata.category(c) in ("Cn", "Co", "Cs"):
            continue
        composed = unicodedata.normalize("NFKC", c)
        becomes = any(map(own, composed.casefold()))
        known = any(own(x) and not 0x1DF00 <= ord(x) < 0x1E000 for x in composed.casefold())  # Latin letters of Unicode 14 are unknown to older JVMs
        if becomes and (not own(c) or (composed != c and known)):  # a letter that the JVM may not know counts if it knows what that becomes
            more.append(ord(c))
        elif own(c) and not becomes:
            less.append(ord(c))
    return rf"[\p{{L}}\p{{N}}{_ranges(more)}&&[^{_ranges(less)}]]" if less else rf"[\p{{L}}\p{{N}}{_ranges(more)}]"


def _ranges(codes: list[int]) -> str:
    """Ascending code points as ranges of a character class: few, as each costs a level of the JVM's stack."""
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))


def has_rule_text(text: Column) -> Column:
    """Whether ``rule_text`` leaves anything of a text; asked without the Arrow function, a character at a time. False for null."""
    return F.coalesce(text.rlike("[A-Za-z0-9]") | text.rlike(_word_class()), F.lit(False))


def matching(text: Column) -> Column:
    """Case-folded words, all that isn't a word character as one space: what duplicates compare."""
    return F.trim(F.regexp_replace(folded(text), r"[^\p{L}\p{N}_]+", " "))


def merchant_name(text: Column) -> Column:
    """Punctuation but & ' - goes; words are capitalised, legal suffixes in capitals."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s&'-]", " "), r"\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(*SUFFIXES), F.upper(w)).otherwise(F.initcap(w))), " ")


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase's words stand in the text as whole words; both normalised to single spaces."""
    return (F.length(phrase) > 0) & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(plain_words(text), " "), F.array(*map(F.lit, words)))


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of canonical JSON: keys sorted, nulls kept, no spaces."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)
