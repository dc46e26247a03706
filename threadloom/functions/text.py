"""Column expressions on text. White space follows ECMAScript (which has U+FEFF and U+00A0, and not U+0085)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Inside of a character class: the white space of ECMAScript.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Inside of a character class: white space and characters without a visible form.
INVISIBLE = r"\s\p{Z}\p{Cc}\p{Cf}\u034F\u115F\u1160\u17B4\u17B5\u180B-\u180E\u2800\u3164\uFE00-\uFE0F\uFFA0"


def strip(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def fold(text: Column) -> Column:
    """Trimmed and in lower case: how identifiers and roles are compared."""
    return F.lower(strip(text))


def has_visible(text: Column) -> Column:
    """Whether there is a character other than white space and invisible ones; false for null."""
    return F.coalesce(text.rlike(f"[^{INVISIBLE}]"), F.lit(False))


def normalize_tag(tag: Column) -> Column:
    """Trimmed, lower case, runs of Unicode white space become one hyphen, hyphens at the ends dropped."""
    joined = F.regexp_replace(F.lower(tag), f"[{SPACE}\\u0085\\p{{Z}}]+", "-")
    return F.regexp_replace(joined, "^-+|-+$", "")


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfc(text: Column) -> Column:
    """Canonical composition. Spark has no built-in for it, so this is a pandas UDF."""
    return _nfc(text)


def nfkc(text: Column) -> Column:
    return _nfkc(text)


def normalize_text(text: Column) -> Column:
    """Trimmed, runs of white space become one blank. Compose with ``nfc`` where the text may be decomposed."""
    return F.regexp_replace(strip(text), f"[{SPACE}]+", " ")


def utf16_slice(text: Column, size: int) -> Column:
    """The first ``size`` UTF-16 units: a character beyond the basic plane counts twice, and where only its first half
    would fit, U+FFFD stands for it, as it does when such a text is written."""
    wide = F.regexp_replace(text, "([\\x{10000}-\\x{10FFFF}])", "$1\u0001")
    cut = F.regexp_replace(F.substring(wide, 1, size), "[\\x{10000}-\\x{10FFFF}]$", "\ufffd")
    return F.when(text.rlike("[\\x{10000}-\\x{10FFFF}]"), F.regexp_replace(cut, "([\\x{10000}-\\x{10FFFF}])\u0001", "$1")).otherwise(F.substring(text, 1, size))


def term_key(term: Column) -> Column:
    """How two spellings of a term are held equal: lower case, hyphens and white space as one blank."""
    return strip(F.regexp_replace(F.lower(normalize_text(term)), f"[-{SPACE}]+", " "))


def normalize_topic(topic: Column) -> Column:
    return strip(F.regexp_replace(F.lower(topic), f"[{SPACE}_-]+", " "))


def latin_tokens(text: Column) -> Column:
    """Latin tokens in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_-]*"), F.lit(0))


def han_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{IsHan}+"), F.lit(0))


def tokenize(text: Column) -> Column:
    """Latin tokens, then Han bigrams (runs of one or two characters stay whole); duplicates kept."""
    pairs = F.transform(
        han_runs(text),
        lambda run: F.when(F.length(run) <= 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))),
    )
    return F.concat(latin_tokens(text), F.flatten(pairs))


def lexical_terms(text: Column) -> Column:
    """Distinct Latin tokens and whole Han runs."""
    return F.array_distinct(F.concat(latin_tokens(text), han_runs(text)))


#: Words that never become a keyword.
KEYWORD_STOPS = ("the", "and", "for", "that", "this", "with", "have", "from", "我们", "这个", "一下", "可以", "就是")


def keywords(text: Column, stops: tuple[str, ...] = KEYWORD_STOPS, limit: int = 12) -> Column:
    """The first distinct words of three letters or more and Han chunks of two to eight characters."""
    latin = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0))
    han = F.regexp_extract_all(text, F.lit(r"\p{IsHan}{2,8}"), F.lit(0))
    words = F.concat(latin, han)
    if stops:
        words = F.filter(words, lambda w: ~w.isin(*stops))
    return F.slice(F.array_distinct(words), 1, limit)


def sha256_id(prefix: str, size: int, *parts: Column) -> Column:
    """``prefix`` and the first ``size`` hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, size))
