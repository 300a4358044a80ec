"""Text functions as JVM-side columns: folding of accents, tokens, phrases, slugs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tell nothing apart in questions about reports, folded.
STOPWORDS = (
    "la", "cua", "va", "cho", "voi", "trong", "tren", "duoi", "den", "tu", "bao", "nhieu", "the", "nao", "gi", "co", "khong", "nam", "cong", "ty",
    "hay", "hoac", "mot", "cac", "nhung", "duoc", "bi", "se", "da", "dang", "thi", "ma", "nay", "do", "vay", "ra", "vao", "ve", "boi",
)

_PRECOMPOSED = [c for c in map(chr, range(0xC0, 0x2B0)) if unicodedata.normalize("NFD", c) != c] + [
    c for c in map(chr, range(0x1E00, 0x1F00)) if unicodedata.normalize("NFD", c) != c
]
_FROM = "đĐ" + "".join(_PRECOMPOSED)
_TO = "dD" + "".join(next(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)) for c in _PRECOMPOSED)


def strip_accents(text: Column) -> Column:
    """Letters without marks; đ as d."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{Mn}", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def fold(text: Column) -> Column:
    """Lower case, no accents, single spaces."""
    return squeeze(F.lower(strip_accents(text)))


def fold_keeping_space(text: Column) -> Column:
    return F.lower(strip_accents(text))


def tokens(text: Column, remove_stopwords: bool = True) -> Column:
    """The folded words of a text, in order, repeated ones kept."""
    # A set is looked up once for each word; with the empty word among the stopwords one filter does both.
    dropped = ["", *STOPWORDS] if remove_stopwords else [""]
    return F.filter(F.split(fold(text), "[^0-9a-z]+"), lambda w: ~w.isin(*dropped))


def ngrams(words: Column, n: int, least: int = 0) -> Column:
    """Runs of n adjacent words joined by spaces, of at least so many letters."""
    pick = lambda i: F.array_join(F.slice(words, i, n), " ")
    runs = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), pick)).otherwise(F.array().cast("array<string>"))
    return F.filter(runs, lambda p: F.length(p) >= least)


def phrases(text: Column) -> Column:
    """Word pairs of 5 letters or more, then triples of 8 or more."""
    words = tokens(text)
    return F.concat(ngrams(words, 2, 5), ngrams(words, 3, 8))


def slug(text: Column, most: int = 80) -> Column:
    """A name for a file: folded words joined by underscores."""
    joined = F.regexp_replace(F.regexp_replace(fold(text), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(joined, 1, most), F.lit("")), F.lit("untitled"))


def column_spaces(text: Column) -> Column:
    """Runs of spaces and tabs as two spaces, the mark between columns."""
    return F.regexp_replace(text, "[ \t]{2,}", "  ")


def safe_name(doc: Column, position: Column) -> Column:
    """The file name of a table."""
    plain = F.regexp_replace(F.regexp_replace(doc, "[^0-9A-Za-z._-]+", "_"), "^_+|_+$", "")
    return F.concat(plain, F.lit("_table_"), position.cast("string"), F.lit(".csv"))
