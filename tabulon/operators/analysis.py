"""Terms and names in questions: the longest first, none within another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.lookalikes import fold
from tabulon.functions.text import fold as fold_column

#: Terms that one automaton holds; a longer list is given in parts, each of them found by itself.
MOST_TERMS = 100_000

SPANS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))

_automata: dict[tuple, object] = {}


def _automaton(terms: tuple[tuple[str, str], ...]):
    """Of (folded surface, key); built once per Python worker."""
    if terms not in _automata:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for surface, key in terms:
            if surface not in machine:
                machine.add_word(surface, (surface, key))
        machine.make_automaton()
        _automata[terms] = machine
    return _automata[terms]


def spans(text: str | None, terms: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int]]:
    """(key, start, length) in the folded text: whole words, longest first, each surface at its first free place, in order of place."""
    return _spans(text, _automaton(terms)) if terms else []


def _spans(text: str | None, machine) -> list[tuple[str, int, int]]:
    if not text:
        return []
    folded = " ".join(fold(text).split())
    found = []
    for end, (surface, key) in machine.iter(folded):
        start = end - len(surface) + 1
        if (start and folded[start - 1].isalnum()) or folded[end + 1 : end + 2].isalnum():
            continue
        found.append((-len(surface), start, surface, key))
    taken: list[tuple[int, int]] = []
    seen: set[str] = set()
    out = []
    for negative, start, surface, key in sorted(found):
        end = start - negative
        if surface in seen or any(start < b and a < end for a, b in taken):
            continue
        seen.add(surface)
        taken.append((start, end))
        out.append((key, start, end - start))
    return sorted(out, key=lambda s: s[1])


def listed(terms: DataFrame, surface: str, key: str) -> tuple[tuple[str, str], ...]:
    """The folded terms of a list, on the driver; at most MOST_TERMS of them."""
    rows = terms.select(F.col(surface).alias("s"), F.col(key).alias("k")).where("s IS NOT NULL AND k IS NOT NULL").distinct().limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: give the list in parts")
    return tuple(sorted({(" ".join(fold(r["s"]).split()), r["k"]) for r in rows} - {("", r["k"]) for r in rows}))


def find_terms(text: Column, terms: tuple[tuple[str, str], ...]) -> Column:
    """spans() as a column."""
    return _finder(terms)(text)


def _finder(terms: tuple[tuple[str, str], ...]):
    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        if not terms:
            return pd.Series([[] for _ in texts])
        machine = _automaton(terms)  # once for a batch: its key is the whole list
        known: dict[str | None, list] = {}
        for t in texts:
            if t not in known:
                known[t] = [{"key": k, "start": s, "length": n} for k, s, n in _spans(t, machine)]
        return pd.Series([known[t] for t in texts])

    return find


def metrics(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, metrics, needs_derived): the metrics of each question in the order of their places; whether any is derived."""
    names = listed(terms, "surface", "metric")
    derived = sorted({r["metric"] for r in terms.where("is_derived").select("metric").distinct().collect()})  # as many as the list at most
    found = questions.select("id", "question").dropDuplicates(["id"]).select("id", find_terms(F.col("question"), names).alias("s"))
    keys = F.array_distinct(F.transform("s", lambda s: s["key"]))
    return found.select("id", keys.alias("metrics"), F.exists(keys, lambda k: k.isin(*derived) if derived else F.lit(False)).alias("needs_derived"))


def expanded(question: Column, metric_names: Column, tickers: Column, years: Column) -> Column:
    """A question with the names of its metrics, its codes and its years behind it."""
    words = lambda a: F.array_join(F.coalesce(a, F.array().cast("array<string>")), " ")
    return F.trim(F.concat_ws(" ", question, F.replace(words(metric_names), F.lit("_"), F.lit(" ")), words(tickers), words(years.cast("array<string>"))))


def is_comparison(question: Column) -> Column:
    return fold_column(question).rlike("so voi|so sanh|cao hon|thap hon|chenh lech|hon kem")


def is_aggregate(question: Column) -> Column:
    return fold_column(question).rlike("tong|trung binh|binh quan|cao nhat|thap nhat|lon nhat")
