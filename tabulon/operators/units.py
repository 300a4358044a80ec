"""Quantities recorded in different units, brought to common ones (problem 4).

One multi-pattern automaton holds all aliases of the units. It runs over folded text; the longest alias at a place
wins, and an alias counts only in the context of a statement of a unit: after a word that announces one, alone in
brackets, or beside a date in a column head. The unit found is joined with the broadcast table of factors.

Defined cases: null and empty texts state nothing; where several places state a unit, the first of title, context,
head and rows counts; a unit that the table of units lacks leaves the factor null; repeated records give one row;
very long texts are searched whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.lookalikes import fold
from tabulon.session import partitions

#: The ways of writing each unit, folded.
ALIASES = {
    "dong": ["dong", "d", "₫", "vnd", "vn dong", "dong viet nam", "viet nam dong", "vietnamese dong", "vietnam dong", "dong vn"],
    "nghin_dong": [
        "nghin dong", "ngan dong", "nghin vnd", "ngan vnd", "nghin d", "ngan d", "000 dong", "000 vnd", "000d", "000 d", "1.000 dong", "1.000d", "1.000 d", "1.000 vnd",
        "1,000 dong", "1,000 vnd", "1000 dong", "1000 vnd", "vnd'000", "vnd 000", "vnd000", "'000 vnd", "'000 dong", "vnd thousand", "thousand vnd", "thousand dong", "vnd thousands",
        "thousands of vnd", "k vnd", "nghin_dong", "nghin", "ngan", "thousand",
    ],
    "trieu_dong": [
        "trieu dong", "trieu vnd", "trieu d", "trd", "tr.d", "tr d", "tr. d", "tr dong", "1.000.000 dong", "1.000.000 vnd", "1.000.000d", "1,000,000 vnd", "million vnd", "vnd million",
        "million dong", "mn vnd", "vnd mn", "vnd m", "vnd millions", "millions of vnd", "m vnd", "trieu_dong", "trieu", "million",
    ],
    "ty_dong": [
        "ty dong", "ti dong", "ty vnd", "ti vnd", "ty d", "ti d", "1.000.000.000 dong", "billion vnd", "vnd billion", "billion dong", "bn vnd", "vnd bn", "vnd billions", "billions of vnd",
        "ty_dong", "ty", "ti", "billion",
    ],
    "tram_ty_dong": ["tram ty dong", "tram ti dong", "tram ty vnd", "tram ti vnd", "tram ty", "tram ti", "hundred billion vnd", "hundreds of billions of vnd", "vnd hundred billion", "hundred billion dong", "tram_ty_dong"],
    "nghin_ty_dong": [
        "nghin ty dong", "ngan ty dong", "nghin ti dong", "ngan ti dong", "nghin ty vnd", "ngan ty vnd", "nghin ti vnd", "ngan ti vnd", "nghin ty", "ngan ty", "nghin ti", "ngan ti",
        "trillion vnd", "vnd trillion", "trillion dong", "trn vnd", "vnd trn", "tn vnd", "trillions of vnd", "nghin_ty_dong", "trillion",
    ],
    "percent": ["%", "percent", "phan tram", "per cent", "pct", "percentage points", "percent points", "diem phan tram"],
    "times": ["times", "lan", "x", "a multiple"],
}
#: Those that amounts of a table can have.
MONEY = {u: a for u, a in ALIASES.items() if u not in ("percent", "times")}
#: Words that announce a unit, folded.
ANNOUNCED = re.compile(
    r"(?:don vi tinh|don vi tien|don vi|dvt|units?|currency|trinh bay theo|tinh theo|tinh bang|bao nhieu|bang may|la may|dat may|\bmay|expressed in|stated in|amounts in|figures in|measured in|[,(]\s*in|\bin)"
    r"\s*[:=(\[–-]*\s*(?:la\s+|theo\s+)?$"
)
#: Heads, folded, of columns that hold no amounts.
NO_AMOUNTS = r"\b(ma|ma so|code|stt|thuyet minh|note|notes|chi tieu|khoan muc)\b"
_DATE = re.compile(r"(?:\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|(?:19|20)\d\d)\s*[-–:(\[,]*\s*$")

#: (aliases, automaton) of the tables of aliases in use, told apart by identity.
_automata: list[tuple[dict, object]] = []


def automaton(aliases: dict[str, list[str]]):
    """The automaton of a table of aliases, built once per Python worker."""
    for known, machine in _automata:
        if known is aliases:
            return machine
    import ahocorasick

    machine = ahocorasick.Automaton()
    for unit, names in aliases.items():
        for name in names:
            machine.add_word(name, (unit, len(name)))
    machine.make_automaton()
    _automata.append((aliases, machine))
    return machine


def _letter(c: str) -> bool:
    return c.isalnum()


def hits(text: str, aliases: dict[str, list[str]] = ALIASES) -> list[tuple[int, int, str]]:
    """(start, end, unit) of the aliases in folded text: whole words, the longest where they overlap."""
    found = []
    for end, (unit, n) in automaton(aliases).iter(text):
        start, end = end - n + 1, end + 1
        if start and _letter(text[start - 1]) and _letter(text[start]):
            continue
        if end < len(text) and _letter(text[end]) and _letter(text[end - 1]):
            continue
        if text[start].isdigit() and start > 1 and text[start - 1] in ".,'" and text[start - 2].isdigit():
            continue
        found.append((start, end, unit))
    found.sort(key=lambda h: (h[0] - h[1], h[0]))
    kept: list[tuple[int, int, str]] = []
    for h in found:
        if all(h[1] <= k[0] or h[0] >= k[1] for k in kept):
            kept.append(h)
    return sorted(kept)


def announced(text: str | None, aliases: dict[str, list[str]] = ALIASES) -> str | None:
    """The unit that a line of text states after a word that announces one; the last, if there are several."""
    if not text:
        return None
    unit = None
    for line in fold(text).split("\n"):
        for start, _, u in hits(line, aliases):
            if ANNOUNCED.search(line[:start]):
                unit = u
    return unit


def labelled(text: str | None, aliases: dict[str, list[str]] = ALIASES) -> str | None:
    """The unit that a title or a column head carries: alone in brackets, or at the end beside a date or alone in a line."""
    if not text:
        return None
    folded = fold(text).replace("\r", "\n")
    for start, end, unit in hits(folded, aliases):
        before, after = folded[:start].rstrip(" "), folded[end:].lstrip(" ")
        if before[-1:] in ("(", "[") and after[:1] in (")", "]"):
            return unit
        if after[:1] in ("", ")", "]", "\n") and (_DATE.search(before) or before.endswith("\n") or not before):
            return unit
    return announced(text, aliases)


def alone(text: str | None, aliases: dict[str, list[str]] = ALIASES) -> str | None:
    """The unit that a field names: its longest alias."""
    if not text:
        return None
    found = hits(fold(text).strip(), aliases)
    return max(found, key=lambda h: h[1] - h[0])[2] if found else None


def asked(question: str | None, aliases: dict[str, list[str]] = ALIASES) -> str | None:
    """The unit that a question asks for."""
    return announced(question, aliases)


def first_stated(title: str | None, context: str | None, heads: Iterable[str | None], rows: Iterable[str | None], own: str | None) -> str:
    """The unit of a table's amounts; `dong` if none is stated anywhere."""
    unit = labelled(title, MONEY) or announced(context, MONEY)
    for read, cells in ((labelled, heads), (announced, rows)):
        for cell in cells if unit is None and cells is not None else ():
            unit = read(cell, MONEY)
            if unit:
                break
    return unit or alone(own, MONEY) or "dong"


@F.pandas_udf(T.StringType())
def _asked(questions: pd.Series) -> pd.Series:
    return questions.map(asked, na_action="ignore")


@F.pandas_udf(T.StringType())
def _table_unit(title: pd.Series, context: pd.Series, heads: pd.Series, rows: pd.Series, own: pd.Series) -> pd.Series:
    return pd.Series([first_stated(*x) for x in zip(title, context, heads, rows, own, strict=True)], dtype=object)


def asked_unit(question: Column) -> Column:
    return _asked(question)


def table_unit(title: Column, context: Column, header_rows: Column, rows: Column, own: Column) -> Column:
    """The unit of a table, from its texts. Of the body only rows with one filled cell can state a unit for all."""
    filled = lambda row: F.filter(row, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    single = F.flatten(F.filter(F.transform(rows, filled), lambda r: F.size(r) == 1))
    return _table_unit(title, context, F.flatten(header_rows), single, own)


def with_factor(df: DataFrame, units: DataFrame, unit_col: str) -> DataFrame:
    """df with `factor` and `kind` of its unit. The table of units is fixed and tiny, so it is broadcast."""
    table = units.select(F.col("unit").alias("_unit"), "factor", "kind").dropDuplicates(["_unit"])
    return df.join(F.broadcast(table), df[unit_col] == table["_unit"], "left").drop("_unit")


def table_units(tables: DataFrame, units: DataFrame) -> DataFrame:
    """(table_ref, unit_scale, right_unit, factor, kind) of each table, once."""
    own = tables.select("table_ref", "unit_scale", "title", "context_before", "header_rows", "rows", "unit")
    once = own.repartition(partitions(own), "table_ref").dropDuplicates(["table_ref"])
    unit = table_unit(F.col("title"), F.col("context_before"), F.col("header_rows"), F.col("rows"), F.col("unit"))
    return with_factor(once.select("table_ref", "unit_scale", unit.alias("right_unit")), units, "right_unit")


def answer_units(answers: DataFrame, questions: DataFrame, units: DataFrame) -> DataFrame:
    """(answer_id, value, raw_value, right_unit, factor, common) of each answer, once; common is raw_value in the unit asked for."""
    wanted = questions.select(F.col("id").alias("question_id"), "question").dropDuplicates(["question_id"])
    wanted = wanted.select("question_id", asked_unit(F.col("question")).alias("right_unit"))
    once = answers.select("answer_id", "question_id", "value", "raw_value").dropDuplicates(["answer_id"])
    joined = with_factor(once.join(wanted, "question_id", "left"), units, "right_unit")
    return joined.select("answer_id", "value", "raw_value", "right_unit", "factor", (F.col("raw_value") / F.col("factor")).alias("common"))


def wrong_units(tables: DataFrame, answers: DataFrame, questions: DataFrame, units: DataFrame) -> DataFrame:
    """(source_table, record_key, unit) of the tables with a missing or wrong scale and the answers not in the unit asked for."""
    t = table_units(tables, units).where(F.col("unit_scale").isNull() | (F.col("unit_scale") != F.col("factor")))
    a = answer_units(answers, questions, units)
    a = a.where(F.col("right_unit").isNotNull() & F.coalesce(F.abs(F.col("value") - F.col("common")) > 0.01 + 1e-6, F.lit(True)))
    row = lambda source, key: (F.lit(source).alias("source_table"), F.col(key).cast("string").alias("record_key"), F.col("right_unit").alias("unit"))
    return t.select(*row("extracted_tables", "table_ref")).unionByName(a.select(*row("normalized_answers", "answer_id")))
