"""How units and periods are spelled, in one table, and the patterns for folded text that are made from it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Unit:
    label: str
    #: Dong per unit; None for what is no money.
    dong: float | None
    #: The unit's own words before the name of the currency.
    words: tuple[str, ...] = ()
    #: Words that stand for it only behind an announcement such as "dvt:".
    brief: tuple[str, ...] = ()
    #: Words that state it wherever they stand.
    plain: tuple[str, ...] = ()


#: From the largest; the first that a text states counts.
UNITS = (
    Unit("nghin_ty_dong", 1e12, words=("nghin ty", "ngan ty")),
    Unit("tram_ty_dong", 1e11, words=("tram ty",)),
    Unit("ty_dong", 1e9, words=("ty",), brief=("ty",), plain=("billion",)),
    Unit("trieu_dong", 1e6, words=("trieu", "tr"), brief=("tr",), plain=("million",)),
    Unit("nghin_dong", 1e3, words=("nghin", "ngan", "ng"), brief=("ng",), plain=("thousand",)),
    Unit("dong", 1.0),
    Unit("percent", None, plain=("phan tram", "%")),
    Unit("times", None, plain=("lan",)),
)
#: Names of the currency, and what announces a unit.
CURRENCY = ("dong", "vnd", "d")
ANNOUNCEMENTS = ("dvt", "don vi", "don vi tinh")
ASKING = "bao nhieu"
#: Shortened words, which questions don't use.
SHORTENED = ("tr", "ng")

BY_LABEL = {u.label: u for u in UNITS}
DIVISORS = tuple((u.label, u.dong) for u in reversed(UNITS) if u.dong)


def any_of(words: tuple[str, ...] | list[str]) -> str:
    return "(" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


def word(pattern: str) -> str:
    """pattern as whole words."""
    return rf"\b{pattern}\b"


def _stated(unit: Unit) -> str:
    """What states a unit of money in a title, a head or the lines before a table."""
    if not unit.words:
        return word(any_of([c for c in CURRENCY if len(c) > 1]))
    ways = [word(any_of(unit.words) + r"\s*" + any_of(CURRENCY)), word(any_of(ANNOUNCEMENTS) + r"\s*:\s*" + any_of(unit.brief) + rf"(\s*{any_of(CURRENCY)})?")]
    ways += [word(any_of(unit.plain))]
    if unit.dong == 1e3:
        ways.append(word(r"vnd[\s']*000"))
    return "|".join(ways)


def _asked(unit: Unit) -> str:
    """What asks for a unit in a question."""
    spelled = any_of([w for w in unit.words if w not in SHORTENED])
    if unit.dong is None:
        letters = [w for w in unit.plain if w.isascii() and w.replace(" ", "").isalpha()]
        return "|".join([word(any_of(letters)), *(w for w in unit.plain if w not in letters)])
    if unit.dong == 1.0:
        return "|".join(word(rf"{any_of(before)}\s+dong") for before in ((ASKING,), ("tinh bang", "bang", "don vi"))) + "|" + word(any_of(("vnd", "viet nam dong")))
    if " " in unit.words[0]:  # two words of number are a unit by themselves
        return word(spelled)
    return word(rf"{spelled}\s*dong") + "|" + word(rf"{ASKING}\s+{spelled}")


#: (pattern, unit) in the order in which they are tried.
STATED = tuple((_stated(u), u.label) for u in UNITS if u.dong and u.dong <= 1e9)
#: A question for a multiple may name a unit besides, so its plain forms are asked first and the bare word last.
ASKED = (
    (word(rf"{ASKING}\s+lan") + "|" + word("he so") + ".*" + word("lan"), "times"),
    (_asked(BY_LABEL["percent"]), "percent"),
    *((_asked(u), u.label) for u in UNITS if u.dong),
    (_asked(BY_LABEL["times"]), "times"),
)

#: Words for the start and the end of a year or period, and for this and the one before.
SPAN = ("nam", "ky")
EDGES = (("dau", "opening", -1), ("cuoi", "closing", 0))
BEFORE, NOW = (("truoc",), ("ngoai",)), (("nay",), ("hien tai",))


def _of_span(which: tuple[tuple[str, ...], tuple[str, ...]]) -> str:
    """Of a year or a period, or of a year only."""
    either, year = which
    return word(any_of(SPAN) + r"\s+" + any_of(either)) + "|" + word(rf"{SPAN[0]}\s+" + any_of(year))


#: (pattern, years from that of the report, period) of heads without a year.
WORD_PERIODS = (
    *((word(rf"{edge}\s+{any_of(SPAN)}"), shift, period) for edge, period, shift in EDGES),
    (_of_span(BEFORE), -1, "annual"),
    (_of_span(NOW), 0, "annual"),
)
#: Words, folded, of texts that are remarks and not heads of columns.
REMARKS = (
    "bctc", "bao cao", "kiem toan", "bo nhiem", "nghi quyet", "thong tu", "quyet dinh", "giay chung nhan", "hop dong", "nhiem ky", "dai hoi", "mau so", "tu ngay", "den ngay",
    "duoc bau", "cap ngay", "so huu",
)
