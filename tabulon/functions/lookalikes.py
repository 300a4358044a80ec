"""Characters that display like others, and the plain form they stand for."""

from __future__ import annotations

import re
import unicodedata

#: Greek, Cyrillic and Latin letters that display like a letter of the Vietnamese or English alphabet.
LETTERS = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν" "АВЕЅІЈКМНОРСТУХҮԌаеѕіјорсухһԁԛԝ" "ÐƉƖɑɡı",
        "ABEZHIKMNOPTYXoiv" "ABESIJKMHOPCTYXYGaesijopcyxhdqw" "ĐĐIagi",
        strict=True,
    )
)
#: Characters without width.
ZERO_WIDTH = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff"
#: Spaces of other widths.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Blocks whose compatibility form is what they display: ligatures, Roman numerals, letters of full or half width.
WIDTHS = [c for r in ((0xFB00, 0xFB07), (0x2160, 0x2180), (0xFF01, 0xFF5F), (0xFFE0, 0xFFE7)) for c in range(*r)]

#: Replacements that need no look at the neighbours.
SIMPLE = {ord(c): None for c in ZERO_WIDTH} | {ord(c): " " for c in SPACES} | {c: unicodedata.normalize("NFKC", chr(c)) for c in WIDTHS}


def _composing() -> set[int]:
    """Code points whose NFC quick check is not Yes, or that may move within a sequence."""
    out, second = set(), set()
    for c in range(0x80, 0x20000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if unicodedata.combining(ch) or unicodedata.normalize("NFC", ch) != ch:
            out.add(c)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and "<" not in parts[0]:
            second.add(int(parts[1], 16))
    return out | second | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))


def _class(points: set[int]) -> str:
    ordered, ranges = sorted(points), []
    for c in ordered:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_COMPOSING = _composing()
_UNSTABLE = _COMPOSING | set(SIMPLE) | set(map(ord, LETTERS))
UNSTABLE = re.compile(f"[{_class(_UNSTABLE)}]")
#: A run of letters, digits, marks and characters without width: the context within which a segment is judged.
_RUN = re.compile(f"[\\w{_class(_COMPOSING)}{_class(set(map(ord, ZERO_WIDTH)))}]+")
_LETTER_MAP = str.maketrans(LETTERS)
_LOOKALIKE = re.compile("[" + "".join(LETTERS) + "]")
_FOREIGN = re.compile("[\u0370-\u052f]")

#: A superset of the texts that hold an unstable character, as a pattern for the JVM.
JVM_UNSTABLE = r"[^\x{0}-\x{7e}\x{a1}-\x{ac}\x{ae}-\x{cf}\x{d1}-\x{130}\x{132}-\x{17f}\x{1a0}\x{1a1}\x{1af}\x{1b0}\x{1ea0}-\x{1ef9}]"


def _segment(run: str) -> str:
    run = run.translate(SIMPLE)
    if _LOOKALIKE.search(run):
        letters = run.translate(_LETTER_MAP)
        if not _FOREIGN.search(letters):  # else it is a foreign word and meant as one
            run = letters
    return unicodedata.normalize("NFC", run)


def _splice(match: re.Match) -> str:
    run = match.group()
    return _segment(run) if UNSTABLE.search(run) else run


def canonical(text: str) -> str:
    """text with precomposed letters, ordinary widths, plain spaces and no look-alikes; the rest as it is."""
    if text.isascii() or not UNSTABLE.search(text):
        return text
    text = _RUN.sub(_splice, text)
    if UNSTABLE.search(text):
        text = text.translate(SIMPLE)
    return text


_D = str.maketrans("đĐ", "dD")


def fold(text: str) -> str:
    """Canonical text in lower case and without accents."""
    text = canonical(text).translate(_D)
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
