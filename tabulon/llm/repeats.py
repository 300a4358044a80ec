"""Text that the pages of a report repeat: a suffix array over the tokens of all its pages (problem 2).

The pages of one report are put behind each other as one stream of tokens, parted by marks that occur once, so that no
repeat runs across pages. In the suffix array of the stream the places that go on with the same tokens stand together;
where such a group spans pages, every place of it on a page behind the first begins a repeat. Two kinds of lines go if
repeats cover all of them but the number of their page: those at the edge of a page, covered by runs of SHORT tokens
or more (running headers and footers), and whole paragraphs covered by runs of LONG tokens or more. Unique runs,
everything where it stands first, and headings and items within a page are kept.

A report is the unit, however many there are of one company, so reports need no grouping and no shuffle.

Defined cases: null and empty texts stay as they are; a text without page markers is one page and repeats nothing;
lines of tables, fences and page markers are never boilerplate; very long texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np

#: The tokens that a repeat has at least: at the edge of a page, and within it.
SHORT, LONG = 5, 12
#: The filled lines that count as the edge of a page.
EDGE = 2

_TOKEN = re.compile(r"\w+|[^\w\s]")
_MARKER = re.compile(r"^=+\s*PAGE\s+(\S+)\s*=+\s*$")
_ITEM = re.compile(r"^\s*(?:[-+*•#]|\d{1,3}[.)]|[a-zđ]\))")
_FENCE = re.compile(r"^\s{0,3}(?:```|~~~)")
_TABULAR = re.compile(r"<t|\||\t|\S {3,}\S")


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of a stream of numbers in their order, by doubling the length that is sorted by."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        steps = np.empty(n, np.int64)
        steps[0], steps[1:] = 0, ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(steps)
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


def repeats(tokens: np.ndarray, page: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether each token is covered by a run of at least `least` tokens that an earlier page holds too. page: its page; order: its suffix array; parting marks must occur once."""
    n = len(tokens)
    covered = np.zeros(n + 1, np.int64)
    order = order[order <= n - least]
    if len(order) < 2:
        return covered[:n] > 0
    same = np.ones(len(order) - 1, bool)
    for d in range(least):
        same &= tokens[order[:-1] + d] == tokens[order[1:] + d]
    group = np.concatenate([[0], np.cumsum(~same)])
    first = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, page[order])
    starts = order[page[order] > first[group]]
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + least, -1)
    return np.cumsum(covered)[:n] > 0


def boilerplate(text: str, short: int = SHORT, long: int = LONG) -> set[int]:
    """The numbers, from 0, of the lines of a text that only repeat what stands on an earlier page."""
    lines = text.split("\n")
    known: dict[str, int] = {}
    tokens: list[int] = []
    page: list[int] = []
    #: Of each line of prose: its place in the stream and the place of the number of its page, if it holds it once.
    of: dict[int, tuple[int, int, int]] = {}
    filled: dict[int, list[int]] = {}
    pages, number, fence = 0, "", False
    for i, line in enumerate(lines):
        marker = _MARKER.match(line)
        if marker:
            pages, number = pages + 1, marker.group(1)
        if _FENCE.match(line):
            fence = not fence
        if line.strip() and not marker:
            filled.setdefault(pages, []).append(i)
        if marker or fence or _FENCE.match(line) or _TABULAR.search(line):
            tokens.append(-len(tokens) - 1)  # a mark of its own
            page.append(pages)
            continue
        found = _TOKEN.findall(line)
        if found:
            at = len(tokens)
            of[i] = (at, at + len(found), at + found.index(number) if found.count(number) == 1 else -1)
            tokens += [known.setdefault(t, len(known)) for t in found]
            page += [pages] * len(found)
    if pages < 2 or len(tokens) < 2 * short:
        return set()
    stream, where = np.array(tokens, np.int64), np.array(page, np.int64)
    order = suffix_array(stream)
    at_edge, within = (repeats(stream, where, order, k) for k in (short, long))

    def gone(i: int, covered: np.ndarray) -> bool:
        a, b, own = of[i]
        return bool(covered[a:b].any()) and all(covered[k] or k == own for k in range(a, b))

    def apart(i: int) -> bool:
        """Whether a line looks like no part of a paragraph: it begins like a heading, ends like one, and the next doesn't go on with it."""
        line, below = lines[i].strip(), lines[i + 1].strip() if i + 1 < len(lines) else ""
        return not line[0].islower() and line[-1] not in ".,;" and not below[:1].islower()

    out = {i for own in filled.values() for i in (*own[:EDGE], *own[-EDGE:]) if i in of and apart(i) and gone(i, at_edge)}
    block: list[int] = []
    for i in range(len(lines) + 1):
        if i in of and not _ITEM.match(lines[i]):
            block.append(i)
            continue
        if block and sum(of[k][1] - of[k][0] for k in block) >= long and all(gone(k, within) for k in block):
            out.update(block)
        block = []
    return out


def without_boilerplate(text: str | None) -> str | None:
    """A text without the lines that only repeat an earlier page."""
    if not text or "PAGE" not in text:
        return text
    gone = boilerplate(text)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text
