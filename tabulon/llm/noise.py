"""Repair of text from scanned pages (problem 6).

1. Words, word pairs, forms with capitals inside and masked lines are counted over all documents and tables,
   pre-aggregated per partition. What has a relative frequency of at least SHARE forms the lexicon; that share bounds
   its size (1 / SHARE entries), whatever the length of the corpus, so it can be broadcast. Below 1.5 million words
   LEAST, not SHARE, decides.
2. For a word the candidates for its correction come from inverted lists of the lexicon: of visual shapes (letters
   that are misread for each other share a shape) and of character q-grams. Beside other words there are the word
   without stray signs or odd capitals, two words it may have been run together from, and the word it may be half of.
   One ranking of gradient-boosted trees chooses among all of them by counts of the word, the candidate and their
   neighbours; what it puts above even odds replaces the word, and nothing else calls a word noise, but for accents
   that no letter takes. It is trained on TRAINING contexts of the lexicon, distorted here, and on the corpus's own misreadings.
3. Cells that may hold numbers go through boosted trees of their own, trained on numbers and codes in both styles.
4. Boosted classifiers of lines and of pairs of lines. One tells a running header by the words and form of its line; it
   learns from where all lines stand, and what it says is weighed against where the line itself was met. In a table a
   shorter form of a header is one too. One tells for a line that ends in a break sign and the line after it whether
   they share a word. Page numbers and specks are patterns.

Defined cases: null and empty texts give nothing; tables, page markers, code and formulas are no prose and stay; a
line without words may only be specks or a page number; repeated documents are read once; an empty corpus has an
empty lexicon and only patterns that need none are found; very long texts are read whole.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.lookalikes import fold
from tabulon.llm.boosting import Boosted
from tabulon.llm.markup import Lexer

#: Words, pairs and lines rarer than this share of all are not in the lexicon: at most 500,000 entries of each are.
SHARE = 2e-6
#: Nor are those met less often than this.
LEAST = 3
#: Longer lines are counted where they open or close a page only: the inside of a page holds few of them twice.
HEADER = 100
#: Kinds of what the ranking chooses from: another word, the word without signs or odd capitals, two words run together, one word taken apart.
LETTERS, SIGNS, JOINED, SPLIT = range(4)
#: Contexts of the lexicon on which the ranking is trained.
TRAINING = 1500
#: Labelled rows, drawn from those of these contexts, that its trees are fitted to.
TRAINED_ROWS = 20_000

_MARKER = re.compile(r"^=+\s*PAGE\s+(\S+)\s*=+\s*$")
_TABULAR = re.compile(r"^\s*\|.*\|\s*$|\t.*\t|\S {3,}\S.* {3,}\S|<table\b")
_RULED = re.compile(r"^\s*\|?[-+:| ]*(?:--|-\+|-\|)[-+:| ]*\|?\s*$")
_WIKI = re.compile(r"^\s*:*\{\|")
_FORMULA = re.compile(r"\$\$.*?\$\$|\$[^$\n]*[\\^_=][^$\n]*\$|\\\(.*?\\\)|\\\[.*?\\\]|\\[a-zA-Z]+")
#: What stands for a formula while a paragraph is repaired: its place among the formulas of the page, between signs no text holds; the other sign where it has no space beside it.
_HELD = re.compile("(?: ?\ufdd1)?\ufdd0(\\d+)\ufdd0(?:\ufdd1 ?)?")
_ITEM = re.compile(r"^\s*(?:[-+*•]|\d{1,3}[.)]|[a-zđ]\)|#{1,6}|>)\s+")
_PUNCTUATION = ".,;:()[]{}\"'“”‘’«»!?…*+=<>–—-/%&"
_NUMBER = re.compile(r"^[\d.,%/:-]+$")
#: Signs at the end of a line that a word is broken with; only the first has other uses.
_BREAKS = ("-", "\xad", "\xac", "\u2010", "\u2011")
_STRAY = re.compile(r"[~^|¦]")
_MARK = re.compile("[\u0300-\u036f]")
_ODD_CASE = regex.compile(r"\p{Ll}\p{Lu}|\p{Lu}{2}\p{Ll}")

#: Letters and groups of letters that scanners take for each other, and their common shape.
_SHAPES = (
    ("|\\|", "n"), ("l-l", "h"), ("rn", "m"), ("ii", "u"), ("iı", "u"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("tl", "u"),
    ("0", "o"), ("1", "i"), ("l", "i"), ("|", "i"), ("!", "i"), ("9", "g"), ("q", "g"), ("5", "s"), ("8", "b"), ("6", "b"), ("e", "c"), ("3", "s"), ("2", "z"), ("7", "t"), ("4", "a"),
)


def shape(word: str, pairs: tuple[tuple[str, str], ...] = _SHAPES) -> str:
    """word without accents and stray signs, letters that are misread for each other made one."""
    word = _STRAY.sub("", fold(word))
    for a, b in pairs:
        if a in word:
            word = word.replace(a, b)
    return word


#: The same, read the other way round where two groups overlap.
_OTHERWISE = tuple(sorted(_SHAPES, key=lambda p: (len(p[0]) < 2, p[0] == "cl")))


def odd_case(chunk: str) -> bool:
    """Whether a chunk has capitals in places where a word has none."""
    return not (chunk.islower() or chunk.isupper() or chunk[1:].islower()) and bool(_ODD_CASE.search(chunk)) and not any(c.isdigit() for c in chunk)


def core(chunk: str) -> str:
    """The word of a run of signs between spaces: lower case, no punctuation around it, numbers as #."""
    word = chunk.strip(_PUNCTUATION).lower()
    if not word:
        return ""
    return "#" if word[0].isdigit() and _NUMBER.match(word) else word


class Page:
    """The lines of one document as prose segments with their places in the page."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        lexer = Lexer(text)
        self.prose: list[str | None] = []
        #: Lines of prose with formulas: their text with a placeholder for each.
        self.holding: dict[int, str] = {}
        self.formulas: list[str] = []
        for i, line in enumerate(self.lines):
            idle = not (lexer.fence or lexer.tag or lexer.comment or lexer.wiki or lexer.environments or lexer.display)
            if idle and ("|" in line or "\t" in line or "   " in line or "<t" in line or line.startswith("=====")) and (_TABULAR.search(line) or _MARKER.match(line)):
                if not _WIKI.match(line):
                    self.prose.append(None)
                    continue
            code, was = bool(lexer.fence), bool(lexer.environments)
            _, clean = lexer.line(line)
            if code or lexer.fence or clean is None or (was and "\\" in line) or lexer.display:
                self.prose.append(None)
            elif "\\" in clean or "$" in clean:
                self.prose.append(_FORMULA.sub(" ", clean))
                self.holding[i] = _FORMULA.sub(self._hold, clean)
            else:
                self.prose.append(None if _RULED.match(clean) else clean)
        self.number: list[str | None] = []
        #: Filled lines before and behind in the page.
        self.before: list[int] = []
        self.behind: list[int] = [0] * len(self.lines)
        page, filled = None, 0
        for line in self.lines:
            m = _MARKER.match(line)
            if m:
                page, filled = m.group(1), 0
            self.number.append(page)
            self.before.append(filled)
            filled += bool(line.strip()) and not m
        filled = 0
        for i in range(len(self.lines) - 1, -1, -1):
            if _MARKER.match(self.lines[i]):
                filled = 0
            else:
                self.behind[i] = filled
                filled += bool(self.lines[i].strip())
        self.paged = page is not None

    def _hold(self, m: re.Match) -> str:
        self.formulas.append(m.group())
        before, after = m.string[: m.start()][-1:], m.string[m.end() :][:1]
        lead, rest = " \ufdd1" if before.strip() else "", "\ufdd1 " if after.strip() else ""
        return f"{lead}\ufdd0{len(self.formulas) - 1}\ufdd0{rest}"

    def held(self, i: int) -> str | None:
        """The prose of a line, with placeholders for its formulas."""
        return self.holding.get(i, self.prose[i])

    def released(self, text: str) -> str:
        """text with its formulas in place of their placeholders."""
        return _HELD.sub(lambda m: self.formulas[int(m.group(1))], text) if self.formulas else text

    def segments(self, skip: set[int] = frozenset(), hold: bool = False) -> Iterator[list[tuple[int, str]]]:
        """Runs of lines of one paragraph: (line index, text). hold: with placeholders for formulas."""
        run: list[tuple[int, str]] = []
        for i, text in enumerate(self.prose):
            if i in skip or (text is None and _MARKER.match(self.lines[i])):
                continue
            if text is None or not text.strip():
                if run:
                    yield run
                run = []
                continue
            if hold:
                text = self.held(i)
            if _ITEM.match(text) or text.isupper():
                if run:
                    yield run
                run = []
            run.append((i, _ITEM.sub("", text)))
            if text.isupper():
                yield run
                run = []
        if run:
            yield run


_AMOUNT = re.compile(r"\b\d[\d.,%/:-]*(?!\w)")
_BULLETS = re.compile(r"\n\s*(?:[-+*•>]|#[.)]|#{1,6}|[a-zđ]\))\s+")


def _prose_chunks(text: str) -> list[str]:
    """What stands between the spaces of the prose of a text, with marks at the ends of its segments; enough for counting."""
    lines = [x for x in text.split("\n") if not ("|" in x or "\t" in x or "   " in x or "<t" in x or x.startswith("====="))]
    joined = _BULLETS.sub("\n\n", "\n".join(["", *(f"\n{x}\n" if x.isupper() else x for x in lines)]))
    return ["<s>", *_AMOUNT.sub("#", joined).replace("\n\n", " </s> <s> ").split(), "</s>"]


def _cores(raw: Counter, raw_pairs: Counter) -> tuple[Counter, Counter]:
    """Counts of words and of pairs of words, from those of what stands between spaces."""
    known = {c: core(c) if c not in ("<s>", "</s>") else c for c in raw}
    words, pairs = Counter(), Counter()
    for c, n in raw.items():
        words[known[c]] += n
    for (a, b), n in raw_pairs.items():
        a, b = known[a], known[b]
        if a and b and a != "</s>":
            pairs[a, b] += n
    words.pop("", None)
    return words, pairs


def statistics(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """(kind, key, n, first, last): counts of words, of forms with capitals inside, of pairs and of masked lines over all documents(text) and tables(rows).

    first and last count the lines that open or close a page (the last two lines count as closing it).
    """
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n", "first", "last"))])

    def batch_of(raw, raw_pairs, lines, first, last):
        words, pairs = _cores(raw, raw_pairs)
        rows = [("w", w, n, 0, 0) for w, n in words.items()] + [("p", f"{a} {b}", n, 0, 0) for (a, b), n in pairs.items()]
        forms: Counter = Counter()
        for c, n in raw.items():
            if odd_case(c):
                forms[c.strip(_PUNCTUATION)] += n
        rows += [("c", c, n, 0, 0) for c, n in forms.items() if c]
        rows += [("l", k, n, first[k], last[k]) for k, n in lines.items() if k]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        for c in (raw, raw_pairs, lines, first, last):
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), *(pa.array(c, pa.int64()) for c in columns[2:])], schema.names)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, raw_pairs, lines, first, last = Counter(), Counter(), Counter(), Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                chunks = _prose_chunks(text)
                raw.update(chunks)
                raw_pairs.update(zip(chunks, chunks[1:], strict=False))
                _count_lines(text, lines, first, last)
            if len(raw_pairs) > 1_000_000 or len(lines) > 500_000:
                yield batch_of(raw, raw_pairs, lines, first, last)
        yield batch_of(raw, raw_pairs, lines, first, last)

    def of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, raw_pairs = Counter(), Counter()
        for batch in batches:
            for cell, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunks = ["<s>", *_AMOUNT.sub("#", cell).split(), "</s>"]
                for c in chunks:
                    raw[c] += n
                for p in zip(chunks, chunks[1:], strict=False):
                    raw_pairs[p] += n
            if len(raw_pairs) > 1_000_000:
                yield batch_of(raw, raw_pairs, Counter(), Counter(), Counter())
        yield batch_of(raw, raw_pairs, Counter(), Counter(), Counter())

    texts = documents.select("text").where(F.col("text").isNotNull())
    # Cells recur far more often than lines, so equal ones are counted before they are taken apart.
    cells = tables.select(F.explode(F.flatten("rows")).alias("cell")).where(F.col("cell").rlike(r"\p{L}{2}")).groupBy("cell").agg(F.count("*").alias("n"))
    counted = texts.mapInArrow(of_texts, schema).unionByName(cells.mapInArrow(of_cells, schema))
    return counted.groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in ("n", "first", "last")))


_DIGITS = re.compile(r"\d+")
#: A part of a line between signs that stand alone or wide gaps.
_PART = re.compile(r"\s+[-–—|/]\s+|\s{3,}")
_CODE = re.compile(r"^[A-Za-z#~^|¦]{3,7}$")


def masked(line: str) -> str:
    """The form of a line in which running headers agree: numbers, codes and names masked."""
    return _mask(_DIGITS.sub("#", line))


def _mask(line: str) -> str:
    """Of each part of a line what stands from its second capital word to its last becomes one sign, a code another: names differ from report to report."""
    line = line.strip()
    if not line or line.isupper() or line.islower():
        return line
    out, at = [], 0
    for m in [*_PART.finditer(line), None]:
        part = line[at : m.start() if m else len(line)]
        words = part.split(" ")
        if len(words) == 1 and sum(map(str.isupper, part)) >= 2 and _CODE.match(part):
            out.append("@")
        else:
            capital = [i for i, w in enumerate(words) if i and w[:1].isupper()]
            out.append(" ".join([*words[: capital[0]], "@", *words[capital[-1] + 1 :]]) if capital else part)
        if m:
            out.append(m.group())
            at = m.end()
    return "".join(out)


#: Signs that no header ends with; lines with them, and those that begin with a small letter, are not counted.
_OPEN_ENDS = ".,;:"


def _count_lines(text: str, lines: Counter, first: Counter, last: Counter) -> None:
    """Count the short lines of paged texts, and those that open or close a page."""
    text = _DIGITS.sub("#", text)
    pages = text.split("\n===== PAGE ")
    if len(pages) == 1 and not text.startswith("===== PAGE "):
        return
    pages[1:] = ["\n" + p.partition("\n")[2] for p in pages[1:]]
    pages[0] = "\n" + pages[0].partition("\n")[2] if text.startswith("===== PAGE ") else ""
    for page in pages:
        filled = [s for s in page.split("\n") if s and not s.isspace()]
        n = len(filled)
        keys = [_mask(s) if s[-1] not in _OPEN_ENDS and not s[0].islower() and (len(s) <= HEADER or i == 0 or i >= n - 2) else "" for i, s in enumerate(filled)]
        lines.update(keys)
        if keys:
            first[keys[0]] += 1
            last.update(keys[-2:] if n > 2 else keys[1:])


class Lexicon:
    """What the corpus says about words, pairs of words and lines; the ranking of corrections."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], lines: dict[str, tuple[int, int, int]], forms: dict[str, int] | None = None):
        self.words, self.pairs, self.lines, self.forms = words, pairs, lines, forms or {}
        self.shape_of: dict[str, str] = {}
        self.shapes: dict[str, list[str]] = defaultdict(list)
        self.grams: dict[str, list[str]] = defaultdict(list)
        for w, n in words.items():
            if n >= LEAST and w.replace("'", "").replace("-", "").isalpha():
                s = self.shape_of[w] = shape(w)
                self.shapes[s].append(w)
                for g in _grams(s):
                    self.grams[g].append(w)
        self.found: dict[str, list[tuple[str, tuple]]] = {}
        self.judged: dict[tuple, tuple[str, int] | None] = {}
        self.doubtful: dict[str, bool] = {}
        self.apart: dict[tuple, str | None] = {}
        self.halved: dict[str, list[tuple[str, str, int]]] = {}
        self.headers: set[str] = set()
        #: What a word that was taken apart may leave: beginnings and ends of words far more frequent than they are.
        halves: dict[str, int] = defaultdict(int)
        for w, n in words.items():
            if n >= LEAST and _plain(w):
                for i in range(1, len(w)):
                    for half in (w[:i], w[i:]):
                        halves[half] = max(halves[half], n)
        self.halves = {h for h, n in halves.items() if words.get(h, 0) * 20 <= n}
        self.model: Boosted | None = None
        self.joins: Boosted | None = None
        self.numbers: Boosted | None = None
        self.furniture_model: Boosted | None = None
        #: In how many masked lines each word is met.
        self.common: Counter = Counter()

    def candidates(self, word: str) -> list[tuple[str, tuple]]:
        """(candidate, features of the two words alone) from the inverted lists; the word itself is none."""
        known = self.found.get(word)
        if known is not None:
            return known
        own = self.words.get(word, 0)
        s = shape(word)
        plain = _STRAY.sub("", word)
        out = []
        near = dict.fromkeys(self.shapes.get(s, ()))
        if "cli" in word:
            other = shape(word, _OTHERWISE)
            if other in self.shapes:
                s, near = other, dict.fromkeys(self.shapes[other])
        if len(s) >= 3:
            grams = _grams(s)
            votes: Counter = Counter()
            for g in grams:
                votes.update(self.grams.get(g, ()))
            enough = max(1, len(grams) - 2)  # one edit touches two grams at most
            for w, v in votes.items():
                if v >= enough and w not in near and self.words[w] >= 5 * own:
                    near[w] = None
        for w in near:
            n = self.words[w]
            if w == word or n < 5 * own:
                continue
            t = self.shape_of[w]
            edits = int(s != t)
            if edits and (len(s) < 4 or not _one_edit(s, t)):
                continue
            letters = _distance(plain, w, 3)
            accents = fold(plain) == fold(w)
            out.append((w, (math.log1p(own), math.log1p(n), edits, letters, float(accents), float(plain == w), float(any(c.isdigit() for c in word)), len(w))))
        if len(self.found) < 300_000:
            self.found[word] = out
        return out

    def pair(self, a: str, b: str) -> int:
        return self.pairs.get(f"{a} {b}", 0)

    def features(self, left: str, word: str, right: str, candidate: str, alone: tuple) -> tuple:
        """Of a word for a word: counts of both with their neighbours, and how far their letters are apart."""
        return self._row(alone, (self.pair(left, word), self.pair(word, right), self.pair(left, candidate), self.pair(candidate, right)), LETTERS, bool(_STRAY.search(word)))

    @staticmethod
    def _row(alone: tuple, near: tuple[int, int, int, int], kind: int, stray: bool, odd: bool = False) -> tuple:
        lw, wr, lc, cr = near
        low = min(lc, cr)
        log = math.log1p
        return (*alone, log(lw), log(wr), log(lc), log(cr), log(low) - log(min(lw, wr)), log(lc + cr) - log(lw + wr), float(kind), float(stray), float(odd))

    def proposals(self, left: str, chunk: str, word: str, right: str, beyond: str) -> list[tuple[str, int, tuple]]:
        """(text, kind, features) of all that could be meant: other words, the word without signs or with plain case, two words, or one word with the next."""
        out = []
        stray = bool(_STRAY.search(chunk)) and any(c.isalnum() for c in chunk) and not chunk.startswith("~/")
        odd = odd_case(chunk)
        if len(word) >= 2 and _plain(word):
            candidates = self.candidates(word)
            lw, wr = (self.pair(left, word), self.pair(word, right)) if candidates else (0, 0)
            for candidate, alone in candidates:
                lc, cr = self.pair(left, candidate), self.pair(candidate, right)
                # A known word stands where the neighbours are no more used to the other one.
                if alone[0] > 0 and lc + cr <= lw + wr and min(lc, cr) <= min(lw, wr) and not stray:
                    continue
                out.append((candidate, LETTERS, self._row(alone, (lw, wr, lc, cr), LETTERS, stray, odd)))
        if stray or odd:
            bare = _STRAY.sub("", word)
            own = self.forms.get(chunk.strip(_PUNCTUATION), 0) if odd else self.words.get(word, 0)
            n = self.words.get(bare, 0)
            alone = (math.log1p(own), math.log1p(n), 0, len(word) - len(bare), 1.0, 1.0, float(any(c.isdigit() for c in word)), len(bare))
            out.append((bare, SIGNS, self._row(alone, (0, 0, self.pair(left, bare), self.pair(bare, right)), SIGNS, stray, odd)))
        if len(word) >= 3 and _plain(word):
            n = self.words.get(word, 0)
            for a, b, c in self.parted(word):
                if c < n or not (self.pair(left, a) or self.pair(b, right)):
                    continue  # neither neighbour is used to the halves
                alone = (math.log1p(n), math.log1p(c), 0, 1, 1.0, 0.0, 0.0, len(word))
                out.append((f"{a} {b}", JOINED, self._row(alone, (self.pair(left, word), self.pair(word, right), self.pair(left, a), self.pair(b, right)), JOINED, stray, odd)))
        whole = self.whole(word, right)
        if whole and self.pair(left, whole) + self.pair(whole, beyond) and self.pair(word, right) <= self.words[whole]:
            alone = (math.log1p(self.pair(word, right)), math.log1p(self.words[whole]), 0, 1, 1.0, 0.0, 0.0, len(whole))
            out.append((whole, SPLIT, self._row(alone, (self.pair(left, word), self.pair(right, beyond), self.pair(left, whole), self.pair(whole, beyond)), SPLIT, stray, odd)))
        return out

    def best(self, left: str, chunk: str, word: str, right: str, beyond: str) -> tuple[str, int] | None:
        """(text, kind) of the proposal that the ranking puts first, if it is above even odds."""
        top, found = 0.0, None
        for text, kind, row in self.proposals(left, chunk, word, right, beyond):
            odds = self.model.score(row) if self.model else 1.0 if kind == SIGNS and row[-2] else row[-4] - 1
            if odds > top:
                top, found = odds, (text, kind)
        return found

    def parted(self, word: str) -> list[tuple[str, str, int]]:
        """(a, b, count) of the pairs of words that a word may have been run together from; where it is unknown, either half may be misread besides."""
        known = self.halved.get(word)
        if known is None:
            known = []
            unknown = not self.words.get(word, 0)
            for i in range(1, len(word)):
                a, b = word[:i], word[i:]
                if unknown:
                    a, b = self._alike(a), self._alike(b)
                if a in self.words and b in self.words and (c := self.pair(a, b)) >= LEAST:
                    known.append((a, b, c))
            if len(self.halved) < 300_000:
                self.halved[word] = known
        return known

    def whole(self, word: str, right: str) -> str | None:
        """The word that word and right may be halves of, or a word that looks like theirs where one of them is unknown."""
        key = (word, right)
        if key in self.apart:
            return self.apart[key]
        out = None
        if right not in ("#", "</s>") and _plain(word) and _plain(right):
            out = word + right
            if self.words.get(out, 0) < LEAST:
                out = self._alike(out) if word not in self.words or right not in self.words else None
            if out is not None and self.words.get(out, 0) < LEAST:
                out = None
        if len(self.apart) < 500_000:
            self.apart[key] = out
        return out

    def _alike(self, word: str) -> str:
        """word if it is in the lexicon, else the most frequent word of its shape, else itself."""
        if word in self.words or len(word) < 2:
            return word
        return max(self.shapes.get(shape(word), ()), key=self.words.get, default=word)

    def settled(self, word: str, right: str) -> bool:
        """Whether nothing at all is proposed for a word in lower case before right, whatever else stands around it."""
        known = self.doubtful.get(word)
        if known is None:
            known = len(word) >= 2 and _plain(word) and bool(self.candidates(word) or len(word) >= 3 and self.parted(word))
            if len(self.doubtful) < 500_000:
                self.doubtful[word] = known
        return not known and not self.whole(word, right)

    def verdict(self, left: str, chunk: str, word: str, right: str, beyond: str) -> tuple[str, int] | None:
        """best(), kept for contexts that recur."""
        plain = chunk.islower() or chunk[1:].islower()
        if plain and not _STRAY.search(chunk) and self.settled(word, right):
            return None
        key = (left, word if plain else chunk, right, beyond if self.whole(word, right) else "")
        if key in self.judged:
            return self.judged[key]
        found = self.best(left, chunk, word, right, beyond)
        if len(self.judged) < 500_000:
            self.judged[key] = found
        return found

    def train(self, seed: int = 7) -> None:
        """Fit the ranking on distorted and on clean contexts of the lexicon."""
        rng = random.Random(seed)
        after, before = defaultdict(list), defaultdict(list)
        for key, n in sorted(self.pairs.items()):
            a, b = key.split(" ", 1)
            if n >= LEAST:
                after[a].append((b, n))
                before[b].append((a, n))
        words = [w for w, n in sorted(self.words.items()) if n >= 2 * LEAST and w.isalpha() and len(w) >= 2 and w in after and w in before]
        if not words:
            return
        weights = [self.words[w] ** 0.5 for w in words]
        common = set(sorted(words, key=self.words.get)[len(words) // 3 :])
        rows, labels = [], []
        for w in rng.choices(words, weights, k=TRAINING):
            left = rng.choices(*zip(*before[w], strict=True))[0]
            right = rng.choices(*zip(*after[w], strict=True))[0]
            for candidate, alone in self.candidates(w):
                rows.append(self.features(left, w, right, candidate, alone))
                labels.append(0)
                rows.append(self.features("", w, right if rng.random() < 0.5 else "", candidate, alone))
                labels.append(0)
            if w not in common:
                continue
            bad = distort(w, rng)
            if bad == w or self.words.get(bad, 0) * 5 > self.words[w]:
                continue
            for candidate, alone in self.candidates(bad):
                rows.append(self.features(left, bad, right, candidate, alone))
                labels.append(int(candidate == w))
                # A neighbour may be misread too, and then says nothing.
                rows.append(self.features("", bad, right if rng.random() < 0.5 else "", candidate, alone))
                labels.append(int(candidate == w))
        # Misreadings that the corpus itself holds: as often as not between the neighbours of a word far more frequent there.
        own = [w for w in sorted(self.words) if w.isalpha() and len(w) >= 2 and w in after and w in before]
        for w in rng.sample(own, min(TRAINING, len(own))):
            for _ in range(3):
                left = rng.choices(*zip(*before[w], strict=True))[0]
                right = rng.choices(*zip(*after[w], strict=True))[0]
                for candidate, alone in self.candidates(w):
                    lw, wr, lc, cr = self.pair(left, w), self.pair(w, right), self.pair(left, candidate), self.pair(candidate, right)
                    if lc >= 10 * lw and cr >= 10 * wr and max(lc, cr) >= 3 * LEAST:
                        rows.append(self.features(left, w, right, candidate, alone))
                        labels.append(1)
                    elif lc < lw or cr < wr:
                        rows.append(self.features(left, w, right, candidate, alone))
                        labels.append(0)
        for texts, meant, kinds in self._other_lessons(rng, words, before, after):
            for text, kind, row in self.proposals(*texts):
                rows.append(row)
                labels.append(int(kind in kinds and (text == meant or meant is None)))
        if rows:
            kept = rng.sample(range(len(rows)), min(TRAINED_ROWS, len(rows)))
            self.model = Boosted(trees=40).fit(np.array([rows[k] for k in kept], float), np.array([labels[k] for k in kept], float))

    def _other_lessons(self, rng: random.Random, words: list[str], before: dict, after: dict) -> Iterator[tuple[tuple[str, str, str, str, str], str | None, tuple[int, ...]]]:
        """(left, chunk, word, right, beyond), the text that is meant (null: any), and the kinds of proposals that are right: words run together and taken apart here, with signs and capitals, and those that stand so in the corpus."""
        pick = lambda of: rng.choices(*zip(*of, strict=True))[0] if of else "</s>"

        def struck(w: str) -> str:
            k = rng.randrange(len(w) + 1)
            return w[:k] + rng.choice("~^|¦") + w[k:]

        def capital(w: str) -> str:
            k = rng.randrange(1, len(w))
            return w[:k] + w[k].upper() + w[k + 1 :]

        pairs = [k.split(" ", 1) for k, n in sorted(self.pairs.items()) if n >= 3 * LEAST and "<" not in k and "#" not in k]
        pairs = [(a, b) for a, b in pairs if a.isalpha() and b.isalpha()]
        weights = [self.words[w] ** 0.5 for w in words]
        for a, b in rng.choices(pairs, [self.pair(a, b) ** 0.5 for a, b in pairs], k=TRAINING // 2) if pairs else ():
            left, right, joined = pick(before.get(a)) if before.get(a) else "<s>", pick(after.get(b)), a + b
            if not self.words.get(joined):
                chunk = rng.choice((joined, joined, struck(joined), capital(joined), a + b.capitalize()))
                if odd_case(chunk) or not chunk[1:].isupper():
                    yield (left, chunk, core(chunk), right, pick(after.get(right))), (f"{a} {b}" if chunk.lower() == joined else None), (JOINED, SIGNS) if chunk != joined else (JOINED,)
            yield (left, a, a, b, right), "", ()  # two words that are two
        for w in rng.choices(words, weights, k=TRAINING):
            left, right = pick(before[w]), pick(after[w])
            beyond = pick(after.get(right))
            if len(w) >= 3:
                k = rng.randrange(1, len(w))
                a, b = w[:k], w[k:]
                if self.pair(a, b) * 20 <= self.words[w]:
                    yield (left, a, a, b, right), w, (SPLIT,)
                shown = capital(w)
                if odd_case(shown):
                    yield (left, shown, w, right, beyond), w, (SIGNS,)
            sign = struck(rng.choice((w, w, w.upper(), "".join(rng.choices("ABCDEGHIKLMNOPQRSTUVXY", k=4)))))
            yield (left, sign, core(sign), right, beyond), None, (SIGNS, LETTERS)
            yield (left, w, w, right, beyond), "", ()
        named = [(c, n) for c, n in sorted(self.forms.items()) if n >= 0.2 * self.words.get(core(c), 0)]
        for c, _ in rng.choices(named, [n for _, n in named], k=TRAINING // 4) if named else ():
            yield ("", c, core(c), "", ""), "", ()

    def pair_features(self, line: str, following: str) -> tuple:
        """What tells whether a line that ends in a break sign is joined to the next: the sign, and counts of the halves, of the whole and of the compound."""
        head = re.search(r"([^\W\d_]+)[^\w\s]$", _STRAY.sub("", line))
        tail = re.match(r"\s*([^\W\d_]+)", _STRAY.sub("", following))
        a, b = head.group(1).lower() if head else "", tail.group(1).lower() if tail else ""
        n = lambda w: math.log1p(self.words.get(w, 0)) if w else 0.0
        goes_on = bool(tail) and (tail.group(1)[0].islower() or bool(head) and head.group(1).isupper())
        near = bool(a and b) and not self.words.get(a + b) and bool(self.candidates(a + b))
        return (float(_BREAKS.index(line[-1])), n(a + b), n(f"{a}-{b}"), n(a), n(b), float(goes_on), float(near), float(len(a)), float(len(b)))

    def train_joins(self, seed: int = 11) -> None:
        """Fit the classifier of line pairs on words broken here and on compounds, names and ranges as they stand."""
        rng = random.Random(seed)
        words = [w for w, n in sorted(self.words.items()) if n >= LEAST and w.isalpha() and len(w) >= 2]
        compounds = [w.split("-", 1) for w, n in sorted(self.words.items()) if n >= LEAST and re.fullmatch(r"[^\W\d_]+-[^\W\d_]+", w)]
        if len(words) < 20:
            return
        rows, labels = [], []
        for w in rng.choices(words, [self.words[w] ** 0.5 for w in words], k=TRAINING):
            k = rng.randrange(1, len(w))
            bad = distort(w[k:], rng) if rng.random() < 0.1 and len(w) - k > 1 else w[k:]
            sign = rng.choice(_BREAKS)
            rows.append(self.pair_features(w[:k] + sign, bad))
            labels.append(1)
            a, b = rng.choice(words), rng.choice(words)
            if not self.words.get(a + b):
                rows.append(self.pair_features(a + "-", rng.choice((b, b.capitalize()))))
                labels.append(0)
            rows.append(self.pair_features(rng.choice(words) + "-", rng.choice(("", "2021", "– " + b))))
            labels.append(0)
        for a, b in rng.choices(compounds, k=TRAINING // 2) if compounds else ():
            rows.append(self.pair_features(a + "-", b))
            labels.append(0)
        self.joins = Boosted(trees=25, depth=4).fit(np.array(rows, float), np.array(labels, float))

    def furniture(self, page: Page, i: int) -> bool:
        """Whether a line is a running header or footer, a page number or scanner specks."""
        line = page.lines[i].strip()
        if not line or page.prose[i] is None and not _FOOT.match(line):
            return False
        if not line[0].isalnum() and not any(c.isalnum() for c in line):
            return bool(_SPECKS.match(line)) and line not in ("---", "***", "-", "*", "+")
        edge = page.paged and (page.before[i] == 0 or page.behind[i] <= 1)
        if line[0] in _NUMBERING and _NUMBERED.match(line):
            digits = re.findall(r"\d+|[ivxlc]+$", line.lower())
            if line.isdigit():
                return edge and len(line) <= 3 or line == page.number[i] and edge
            return bool(digits)
        if not edge or line[-1] in _OPEN_ENDS or line[0].islower():
            return False
        return masked(line) in self.headers

    def shortened(self, key: str) -> bool:
        """Whether a masked line has most words of a running header, in their order, and no others."""
        words = key.split()
        for header in self.headers:
            of = header.split()
            if len(words) >= 3 and SHORTER * len(of) <= len(words) < len(of):
                rest = iter(of)
                if all(w in rest for w in words):
                    return True
        return False

    def settle(self) -> None:
        """Which masked lines are running headers or footers.

        A classifier tells from the words and the form of a line alone how likely it stands at the edge of a page; it
        learns that from the places of all lines, which are no features of it. What it says of a line is then weighed
        against where that line was met: each place at an edge speaks for a header, each other one against.
        """
        keys = [k for k, (n, _, _) in sorted(self.lines.items()) if n >= LEAST and any(c.isalpha() for c in k)]
        if not keys:
            return
        counts = np.array([self.lines[k] for k in keys], float)
        share = np.minimum(1.0, counts[:, 1:].sum(1) / counts[:, 0])
        self.common = common = Counter(w for k in keys for w in set(k.lower().split()))
        rows = np.array([_line_features(k, common) for k in keys], float)
        self.furniture_model = model = Boosted(trees=30, depth=4, least=3).fit(rows, share)
        body = counts[share < 0.5]
        usual = min(max(body[:, 1:].sum() / max(body[:, 0].sum(), 1.0), 0.01), 0.5)  # how often other lines stand at an edge
        edge, inside = math.log(AT_EDGE / usual), math.log((1 - AT_EDGE) / (1 - usual))
        for k, row, (n, first, last) in zip(keys, rows, counts, strict=True):
            met = min(n, first + last)
            if model.score(row) + met * edge + (n - met) * inside > 0:
                self.headers.add(k)


#: How often a running header stands at the edge of its page; the rest is headers behind specks and other furniture.
AT_EDGE = 0.95
#: The share of the words of a header that a shorter form of it has.
SHORTER = 0.7


def _line_features(key: str, common: Counter) -> tuple:
    """The form of a masked line and how common its words are among lines; nothing of where it was met."""
    words = key.split()
    of = [common[w.lower()] for w in words]
    letters = sum(c.isalpha() for c in key)
    return (
        float(len(key)), float(len(words)), float(key[-1:] in ".,;:"), float(key.isupper()), float(key[:1].islower()), float("#" in key), float("@" in key), float(" - " in key or "|" in key),
        sum(w[:1].isupper() for w in words) / len(words), letters / len(key), math.log1p(min(of)), math.log1p(max(of)), sum(map(math.log1p, of)) / len(of),
    )


_FOOT = re.compile(r"^\S.*\S {3,}\d{1,4}$")
#: What a page number begins with.
_NUMBERING = frozenset("-–—[(0123456789tTpPiIvVxXlL")
_SPECKS = re.compile(r"^[\s~`'·¸|.,:^¦;\"°•_-]+$")
#: Ways of writing a page number.
_NUMBERED = re.compile(r"^(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|\(\s*\d{1,4}\s*\)|\d{1,4}|\d{1,4}\s*/\s*\d{1,4}|(?:trang|page|tr\.|p\.)\s*\d{1,4}(?:\s*(?:/|of|trên)\s*\d{1,4})?(?:\s*\|\s*\S+)?|[ivxl]{1,8})$", re.I)


def _plain(word: str) -> bool:
    """Whether word is one of a language and not a number, a path or a name of a file."""
    return word != "#" and not any(c in word for c in "_\\/@.")


def _grams(s: str) -> list[str]:
    s = f"^{s}$"
    return [s[i : i + 2] for i in range(len(s) - 1)]


def _one_edit(a: str, b: str) -> bool:
    """Whether two different words are one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    k, n = 0, min(len(a), len(b))
    while k < n and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _distance(a: str, b: str, most: int) -> int:
    """Edits between a and b, or most if there are as many or more."""
    if abs(len(a) - len(b)) >= most:
        return most
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (c != d))
        if min(row) >= most:
            return most
    return min(row[-1], most)


_TONES = "àáảãạ ằắẳẵặ ầấẩẫậ èéẻẽẹ ềếểễệ ìíỉĩị òóỏõọ ồốổỗộ ờớởỡợ ùúủũụ ừứửữự ỳýỷỹỵ".split()
_MISREAD = {"o": "0", "i": "1", "l": "1", "g": "9q", "s": "5", "b": "8", "c": "e", "e": "c", "q": "g", "m": ["rn"], "u": ["ii"], "h": ["li"], "n": ["ri"], "w": ["vv"], "d": ["cl"]}


def distort(word: str, rng: random.Random) -> str:
    """word as a scanner might misread it."""
    i = rng.randrange(len(word))
    kind = rng.random()
    if kind < 0.25:
        k = rng.randrange(len(word) + 1)
        return word[:k] + rng.choice("~^|¦") + word[k:]
    if kind < 0.6:
        places = [k for k, c in enumerate(word) if fold(c) in _MISREAD]
        if places:
            k = rng.choice(places)
            return word[:k] + rng.choice(_MISREAD[fold(word[k])]) + word[k + 1 :]
    for k in rng.sample(range(len(word)), len(word)):
        group = next((g for g in _TONES if word[k] in g), None)
        plain = fold(word[k])
        if group or plain != word[k]:
            return word[:k] + rng.choice([*(group or []), plain]) + word[k + 1 :]
    return word[:i] + word[i + 1 :] if len(word) > 3 else word


#: A number as it is printed, or a code.
_CLEAN = re.compile(r"^(?:[-+]?\(?[-+]?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?\)?%?|[-+]?\(?\d+(?:[.,]\d+)?\)?%?|\d{1,2}/\d{1,2}/\d{4}|[-–—]|n/a|)$")
_CODES = re.compile(r"^(?:\d{1,3}[a-z]|[A-Z]{1,4}\.?\d{1,3})$")
#: The plainest printed numbers, of which most cells consist.
_PRINTED = re.compile(r"^\(?\d{1,3}(?:[.,]\d{3})*\)?$|^[-–]$")
_NUMERIC = re.compile(r"^[(\[|'*~^¦-]*[\dOoQDlIiSsBZzg|.,~*^'¦%-]*[\d.,][\dOoQDlIiSsBZzg|.,~*^'¦%-]*[)\]|'*~^¦]*$")


#: The digits for which scanners read letters. An upright stroke is a 1 or a speck.
_DIGIT_OF = str.maketrans("OoQDlIiSsBZzgq", "00001115582299", "~*^'¦")
#: A number whose digits, if there are separators, stand in threes behind them.
_GROUPED = re.compile(r"^-?\(?-?\d{1,3}(?:(\D)\d{3}(?:\1\d{3})*)?\)?%?$")
_BROKEN = re.compile(r"\w[-\xad¬\u2010\u2011]\n")


def printed_number(cell: str) -> str:
    """A misread number as it was printed: digits for letters, no specks. A stroke is a 1, unless only without it the digits stand in threes."""
    text = cell.strip().translate(_DIGIT_OF)
    strokes = text.count("|")
    if not strokes:
        return text
    pieces, best = text.split("|"), None
    for n in range(2 ** min(strokes, 6)):
        new = pieces[0] + "".join(("" if n >> k & 1 else "1") + p for k, p in enumerate(pieces[1:]))
        if _GROUPED.match(new):
            return new
        if best is None or _CLEAN.match(new) and not _CLEAN.match(best):
            best = new
    return best


def number_features(cell: str, code_column: bool) -> tuple:
    """Of a cell that may hold a number: how it and its plain form look, and where it stands."""
    plain = printed_number(cell)
    letters = sum(c.isalpha() for c in cell)
    return (
        float(bool(_CLEAN.match(cell))), float(bool(_CLEAN.match(plain))), float(bool(_CODES.match(cell))), float(bool(_NUMERIC.match(cell))), float(bool(_GROUPED.match(plain))), float(code_column),
        float(letters), float(sum(c in "~^¦*'" for c in cell)), float(cell.count("|")), float(sum(c.isdigit() for c in cell)), float(len(cell)), float(cell[:1].isalpha()), float(cell[-1:].isalpha()),
        float(sum(c.isalpha() and c not in "OoQDlIiSsBZzgq" for c in cell)),
    )


def number_model(seed: int = 5) -> Boosted:
    """Which cells hold a misread number, learned from numbers and codes in both styles, printed and distorted here."""
    rng = random.Random(seed)
    swap = {"0": "OoQD", "1": "lIi|", "5": "Ss", "8": "B", "2": "Zz", "9": "g"}

    def number() -> str:
        n, dot = rng.choice((rng.randrange(10), rng.randrange(1000), rng.randrange(10**6), rng.randrange(10**9), rng.randrange(10**12))), rng.choice(".,")
        text = f"{n:,}".replace(",", dot)
        if rng.random() < 0.15:
            text += ("," if dot == "." else ".") + str(rng.randrange(100)).zfill(rng.choice((1, 2)))
        return rng.choice((text, text, text, f"({text})", f"-{text}", f"{text}%"))

    def code() -> str:
        return rng.choice((str(rng.randrange(1, 500)), str(rng.randrange(1, 500)), f"{rng.randrange(1, 400)}{rng.choice('abc')}", f"{rng.choice(('I', 'V', 'VI', 'X', 'III'))}.{rng.randrange(1, 40)}", f"{rng.choice('ABCDEV')}{rng.randrange(1, 99):02d}"))

    def spoilt(text: str) -> str:
        places = [k for k, c in enumerate(text) if c in swap]
        if places and rng.random() < 0.6:
            for k in rng.sample(places, rng.randrange(1, min(3, len(places)) + 1)):
                text = text[:k] + rng.choice(swap[text[k]]) + text[k + 1 :]
            return text
        k = rng.randrange(len(text) + 1)
        return text[:k] + rng.choice("~^|¦'*") + text[k:]

    rows, labels = [], []
    for _ in range(TRAINING // 2):
        clean, in_codes = number(), code()
        for text, column, label in ((clean, False, 0), (spoilt(clean), False, 1), (in_codes, True, 0), (rng.choice("-–"), False, 0), (spoilt(str(rng.randrange(1, 500))), True, 1)):
            bad = label and not (_CLEAN.match(text) or column and _CODES.match(text))
            rows.append(number_features(text, column))
            labels.append(int(bad))
        code_like = rng.choice("BSZ") + str(rng.randrange(1, 99)).zfill(2)  # a digit in a column of amounts, where no code stands
        rows.append(number_features(code_like, False))
        labels.append(1)
    return Boosted(trees=30, depth=4).fit(np.array(rows, float), np.array(labels, float))


class Reader:
    """Finds and repairs the noise of texts and cells with a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.sure: set[str] = set()
        self.unsure: set[str] = set()
        self.core_of: dict[str, str] = {}
        self.misread: dict[tuple[str, bool], bool] = {}
        self.headed: dict[str, bool] = {}
        #: Chunks in contexts that were judged before.
        self.heard: dict[tuple, bool] = {}
        #: (chunk, word behind it) that hold no noise whatever stands around them.
        self.calm: set[tuple[str, str]] = set()

    def _words(self, segment: list[tuple[int, str]]) -> list[tuple[int, str, str]]:
        """(line, chunk, word) of a segment, in order."""
        of = self.core_of
        out = []
        for i, text in segment:
            for chunk in text.split():
                word = of.get(chunk)
                if word is None:
                    word = core(chunk)
                    if len(of) < 500_000:
                        of[chunk] = word
                if word:
                    out.append((i, chunk, word))
        return out

    def wrong_number(self, cell: str, code_column: bool) -> bool:
        """Whether a cell is a number or code with letters or specks for digits."""
        if _CLEAN.match(cell) or code_column and _CODES.match(cell):
            return False  # as it would be printed
        key = (cell.strip(), code_column)
        known = self.misread.get(key)
        if known is None:
            known = (bool(_NUMERIC.match(key[0]) or _CODES.match(key[0])) or code_column and len(key[0]) <= 8) and self._numbers().score(number_features(*key)) > 0
            if len(self.misread) < 300_000:
                self.misread[key] = known
        return known

    def _numbers(self) -> Boosted:
        if self.lexicon.numbers is None:
            self.lexicon.numbers = number_model()
        return self.lexicon.numbers

    def furniture_cell(self, text: str) -> bool:
        """Whether the only filled cell of a row, its first, is a page number, a running header or specks."""
        if not any(c.isalnum() for c in text):
            return bool(_SPECKS.match(text)) and text != "-"
        if _NUMBERED.match(text):
            return not text.isdigit()
        key = masked(text)
        if key in self.lexicon.headers:
            return True
        known = self.headed.get(key)
        if known is None:  # a table has no edge of a page, but a shorter form of a header is one
            known = self.lexicon.shortened(key)
            if len(self.headed) < 300_000:
                self.headed[key] = known
        return known

    def fine(self, text: str) -> bool:
        """Whether text has only words that stand beyond doubt in any context."""
        chunks = _AMOUNT.sub("#", text).split()
        if self.sure.issuperset(chunks):
            return True
        all_fine = True
        for c in chunks:
            if c not in self.sure:
                if self._sure(c):
                    if len(self.sure) < 500_000:
                        self.sure.add(c)
                else:
                    all_fine = False
                    if c not in self.unsure and len(self.unsure) < 500_000:
                        self.unsure.add(c)
        return all_fine

    def _sure(self, chunk: str) -> bool:
        if chunk in self.unsure:
            return False
        word, lexicon = core(chunk), self.lexicon
        if not word or word == "#":
            return not _STRAY.search(chunk)
        if _STRAY.search(chunk) or _MARK.search(chunk) or word in lexicon.halves:
            return False
        if not (chunk.islower() or chunk.isupper() or chunk[1:].islower()) and _ODD_CASE.search(chunk):
            return False
        return not _plain(word) or not (lexicon.candidates(word) or len(word) >= 3 and lexicon.parted(word))

    def broken(self, line: str, following: str | None) -> bool:
        """Whether line ends in a word that the following line goes on with."""
        line = line.rstrip()
        if line[-1:] not in _BREAKS or not line[-2:-1].isalpha():
            return False
        row = self.lexicon.pair_features(line, following or "")
        model = self.lexicon.joins
        return model.score(row) > 0 if model else row[0] > 0

    def lines(self, text: str) -> set[int]:
        """The numbers, from 1, of the lines that hold noise."""
        page, lexicon = Page(text), self.lexicon
        found = {i for i in range(len(page.lines)) if lexicon.furniture(page, i)}
        furniture = set(found)
        prose = [i for i in range(len(page.lines)) if i not in furniture and page.prose[i] is not None and page.prose[i].strip()]
        joins: dict[int, bool] = {}
        for a, b in zip(prose, prose[1:] + [None], strict=True):
            ends = page.prose[a].rstrip()
            if ends[-1:] in _BREAKS and self.broken(ends, page.prose[b] if b is not None else None):
                joins[a] = True
                found.add(a)
                if b is not None and _STRAY.search(page.prose[b].split()[0]):
                    found.add(b)
        for segment in page.segments(furniture):
            doubtful = {i for i, t in segment if i not in found and not self.fine(t)}
            if not doubtful:
                continue
            # A word is judged by the two behind it and the one before, so two lines on either side are enough.
            near = {q for k, (i, _) in enumerate(segment) if i in doubtful for q in range(max(0, k - 2), min(len(segment), k + 3))}
            words = self._words([segment[q] for q in sorted(near)])
            if joins:
                words = self._mend(words, joins)
            n, sure, loud, heard = len(words), self.sure, segment[0][1].isupper(), self.heard
            for k, (i, chunk, word) in enumerate(words):
                if word == "#" or chunk in sure or i not in doubtful or i in found:
                    continue
                left = words[k - 1][2] if k else "<s>"
                right = words[k + 1][2] if k + 1 < n else "</s>"
                beyond = words[k + 2][2] if k + 2 < n else "</s>"
                key = (left, chunk, right, beyond, loud)
                noisy = heard.get(key)
                if noisy is None:
                    noisy = self.noisy(chunk, left, word, right, beyond, loud)
                    if len(heard) < 500_000:
                        heard[key] = noisy
                if noisy:
                    found.add(i)
        return {i + 1 for i in found}

    def _mend(self, words: list[tuple[int, str, str]], joins: dict[int, bool]) -> list[tuple[int, str, str]]:
        out: list[tuple[int, str, str]] = []
        for w in words:
            if out and out[-1][0] in joins and w[0] != out[-1][0] and out[-1][1].endswith(_BREAKS):
                i, chunk, _ = out[-1]
                out[-1] = (i, chunk[:-1] + w[1], core(chunk[:-1] + w[1]))
            else:
                out.append(w)
        return out

    def noisy(self, chunk: str, left: str, word: str, right: str, beyond: str, loud: bool = True) -> bool:
        """Whether a chunk holds noise. loud: it stands in a line of capitals, where its own are no sign of an abbreviation."""
        if _MARK.search(chunk) and _MARK.search(unicodedata.normalize("NFC", chunk)):
            return True  # accents that no letter takes together
        if not loud and chunk.isupper() and len(word) <= 5 and word.isalpha():
            return False
        return self.lexicon.verdict(left, chunk, word, right, beyond) is not None

    def cell(self, cell: str, column: int, filled: int) -> bool:
        """Whether a cell of a table, in a column from 0 and a row with so many filled cells, holds noise."""
        text = cell.strip()
        if not text:
            return False
        if column == 0 and filled == 1 and self.furniture_cell(text):
            return True
        if column or _NUMERIC.match(text) and any(c.isdigit() for c in text):
            return bool(_BROKEN.search(text)) or self.wrong_number(text, column == 1) or (any(c.isalpha() for c in text) and len(text) > 4 and self._text(text))
        return self._text(text)

    def _text(self, text: str) -> bool:
        parts = text.split("\n")
        if len(parts) == 1 and self.fine(text):
            return False
        if any(self.broken(a, b) for a, b in zip(parts, parts[1:], strict=False)):
            return True
        words = [w for w in ((c, core(c)) for c in _ITEM.sub("", text.replace("\n", " ")).split()) if w[1]]
        for k, (chunk, word) in enumerate(words):
            left = words[k - 1][1] if k else "<s>"
            right = words[k + 1][1] if k + 1 < len(words) else "</s>"
            beyond = words[k + 2][1] if k + 2 < len(words) else "</s>"
            if self.noisy(chunk, left, word, right, beyond, text.isupper()):
                return True
        return False

    def repair_cell(self, cell: str | None, column: int) -> str | None:
        """A cell of a table, in a column from 0 and a row that is no furniture: numbers and words as they were printed, broken words joined."""
        if not cell or not self.cell(cell, column, 2):
            return cell
        text = cell.strip()
        for _ in range(3):  # a word may be doubtful only once its neighbour is repaired
            new = self._cell(text, column)
            if new == text or not self.cell(new, column, 2):
                return new
            text = new
        return text

    def _cell(self, text: str, column: int) -> str:
        if column or _NUMERIC.match(text) and any(c.isdigit() for c in text):
            if self.wrong_number(text, column == 1):
                return printed_number(text) if _NUMERIC.match(text) or _CLEAN.match(text) else _STRAY.sub("", text)
            if not any(c.isalpha() for c in text):
                return text
        lead = _ITEM.match(text)
        parts = text[lead.end() if lead else 0 :].split("\n")
        joins = {k: True for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (_BROKEN.search(f"{a}\n") if column else self.broken(a, b))}
        parts = [p.rstrip() if k in joins else p for k, p in enumerate(parts)]
        words = self._mend(self._words_all(list(enumerate(parts))), joins)
        out, last = [], 0
        for (k, _, _), chunk in zip(words, self._repaired(words, text.isupper()), strict=True):
            if chunk:
                out.append(("\n" if any(j not in joins for j in range(last, k)) else " ") * bool(out) + chunk)
                last = k
        return (lead.group() if lead else "") + "".join(out)

    def repair(self, text: str | None) -> str | None:
        """text as continuous paragraphs: no furniture, broken words joined, misread words replaced; formulas stay."""
        if not text:
            return text
        page, lexicon = Page(text), self.lexicon
        furniture = {i for i in range(len(page.lines)) if lexicon.furniture(page, i)}
        prose = [i for i in range(len(page.lines)) if i not in furniture and page.prose[i] is not None and page.prose[i].strip()]
        joins = {a: True for a, b in zip(prose, prose[1:], strict=False) if page.held(a).rstrip()[-1:] in _BREAKS and self.broken(page.held(a), page.held(b))}
        mended: dict[int, str] = {}
        for segment in page.segments(furniture, hold=True):
            for _, t in segment:
                self.fine(t)  # tells which chunks are beyond doubt in any context
            words = self._mend(self._words_all(segment), joins)
            lead = _ITEM.match(page.held(segment[0][0]))
            mended[segment[0][0]] = page.released((lead.group() if lead else "") + " ".join(x for x in self._repaired(words) if x))
            for i, _ in segment[1:]:
                mended[i] = ""
        kept = []
        for i, line in enumerate(page.lines):
            if i in furniture or i in mended and not mended[i] and page.prose[i].strip():
                continue
            kept.append(mended.get(i, line))
        return "\n".join(kept)

    def _repaired(self, words: list[tuple[int, str, str]], loud: bool = True) -> list[str]:
        """The chunks of a segment, repaired; empty where the one before took it in.

        Those that stand for formulas are no words: their neighbours are read past them, but not put together.
        """
        said = [k for k, w in enumerate(words) if "\ufdd0" not in w[1]]
        cores = ["<s>", *(words[k][2] for k in said), "</s>", "</s>"]
        out = [w[1] for w in words]
        skip = False
        for n, k in enumerate(said, 1):
            if skip:
                skip = False
                continue
            chunk, word, pair = words[k][1], cores[n], (words[k][1], cores[n + 1])
            if word == "#" or chunk in self.sure or pair in self.calm:
                continue
            key = (cores[n - 1], chunk, cores[n + 1], cores[n + 2], loud)
            noisy = self.heard.get(key)
            if noisy is None:
                noisy = self.noisy(chunk, cores[n - 1], word, cores[n + 1], cores[n + 2], loud)
                if len(self.heard) < 500_000:
                    self.heard[key] = noisy
            if not noisy:
                if loud and chunk.islower() and not _STRAY.search(chunk) and self.lexicon.settled(word, cores[n + 1]) and len(self.calm) < 500_000:
                    self.calm.add(pair)
                continue
            beside = n == len(said) or said[n] == k + 1
            out[k], skip = self._word(chunk, cores[n - 1], word, cores[n + 1], cores[n + 2], beside)
            if skip:
                out[said[n]] = ""
        return out

    def _words_all(self, segment: list[tuple[int, str]]) -> list[tuple[int, str, str]]:
        of = self.core_of
        out = []
        for i, text in segment:
            for chunk in text.split():
                word = of.get(chunk)
                if word is None:
                    word = core(chunk)
                    if len(of) < 500_000:
                        of[chunk] = word
                out.append((i, chunk, word or "#"))
        return out

    def _word(self, chunk: str, left: str, word: str, right: str, beyond: str, beside: bool) -> tuple[str, bool]:
        """(a noisy chunk repaired, whether it took in the next). beside: nothing stands before the next word."""
        found = self.lexicon.verdict(left, chunk, word, right, beyond)
        if found is not None and found[1] == SPLIT and not beside:
            found = None
        whole = found if found is not None and found[1] == SPLIT else None
        new = found[0] if found is not None else _STRAY.sub("", word)
        bare = chunk.strip(_PUNCTUATION)
        at = chunk.find(bare) if bare else 0
        new = new.upper() if sum(c.isupper() for c in bare) > 0.6 * len(bare) > 1 else new.capitalize() if bare[:1].isupper() else new
        return chunk[:at] + new + chunk[at + len(bare) :], whole is not None


def lexicon(documents: DataFrame, tables: DataFrame) -> Lexicon:
    """The trained lexicon of the corpus, on the driver. Its size is bounded by 1 / SHARE for words, pairs and lines each."""
    counted = statistics(documents, tables).persist()
    totals = {r["kind"]: r["n"] for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = F.lit(None).cast("double")
    for kind, n in totals.items():
        least = F.when(F.col("kind") == kind, F.lit(max(float(LEAST), SHARE * n))).otherwise(least)
    words, pairs, lines, forms = {}, {}, {}, {}
    for r in counted.where(F.col("n") >= least).collect():
        if r["kind"] == "w":
            words[r["key"]] = r["n"]
        elif r["kind"] == "p":
            pairs[r["key"]] = r["n"]
        elif r["kind"] == "c":
            forms[r["key"]] = r["n"]
        else:
            lines[r["key"]] = (r["n"], r["first"], r["last"])
    counted.unpersist()
    out = Lexicon(words, pairs, lines, forms)
    out.settle()
    out.train()
    out.train_joins()
    out.numbers = number_model()
    return out


_reader_of: list = []


def _reader(shared) -> Reader:
    """The reader of a broadcast lexicon, made once per Python worker, so that what it has judged is kept."""
    if not _reader_of or _reader_of[0] is not shared.value:
        _reader_of[:] = [shared.value, Reader(shared.value)]
    return _reader_of[1]


FOUND = T.StructType([T.StructField("record_key", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("col_no", T.LongType())])


def found_lines(spark: SparkSession, documents: DataFrame, shared) -> DataFrame:
    """(record_key, line_no, col_no = 0) of the noisy lines of documents(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared)
        for batch in batches:
            keys, numbers = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n in sorted(reader.lines(text)) if text else ():
                    keys.append(key)
                    numbers.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int64()), pa.array([0] * len(keys), pa.int64())], FOUND.names)

    return documents.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, FOUND).distinct()


def _flat(tables: pa.Array) -> tuple[pa.Array, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(cells, rows, places) of an array of tables: each cell that is no null, the table and line from 0 of each row, and the row and column from 0 of each cell."""
    rows = pc.list_flatten(tables)
    table = pc.list_parent_indices(tables).to_numpy(zero_copy_only=False).astype(np.int64)
    cells = pc.list_flatten(rows)
    of = pc.list_parent_indices(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    within = lambda owner: np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
    col, there = within(of), pc.is_valid(cells).to_numpy(zero_copy_only=False)
    return cells.filter(pa.array(there)), {"table": table, "line": within(table)}, {"row": of[there], "col": col[there]}


def found_cells(spark: SparkSession, tables: DataFrame, shared) -> DataFrame:
    """(record_key, line_no, col_no) of the noisy cells of tables(table_ref, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared)
        seen: dict[tuple, bool] = {}
        for batch in batches:
            cells, row, place = _flat(batch.column(1))
            text, table, line = cells, row["table"], row["line"]
            of = place["row"]
            filled = pc.not_equal(pc.utf8_trim_whitespace(text), "").to_numpy(zero_copy_only=False)
            later = np.bincount(of[filled & (place["col"] > 0)], minlength=len(table)) > 0
            # Equal cells in like places are judged once.
            printed = pc.match_substring_regex(text, _PRINTED.pattern).to_numpy(zero_copy_only=False) & (place["col"] > 1)
            kept = np.flatnonzero(pc.not_equal(text, "").to_numpy(zero_copy_only=False) & ~printed)
            coded = text.dictionary_encode()
            kind = coded.indices.to_numpy(zero_copy_only=False)[kept].astype(np.int64) * 6 + np.minimum(place["col"][kept], 2) * 2 + ~later[of[kept]]
            distinct, back = np.unique(kind, return_inverse=True)
            words = coded.dictionary.take(pa.array(distinct // 6)).to_pylist()
            noisy = np.zeros(len(distinct), bool)
            for k, (cell, how) in enumerate(zip(words, (distinct % 6).tolist(), strict=True)):
                known = seen.get((cell, how))
                if known is None:
                    known = reader.cell(cell, how // 2, 1 if how % 2 else 2)
                    if len(seen) < 500_000:
                        seen[cell, how] = known
                noisy[k] = known
            hit = kept[noisy[back]] if len(kept) else kept
            keys = batch.column(0).take(pa.array(table[of[hit]]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(line[of[hit]] + 1, pa.int64()), pa.array(place["col"][hit] + 1, pa.int64())], FOUND.names)

    return tables.select(F.col("table_ref").cast("string"), "rows").mapInArrow(run, FOUND).distinct()


def repaired(documents: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text) with each text repaired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([reader.repair(t) for t in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return documents.select(id_col, text_col).mapInArrow(run, T.StructType([documents.schema[id_col], T.StructField("text", T.StringType())]))


CELLS = T.StructType([*FOUND.fields, T.StructField("text", T.StringType())])


def repaired_cells(tables: DataFrame, shared) -> DataFrame:
    """(record_key, line_no, col_no, text) of all cells of tables(table_ref, rows), repaired. Rows that are furniture are left out, the others keep their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared)
        seen: dict[tuple, str] = {}
        for batch in batches:
            keys, rows, columns, texts = [], [], [], []
            for key, table in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for r, row in enumerate(table or (), 1):
                    if not row:
                        continue
                    if row[0] and row[0].strip() and not any(c and not c.isspace() for c in row[1:]) and reader.furniture_cell(row[0].strip()):
                        continue
                    for c, cell in enumerate(row):
                        new = cell
                        if cell and not (c > 1 and _PRINTED.match(cell)):
                            what = (cell, min(c, 2))
                            new = seen.get(what)
                            if new is None:
                                new = reader.repair_cell(cell, c)
                                if len(seen) < 500_000:
                                    seen[what] = new
                        keys.append(key)
                        rows.append(r)
                        columns.append(c + 1)
                        texts.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(rows, pa.int64()), pa.array(columns, pa.int64()), pa.array(texts, pa.string())], CELLS.names)

    return tables.select(F.col("table_ref").cast("string"), "rows").mapInArrow(run, CELLS)
