"""Mapping of freely entered values to the entries of a reference list (problem 1).

The reference entries, folded and without separators, stand in a trie together with their alias paths: an abbreviation
is a second path from the letter where its phrase begins to the letter where it ends, and an entry may begin at any of
its words (as in "thu, Doanh"). Paths that go on alike share their nodes, so the paths are never multiplied out. A value
is the pattern of a Levenshtein automaton that is run down the trie, one word of bits for each number of errors, a block
of values at a time. It may start at any word of the value and end at any, so additions around the name cost nothing.
The walk leaves a branch only where no entry below can come within its distance: where all rows of bits are empty, or
where more letter pairs that all entries below share are missing in the value than the errors left can spoil. So all
entries within the distance allowed for their length come back; the least share of errors, then the longest, is the match.

A word cut short with a full stop goes on with any letters up to the end of a word; a value that breaks off matches the
one entry that goes on from there. Both are asked only where nothing is near.

Equal values are looked up once: the distinct ones are mapped and joined back. A reference list longer than MOST_ENTRIES
is searched in several tries of which each gives all its entries within distance; the decision falls over all of them.

Defined cases: a null, blank or letterless value is unmatched; a value that lies equally near to several entries takes
the first by key; of the entries within distance the one that the record's own key names is taken, and that key also
stands where none is near; very long values are searched in overlapping windows of whole words; an empty reference list
leaves all values unmatched; null keys and surfaces are no entries; repeated rows and columns of any name are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.lookalikes import fold
from tabulon.functions.text import fold as jvm_fold
from tabulon.session import partitions

#: Abbreviations in use for words of metric names and table titles, folded.
ABBREVIATIONS = {
    "doanh thu": ["dt"],
    "chi phi": ["cp"],
    "loi nhuan": ["ln"],
    "thuyet minh": ["tm"],
    "ngan han": ["nh"],
    "dai han": ["dh"],
    "quan ly": ["ql"],
    "ke toan": ["kt"],
    "nguoi ban": ["nb"],
    "tai san co dinh": ["tscd"],
    "tuong duong tien": ["tdt"],
    "chung khoan": ["ck"],
    "gia tri gia tang": ["gtgt"],
    "truoc thue": ["tt"],
    "sau thue": ["st"],
    "bat dong san": ["bds"],
    "xay dung co ban": ["xdcb"],
    "hang ton kho": ["htk"],
    "von chu so huu": ["vcsh"],
    "bao cao": ["bc"],
    "ket qua kinh doanh": ["kqkd"],
    "can doi": ["cd"],
    "can doi ke toan": ["cdkt"],
    "thuan": ["thn"],
    "statement": ["stmt"],
    "note on": ["nt"],
    "non-current": ["non-cur"],
    "current": ["cur"],
    "receivables": ["recv"],
    "borrowings": ["borr"],
    "accounting": ["acc"],
    "investments": ["invest"],
    "investment": ["invest"],
    "equity": ["eq"],
    "property": ["prop"],
    "phai thu": ["pthu"],
    "phai tra": ["ptra"],
    "dau tu": ["dt"],
    "operations": ["ops"],
}
#: Additions that may stand within a name: remarks in brackets, years and dates.
_ADDED = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\bnam (?:nay|truoc|\d{4})\b|\b\d{1,2}/\d{1,2}/\d{4}\b")
#: A word cut short, with a full stop for the rest.
_SHORT = re.compile(r"\b([a-z]{1,6})\.(?![a-z0-9])")
_WORD = re.compile(r"[a-z0-9]+")
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in _SIGNS]] = range(len(_SIGNS))
#: Bits for the letter pairs of a text.
_PAIR_BITS = 256
#: Values that are walked down the trie together.
_BLOCK = 256
#: Errors allowed where a word is cut short or the value breaks off.
_FEW = 2
#: The fewest letters of a value that breaks off.
_CUT = 10


def allowed(length: int) -> int:
    """Errors allowed for an entry of this many letters."""
    return 0 if length < 5 else 1 if length < 9 else 2 if length < 15 else 3 if length < 22 else 4


def _letters(text: str) -> list[str]:
    return _WORD.findall(text)


def _pair_bit(a: str, b: str) -> int:
    return 1 << ((_SIGNS.index(a) * len(_SIGNS) + _SIGNS.index(b)) * 89 % _PAIR_BITS)


@dataclass
class Window:
    """A run of whole words of a value without its separators, as bits: where words start, where they end, where they end in a full stop or the value does, and where a word was cut short."""

    of: int
    text: str
    starts: int
    ends: int
    stops: int
    shorts: int


class TermTrie:
    """The reference entries (key, surface) as a trie that answers which keys are near a value."""

    def __init__(self, entries: list[tuple[str, str]], abbreviations: dict[str, list[str]] = ABBREVIATIONS):
        phrases = [(_letters(p.replace("-", " ")), ["".join(_letters(s)) for s in shorts]) for p, shorts in abbreviations.items()]
        self.keys: list[str] = sorted({k for k, s in entries if k is not None and s is not None})
        self.named = {"".join(_letters(fold(k))): k for k in reversed(self.keys)}
        number = {k: i for i, k in enumerate(self.keys)}
        # One place for each letter of each entry and alias: its key, whether a word or the entry ends there, and where its letters lead.
        self._key, self._word, self._end, self._next = [], [], [], []
        first: list[int] = []
        for key, surface in sorted({(k, s) for k, s in entries if k is not None and s is not None}):
            words = _letters(fold(surface))
            for k in range(len(words)):
                first.append(self._chain(number[key], words, k, phrases))
        self._share(first)
        del self._key, self._word, self._end, self._next

    def _place(self, key: int, word: bool = False, end: bool = False) -> int:
        self._key.append(key)
        self._word.append(word)
        self._end.append(end)
        self._next.append({})
        return len(self._key) - 1

    def _chain(self, key: int, words: list[str], k: int, phrases: list[tuple[list[str], list[str]]]) -> int:
        """The places of an entry read from its word k on, with its aliases; the first of them."""
        order = words[k:] + words[:k]
        at, places = [0], [self._place(key, True)]
        for w in order:
            for c in w:
                new = self._place(key)
                self._next[places[-1]].setdefault(c, []).append(new)
                places.append(new)
            self._word[places[-1]] = True
            at.append(len(places) - 1)
        self._end[places[-1]] = True
        turn = len(words) - k
        for phrase, shorts in phrases:
            n = len(phrase)
            for i in range(len(order) - n + 1):
                if order[i : i + n] != phrase or (i < turn < i + n):
                    continue
                for short in shorts:
                    place = places[at[i]]
                    for c in short[:-1]:
                        new = self._place(key)
                        self._next[place].setdefault(c, []).append(new)
                        place = new
                    self._next[place].setdefault(short[-1], []).append(places[at[i + n]])
        return places[0]

    def _share(self, first: list[int]) -> None:
        """Put places that the same letters lead to into one node, and lay the nodes out as arrays."""
        root = tuple(first)
        number, order = {root: 0}, [root]
        edges: list[list[tuple[str, int]]] = []
        for node in order:
            leads: dict[str, set[int]] = {}
            for p in node:
                for c, targets in self._next[p].items():
                    leads.setdefault(c, set()).update(targets)
            own = []
            for c in sorted(leads):
                target = tuple(sorted(leads[c]))
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                own.append((c, number[target]))
            edges.append(own)
        n = len(order)
        self.ends: list[tuple[int, ...]] = [tuple(sorted({self._key[p] for p in node if self._end[p]})) for node in order]
        self.only = np.array([next(iter(ks)) if len(ks := {self._key[p] for p in node}) == 1 else -1 for node in order], np.int64)
        self.word = np.array([any(self._word[p] for p in node) for node in order], bool)
        self.is_end = np.array([bool(e) for e in self.ends], bool)
        # The letters to the farthest end below a node, and the letter pairs that all paths have behind an edge.
        far = [0] * n
        behind: list[list[int]] = [[] for _ in range(n)]
        done = [False] * n
        every = (1 << _PAIR_BITS) - 1
        stack = [(0, 0)] if n else []
        while stack:
            node, i = stack.pop()
            if i < len(edges[node]):
                stack.append((node, i + 1))
                if not done[edges[node][i][1]]:
                    stack.append((edges[node][i][1], 0))
                continue
            if done[node]:
                continue
            for c, child in edges[node]:
                far[node] = max(far[node], 1 + far[child])
                shared = 0 if self.ends[child] else every
                for (d, _), bits in zip(edges[child], behind[child], strict=True):
                    shared &= _pair_bit(c, d) | bits
                behind[node].append(shared)
            done[node] = True
        self.far = np.array(far, np.int64)
        self.longest = far[0]
        self.count = np.array([len(e) for e in edges], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.to = np.array([t for e in edges for _, t in e], np.int64)
        self.sign = np.array([_SIGNS.index(c) for e in edges for c, _ in e], np.int64)
        flat = b"".join(b.to_bytes(_PAIR_BITS // 8, "little") for bs in behind for b in bs)
        self.pairs = np.frombuffer(flat, "<u8").reshape(-1, _PAIR_BITS // 64)
        self.limit = np.array([allowed(i) for i in range(self.longest + 1)], np.int64)
        self.most = int(self.limit[-1])
        #: The letters of a window: enough for any entry within its distance, and as many as a machine word has bits where that will do.
        self.width = max(self.longest + self.most, 63)
        self.kind = np.uint64 if self.width <= 63 else object

    # --- values as windows

    def _windows(self, of: int, folded: str) -> list[Window]:
        """The words of a folded text in windows of at most width letters, so that each run of words that an entry may match lies within one."""
        reach = self.longest + self.most
        shorts = {m.end(1) for m in _SHORT.finditer(folded)}
        out, run = [], []
        for m in _WORD.finditer(folded):
            w = (m.group(), m.end() in shorts, folded[m.end() : m.end() + 1] in (".", "…"))
            if len(w[0]) <= reach:
                run.append(w)
            else:  # no entry runs across it
                out += self._cut(of, run, reach)
                run = []
        out += self._cut(of, run, reach)
        if out and run:
            out[-1].stops |= 1 << len(out[-1].text)
        return out

    def _cut(self, of: int, run: list[tuple[str, bool, bool]], reach: int) -> list[Window]:
        at = [0]
        for w in run:
            at.append(at[-1] + len(w[0]))
        out, begin = [], 0
        while begin < len(run):
            end = begin + 1
            while end < len(run) and at[end + 1] - at[begin] <= self.width:
                end += 1
            out.append(self._window(of, run[begin:end]))
            if end == len(run):
                break
            # The next window begins at the first word from which an entry might take in the word behind this one.
            begin = next(s for s in range(begin + 1, end + 1) if at[end + 1] - at[s] <= reach)
        return out

    @staticmethod
    def _window(of: int, run: list[tuple[str, bool, bool]]) -> Window:
        starts = ends = stops = shorts = at = 0
        for w, short, stop in run:
            starts |= 1 << at
            at += len(w)
            ends |= 1 << at
            shorts |= short << at
            stops |= stop << at
        return Window(of, "".join(w for w, _, _ in run), starts, ends, stops, shorts)

    # --- the automaton

    def _walk(self, windows: list[Window], errors: int, shorts: bool = False, cut: bool = False) -> Iterator[tuple[int, int, int, int]]:
        """(value, key, letters, errors) of the entries within so many errors of any window.

        shorts: words cut short go on with any letters to the end of a word. cut: beginnings of entries with which the
        value breaks off, where only one entry goes on.
        """
        for i in range(0, len(windows), _BLOCK):
            yield from self._block(windows[i : i + _BLOCK], errors, shorts, cut)

    def _block(self, windows: list[Window], errors: int, shorts: bool, cut: bool) -> Iterator[tuple[int, int, int, int]]:
        kind = self.kind
        one = kind(1) if kind is np.uint64 else 1
        bits = lambda xs: np.array(xs, kind)
        sizes = np.array([len(w.text) for w in windows])
        signs = _CODE[np.frombuffer("".join(w.text for w in windows).encode(), np.uint8)]
        of = np.repeat(np.arange(len(windows)), sizes)
        place = np.arange(len(signs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        masks = np.zeros((len(windows), len(_SIGNS)), kind)
        np.bitwise_or.at(masks, (of, signs), bits([1 << int(p) for p in place]) if kind is object else one << place.astype(kind))
        same = np.flatnonzero(of[1:] == of[:-1])
        pair = (signs[same] * len(_SIGNS) + signs[same + 1]) * 89 % _PAIR_BITS
        lacks = np.zeros((len(windows), _PAIR_BITS // 64), np.uint64)
        np.bitwise_or.at(lacks, (of[same], pair >> 6), np.uint64(1) << (pair & 63).astype(np.uint64))
        lacks = ~lacks
        full = bits([(1 << (len(w.text) + 1)) - 1 for w in windows])
        accept, last, short = bits([w.ends for w in windows]), bits([w.stops for w in windows]), bits([w.shorts for w in windows])
        value, node = np.arange(len(windows)), np.zeros(len(windows), np.int64)
        rows = [bits([w.starts for w in windows])]
        for _ in range(errors):
            rows.append((rows[-1] | rows[-1] << one) & full)
        open_ = [r ^ r for r in rows] if shorts else []
        least = np.zeros(len(windows), np.int64)
        depth = 0
        while len(value):
            count = self.count[node]
            source = np.repeat(np.arange(len(value)), count)
            edge = np.arange(len(source)) + np.repeat(self.first[node] - np.cumsum(count) + count, count)
            depth += 1
            if not (shorts or cut):
                spare = np.minimum(self.limit[depth + self.far[self.to[edge]]], errors) - least[source]
                missing = np.bitwise_count(self.pairs[edge] & lacks[value[source]]).sum(1, dtype=np.int64)
                near = missing <= 2 * spare  # an error spoils two pairs at most
                source, edge = source[near], edge[near]
            value, node = value[source], self.to[edge]
            mask, whole = masks[value, self.sign[edge]], full[value]
            old = rows[0][source]
            new = [(old & mask) << one]
            for j in range(1, errors + 1):
                own = rows[j][source]
                new.append((((own & mask) | old | new[-1]) << one | old) & whole)
                old = own
            if shorts:
                # A word cut short is read on until a word of the entry ends, where the value goes on too.
                ended, nothing = self.word[node], whole ^ whole
                for j in range(errors + 1):
                    stays = open_[j][source] | (rows[j][source] & mask) << one & short[value]
                    new[j] = np.where(ended, new[j] | stays, new[j])
                    open_[j] = np.where(ended, nothing, stays)
            filled = np.array([r != 0 for r in new], bool) if not shorts else np.array([(r != 0) | (s != 0) for r, s in zip(new, open_, strict=True)], bool)
            least = filled.argmax(0)
            alive = filled.any(0) & (least <= self.limit[depth + self.far[node]] if not cut else True)
            keep = np.flatnonzero(alive)
            value, node, least = value[keep], node[keep], least[keep]
            rows = [r[keep] for r in new]
            open_ = [r[keep] for r in open_]
            if cut:
                at = np.flatnonzero((self.only[node] >= 0)) if depth >= _CUT else ()
                goal = last
            else:
                at, goal = np.flatnonzero(self.is_end[node]), accept
            if len(at):
                hit = np.array([(r[at] & goal[value[at]]) != 0 for r in rows], bool)
                j = hit.argmax(0)
                good = hit.any(0) & (j <= (allowed(depth) - 1 if cut else int(self.limit[depth])))
                for s, e in zip(at[good], j[good], strict=True):
                    for key in (int(self.only[node[s]]),) if cut else self.ends[node[s]]:
                        yield windows[value[s]].of, key, depth, int(e)

    def near(self, values: list[str | None]) -> list[list[tuple[float, int, str]]]:
        """For each value (share of wrong letters, -letters, key) of all entries within their distance, best first."""
        if not self.keys or not self.longest:
            return [[] for _ in values]
        folded = [fold(v) if v else "" for v in values]
        known = {f: None for f in folded}
        texts = [(_ADDED.sub(" ", f), f) for f in known]
        found: list[dict[str, tuple[float, int]]] = [{} for _ in texts]
        rounds = (
            (lambda i: dict.fromkeys(texts[i]), self.most, {}),
            (lambda i: [texts[i][0]] if _SHORT.search(texts[i][0]) else [], _FEW, {"shorts": True}),
            (lambda i: [texts[i][0]], _FEW, {"cut": True}),
        )
        for of, errors, how in rounds:
            windows = [w for i in range(len(texts)) if not found[i] for t in of(i) for w in self._windows(i, t) if w.text]
            for i, key, letters, e in self._walk(windows, errors, **how):
                own, name = found[i], self.keys[key]
                new = (e / letters, -letters)
                if name not in own or new < own[name]:
                    own[name] = new
        for f, own in zip(known, found, strict=True):
            known[f] = sorted((*best, key) for key, best in own.items())
        return [known[f] for f in folded]

    def known(self, hint: str | None) -> str | None:
        """The key that a hint names, case and separators aside."""
        return self.named.get("".join(_letters(fold(hint)))) if hint else None

    def match(self, value: str | None, hint: str | None = None) -> str:
        """The key of the entry meant by value, or `unmatched`: the record's own key where it is within distance or nothing else is, else the nearest."""
        found, known = self.near([value])[0], self.known(hint)
        if known is not None and (not found or any(f[2] == known for f in found)):
            return known
        return found[0][2] if found else "unmatched"


#: Entries in one trie at most.
MOST_ENTRIES = 10_000

_tries: list[tuple[list, TermTrie]] = []


def _trie(shared) -> TermTrie:
    """The trie of broadcast entries, built once per Python worker."""
    for listed, trie in _tries:
        if listed is shared.value:
            return trie
    _tries.append((shared.value, TermTrie(shared.value)))
    return _tries[-1][1]


_FOUND = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("v", "h")),
        T.StructField("share", T.DoubleType()),
        T.StructField("letters", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("key", "known", "kept")),
    ]
)


def _searched(lookups: DataFrame, shared) -> DataFrame:
    """For each value and hint the best entry of one trie, the key of that trie that the hint names, and that key again where it is within distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(shared)
        for batch in batches:
            values, hints = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            distinct = list(dict.fromkeys(values))
            near = dict(zip(distinct, trie.near(distinct), strict=True))
            rows = []
            for v, h in zip(values, hints, strict=True):
                found, known = near[v], trie.known(h)
                kept = known if any(f[2] == known for f in found) else None
                rows.append((v, h, *(found[0] if found else (None, None, None)), known, kept))
            columns = list(zip(*rows, strict=True)) or [()] * len(_FOUND)
            kinds = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _FOUND.names)

    return lookups.mapInArrow(run, _FOUND)


def map_to_entries(values: DataFrame, entries: DataFrame, value_col: str, hint_col: str | None = None, out_col: str = "entry", most_entries: int = MOST_ENTRIES) -> DataFrame:
    """values with out_col, the key of the entry of `entries`(key, surface) meant by value_col, or `unmatched`.

    The list is read in shards of about most_entries, each bounded, so it may be of any length.
    """
    spark = values.sparkSession
    shards = max(1, -(-entries.count() // most_entries))
    hint = F.col(hint_col) if hint_col else F.lit(None).cast("string")
    lookups = values.select(F.col(value_col).alias("v"), hint.alias("h")).distinct()
    # Values that differ in case, accents and signs only go to one worker, which walks once for all of them.
    lookups = lookups.repartition(partitions(lookups), F.regexp_replace(jvm_fold(F.col("v")), "[^a-z0-9]+", ""))
    found = None
    for i in range(shards):
        shard = entries.where(F.pmod(F.xxhash64("key", "surface"), F.lit(shards)) == i) if shards > 1 else entries
        listed = sorted({(r["key"], r["surface"]) for r in shard.select("key", "surface").collect() if r["key"] is not None and r["surface"] is not None})
        part = _searched(lookups, spark.sparkContext.broadcast(listed))
        found = part if found is None else found.unionByName(part)
    best, known, kept = F.when(F.col("key").isNotNull(), F.struct("share", "letters", "key")), F.col("known"), F.col("kept")
    if shards > 1:
        found = found.groupBy("v", "h").agg(F.min(best).alias("best"), F.min("known").alias("known"), F.min("kept").alias("kept"))
        best = F.col("best")
    entry = F.coalesce(kept, best["key"], known, F.lit("unmatched"))
    mapped = found.select("v", "h", entry.alias("_entry"))
    # The rows of a value that very many share are split by adaptive execution; each has one row on the other side.
    rows = values.select(F.struct("*").alias("_row"), F.col(value_col).alias("_v"), hint.alias("_h"))
    out = rows.join(mapped, rows["_v"].eqNullSafe(mapped["v"]) & rows["_h"].eqNullSafe(mapped["h"]), "left")
    kept_columns = [F.col("_row")[c].alias(c) for c in values.columns if c != out_col]
    return out.select(*kept_columns, F.col("_entry").alias(out_col))
