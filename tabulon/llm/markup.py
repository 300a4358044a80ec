"""Markup residue in lines and cells, and the clean text beneath it (problem 2).

A lexer with the grammars of HTML, Markdown, wiki text and LaTeX reads each document once, line by line, with the
little state that spans lines: an open tag or comment, a code fence, a wiki table, a LaTeX environment. It tells
which lines hold markup and rewrites them: headings, list items, code and formulas stay as plain conventions
("# ", "- ", fences, "$...$"), everything else that is markup goes.

Defined cases: null and empty texts give no lines; page markers, <table> lines, pipe rows and their separators,
plain bullets, numbering and code between fences are left alone; an unclosed tag or environment ends with the text;
very long texts are read whole; repeated documents are read once.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.repeats import without_boilerplate

#: Names of HTML elements and of wiki extensions written like them.
TAGS = (
    "a abbr acronym address article aside b base big blockquote body br button caption center cite code col colgroup "
    "dd del details dfn dir div dl dt em fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header "
    "hr html i iframe img input ins kbd label legend li link main map mark math menu meta nav nobr noscript nowiki o:p "
    "object ol option p param pre q ref references s samp script section select small span strike strong style sub "
    "summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr br/ gallery "
    "poem syntaxhighlight onlyinclude includeonly noinclude"
).split()
_NAME = "(?:" + "|".join(sorted(map(re.escape, TAGS), key=len, reverse=True)) + ")"
_TAG = re.compile(rf"</?{_NAME}(?=[\s/>])[^<>]*>|<!DOCTYPE[^<>]*>|<\?xml[^<>]*>|<!--.*?-->", re.I)
_OPEN_TAG = re.compile(rf"</?{_NAME}(?=[\s/]|$)[^<>]*$", re.I)
#: What may stand on the line after an open tag: attributes, up to its end if that comes.
_ATTRIBUTES = re.compile(r"\s*(?:[\w:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+)\s*)+(?:(/?>)|$)|\s*(/?>)")
_OPEN_COMMENT = re.compile(r"<!--(?!.*-->)")
#: With a semicolon any name; without one only the names that HTML allows so, not before a letter or digit.
_BARE_ENTITIES = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True))
_ENTITY = re.compile(rf"&(?:(?:[A-Za-z][A-Za-z0-9]{{1,30}}|#\d{{1,7}}|#[xX][0-9A-Fa-f]{{1,6}});|(?:{_BARE_ENTITIES})(?![A-Za-z0-9=]))")

_HEADING = re.compile(r"^(\s{0,3}#{1,6})\s+(?=\S)")
_QUOTE = re.compile(r"^\s{0,3}>\s?(?=\S)")
_TASK = re.compile(r"^(\s*[-*+]\s+)\[[ xX]\]\s+")
_FENCE = re.compile(r"^\s{0,3}(```+|~~~+)\s*([A-Za-z0-9_+.-]*)\s*$")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\(\s*[^()\s]*(?:\([^()\s]*\))?[^()\s]*(?:\s+\"[^\"]*\")?\s*\)")
_REFERENCE = re.compile(r"\[\^[^\[\]\s]{1,20}\]:?")
_DEFINED = re.compile(r"^\s{0,3}\[[^\[\]]+\]:\s+\S+\s*$")
_STRONG = re.compile(r"(?<![*\w])(\*{1,3})(?=[^\s*])([^*\n]*?[^\s*])\1(?![*\w])|(?<!\w)(_{2,3})(?=[^\s_])([^\n]*?[^\s])\3(?!\w)|(?<![\w/\\.])(_)(?=[^\s_])([^_\n]*?[^\s_])_(?![\w/])|(?<!\w)(\*{2})(?=[^\s*])([^*\n]*?[^\s*])\7")
_STRUCK = re.compile(r"~~(?=[^\s~])([^~\n]*?[^\s~]|[^~\n]*?(?:[^\s~]~[^\s~])+[^~\n]*?)~~")
_CODE = re.compile(r"(?<![`\w])(`{1,2})(?=[^\s`])([^`\n]*?[^\s`])\1(?!`)")
_RULE = re.compile(r"^\s{0,3}(?:(?:\*\s*){3,}|(?:_\s*){3,})$")

_QUOTES = re.compile(r"('{5}|'{3}|'{2})(?=[^'\s])([^\n]*?[^'\s])\1(?!')")
_WIKI_LINK = re.compile(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]")
_MEDIA = re.compile(r"^\s*:?(?:file|image|media|category|tập tin|tệp|hình|thể loại)\s*:", re.I)
_TEMPLATE = re.compile(r"\{\{[^{}\n]*\}\}")
_URL_LINK = re.compile(r"\[(?:https?|ftp)://[^\s\[\]]+(?:\s+([^\[\]]*))?\]")
_WIKI_HEADING = re.compile(r"^\s*(={2,6})\s*(\S.*?)\s*\1\s*$")
_WIKI_OPEN = re.compile(r"^\s*:*\{\|(?!\|)")
_WIKI_CLOSE = re.compile(r"^\s*\|\}")
_WIKI_ROW = re.compile(r"^\s*(?:\|[-+}]?|!)")

_COMMAND = re.compile(r"\\(?:[a-zA-Z]+\*?)")
_PATH = re.compile(r"(?:\b[A-Za-z]:|\\)\\[\w.\\ -]*")
_SECTION = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?\{([^{}]*)\}")
_ITEM = re.compile(r"^\s*\\item(?:\[[^\[\]]*\])?\s*")
_BEGIN = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\[\]]*\])?(?:\{[^{}]*\})?")
_GROUP = re.compile(r"\{\\(?:bf|it|em|rm|sf|tt|sc|sl|small|large|Large|bfseries|itshape|ttfamily|scshape)\b\s*([^{}]*)\}")
_DISPLAY = re.compile(r"\\\[.*?(?:\\\]|$)|\\\]|\\\(.*?\\\)|\$\$.+?\$\$|\$\$")
_MATH = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\d$])")
_MONEY = re.compile(r"^\s*\d[\d.,]*\s+\D")
_BREAK = re.compile(r"\\\\(?=\s|$|\[|\*)|\\[,;:!%&#$_{}~^]|\\ (?=\S)")
_FORMULAS = {"equation", "align", "gather", "multline", "eqnarray", "math", "displaymath", "alignat", "flalign"}
#: Commands without an argument that show nothing.
_BARE = re.compile(r"\\(?:hline|midrule|toprule|bottomrule|centering|noindent|newpage|clearpage|pagebreak|par|newline|linebreak|item|small|footnotesize|quad|qquad|bigskip|medskip|smallskip|maketitle|tableofcontents|hfill|vfill|protect|displaystyle)\b\s?")
_DROPPED = re.compile(r"~?\\(?:cite[tp]?|label|ref|eqref|pageref|footnote|footnotemark|index|vspace|hspace|includegraphics|usepackage|documentclass|bibliography|input)\*?(?:\[[^\[\]]*\])*\{[^{}]*\}")
_WRAPPED = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\[\]]*\])?\{([^{}]*)\}")

#: A line without any of these holds no markup by itself.
_SIGN = re.compile(r"[<>&#*_`~\[\]{}\\$'=|!]")
#: Lines that are tables or page markers in their own right.
_MARKER = re.compile(r"^=+\s*PAGE\s+\S+\s*=+\s*$")
_TABLE_LINE = re.compile(r"^\s*<table\b.*</table>\s*$", re.I)
_PIPE_ROW = re.compile(r"^\s*\|.*\|\s*$")


class Lexer:
    """The state of one text between its lines."""

    def __init__(self, text: str = "") -> None:
        #: Of what may span lines only that is begun whose end is still to come.
        self.comments = text.count("-->")
        self.tables = len(re.findall(r"(?m)^\s*\|\}", text)) if "|}" in text else 0
        self.fence = ""
        self.tag = False
        self.comment = False
        self.wiki = 0
        self.environments: list[str] = []
        self.display = False

    def line(self, line: str) -> tuple[bool, str | None]:
        """(whether the line holds markup, the clean line or None where nothing is left of it)."""
        if self.fence:
            closes = _FENCE.match(line)
            if closes and closes.group(1)[0] == self.fence[0] and len(closes.group(1)) >= len(self.fence) and not closes.group(2):
                self.fence = ""
                return True, line
            return False, line
        if self.comment:
            end = line.find("-->")
            if end < 0:
                return True, None
            self.comment = False
            self.comments -= 1
            return True, self._rest(line[end + 3 :])
        if self.tag:
            attributes = _ATTRIBUTES.match(line)
            self.tag = False
            if attributes:
                ended = attributes.group(1) or attributes.group(2)
                self.tag = not ended
                return True, self._rest(line[attributes.end() :]) if ended else None
        if self.display:
            if "\\]" in line or "$$" in line:
                self.display = False
                return True, line
            return bool(_COMMAND.search(line) or re.search(r"[_^]\{|[_^]\w", line)), line
        if not (_SIGN.search(line) or self.environments):
            return False, line
        return self._markup(line)

    def _rest(self, line: str) -> str | None:
        return self._markup(line)[1] if line.strip() else None

    def _markup(self, line: str) -> tuple[bool, str | None]:
        if _MARKER.match(line) or _TABLE_LINE.match(line):
            return False, line
        opened = _FENCE.match(line)
        if opened:
            self.fence = opened.group(1)
            return True, line
        if self.wiki:
            if _WIKI_CLOSE.match(line):
                self.wiki -= 1
                self.tables -= 1
                return True, None
            if _WIKI_ROW.match(line):
                return True, self._wiki_row(line)
        elif _WIKI_OPEN.match(line):
            self.wiki += self.tables > 0
            return True, None
        if _PIPE_ROW.match(line) and not self.environments:
            return False, line
        before = line
        if any(e.rstrip("*") in ("verbatim", "lstlisting", "minted") for e in self.environments) and "\\end{" not in line:
            return False, line
        line = self._html(line)
        line = self._latex(line)
        line = self._wiki(line)
        line = self._markdown(line)
        if line == before:
            return False, line
        clean = re.sub(r"(?<=\S)[ \t]{2,}", " ", line).rstrip()
        return True, clean if clean.strip() else None

    def _html(self, line: str) -> str:
        if "<" in line:
            self.comments -= line.count("-->")
            line = _TAG.sub(_tag_text, line)
            comment = _OPEN_COMMENT.search(line)
            if comment:
                self.comment = self.comments > 0
                line = line[: comment.start()]
            opened = _OPEN_TAG.search(line)
            if opened:
                self.tag = True
                line = line[: opened.start()]
        if "&" in line:
            new = _ENTITY.sub(_entity_text, line)
            line = _TAG.sub(_tag_text, new) if new != line and "<" in new else new
        return line

    def _latex(self, line: str) -> str:
        if "\\" in line:
            for m in _BEGIN.finditer(line):
                if m.group(1) == "begin":
                    self.environments.append(m.group(2))
                elif self.environments:
                    self.environments.pop()
            line = _BEGIN.sub(lambda m: ("\\[" if m.group(1) == "begin" else "\\]") if m.group(2).rstrip("*") in _FORMULAS else "", line)
        kept: list[str] = []

        def keep(m: re.Match) -> str:
            kept.append(m.group())
            return f"\x00{len(kept) - 1}\x00"

        changed = False
        if "\\[" in line and "\\]" not in line and not _BREAK.search(line.replace("\\[", "")) and line.strip() == "\\[":
            self.display = not any(e.rstrip("*") in _FORMULAS for e in self.environments)
            return line + " "
        if "$" in line or "\\[" in line or "\\]" in line or "\\(" in line:
            new = _DISPLAY.sub(keep, line)
            if line.strip() == "$$":
                self.display = True
            new = _MATH.sub(lambda m: m.group() if _MONEY.match(m.group(1)) else keep(m), new)
            changed, line = new != line, new
        if any(e.rstrip("*") in _FORMULAS for e in self.environments) and not line.startswith("\\["):
            return line + " " if changed or _COMMAND.search(line) or re.search(r"[_^]\{|[_^]\w", line) else line
        if "\\" in line:
            shielded = _PATH.sub(keep, line) if re.search(r"\b[A-Za-z]:\\", line) else line
            new = _SECTION.sub(r"# \1", shielded)
            new = _ITEM.sub("- ", new)
            new = _DROPPED.sub("", new)
            new = _GROUP.sub(r"\1", new)
            new = _BARE.sub("", new)
            for _ in range(3):
                new = _WRAPPED.sub(r"\1", new)
            new = re.sub(r"\\[a-zA-Z]+\*?\s?(?![\\\w])", "", new) if not re.search(r"\\\w+\\", new) else new
            new = _BREAK.sub(lambda m: m.group()[1:] if m.group()[1] in "%&#$_{}" else "", new)
            changed, line = changed or new != shielded, new
        elif "{\\" in line:
            line = _GROUP.sub(r"\1", line)
        line = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], line)
        return line + " " if changed else line  # a formula stays, but the line does hold markup

    def _wiki(self, line: str) -> str:
        if "''" in line:
            line = _QUOTES.sub(r"\2", line)
        if "[[" in line:
            line = _WIKI_LINK.sub(lambda m: "" if _MEDIA.match(m.group(1)) else (m.group(2) if m.group(2) is not None else m.group(1)), line)
        while "{{" in line:
            new = _TEMPLATE.sub("", line)
            if new == line:
                break
            line = new
        if "[" in line and "://" in line:
            line = _URL_LINK.sub(lambda m: m.group(1) or "", line)
        if "==" in line:
            line = _WIKI_HEADING.sub(lambda m: "#" * (len(m.group(1)) - 1) + " " + m.group(2), line)
        return line

    def _wiki_row(self, line: str) -> str | None:
        text = re.sub(r"^\s*(?:\|[-+]?|!)", "", line)
        cells = [re.sub(r"^[^|\[\]{}]*=[^|\[\]{}]*\|(?!\|)", "", c).strip() for c in re.split(r"\|\||!!", text)]
        if line.lstrip().startswith("|-"):
            return None
        inner = [self._markdown(self._wiki(self._latex(self._html(c)))).strip() for c in cells]
        return "| " + " | ".join(inner) + " |" if any(inner) else None

    def _markdown(self, line: str) -> str:
        if "#" in line:
            heading = _HEADING.match(line)
            if heading:
                line = heading.group(1).strip() + " " + line[heading.end() :] + " "
        if ">" in line:
            line = _QUOTE.sub("", line)
        if "[" in line:
            line = _TASK.sub(r"\1", line)
            if _DEFINED.match(line):
                return ""
            line = _LINK.sub(r"\1", line)
            line = _REFERENCE.sub("", line)
        if "`" in line:
            line = _CODE.sub(lambda m: m.group(2) + " ", line)
        if "~~" in line:
            line = _STRUCK.sub(r"\1", line)
        if "*" in line or "_" in line:
            if _RULE.match(line):
                return ""
            for _ in range(2):
                line = _STRONG.sub(lambda m: m.group(2) or m.group(4) or m.group(6) or m.group(8), line)
        return line


def _tag_text(m: re.Match) -> str:
    tag = m.group().lower()
    if re.match(r"<h([1-6])[\s>]", tag):
        return "#" * int(tag[2]) + " "
    if re.match(r"<li[\s>]", tag):
        return "- "
    return " " if re.match(r"</?(?:br|p|div|td|th|tr|li|h[1-6])[\s/>]", tag) else ""


def _entity_text(m: re.Match) -> str:
    text = html.unescape(m.group())
    return " " if text in "\xa0\u200b" else text


def lines(text: str | None) -> Iterator[tuple[int, bool, str | None]]:
    """(line number from 1, whether it holds markup, the clean line or None) of each line."""
    if not text:
        return
    lexer = Lexer(text)
    for n, line in enumerate(text.split("\n"), 1):
        yield n, *lexer.line(line[:-1] if line.endswith("\r") else line)


def marked(text: str | None) -> list[int]:
    """The numbers of the lines that hold markup."""
    return [n for n, holds, _ in lines(text) if holds]


def clean(text: str | None) -> str | None:
    """The text without markup; lines of which nothing is left go."""
    if text is None:
        return None
    return "\n".join(line for _, _, line in lines(text) if line is not None)


#: The raised mark of a note at the end of a line of a cell; squares of a length and powers of ten are none.
_NOTE = re.compile(r"(?<=\S)(?<!\bm)(?<!\b[cdkm]m)(?<![x×·*]10)(?<![x×·*] 10)[ \t]*<sup>\s*[(\[]?(?:\d{1,2}|\*{1,3})[)\]]?\s*</sup>[ \t]*$", re.I | re.M)


def clean_cell(cell: str | None) -> tuple[bool, str | None]:
    """(whether a cell holds markup, the clean cell). A cell is a text of its own, of one or more lines."""
    if not cell or not _SIGN.search(cell):
        return False, cell
    holds, text = Lexer(cell)._markup(cell.replace("\n", "\x01"))
    if not holds:
        return False, cell
    if "<sup" in cell.lower():  # else the mark would run into the number before it
        text = Lexer(cell)._markup(_NOTE.sub("", cell).replace("\n", "\x01"))[1]
    text = re.sub(r"\$([^$\\^_={}]*)\$", r"\1", text or "")
    return True, "\n".join(part.strip() for part in text.split("\x01"))


LINE_SCHEMA = T.StructType([T.StructField("record_key", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("col_no", T.LongType())])


def found_lines(documents: DataFrame) -> DataFrame:
    """(record_key, line_no, col_no) of the lines of documents(doc_id, text) that hold markup, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n in marked(text):
                    keys.append(key)
                    numbers.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int64()), pa.array([0] * len(keys), pa.int64())], ["record_key", "line_no", "col_no"])

    return documents.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, LINE_SCHEMA).distinct()


def found_cells(tables: DataFrame) -> DataFrame:
    """(record_key, line_no, col_no) of the cells of tables(table_ref, rows) that hold markup, each once."""
    sign = r"[<>&#*_`~\[\]{}\\$'=|!]"
    rows = tables.select(F.col("table_ref").alias("record_key"), F.posexplode("rows").alias("r", "row"))
    cells = rows.select("record_key", (F.col("r") + 1).cast("long").alias("line_no"), F.posexplode("row").alias("c", "cell"))
    cells = cells.select("record_key", "line_no", (F.col("c") + 1).cast("long").alias("col_no"), "cell").where(F.col("cell").rlike(sign))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([clean_cell(c)[0] for c in batch.column(3).to_pylist()], pa.bool_())
            yield batch.select(["record_key", "line_no", "col_no"]).filter(keep)

    return cells.mapInArrow(run, LINE_SCHEMA).distinct()


def cleaned(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text) with the clean text of each document, without the lines that only repeat an earlier page of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([without_boilerplate(clean(t)) for t in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return documents.select(id_col, text_col).mapInArrow(run, T.StructType([documents.schema[id_col], T.StructField("text", T.StringType())]))


CELLS = T.StructType([*LINE_SCHEMA.fields, T.StructField("text", T.StringType())])


def cleaned_cells(tables: DataFrame) -> DataFrame:
    """(record_key, line_no, col_no, text) with the clean text of each cell of tables(table_ref, rows)."""
    rows = tables.select(F.col("table_ref").cast("string").alias("record_key"), F.posexplode("rows").alias("r", "row"))
    cells = rows.select("record_key", (F.col("r") + 1).cast("long").alias("line_no"), F.posexplode("row").alias("c", "text"))
    cells = cells.select("record_key", "line_no", (F.col("c") + 1).cast("long").alias("col_no"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([clean_cell(c)[1] for c in batch.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], clean], CELLS.names)

    return cells.mapInArrow(run, CELLS)
