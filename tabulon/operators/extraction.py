"""From documents to grids: lines, page markers, tables of text and of HTML."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.numbers import is_number_like
from tabulon.functions.text import fold

#: A page's marker, and the lines that number pages.
MARKER = r"^===== PAGE ([0-9]+) =====$"
PAGE_NOISE = r"(?i)^\s*(trang\s*[0-9]+|page\s*[0-9]+|-\s*[0-9]+\s*-|[0-9]+\s*/\s*[0-9]+)\s*$"
#: Words of titles of tables, folded.
TITLE_HINTS = (
    "bang can doi ke toan", "bao cao ket qua", "luu chuyen tien te", "tinh hinh tai chinh", "thuyet minh", "chi tieu", "tai san", "nguon von", "tong cong", "don vi tinh", "balance sheet", "income statement", "cash flow",
)
#: What a folded title holds, in order, and the section that it stands for.
SECTIONS = (
    ("can doi ke toan|tinh hinh tai chinh|balance sheet", "balance_sheet"),
    ("ket qua hoat dong|ket qua kinh doanh|income statement", "income_statement"),
    ("luu chuyen tien te|cash flow", "cash_flow"),
    ("thuyet minh", "notes"),
)


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) from 1."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


def clean_line(line: Column) -> Column:
    """A line without control characters, runs of three or more of a sign as two, no space at the end."""
    plain = F.regexp_replace(line, r"[\x00-\x08\x0B-\x1F]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)([^\w\s])\1{2,}", "$1$1"), r"(?U)\s+$", "")


def is_page_noise(line: Column) -> Column:
    return line.rlike(PAGE_NOISE)


def section(text: Column) -> Column:
    flat, out = fold(text), F.lit(None).cast("string")
    for pattern, label in reversed(SECTIONS):
        out = F.when(flat.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def title(context: Column) -> Column:
    """Of the lines before a table: the last with a word of titles, a line of units being a weak one; else the last line."""
    filled = F.filter(F.split(context, "\n"), lambda x: F.trim(x) != "")
    hinted = F.filter(filled, lambda x: fold(x).rlike("|".join(TITLE_HINTS)))
    strong = F.filter(hinted, lambda x: ~fold(x).rlike("^[(]?(don vi|dvt|unit)"))
    last = lambda a: F.when(F.size(a) > 0, F.trim(F.element_at(a, -1)))
    return F.coalesce(last(strong), last(hinted), last(filled))


#: Terms that scanners misread, as they are put right.
MISREAD_TERMS = (("Doanh thu thuan", "Doanh thu thuần"), ("TONG CONG", "TỔNG CỘNG"), ("TAI SAN", "TÀI SẢN"), ("NGUON VON", "NGUỒN VỐN"))


def clean_text(text: Column, terms: tuple[tuple[str, str], ...] = MISREAD_TERMS) -> Column:
    """A text with clean lines, without the lines that number pages, misread terms put right."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~is_page_noise(x))
    out = F.array_join(F.transform(kept, clean_line), "\n")
    for wrong, right in terms:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def is_header_line(line: Column, min_cols: int = 2) -> Column:
    """Whether a line of several cells holds a word of titles: the head of a table of text."""
    kind = dialect(line, min_cols)
    filled = F.filter(cells(line, kind), lambda c: c != "")
    return kind.isNotNull() & (F.size(filled) >= min_cols) & fold(line).rlike("|".join(TITLE_HINTS))


def page_of_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, page): each line with the last marker at or before it, looked up within its own document."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines(documents).withColumn("_page", F.when(F.col("line").rlike(MARKER), F.regexp_extract("line", MARKER, 1).cast("int")))
    return marked.select("doc_id", "line_no", "line", F.last("_page", True).over(order).alias("page"))


def dialect(line: Column, min_cols: int = 2) -> Column:
    """pipe, tab, whitespace or null: how a line of a table parts its cells."""
    pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    gaps = F.size(F.filter(F.split(F.trim(line), r" {2,}"), lambda c: c != ""))
    return F.when(pipes >= 2, "pipe").when(F.instr(line, "\t") > 0, "tab").when(gaps >= min_cols, "whitespace")


def cells(line: Column, kind: Column) -> Column:
    """The cells of a line in its dialect, trimmed."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    split = F.when(kind == "pipe", F.split(inner, r"\|")).when(kind == "tab", F.split(line, "\t")).otherwise(F.split(F.trim(line), r" {2,}"))
    return F.transform(split, lambda c: F.trim(c))


def is_separator(line: Column) -> Column:
    return line.rlike(r"^[\s|:+=-]*-[\s|:+=-]*$")


def tabular(documents: DataFrame, min_cols: int = 2) -> DataFrame:
    """(doc_id, line_no, line, dialect) of the lines with enough filled cells and a number among them."""
    own = lines(documents).withColumn("dialect", dialect(F.col("line"), min_cols)).where("dialect IS NOT NULL")
    filled = F.filter(cells(F.col("line"), F.col("dialect")), lambda c: c != "")
    keep = (F.size(filled) >= min_cols) & F.exists(filled, is_number_like) & ~is_page_noise(F.col("line")) & ~is_separator(F.col("line"))
    return own.where(keep & ~F.col("line").contains("<table"))


def dialect_vote(documents: DataFrame) -> DataFrame:
    """(doc_id, dialect, n): the dialect of most tabular lines; of equals the first by name."""
    counted = tabular(documents).groupBy("doc_id", "dialect").agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "dialect")).alias("_b")).select("doc_id", "_b.dialect", (-F.col("_b.m")).alias("n"))


def blocks(documents: DataFrame, gap: int = 2, min_rows: int = 2) -> DataFrame:
    """(doc_id, block, first_line, last_line, n_rows): runs of tabular lines with at most `gap` other lines between."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    marked = tabular(documents).select("doc_id", "line_no", (F.col("line_no") - F.lag("line_no").over(order) > gap + 1).alias("_new"))
    numbered = marked.select("doc_id", "line_no", F.sum(F.coalesce(F.col("_new").cast("int"), F.lit(1))).over(order).alias("run"))
    grouped = numbered.groupBy("doc_id", "run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_rows")).where(F.col("n_rows") >= min_rows)
    return grouped.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")).alias("block"), "first_line", "last_line", "n_rows")


def text_tables(documents: DataFrame, gap: int = 2, min_rows: int = 2, above: int = 6) -> DataFrame:
    """(doc_id, position, rows, first_line, n_cols, page, context_before) of the tables that lines of text make.

    position counts from 1 in each document. A head right above a block belongs to it; separators and blank lines are
    no rows; shorter rows are filled up. The context is the last lines above.
    """
    found = blocks(documents, gap, min_rows)
    whole = page_of_lines(documents)
    heads = whole.where(is_header_line(F.col("line")) & ~is_separator(F.col("line"))).select("doc_id", F.col("line_no").alias("_head"))
    # A head may stand one line above, or two with a separator between.
    near = found.select("doc_id", F.col("block").alias("position"), F.explode(F.array(F.col("first_line") - 1, F.col("first_line") - 2)).alias("_head")).join(heads, ["doc_id", "_head"])
    first = near.groupBy("doc_id", "position").agg(F.max("_head").alias("_head"))
    begun = found.select("doc_id", F.col("block").alias("position"), "first_line", "last_line").join(first, ["doc_id", "position"], "left")
    begun = begun.select("doc_id", "position", "last_line", F.coalesce("_head", "first_line").alias("first_line"))
    inside = begun.select("doc_id", "position", F.explode(F.sequence("first_line", "last_line")).alias("line_no"))
    lined = inside.join(whole, ["doc_id", "line_no"]).where((F.trim("line") != "") & ~is_separator(F.col("line")) & ~is_page_noise(F.col("line")) & ~F.col("line").rlike(MARKER))
    split = lined.select("doc_id", "position", "line_no", "page", cells(F.col("line"), dialect(F.col("line"))).alias("_c"))
    tables = split.groupBy("doc_id", "position").agg(F.array_sort(F.collect_list(F.struct("line_no", "_c"))).alias("_r"), F.max(F.size("_c")).alias("n_cols"), F.min("page").alias("page"))
    rows = F.transform("_r", lambda r: padded(r["_c"], F.col("n_cols")))
    before = begun.select("doc_id", "position", F.explode(F.sequence(F.greatest(F.col("first_line") - above, F.lit(1)), F.greatest(F.col("first_line") - 1, F.lit(1)))).alias("line_no"), "first_line").where("line_no < first_line")
    context = before.join(whole, ["doc_id", "line_no"]).where((F.trim("line") != "") & ~F.col("line").rlike(MARKER)).groupBy("doc_id", "position").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"])), "\n").alias("context_before")
    )
    out = tables.join(begun.select("doc_id", "position", "first_line"), ["doc_id", "position"]).join(context, ["doc_id", "position"], "left")
    return out.select("doc_id", "position", rows.alias("rows"), "first_line", "n_cols", "page", F.coalesce("context_before", F.lit("")).alias("context_before"))


def padded(row: Column, width: Column) -> Column:
    """A row of just so many cells: filled up with empty ones, or cut."""
    return F.slice(F.concat(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), width)), F.lit(1), width)


def wide(head: Column, body: Column) -> Column:
    """struct(columns, rows) of one width: that of the head; without any body the head is a row under numbered columns."""
    width = F.size(head)
    numbered = F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: F.concat(F.lit("col_"), i.cast("string")))
    filled = F.transform(body, lambda r: padded(r, width))
    return F.when(F.size(body) > 0, F.struct(head.alias("columns"), filled.alias("rows"))).otherwise(F.struct(numbered.alias("columns"), F.array(head).alias("rows")))


def detected(documents: DataFrame) -> DataFrame:
    """(doc_id, position, rows, n_cols, page, context_before, is_continuation, source) of all tables of each document: its HTML tables, or where it has none its tables of text."""
    marked = html_tables(documents).select("doc_id", "position", "rows", "n_cols", "page", "context_before", "is_continuation", F.lit("html").alias("source"))
    plain = documents.join(marked.select("doc_id").distinct(), "doc_id", "left_anti")
    text = text_tables(plain).select("doc_id", "position", "rows", "n_cols", "page", "context_before", F.lit(False).alias("is_continuation"), F.lit("text").alias("source"))
    return marked.unionByName(text)


def table_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?i)<table"))


# --- HTML tables: the one place where the logic is a walk over nested marks, so it runs in Python over Arrow batches.

_TABLE = re.compile(r"<table\b[^>]*>(.*?)</table>", re.I | re.S)
_ROW = re.compile(r"<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|$)", re.I | re.S)
_CELL = re.compile(r"<t[dh]\b([^>]*)>(.*?)(?=<t[dh]\b|</t[dh]>|</tr>|$)", re.I | re.S)
_SPAN = re.compile(r"\b(row|col)span\s*=\s*[\"']?\s*(\d+)", re.I)
_TAG = re.compile(r"<[^>]+>")
_GROUPED = re.compile(r"\(?\d{1,3}(?:[.,]\d{3})+\)?|(?<![\d.,])-(?![\d.,])")
_PAGE = re.compile(r"(?m)^=+ PAGE (\d+) =+$")
_INTERESTING = re.compile(r"\d[.,]\d{3}")


def clean_cell(text: str) -> str:
    return html.unescape(_TAG.sub(" ", text)).replace("\xa0", " ").strip()


def split_glued(text: str, parts: int) -> list[str] | None:
    """Numbers that stand without a space between them, if there are just so many and nothing else."""
    found = _GROUPED.findall(text)
    if len(found) != parts or "".join(found) != re.sub(r"\s+", "", text):
        return None
    return ["" if f == "-" else f for f in found]


def decode_grid(body: str) -> list[list[str]]:
    """The rectangle of cells of a table's rows.

    A cell over several columns fills the first. Over several rows it is told apart into as many glued numbers, else
    a figure stays in the first row only, else the text is repeated down.
    """
    rows: list[list[str]] = []
    pending: dict[int, list[str]] = {}
    for tr in _ROW.findall(body):
        row: list[str] = []

        def fill(row=row):
            while pending.get(len(row)):
                row.append(pending[len(row)].pop(0))

        for attributes, inner in _CELL.findall(tr):
            fill()
            spans = {k.lower(): max(1, int(v)) for k, v in _SPAN.findall(attributes)}
            text, down = clean_cell(inner), spans.get("row", 1)
            values = [text]
            if down > 1:
                values = split_glued(text, down) or ([text] + [""] * (down - 1) if _INTERESTING.search(text) else [text] * down)
            at = len(row)
            row.append(values[0])
            if down > 1:
                pending[at] = values[1:]
            for k in range(1, spans.get("col", 1)):
                row.append("")
                if down > 1:
                    pending[at + k] = [""] * (down - 1)
        fill()
        if row:
            rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def find_tables(text: str, min_rows: int = 2, min_cols: int = 2, context: int = 400, close: int = 30) -> list[dict]:
    """The tables of a document: position is the line of the tag; tables of one width with nearly nothing between are linked."""
    pages = [(m.start(), int(m.group(1))) for m in _PAGE.finditer(text)]
    found: list[dict] = []
    end_before = 0
    for m in _TABLE.finditer(text):
        grid = decode_grid(m.group(1))
        before = _TAG.sub(" ", text[max(end_before, m.start() - context) : m.start()])
        kept = "\n".join(x.strip() for x in before.split("\n") if x.strip())
        end_before = m.end()
        if len(grid) < min_rows or len(grid[0]) < min_cols:
            continue
        page = None
        for start, number in pages:
            if start > m.start():
                break
            page = number
        found.append(
            {
                "position": text.count("\n", 0, m.start()) + 1, "rows": grid, "char_start": m.start(), "char_end": m.end(), "page": page,
                "context_before": kept, "n_cols": len(grid[0]), "is_continuation": False, "group_position": None, "parent_position": None, "next_position": None,
            }
        )
    for a, b in zip(found, found[1:], strict=False):
        between = _TAG.sub("", _PAGE.sub("", text[a["char_end"] : b["char_start"]])).strip()
        if a["n_cols"] == b["n_cols"] and len(between) < close:
            head = a["group_position"] or a["position"]
            a["group_position"] = head
            b.update(is_continuation=True, group_position=head, parent_position=head)
            a["next_position"] = b["position"]
            b["context_before"] = b["context_before"] or a["context_before"]
    return found


HTML_TABLE = T.StructType(
    [
        T.StructField("doc_id", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("context_before", T.StringType()),
        T.StructField("n_cols", T.IntegerType()), T.StructField("is_continuation", T.BooleanType()), T.StructField("group_position", T.IntegerType()),
        T.StructField("parent_position", T.IntegerType()), T.StructField("next_position", T.IntegerType()),
    ]
)


def html_tables(documents: DataFrame) -> DataFrame:
    """The HTML tables of documents(doc_id, text), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(HTML_TABLE)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [{"doc_id": key, **t} for t in find_tables(text)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return documents.where(F.col("text").contains("<table")).select("doc_id", "text").mapInArrow(run, HTML_TABLE)


def linked(tables: DataFrame, close: int) -> DataFrame:
    """(doc_id, position, head, is_continuation, next_position): tables of one width that begin within `close` characters of the one before."""
    order = Window.partitionBy("doc_id").orderBy("position")
    joins = (F.col("char_start") - F.lag("char_end").over(order) < close) & (F.col("n_cols") == F.lag("n_cols").over(order))
    marked = tables.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    run = F.sum((~F.col("_joins")).cast("int")).over(order)
    marked = marked.withColumn("_run", run)
    chain = Window.partitionBy("doc_id", "_run").orderBy("position")
    return marked.select("doc_id", "position", F.first("position").over(chain).alias("head"), F.col("_joins").alias("is_continuation"), F.lead("position").over(chain).alias("next_position"))


def linked_by_text(tables: DataFrame, documents: DataFrame, close: int = 30) -> DataFrame:
    """As linked(), but by what stands between two tables: fewer than `close` characters once tags and page markers are out."""
    order = Window.partitionBy("doc_id").orderBy("position")
    own = tables.withColumn("_end", F.lag("char_end").over(order)).withColumn("_same", F.col("n_cols") == F.lag("n_cols").over(order))
    between = F.substring("text", F.col("_end") + 1, F.greatest(F.col("char_start") - F.col("_end"), F.lit(0)))
    plain = F.trim(F.regexp_replace(F.regexp_replace(between, r"(?m)^=+ PAGE (\d+) =+$", ""), "<[^>]+>", ""))
    # Only the texts of documents with two such tables in a row are read.
    read = own.where("_same").join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "position", (F.length(F.regexp_replace(plain, r"^\s+|\s+$", "")) < close).alias("_joins"))
    marked = own.join(read, ["doc_id", "position"], "left").withColumn("_joins", F.coalesce("_joins", F.lit(False)))
    marked = marked.withColumn("_run", F.sum((~F.col("_joins")).cast("int")).over(order))
    chain = Window.partitionBy("doc_id", "_run").orderBy("position")
    return marked.select("doc_id", "position", F.first("position").over(chain).alias("head"), F.col("_joins").alias("is_continuation"), F.lead("position").over(chain).alias("next_position"))


def inherited(tables: DataFrame) -> DataFrame:
    """tables with the section that a continuation takes from the table before it."""
    order = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return tables.withColumn("section_or_before", F.when(F.col("is_continuation"), F.last("section", True).over(order)).otherwise(F.col("section")))
