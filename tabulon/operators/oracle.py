"""SQL with the results of the core queries, for an engine that holds the same tables as views."""

from __future__ import annotations

from tabulon.functions.spellings import ASKED, REMARKS, STATED, WORD_PERIODS
from tabulon.functions.text import STOPWORDS
from tabulon.operators.companies import GENERIC, LEGAL_FORMS
from tabulon.operators.extraction import PAGE_NOISE, SECTIONS, TITLE_HINTS
from tabulon.operators.normalization import ITEM_HINTS, SKIP_HINTS
from tabulon.operators.programs import DERIVED


def q(text: str) -> str:
    return text.replace("'", "''")


def fold(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


def tokens(x: str, stop: bool = True) -> str:
    rest = f" AND NOT list_contains([{', '.join(repr(w) for w in STOPWORDS)}], w)" if stop else ""
    return f"list_filter(string_split_regex({fold(x)}, '[^0-9a-z]+'), lambda w: w <> ''{rest})"


def first_match(x: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{q(p)}') THEN '{label}'" for p, label in patterns) + " END"


NUMBER_LIKE = r"^[(-]?[0-9\s.,OoIlSsBZzQgD]+[)%]?$"


def number_steps(source: str, keep: str, cell: str = "cell") -> str:
    """CTEs n1..n4 that parse a cell of `source`; n4 has the columns `keep` and `value`."""
    return f"""
n1 AS (SELECT {keep}, {cell} AS raw, regexp_replace({cell}, '^[ \\t''"*]+|[ \\t''"*]+$', '', 'g') AS t FROM {source}),
n2 AS (SELECT {keep}, raw, CASE WHEN regexp_matches(trim(t), '{NUMBER_LIKE}') AND regexp_matches(t, '[0-9]') THEN translate(t, 'OoQDlI|iSsBZzg', '00001111558229') ELSE t END AS t FROM n1),
n3 AS (SELECT {keep}, raw, regexp_matches(t, '^\\(\\s*.+?\\s*\\)$') AS b, regexp_replace(CASE WHEN regexp_matches(t, '^\\(\\s*.+?\\s*\\)$') THEN trim(regexp_extract(t, '^\\(\\s*(.+?)\\s*\\)$', 1)) ELSE t END, '%\\s*$', '') AS t FROM n2),
n3b AS (SELECT {keep}, raw, b, starts_with(trim(t), '-') AS m, regexp_replace(trim(regexp_replace(trim(t), '^[-+]', '')), '[  ]', '', 'g') AS t FROM n3),
n4 AS (SELECT {keep}, CASE WHEN regexp_matches(t, '^[0-9.,\\s]+$') AND NOT (lower(trim(raw)) IN ('', '-', '--', 'n/a', 'na', 'none', 'null', '..', '...')) THEN
  (CASE WHEN b <> m THEN -1 ELSE 1 END) * TRY_CAST(CASE
    WHEN contains(t, '.') AND contains(t, ',') AND strpos(reverse(t), '.') < strpos(reverse(t), ',') THEN replace(t, ',', '')
    WHEN contains(t, '.') AND contains(t, ',') THEN replace(replace(t, '.', ''), ',', '.')
    WHEN contains(t, ',') THEN CASE WHEN length(t) - length(replace(t, ',', '')) > 1 OR (length(split_part(t, ',', -1)) = 3 AND split_part(t, ',', 1) <> '') THEN replace(t, ',', '') ELSE replace(t, ',', '.') END
    WHEN contains(t, '.') THEN CASE WHEN length(t) - length(replace(t, '.', '')) > 1 OR (length(split_part(t, '.', -1)) = 3 AND split_part(t, '.', 1) <> '') THEN replace(t, '.', '') ELSE t END
    ELSE t END AS DOUBLE) END AS value FROM n3b)"""


def cells(name: str, rows: str = "rows") -> str:
    return f"""
once AS (SELECT DISTINCT table_ref, {rows} AS rows FROM {name}),
r AS (SELECT table_ref, unnest(rows) AS row, generate_subscripts(rows, 1) - 1 AS row_idx FROM once),
cells AS (SELECT table_ref, CAST(row_idx AS INTEGER) AS row_idx, unnest(row) AS cell, CAST(generate_subscripts(row, 1) - 1 AS INTEGER) AS col_idx FROM r)"""


LATEST = """
catalog AS (SELECT * FROM table_catalog QUALIFY row_number() OVER (PARTITION BY table_ref ORDER BY ingested_at DESC) = 1),
asked AS (SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"""
CANDIDATES = "c AS (SELECT DISTINCT qid, table_ref, doc_id, rank, score, bm25_score, CASE WHEN dense_kind = 'l2' THEN -dense_score ELSE dense_score END AS dense FROM candidates)"
ADMITTED = """
pairs AS (SELECT DISTINCT a.id, c.table_ref,
  CASE WHEN (len(a.years) = 0 OR list_contains(a.years, c.year)) AND (a.report_type IS NULL OR coalesce(a.report_type = c.report_type, FALSE)) THEN 1
       WHEN len(a.years) > 0 AND len(list_filter(a.years, lambda y: c.year BETWEEN y AND y + 2)) > 0 AND (a.report_type IS NULL OR coalesce(a.report_type = c.report_type, FALSE)) THEN 2
       WHEN len(a.years) = 0 OR list_contains(a.years, c.year) THEN 3
       WHEN len(a.years) > 0 AND len(list_filter(a.years, lambda y: c.year BETWEEN y AND y + 2)) > 0 THEN 4 ELSE 5 END AS level
  FROM (SELECT id, unnest(tickers) AS ticker, years, report_type FROM asked) a JOIN catalog c ON upper(a.ticker) = upper(c.ticker)),
lv AS (SELECT id, table_ref, min(level) AS level FROM pairs GROUP BY ALL),
admitted AS (SELECT lv.* FROM lv JOIN (SELECT id, min(level) AS level FROM lv GROUP BY id) USING (id, level))"""
YEARS = "list_transform(regexp_extract_all(regexp_replace(regexp_replace({x}, '[0-9]{{5,}}', ' ', 'g'), '([0-9]{{4}})', ' \\1 ', 'g'), ' ((19|20)[0-9]{{2}}) ', 1), lambda y: CAST(y AS INTEGER))"
LINES = """
docs AS (SELECT DISTINCT doc_id, text FROM raw_documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no FROM docs)"""
TABULAR = LINES + f""",
d1 AS (SELECT *, length(line) - length(replace(line, '|', '')) AS pipes, len(list_filter(string_split_regex(trim(line), ' {{2,}}'), lambda c: c <> '')) AS gaps FROM lines),
d2 AS (SELECT *, CASE WHEN pipes >= 2 THEN 'pipe' WHEN contains(line, chr(9)) THEN 'tab' WHEN gaps >= 2 THEN 'whitespace' END AS dialect FROM d1),
d3 AS (SELECT *, list_filter(list_transform(CASE dialect WHEN 'pipe' THEN string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|') WHEN 'tab' THEN string_split(line, chr(9)) ELSE string_split_regex(trim(line), ' {{2,}}') END, lambda x: trim(x)), lambda x: x <> '') AS filled FROM d2 WHERE dialect IS NOT NULL),
tabular AS (SELECT doc_id, line_no, line, dialect FROM d3 WHERE len(filled) >= 2 AND len(list_filter(filled, lambda c: regexp_matches(trim(c), '{NUMBER_LIKE}') AND regexp_matches(c, '[0-9]'))) > 0
  AND NOT regexp_matches(line, '(?i)^\\s*(trang\\s*[0-9]+|page\\s*[0-9]+|-\\s*[0-9]+\\s*-|[0-9]+\\s*/\\s*[0-9]+)\\s*$') AND NOT regexp_matches(line, '^[\\s|:+=-]*-[\\s|:+=-]*$') AND NOT contains(line, '<table'))"""
YEARLY = "yearly AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_extendedprice) AS gross, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY ALL)"
EVALUATED = LATEST + f""", {CANDIDATES},
rd AS (SELECT DISTINCT ON (doc_id) doc_id, ticker, year FROM raw_documents),
gd AS (SELECT a.id, list_sort(list(DISTINCT rd.doc_id)) AS gold_docs FROM (SELECT id, unnest(tickers) AS ticker, years FROM asked) a JOIN rd ON rd.ticker = a.ticker AND list_contains(a.years, rd.year) GROUP BY a.id),
ga AS (SELECT question_id AS id, arg_min(raw_value / coalesce(divisor, 1.0), answer_id) AS gold_answer, arg_min(value, answer_id) AS answer FROM normalized_answers GROUP BY 1),
pd AS (SELECT qid AS id, list(doc_id ORDER BY rank, table_ref) AS docs FROM c WHERE rank <= 10 GROUP BY 1),
e0 AS (SELECT a.id, coalesce(gold_docs, []) AS g, coalesce(docs, []) AS p, gold_answer, answer FROM (SELECT DISTINCT id FROM asked) a LEFT JOIN gd USING (id) LEFT JOIN ga USING (id) LEFT JOIN pd USING (id)),
e1 AS (SELECT *, list_distinct(p) AS pu, len(list_intersect(list_distinct(p), g)) AS n FROM e0),
e2 AS (SELECT *, CASE WHEN len(g) = 0 THEN CASE WHEN len(pu) = 0 THEN 1.0 ELSE 0.0 END WHEN len(pu) = 0 THEN 0.0 ELSE n / len(pu) END AS doc_precision,
  CASE WHEN len(g) = 0 THEN 1.0 WHEN len(pu) = 0 THEN 0.0 ELSE n / len(g) END AS doc_recall FROM e1),
e AS (SELECT id, answer, gold_answer, len(p) > 0 AS found_any, doc_precision, doc_recall, CASE WHEN 4 * doc_precision + doc_recall = 0 THEN 0.0 ELSE 5 * doc_precision * doc_recall / (4 * doc_precision + doc_recall) END AS doc_f2,
  coalesce(1.0 / list_min(list_filter(list_transform(range(1, least(len(p), 5) + 1), lambda i: CASE WHEN list_contains(g, p[i]) THEN i END), lambda i: i IS NOT NULL)), 0.0) AS doc_mrr,
  CASE WHEN answer IS NULL AND gold_answer IS NULL THEN TRUE WHEN answer IS NULL OR gold_answer IS NULL THEN FALSE WHEN isnan(answer) OR isnan(gold_answer) THEN FALSE
    ELSE abs(answer - gold_answer) <= 1e-6 OR (gold_answer <> 0 AND abs(answer - gold_answer) <= 0.01 * abs(gold_answer)) END AS answer_correct FROM e2)"""
FLAT = fold("question")
BM25 = """
tf AS (SELECT {id}, term, count(*) AS tf, any_value(len) AS len FROM (SELECT {id}, len(t) AS len, unnest(t) AS term FROM words) GROUP BY {id}, term),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM words),
df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term, n),
sc AS (SELECT query, {id}, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM (SELECT DISTINCT query, unnest(t) AS term FROM asking) JOIN tf USING (term) JOIN df USING (term), st {restrict} GROUP BY query, {id})"""
PHRASES = """
list_concat(list_filter(CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END, lambda p: length(p) >= 5),
            list_filter(CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) ELSE [] END, lambda p: length(p) >= 8))"""
FALLBACK = "coalesce(nullif(trim(card), ''), concat_ws(' ', ticker, CAST(year AS VARCHAR), report_type, section, title, unit))"
CUT = f"""{CANDIDATES},
sh AS (SELECT id AS qid, CASE WHEN len(tickers) >= 2 THEN least(24, len(tickers) * least(2, greatest(1, len(years)))) WHEN len(years) >= 2 THEN least(24, greatest(least(2, len(years) * 2), len(years) * 2)) WHEN needs_derived THEN 3 ELSE 2 END AS budget, tickers FROM asked),
f AS (SELECT qid, arg_min(score, rank) AS first FROM c GROUP BY qid),
cut AS (SELECT c.qid, table_ref, rank FROM c JOIN sh USING (qid) JOIN f USING (qid) WHERE rank <= budget AND (score >= 0.35 * first OR rank <= 1))"""


def _by_magnitude() -> str:
    a = "abs(raw_value)"
    return f"""CASE unit WHEN 'ty_dong' THEN CASE WHEN {a} >= 1e8 THEN 1e9 WHEN {a} >= 10 THEN 1e3 ELSE 1.0 END
      WHEN 'trieu_dong' THEN CASE WHEN {a} >= 1e6 THEN 1e6 ELSE 1.0 END WHEN 'nghin_ty_dong' THEN CASE WHEN {a} >= 1e11 THEN 1e12 WHEN {a} >= 1e6 THEN 1e3 ELSE 1.0 END
      WHEN 'tram_ty_dong' THEN CASE WHEN {a} >= 1e10 THEN 1e11 ELSE 1.0 END WHEN 'nghin_dong' THEN CASE WHEN {a} >= 1e3 THEN 1e3 ELSE 1.0 END ELSE 1.0 END"""


_D = r"(^|[^0-9])([0-9]{1,2})\s*[/.-]\s*([0-9]{1,2})\s*[/.-]\s*((19|20)[0-9]{2})($|[^0-9])"
_W = r"([0-9]{1,2}) thang ([0-9]{1,2}) nam ((19|20)[0-9]{2})"
_RANGE = r"((?:19|20)[0-9]{2})(\s*)(den|-|–|toi)\s*(?:nam)?\s*((?:19|20)[0-9]{2})"
_UNIT_OF = "replace(" + fold("concat_ws(' ', title, context_before)") + ", 'cong ty', 'cong_ty')"

#: From h(table_ref, y, header, col_idx) to p4(table_ref, col_idx, year, period, source_date).
PERIOD_STEPS = f"""p1 AS (SELECT *, trim(header) AS t, {fold('header')} AS f, {YEARS.format(x='trim(header)')} AS ys FROM h),
p2 AS (SELECT *, regexp_matches(t, '{_D}') AS dated, regexp_matches(f, '{_W}') AS worded FROM p1 WHERE t <> '' AND length(t) <= 60 AND NOT regexp_matches(f, '{"|".join(REMARKS)}') AND len(ys) <= 1),
p3 AS (SELECT *, TRY_CAST(CASE WHEN dated THEN regexp_extract(t, '{_D}', 2) ELSE regexp_extract(f, '{_W}', 1) END AS INTEGER) AS dd, TRY_CAST(CASE WHEN dated THEN regexp_extract(t, '{_D}', 3) ELSE regexp_extract(f, '{_W}', 2) END AS INTEGER) AS mm,
  TRY_CAST(CASE WHEN dated THEN regexp_extract(t, '{_D}', 4) ELSE regexp_extract(f, '{_W}', 3) END AS INTEGER) AS yy,
  CASE WHEN dated THEN regexp_replace(regexp_extract(t, '{_D}', 0), '^[^0-9]+|[^0-9]+$', '', 'g') ELSE regexp_extract(f, '{_W}', 0) END AS src FROM p2),
p4 AS (SELECT table_ref, col_idx, CASE WHEN (dated OR worded) AND dd = 1 AND mm = 1 THEN yy - 1 WHEN dated OR worded THEN yy WHEN len(ys) = 1 THEN ys[1]
    {" ".join(f"WHEN regexp_matches(f, '{q(p)}') THEN y + {s}" for p, s, _ in WORD_PERIODS)} END AS year,
  CASE WHEN (dated OR worded) AND NOT (dd BETWEEN 1 AND 31 AND mm BETWEEN 1 AND 12) THEN 'unknown' WHEN (dated OR worded) AND dd = 31 AND mm = 12 THEN 'closing' WHEN (dated OR worded) AND dd = 1 AND mm = 1 THEN 'opening'
    WHEN dated OR worded THEN 'point_in_time' WHEN len(ys) = 1 THEN 'annual' {" ".join(f"WHEN regexp_matches(f, '{q(p)}') THEN '{x}'" for p, _, x in WORD_PERIODS)} END AS period,
  CASE WHEN dated OR worded THEN src END AS source_date FROM p3)"""
ROLES = f"""
{cells('extracted_tables')}, st0 AS (SELECT table_ref, row_idx, col_idx, trim(coalesce(cell, '')) AS cell FROM cells), {number_steps('st0', 'table_ref, row_idx, col_idx, cell')},
st AS (SELECT table_ref, col_idx, count(*) FILTER (cell <> '') AS n, count(*) FILTER (cell <> '' AND value IS NOT NULL) AS numeric, count(*) FILTER (regexp_full_match(cell, '[0-9]{{2,3}}[a-z]?')) AS coded,
  count(*) FILTER (cell <> '' AND value IS NULL) AS texts, round(avg(length(cell)) FILTER (cell <> ''), 4) AS mean_length FROM n4 GROUP BY table_ref, col_idx),
o1 AS (SELECT DISTINCT ON (table_ref) table_ref, doc_id, header_rows[1] AS heads FROM extracted_tables), ry AS (SELECT DISTINCT ON (doc_id) doc_id, year AS y FROM raw_documents),
h AS (SELECT table_ref, y, unnest(heads) AS header, CAST(generate_subscripts(heads, 1) - 1 AS INTEGER) AS col_idx FROM o1 LEFT JOIN ry USING (doc_id)),
{PERIOD_STEPS},
ro1 AS (SELECT h.table_ref, h.col_idx, h.header, {fold('h.header')} AS flat, p4.year, p4.period, p4.source_date, p4.period IS NOT NULL AS dated, st.* EXCLUDE (table_ref, col_idx) FROM h JOIN st USING (table_ref, col_idx) LEFT JOIN p4 USING (table_ref, col_idx)),
ro2 AS (SELECT *, texts / greatest(n, 1) * least(coalesce(mean_length, 0) / 10, 1.0) AS texty FROM ro1),
ro3 AS (SELECT *, CASE WHEN dated THEN -1.0 WHEN regexp_matches(flat, '{"|".join(ITEM_HINTS)}') THEN 10.0 WHEN texty > 0.3 THEN texty ELSE -1.0 END AS score, row_number() OVER (PARTITION BY table_ref, year, period ORDER BY col_idx) AS nth FROM ro2),
ro4 AS (SELECT *, score > 0 AND row_number() OVER (PARTITION BY table_ref ORDER BY score DESC, col_idx) = 1 AS is_item FROM ro3),
roles AS (SELECT table_ref, col_idx, header, CASE WHEN is_item THEN 'item' WHEN dated THEN CASE WHEN nth = 1 THEN 'period' ELSE 'skip' END WHEN regexp_matches(flat, '\\b(ma|code)\\b') OR (n >= 3 AND coded / n > 0.7) THEN 'code'
  WHEN regexp_matches(flat, '{SKIP_HINTS}') THEN 'skip' WHEN n > 0 AND numeric / n >= 0.6 THEN 'category' ELSE 'skip' END AS role, year, period, source_date FROM ro4)"""


SQL: dict[str, str] = {
    "fold_text": f"SELECT doc_id, {fold('text')} AS folded FROM documents",
    "token_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS term FROM documents) GROUP BY term",
    "question_phrases": f"WITH a AS (SELECT DISTINCT id, {tokens('question')} AS t FROM questions) SELECT id, array_to_string({PHRASES}, '|') AS phrases FROM a",
    "table_names": f"""WITH a AS (SELECT DISTINCT table_ref, doc_id, position, title FROM table_catalog)
SELECT table_ref, coalesce(nullif(substr(regexp_replace(regexp_replace({fold('title')}, '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80), ''), 'untitled') AS slug,
  regexp_replace(regexp_replace(doc_id, '[^0-9A-Za-z._-]+', '_', 'g'), '^_+|_+$', '', 'g') || '_table_' || position || '.csv' AS file FROM a""",
    "parsed_numbers": f"WITH {cells('extracted_tables')}, {number_steps('cells', 'table_ref, row_idx, col_idx')} SELECT table_ref, row_idx, col_idx, value FROM n4 WHERE value IS NOT NULL",
    "context_units": f"""WITH a AS (SELECT DISTINCT table_ref, {_UNIT_OF} AS f FROM extracted_tables),
b AS (SELECT table_ref, {first_match('f', STATED)} AS unit FROM a)
SELECT table_ref, unit, CASE unit WHEN 'nghin_dong' THEN 1e3 WHEN 'trieu_dong' THEN 1e6 WHEN 'ty_dong' THEN 1e9 ELSE 1.0 END AS scale FROM b""",
    "column_periods": f"""WITH once AS (SELECT DISTINCT ON (table_ref) table_ref, doc_id, header_rows[1] AS heads FROM extracted_tables),
h AS (SELECT table_ref, TRY_CAST(list_last(regexp_extract_all(doc_id, '(19|20)[0-9]{{2}}')) AS INTEGER) AS y, unnest(heads) AS header, CAST(generate_subscripts(heads, 1) - 1 AS INTEGER) AS col_idx FROM once),
{PERIOD_STEPS}
SELECT * FROM p4 WHERE period IS NOT NULL AND year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY table_ref, year, period ORDER BY col_idx) = 1""",
    "question_constraints": f"""WITH a AS (SELECT DISTINCT id, question, {FLAT} AS f FROM questions),
b AS (SELECT *, TRY_CAST(regexp_extract(f, '{_RANGE}', 1) AS INTEGER) AS lo, TRY_CAST(regexp_extract(f, '{_RANGE}', 4) AS INTEGER) AS hi FROM a)
SELECT id, {first_match('f', [(r"dau\s*(nam|ky)|ngay\s*0?1\s*[/.-]\s*0?1", 'opening'), (r"cuoi\s*(nam|ky)|ngay\s*31\s*[/.-]\s*12", 'closing'), (r"trong\s*nam|ca\s*nam|trong\s*ky", 'annual')])} AS period,
  coalesce({first_match('f', ASKED)}, 'none') AS unit,
  array_to_string(CASE WHEN lo IS NOT NULL AND abs(hi - lo) <= 15 THEN range(least(lo, hi), greatest(lo, hi) + 1) ELSE list_sort(list_distinct({YEARS.format(x='question')})) END, ',') AS years,
  {first_match('f', [("cong ty me|rieng le|bao cao rieng|bctc rieng|cua me|cua rieng", 'separate'), ("hop nhat|toan tap doan|bctc hn|bctchn", 'consolidated')])} AS type FROM b""",
    "question_tickers": """WITH a AS (SELECT DISTINCT id, question, regexp_extract_all(question, '\\(([A-Z][A-Z0-9]{2,4})\\)', 1) AS t, list_filter(string_split_regex(question, '[^A-Za-z0-9]+'), lambda w: regexp_full_match(w, '[A-Z][A-Z0-9]{2,4}')) AS w FROM questions),
b AS (SELECT id, unnest(list_distinct(CASE WHEN len(t) > 0 THEN t ELSE w END)) AS ticker FROM a) SELECT id, ticker FROM b WHERE ticker IN (SELECT ticker FROM table_catalog WHERE ticker IS NOT NULL)""",
    "question_shapes": f"""WITH {LATEST}, f AS (SELECT *, {fold('question')} AS fq FROM asked)
SELECT id, regexp_matches(fq, 'so voi|so sanh|cao hon|thap hon|chenh lech|hon kem') AS compares, regexp_matches(fq, 'tong|trung binh|binh quan|cao nhat|thap nhat|lon nhat') AS aggregates,
  trim(concat_ws(' ', question, replace(array_to_string(coalesce(metrics, []), ' '), '_', ' '), array_to_string(coalesce(tickers, []), ' '), array_to_string(coalesce(years, []), ' '))) AS expanded FROM f""",
    "inherited_sections": """WITH a AS (SELECT DISTINCT ON (table_ref) table_ref, doc_id, position, section, is_continuation FROM extracted_tables)
SELECT table_ref, CASE WHEN is_continuation THEN last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position) ELSE section END AS section FROM a""",
    "answers_in_asked_unit": f"""WITH a AS (SELECT DISTINCT id, {FLAT} AS f FROM questions),
b AS (SELECT answer_id, raw_value, coalesce({first_match('f', ASKED)}, 'none') AS unit FROM (SELECT DISTINCT answer_id, question_id, raw_value FROM normalized_answers) JOIN a ON id = question_id),
x AS (SELECT *, raw_value / ({_by_magnitude()}) AS v FROM b)
SELECT answer_id, unit, CASE WHEN unit NOT IN ('nghin_dong', 'nghin_ty_dong') AND round(v, 2) = 0 AND v <> 0 THEN round(v, 4) ELSE round(v, 2) END AS answer,
  CASE unit WHEN 'nghin_dong' THEN 1e3 WHEN 'trieu_dong' THEN 1e6 WHEN 'ty_dong' THEN 1e9 WHEN 'tram_ty_dong' THEN 1e11 WHEN 'nghin_ty_dong' THEN 1e12 ELSE 1.0 END AS divisor FROM x""",
    "document_metadata": """WITH a AS (SELECT DISTINCT path, text FROM raw_documents),
b AS (SELECT path, text, regexp_extract(path, '([^/]+?)(_extracted)?\\.[A-Za-z0-9]+$', 1) AS doc_id, list_reverse(string_split(path, '/')[:-2]) AS f FROM a)
SELECT doc_id, path, coalesce(list_filter(f, lambda p: regexp_full_match(p, '[A-Z][A-Z0-9]{2,4}'))[1], nullif(regexp_extract(doc_id, '^([A-Z0-9]{3,5})_', 1), '')) AS ticker,
  coalesce(CAST(list_filter(f, lambda p: regexp_full_match(p, '(19|20)[0-9]{2}'))[1] AS INTEGER), TRY_CAST(list_last(regexp_extract_all(doc_id, '(19|20)[0-9]{2}')) AS INTEGER)) AS year,
  CASE WHEN regexp_matches(lower(doc_id), 'separate|rieng|_me|cong_ty_me|parent') THEN 'separate' ELSE 'consolidated' END AS report_type, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS n_lines FROM b""",
    "catalog_inferred": """WITH a AS (SELECT DISTINCT table_ref, doc_id FROM table_catalog)
SELECT table_ref, nullif(regexp_extract(upper(doc_id), '^([A-Z0-9]{3,5})_', 1), '') AS ticker, TRY_CAST(list_last(regexp_extract_all(doc_id, '(19|20)[0-9]{2}')) AS INTEGER) AS year,
  CASE WHEN regexp_matches(lower(doc_id), 'separate|rieng|_me|cong_ty_me|parent') THEN 'separate' ELSE 'consolidated' END AS report_type FROM a""",
    "catalog_latest": f"WITH {LATEST} SELECT table_ref, doc_id, position, title, unit, ingested_at FROM catalog",
    "catalog_stream": f"WITH {LATEST} SELECT table_ref, doc_id, position, title, unit, ingested_at FROM catalog",
    "table_counts": "SELECT DISTINCT doc_id, len(regexp_extract_all(text, '(?i)<table')) AS n FROM raw_documents",
    "table_pages": f"""WITH {LINES}, m AS (SELECT *, TRY_CAST(regexp_extract(line, '^===== PAGE ([0-9]+) =====$', 1) AS INTEGER) AS p FROM lines)
SELECT doc_id, line_no, page FROM (SELECT doc_id, line_no, line, last_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS page FROM m) WHERE contains(line, '<table')""",
    "dialect_votes": f"WITH {TABULAR}, v AS (SELECT doc_id, dialect, count(*) AS n FROM tabular GROUP BY ALL) SELECT doc_id, dialect, n FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, dialect) = 1",
    "table_blocks": f"""WITH {TABULAR}, m AS (SELECT doc_id, line_no, CASE WHEN coalesce(line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) > 3, TRUE) THEN 1 ELSE 0 END AS b FROM tabular),
r AS (SELECT doc_id, line_no, sum(b) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM m), g AS (SELECT doc_id, run, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_rows FROM r GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS INTEGER) AS block, first_line, last_line, n_rows FROM g""",
    "linked_tables": """WITH a AS (SELECT DISTINCT doc_id, position, char_start, char_end, n_cols FROM html_tables),
j AS (SELECT *, coalesce(char_start - lag(char_end) OVER w < 2000 AND n_cols = lag(n_cols) OVER w, FALSE) AS joins FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
r AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY position) AS run FROM j)
SELECT doc_id, position, first_value(position) OVER w AS head, joins AS is_continuation, lead(position) OVER w AS next_position FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY position)""",
    "table_sections": f"""WITH a AS (SELECT DISTINCT table_ref, title, context_before FROM extracted_tables),
b AS (SELECT table_ref, {fold("concat_ws(chr(10), title, context_before)")} AS f, list_filter(string_split(context_before, chr(10)), lambda x: trim(x) <> '') AS l FROM a),
h AS (SELECT *, list_filter(l, lambda x: regexp_matches({fold('x')}, '{"|".join(TITLE_HINTS)}')) AS hinted FROM b)
SELECT table_ref, {first_match('f', SECTIONS)} AS section, coalesce(trim(list_last(list_filter(hinted, lambda x: NOT regexp_matches({fold('x')}, '^[(]?(don vi|dvt|unit)')))), trim(list_last(hinted)), trim(list_last(l))) AS title FROM h""",
    "header_rows": f"""WITH {cells('html_tables')}, s AS (SELECT table_ref, row_idx, round(avg(CASE WHEN regexp_matches(trim(cell), '^[0-9.,()\\s-]+$') THEN 1.0 ELSE 0.0 END) - CASE WHEN bool_or(regexp_matches(cell, '(19|20)[0-9]{{2}}')) THEN 0.3 ELSE 0.0 END, 9) AS score FROM cells WHERE row_idx < 3 GROUP BY ALL)
SELECT table_ref, row_idx FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY table_ref ORDER BY score, row_idx) = 1) WHERE score < 0.6""",
    "column_names": f"""WITH {cells('html_tables')}, p AS (SELECT table_ref, col_idx, trim(regexp_replace(coalesce(cell, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM cells WHERE row_idx = 0), b AS (SELECT table_ref, col_idx, CASE WHEN t = '' THEN 'col_' || col_idx ELSE t END AS base FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY table_ref, base ORDER BY col_idx) - 1 AS k FROM b) SELECT table_ref, col_idx, CASE WHEN k > 0 THEN base || '_' || k ELSE base END AS name FROM n""",
    "column_statistics": f"""WITH {cells('extracted_tables')}, t AS (SELECT table_ref, row_idx, col_idx, trim(coalesce(cell, '')) AS cell FROM cells), {number_steps('t', 'table_ref, row_idx, col_idx, cell')}
SELECT table_ref, col_idx, CAST(count(*) FILTER (cell <> '') AS BIGINT) AS n, CAST(count(*) FILTER (cell <> '' AND value IS NOT NULL) AS BIGINT) AS numeric, CAST(count(*) FILTER (regexp_full_match(cell, '[0-9]{{2,3}}[a-z]?')) AS BIGINT) AS coded,
  CAST(count(*) FILTER (cell <> '' AND value IS NULL) AS BIGINT) AS texts, round(avg(length(cell)) FILTER (cell <> ''), 4) AS mean_length FROM n4 GROUP BY table_ref, col_idx""",
    "ambiguous_facts": f"""WITH {cells('extracted_tables')}, v AS (SELECT * FROM cells WHERE col_idx >= 1), {number_steps('v', 'table_ref, row_idx, col_idx')},
i AS (SELECT table_ref, row_idx, trim(cell) AS item FROM cells WHERE col_idx = 0)
SELECT item, col_idx AS year, 'annual' AS period, count(DISTINCT value) AS n_values FROM n4 JOIN i USING (table_ref, row_idx) WHERE value IS NOT NULL GROUP BY item, col_idx HAVING count(DISTINCT value) > 1""",
    "table_cards": f"""WITH {LATEST}, {cells('extracted_tables')}, i AS (SELECT table_ref, trim(cell) AS item, min(row_idx) AS o FROM cells WHERE col_idx = 0 AND trim(cell) <> '' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY table_ref ORDER BY o, item) AS k FROM i), l AS (SELECT table_ref, string_agg(item, '; ' ORDER BY k) AS items FROM k WHERE k <= 30 GROUP BY table_ref)
SELECT table_ref, concat_ws(chr(10), 'ticker: ' || nullif(ticker, ''), 'year: ' || year, 'type: ' || nullif(report_type, ''), 'section: ' || nullif(section, ''), CASE WHEN trim(title) <> '' THEN 'title: ' || title END, CASE WHEN trim(unit) <> '' THEN 'unit: ' || unit END, 'items: ' || items) AS card FROM catalog LEFT JOIN l USING (table_ref)""",
    "fallback_cards": f"WITH {LATEST} SELECT table_ref, {FALLBACK} AS card FROM catalog",
    "term_weights": f"""WITH t AS (SELECT DISTINCT doc_id, unnest({tokens('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t, n GROUP BY term, n""",
    "document_lengths": f"SELECT doc_id, coalesce(len({tokens('text')}), 0) AS n_terms FROM documents",
    "bm25_top": f"""WITH words AS (SELECT doc_id, {tokens('text')} AS t FROM documents WHERE text IS NOT NULL), asking AS (SELECT DISTINCT surface AS query, {tokens('surface')} AS t FROM metric_terms), {BM25.format(id='doc_id', restrict='')}
SELECT query, doc_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10""",
    "dense_ip": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id, round(list_inner_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 100 = 0)
SELECT query, vec_id, score FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY p.score DESC, vec_id) <= 10""",
    "dense_l2": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id, round(2 * list_inner_product(a.v, b.v) - list_inner_product(a.v, a.v) - list_inner_product(b.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 100 = 0)
SELECT query, vec_id, score FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY p.score DESC, vec_id) <= 10""",
    "rrf_fusion": f"""WITH {CANDIDATES}, u AS (SELECT qid, table_ref, 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY bm25_score DESC, table_ref)) AS s FROM c WHERE bm25_score IS NOT NULL
UNION ALL SELECT qid, table_ref, 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY dense DESC, table_ref)) FROM c WHERE dense IS NOT NULL) SELECT qid, table_ref, round(sum(s), 9) AS score FROM u GROUP BY ALL""",
    "hybrid_search": f"""WITH {LATEST}, {ADMITTED}, {CANDIDATES}, words AS (SELECT table_ref, {tokens(FALLBACK)} AS t FROM catalog), asking AS (SELECT id AS query, {tokens('question')} AS t FROM asked),
{BM25.format(id='table_ref', restrict='WHERE (query, table_ref) IN (SELECT (id, table_ref) FROM admitted)')},
sp AS (SELECT query AS qid, table_ref, row_number() OVER (PARTITION BY query ORDER BY score DESC, table_ref) AS k FROM sc WHERE score > 0 QUALIFY k <= 150), de AS (SELECT qid, table_ref, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, table_ref) AS k FROM c WHERE dense IS NOT NULL QUALIFY k <= 150),
fu AS (SELECT qid, table_ref, round(sum(1.0 / (60 + k)), 9) AS score FROM (SELECT * FROM sp UNION ALL SELECT * FROM de) GROUP BY ALL), t AS (SELECT qid, table_ref, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, table_ref) AS INTEGER) AS rank, score FROM fu QUALIFY rank <= 20)
SELECT qid, t.table_ref, rank, score, section FROM t LEFT JOIN catalog USING (table_ref)""",
    "content_rerank": f"""WITH {LATEST}, {CANDIDATES}, k AS (SELECT id AS qid, {tokens('question')} AS t FROM asked), qq AS (SELECT qid, list_distinct({PHRASES}) AS p, list_distinct(list_filter(t, lambda w: length(w) >= 2)) AS w FROM k),
d AS (SELECT table_ref, {fold(FALLBACK)} AS f FROM catalog), s AS (SELECT qid, table_ref, 6 * len(list_filter(p, lambda x: contains(f, x))) + 2 * len(list_filter(w, lambda x: contains(f, x))) AS content, score, rank AS was FROM c JOIN qq USING (qid) JOIN d USING (table_ref))
SELECT qid, table_ref, CASE WHEN was <= 35 THEN CAST(content AS INTEGER) END AS content, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN was <= 35 THEN 0 ELSE 1 END, CASE WHEN was <= 35 THEN content * 10 + score END DESC, CASE WHEN was <= 35 THEN score END DESC, CASE WHEN was > 35 THEN was END, table_ref) AS INTEGER) AS rank FROM s""",
    "adaptive_cut": f"WITH {LATEST}, {CUT} SELECT qid, table_ref, rank FROM cut",
    "coverage_repair": f"""WITH {LATEST}, {CUT}, pool AS (SELECT c.qid, c.table_ref, c.rank, catalog.ticker FROM c JOIN catalog USING (table_ref)), need AS (SELECT DISTINCT qid, unnest(tickers) AS ticker FROM sh),
miss AS (SELECT * FROM need EXCEPT SELECT pool.qid, ticker FROM pool JOIN cut USING (qid, table_ref)), best AS (SELECT qid, ticker, arg_min(table_ref, rank) AS table_ref FROM pool JOIN miss USING (qid, ticker) GROUP BY ALL)
SELECT qid, table_ref FROM cut UNION SELECT qid, table_ref FROM best""",
    "linked_expansion": f"""WITH {LATEST}, {CUT}, pool AS (SELECT c.qid, c.table_ref, group_id, parent_table_ref AS pa, next_table_ref AS ne FROM c JOIN catalog USING (table_ref)), l AS (SELECT pool.* FROM pool JOIN cut USING (qid, table_ref))
SELECT qid, table_ref FROM cut UNION SELECT l.qid, p.table_ref FROM l JOIN pool p ON l.qid = p.qid AND (l.group_id = p.group_id OR l.pa = p.table_ref OR l.ne = p.table_ref OR l.table_ref = p.pa OR l.table_ref = p.ne)""",
    "lookup_largest": """WITH r AS (SELECT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_mktsegment, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) = 1)
SELECT c_mktsegment, year, CASE WHEN round(v / 1e6, 2) = 0 AND v <> 0 THEN round(v / 1e6, 4) ELSE round(v / 1e6, 2) END AS millions FROM r""",
    "ratio_by_nation": f"WITH {YEARLY} SELECT n_name, year, round(sum(net) / sum(gross) * 100, 4) AS margin FROM yearly JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL",
    "growth_by_nation": f"""WITH {YEARLY}, s AS (SELECT s_nationkey, year, sum(net) AS net FROM yearly JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT s_nationkey, year, round((net - lag(net) OVER w) / abs(lag(net) OVER w) * 100, 4) AS growth, CASE WHEN year > first_value(year) OVER w THEN round((power(net / first_value(net) OVER w, 1.0 / (year - first_value(year) OVER w)) - 1) * 100, 4) END AS cagr FROM s WINDOW w AS (PARTITION BY s_nationkey ORDER BY year)""",
    "best_year": f"WITH {YEARLY} SELECT l_suppkey, CAST(year AS DOUBLE) AS best_year, round(net, 2) AS net FROM yearly QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY round(yearly.net, 2) DESC, year) = 1",
    "peer_share": f"""WITH {YEARLY}, r AS (SELECT year, round(net / gross * 100, 6) AS margin, round(net, 2) AS net FROM yearly), m AS (SELECT year, median(margin) AS med FROM r GROUP BY year)
SELECT r.year, round(any_value(med), 4) AS median, round(sum(CASE WHEN margin > med THEN net ELSE 0 END) / sum(net) * 100, 4) AS share FROM r JOIN m USING (year) GROUP BY r.year""",
    "opening_balances": """WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT o_custkey, year, round(coalesce(sum(v) OVER (PARTITION BY o_custkey ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS opening, round(sum(v) OVER (PARTITION BY o_custkey ORDER BY year ROWS UNBOUNDED PRECEDING), 2) AS closing FROM y""",
    "plan_ratio": "SELECT c_mktsegment AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice) * 100, 4) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "eval_questions": f"WITH {EVALUATED} SELECT id, round(doc_precision, 6) AS doc_precision, round(doc_recall, 6) AS doc_recall, round(doc_f2, 6) AS doc_f2, round(doc_mrr, 6) AS doc_mrr, answer_correct FROM e",
    "eval_summary": f"WITH {EVALUATED} SELECT count(*) AS n, round(avg(doc_precision), 6) AS precision, round(avg(doc_recall), 6) AS recall, round(avg(doc_f2), 6) AS f2, round(avg(doc_mrr), 6) AS mrr, round(avg(CAST(answer_correct AS DOUBLE)), 6) AS answer_accuracy FROM e",
    "failure_counts": f"""WITH {EVALUATED}, t AS (SELECT unnest([CASE WHEN NOT found_any THEN 'NO_DOCUMENT' END, CASE WHEN found_any AND doc_recall = 0 THEN 'WRONG_DOCUMENT' END, CASE WHEN doc_recall > 0 AND doc_recall < 1 THEN 'PARTIAL_DOCUMENTS' END,
CASE WHEN doc_recall > 0 AND doc_precision < 1 THEN 'EXTRA_DOCUMENTS' END, CASE WHEN answer IS NULL AND gold_answer IS NOT NULL THEN 'MISSING_ANSWER' END, CASE WHEN answer IS NOT NULL AND NOT answer_correct THEN 'WRONG_ANSWER' END]) AS tag FROM e) SELECT tag, count(*) AS n FROM t WHERE tag IS NOT NULL GROUP BY tag""",
    "eval_funnel": f"""WITH {EVALUATED}, s AS (SELECT unnest([{{'step': 'all', 'n': count(*)}}, {{'step': 'any_document', 'n': count(*) FILTER (found_any)}}, {{'step': 'right_document', 'n': count(*) FILTER (doc_recall > 0)}}, {{'step': 'right_answer', 'n': count(*) FILTER (answer_correct AND doc_recall > 0)}}]) AS x, count(*) AS t FROM e)
SELECT x.step AS step, x.n AS n, round(x.n * 100.0 / t, 4) AS percent FROM s""",
    "worst_questions": f"WITH {EVALUATED} SELECT id, round(doc_f2, 6) AS doc_f2 FROM e ORDER BY 2, 1 LIMIT 20",
    "integrity_checks": """WITH k AS (SELECT DISTINCT doc_id FROM table_catalog), d AS (SELECT DISTINCT doc_id FROM raw_documents),
x AS (SELECT 'repeated_keys' AS "check", count(*) AS n FROM (SELECT table_ref FROM table_catalog GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'tables_without_document', count(*) FROM k ANTI JOIN d USING (doc_id) UNION ALL SELECT 'documents_without_table', count(*) FROM d ANTI JOIN k USING (doc_id) UNION ALL SELECT 'tables_with_code', count(ticker) FROM table_catalog)
SELECT "check", CASE "check" WHEN 'repeated_keys' THEN CASE WHEN n = 0 THEN 'ok' ELSE 'error' END WHEN 'tables_without_document' THEN CASE WHEN n = 0 THEN 'ok' WHEN n > 0.05 * (SELECT count(*) FROM k) THEN 'error' ELSE 'warning' END
WHEN 'documents_without_table' THEN CASE WHEN n = 0 THEN 'ok' ELSE 'warning' END ELSE CASE WHEN n < 0.9 * (SELECT count(*) FROM table_catalog) THEN 'error' ELSE 'ok' END END AS severity, n FROM x""",
    "index_checks": """WITH x AS (SELECT 'sparse' AS "check", count(DISTINCT table_ref) AS n FROM extracted_tables UNION ALL SELECT 'dense', count(DISTINCT table_ref) FROM candidates)
SELECT "check", (SELECT count(DISTINCT table_ref) FROM table_catalog) AS expected, n, n = (SELECT count(DISTINCT table_ref) FROM table_catalog) AS ok FROM x""",
}


# --- classes of tables, companies


def _cascade(catalog: str = "catalog") -> str:
    """CTEs ending in lv(id, level, table_ref) of the levels 1 to 6 and best(id, level)."""
    typed = "(a.report_type IS NULL OR coalesce(a.report_type = c.report_type, FALSE))"
    exact, wider = "list_contains(a.years, c.year)", "len(list_filter(a.years, lambda y: c.year BETWEEN y AND y + 2)) > 0"
    none = "len(a.years) = 0"
    return f"""
qs AS (SELECT id, coalesce(tickers, []) AS tickers, coalesce(years, []) AS years, report_type FROM asked),
cp AS (SELECT DISTINCT a.id, c.table_ref, CASE WHEN ({none} OR {exact}) AND {typed} THEN 1 WHEN {wider} AND {typed} THEN 2 WHEN {none} OR {exact} THEN 3 WHEN {wider} THEN 4 ELSE 5 END AS level
  FROM (SELECT id, unnest(tickers) AS ticker, years, report_type FROM qs) a JOIN {catalog} c ON upper(a.ticker) = upper(c.ticker)),
yp AS (SELECT DISTINCT a.id, c.table_ref, 6 AS level FROM (SELECT id, unnest(years) AS y FROM qs WHERE id NOT IN (SELECT id FROM cp)) a JOIN {catalog} c ON a.y = c.year),
lv AS (SELECT id, table_ref, level FROM (SELECT * FROM cp UNION ALL SELECT * FROM yp) QUALIFY level = min(level) OVER (PARTITION BY id))"""


def _counted(catalog: str) -> str:
    return f"""SELECT id, min(level) AS level, count(*) AS n_tables FROM lv GROUP BY id
UNION ALL SELECT id, 7, (SELECT count(*) FROM {catalog}) FROM qs WHERE id NOT IN (SELECT id FROM lv)"""


_NAMED = r"(Công ty [^()?.,:;]{3,80}) \(([A-Z][A-Z0-9]{2,4})\)"


def _key(x: str) -> str:
    out = fold(x)
    for form in LEGAL_FORMS:
        out = f"replace({out}, '{form}', ' ')"
    return f"trim(regexp_replace({out}, '[^0-9a-z]+', ' ', 'g'))"


COMPANIES = f"names AS (SELECT DISTINCT regexp_extract(question, '{_NAMED}', 2) AS ticker, regexp_extract(question, '{_NAMED}', 1) AS name FROM questions WHERE regexp_matches(question, '{_NAMED}'))"
_GENERIC = "[" + ", ".join(f"'{w}'" for w in GENERIC) + "]"
JUDGED = EVALUATED + """,
gt AS (SELECT a.id, list_sort(list(DISTINCT catalog.table_ref)) AS gold_tables FROM (SELECT id, ticker, unnest(years) AS year FROM (SELECT id, unnest(tickers) AS ticker, years FROM asked)) a JOIN catalog ON catalog.ticker = a.ticker AND catalog.year = a.year GROUP BY a.id),
pt AS (SELECT qid AS id, list(table_ref ORDER BY rank, table_ref) AS tabs FROM c WHERE rank <= 10 GROUP BY 1),
j0 AS (SELECT e2.id, e2.answer, e2.gold_answer, g AS gd, p AS pd, coalesce(gold_tables, []) AS gt, coalesce(tabs, []) AS pt, doc_precision, doc_recall FROM e2 LEFT JOIN gt USING (id) LEFT JOIN pt USING (id)),
j1 AS (SELECT j0.*, e.doc_f2, e.doc_mrr, e.answer_correct, id % 7 <> 0 AS planned, len(list_intersect(list_distinct(pt), gt)) AS n FROM j0 JOIN e USING (id)),
j2 AS (SELECT *, CASE WHEN len(gt) = 0 THEN CASE WHEN len(pt) = 0 THEN 1.0 ELSE 0.0 END WHEN len(pt) = 0 THEN 0.0 ELSE n / len(pt) END AS table_precision, CASE WHEN len(gt) = 0 THEN 1.0 WHEN len(pt) = 0 THEN 0.0 ELSE n / len(gt) END AS table_recall,
  coalesce(1.0 / list_min(list_filter(list_transform(range(1, least(len(pt), 5) + 1), lambda i: CASE WHEN list_contains(gt, pt[i]) THEN i END), lambda i: i IS NOT NULL)), 0.0) AS table_mrr FROM j1),
j3 AS (SELECT *, CASE WHEN 4 * table_precision + table_recall = 0 THEN 0.0 ELSE 5 * table_precision * table_recall / (4 * table_precision + table_recall) END AS table_f2, planned AND answer_correct AS execution_correct,
  list_filter([CASE WHEN len(gt) > 0 AND NOT list_has_any(gt, pt) THEN 'TABLE_MISS' END, CASE WHEN len(gd) > 0 AND NOT list_has_any(gd, pd) THEN 'DOC_MISS' END], lambda x: x IS NOT NULL) AS miss,
  list_filter([CASE WHEN len(gt) > 0 AND table_recall > 0 AND table_mrr < 1 THEN 'TABLE_BAD_RANK' END, CASE WHEN len(gd) > 0 AND doc_recall > 0 AND doc_mrr < 1 THEN 'DOC_BAD_RANK' END], lambda x: x IS NOT NULL) AS bad FROM j2),
j4 AS (SELECT *, CASE WHEN len(miss) > 0 THEN miss ELSE bad END AS up FROM j3),
j AS (SELECT *, list_concat(up, CASE WHEN answer_correct THEN CASE WHEN len(up) = 0 THEN ['SUCCESS'] ELSE [] END WHEN NOT planned THEN ['QUERY_NO_CODE'] WHEN answer IS NOT NULL THEN ['EXECUTION_ERROR'] WHEN len(up) = 0 THEN ['ANSWER_MISMATCH'] ELSE [] END) AS tags FROM j4)"""
_SCORES = [f"{n}_{k}" for n in ("doc", "table") for k in ("precision", "recall", "f2", "mrr")]
TYPED = """
m AS (SELECT match_id, any_value(table_ref) AS table_ref, any_value(metric) AS metric FROM (SELECT DISTINCT match_id, table_ref, metric FROM term_matches WHERE metric IS NOT NULL) GROUP BY 1),
typed AS (SELECT catalog.ticker, catalog.year, m.metric, m.table_ref, m.match_id, CAST(m.match_id AS DOUBLE) AS value FROM m JOIN catalog USING (table_ref) WHERE catalog.ticker IS NOT NULL AND catalog.year IS NOT NULL)"""
_TERMS = sorted({t for f in DERIVED.values() for t in (*f.above, *f.below, *f.less)})


_WIDE = ", ".join(f"min(value) FILTER (metric = '{t}') AS {t}" for t in _TERMS)


def _formula(name: str) -> str:
    f = DERIVED[name]
    above = " + ".join(f.above) + "".join(f" - {t}" for t in f.less)
    return f"SELECT ticker, year, '{name}' AS metric, round(({above}) / nullif({' + '.join(f.below)}, 0) * {f.factor}, 6) AS value FROM w"


ITEMS = f"""{CANDIDATES},
a AS (SELECT question_id AS id, arg_min(raw_value, answer_id) AS value FROM normalized_answers GROUP BY 1),
r AS (SELECT qid AS id, rank, table_ref, c.doc_id, replace(csv_path, chr(92), '/') AS path FROM c LEFT JOIN catalog USING (table_ref) WHERE rank <= 5),
r1 AS (SELECT id, list(table_ref ORDER BY rank, table_ref) AS tabs, list(doc_id ORDER BY rank, table_ref) AS docs, list(path ORDER BY rank, table_ref) AS paths FROM r GROUP BY id),
u AS (SELECT id, question, value, coalesce({first_match(fold('question'), ASKED)}, 'none') AS unit, tabs, docs, paths FROM asked LEFT JOIN a USING (id) LEFT JOIN r1 USING (id)),
u1 AS (SELECT *, CASE unit WHEN 'ty_dong' THEN 1e9 ELSE 1e6 END AS by_large FROM u),
items AS (SELECT id, question, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0.0 WHEN value >= 1e11 AND unit IN ('trieu_dong', 'ty_dong') THEN round(value / by_large, 2) ELSE round(value, 2) END AS answer,
  list_filter(coalesce(docs, []), lambda x, i: list_position(docs, x) = i) AS docs, list_filter(coalesce(tabs, []), lambda x, i: list_position(tabs, x) = i) AS tabs,
  list_transform(list_filter(coalesce(paths, []), lambda x: x IS NOT NULL)[:4], lambda x: CASE WHEN starts_with(regexp_replace(x, '^[./]+', ''), 'data/') THEN regexp_replace(x, '^[./]+', '') ELSE 'data/' || split_part(x, '/', -1) END) AS paths FROM u1)"""
_BETWEEN = r"regexp_replace(regexp_replace(substr(text, CAST(e AS BIGINT) + 1, greatest(char_start - e, 0)), '(?m)^=+ PAGE (\d+) =+$', '', 'g'), '<[^>]+>', '', 'g')"

def _squeezed(x: str) -> str:
    """Runs of three or more of a sign as two, one sign after the other, for want of back-references."""
    for sign in "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~–—…•·«»“”‘’°±×÷€£¥©®":
        literal = sign.replace("'", "''")
        x = f"regexp_replace({x}, '{chr(92) + literal if sign.isascii() else literal}{{3,}}', '{literal * 2 if sign != chr(92) else chr(92) * 4}', 'g')"
    return x


SQL |= {
    "filter_cascade": f"WITH {LATEST}, {_cascade()} {_counted('catalog')}",
    "cascade_without_unit": f"WITH {LATEST}, bare AS (SELECT * FROM catalog WHERE unit IS NULL), {_cascade('bare')} {_counted('bare')}",
    "admitted_tables": f"WITH {LATEST}, {_cascade()} SELECT id, level, table_ref FROM lv",
    "questions_without_filter": f"WITH {LATEST} SELECT DISTINCT id FROM asked WHERE id NOT IN (SELECT a.id FROM (SELECT id, unnest(tickers) AS ticker FROM asked) a JOIN catalog c ON upper(a.ticker) = upper(c.ticker) WHERE c.title IS NULL)",
    "company_names": f"WITH {COMPANIES} SELECT ticker, name, {_key('name')} AS key FROM names",
    "unique_aliases": f"""WITH {COMPANIES}, k AS (SELECT DISTINCT ticker, {_key('name')} AS key FROM names), w AS (SELECT ticker, string_split(key, ' ') AS w FROM k WHERE key <> ''), e AS (SELECT ticker, w, unnest([2, 3, 4]) AS n FROM w),
a AS (SELECT ticker, array_to_string(w[len(w) - n + 1:], ' ') AS alias FROM e WHERE n <= len(w))
SELECT alias, min(ticker) AS ticker FROM a WHERE length(alias) >= 6 AND NOT list_contains({_GENERIC}, alias) AND len(list_filter(string_split(alias, ' '), lambda x: NOT list_contains({_GENERIC}, x))) > 0 AND alias NOT IN (SELECT key FROM k)
GROUP BY alias HAVING count(DISTINCT ticker) = 1""",
    "unanswered": "SELECT DISTINCT id FROM questions WHERE id NOT IN (SELECT question_id FROM normalized_answers WHERE converted AND question_id IS NOT NULL)",
    "linked_by_text": f"""WITH h AS (SELECT DISTINCT doc_id, position, char_start, char_end, n_cols FROM html_tables), d AS (SELECT DISTINCT doc_id, text FROM raw_documents),
o AS (SELECT *, lag(char_end) OVER w AS e, n_cols = lag(n_cols) OVER w AS same FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
j AS (SELECT o.*, coalesce(same AND length(regexp_replace({_BETWEEN}, '^\\s+|\\s+$', '', 'g')) < 30, FALSE) AS joins FROM o LEFT JOIN d USING (doc_id)),
r AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY position) AS run FROM j)
SELECT doc_id, position, first_value(position) OVER w AS head, joins AS is_continuation, lead(position) OVER w AS next_position FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY position)""",
    "header_lines": f"""WITH {TABULAR} SELECT doc_id, count(*) AS n FROM d3 WHERE len(filled) >= 2 AND regexp_matches({fold('line')}, '{"|".join(TITLE_HINTS)}') GROUP BY doc_id""",
    "wide_tables": """WITH o AS (SELECT DISTINCT table_ref, header_rows[1] AS h, rows FROM extracted_tables),
w AS (SELECT table_ref, CASE WHEN len(rows) > 0 THEN h ELSE list_transform(range(len(h)), lambda i: 'col_' || i) END AS cols, CASE WHEN len(rows) > 0 THEN rows ELSE [h] END AS rows FROM o WHERE h IS NOT NULL),
r AS (SELECT table_ref, cols, unnest(rows) AS row, generate_subscripts(rows, 1) - 1 AS row_idx FROM w), c AS (SELECT table_ref, row_idx, cols, row, unnest(range(len(cols))) AS i FROM r)
SELECT table_ref, CAST(row_idx AS INTEGER) AS row_idx, CAST(i AS INTEGER) AS col_idx, cols[i + 1] AS "column", coalesce(row[i + 1], '') AS cell FROM c""",
    "loaded_types": """WITH d AS (SELECT DISTINCT doc_id, replace(replace(lower(doc_id), '_', ''), '-', '') AS f FROM raw_documents)
SELECT doc_id, CASE WHEN regexp_matches(f, 'separate|rieng|congtyme|parent') THEN 'separate' WHEN regexp_matches(f, 'consolidated|hopnhat') THEN 'consolidated' ELSE 'unknown' END AS report_type FROM d""",
    "rrf_bonus": f"""WITH {LATEST}, {CANDIDATES}, u AS (SELECT qid, table_ref, 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY bm25_score DESC, table_ref)) AS s, bm25_score AS a, NULL AS b FROM c WHERE bm25_score IS NOT NULL
UNION ALL SELECT qid, table_ref, 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY dense DESC, table_ref)), NULL, dense FROM c WHERE dense IS NOT NULL),
f AS (SELECT qid, table_ref, sum(s) AS s, coalesce(max(a), 0) AS sparse_score, coalesce(max(b), 0) AS dense_score FROM u GROUP BY ALL)
SELECT qid, table_ref, round(s + CASE WHEN coalesce(len(metrics), 0) > 0 AND TRY_CAST(split_part(table_ref, '|', -1) AS INTEGER) BETWEEN 1 AND 12 THEN 0.003 ELSE 0 END, 9) AS score, sparse_score, dense_score FROM f LEFT JOIN asked ON id = qid""",
    "dense_allowed": """WITH a AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id, round(list_dot_product(v, CAST(embedding AS DOUBLE[])), 6) AS score FROM a JOIN embeddings USING (label))
SELECT query, vec_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
    "order_lookup": "SELECT round(arg_min(o_totalprice, (o_orderdate, o_orderkey)) / 1000, 2) AS thousands FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND year(o_orderdate) = 1995",
    "concat_lookup": "SELECT lower(o_orderpriority) AS o_orderpriority, arg_min(o_totalprice, (CASE WHEN year(o_orderdate) < 1998 THEN 1 ELSE 2 END, o_orderkey)) AS value FROM orders GROUP BY 1",
    "derived_metrics": f"WITH {LATEST}, {TYPED}, w AS (SELECT ticker, year, {_WIDE} FROM typed GROUP BY ALL), x AS ({' UNION ALL '.join(map(_formula, DERIVED))}) SELECT * FROM x WHERE value IS NOT NULL",
    "relaxed_answers": f"""WITH {LATEST}, {TYPED}, f AS (SELECT ticker, metric, year, arg_min(value, (table_ref, match_id)) AS value FROM typed GROUP BY ALL),
q AS (SELECT DISTINCT id, ticker, metric, unnest(years) AS year FROM (SELECT id, ticker, unnest(metrics) AS metric, years FROM (SELECT id, unnest(tickers) AS ticker, metrics, years FROM asked)))
SELECT q.id || '|' || q.ticker || '|' || q.metric || '|' || q.year AS id, CASE WHEN f.year = q.year THEN 1 ELSE 3 END AS level, f.value FROM q JOIN f ON f.ticker = q.ticker AND f.metric = q.metric
QUALIFY row_number() OVER (PARTITION BY q.id, q.ticker, q.metric, q.year ORDER BY CASE WHEN f.year = q.year THEN 1 ELSE 3 END, f.year DESC, f.value) = 1""",
    "bound_tables": f"""WITH {LATEST}, {CANDIDATES}, s AS (SELECT qid AS id, rank, c.table_ref, group_id, NOT needs_derived AND len(tickers) <= 1 AND len(years) <= 1 AS simple FROM c JOIN asked ON asked.id = qid LEFT JOIN catalog USING (table_ref) WHERE rank <= 5),
f AS (SELECT *, first_value(table_ref) OVER w AS ft, first_value(group_id) OVER w AS fg FROM s WINDOW w AS (PARTITION BY id ORDER BY rank, table_ref))
SELECT id, table_ref, 'df' || row_number() OVER (PARTITION BY id ORDER BY rank, table_ref) AS variable FROM f WHERE coalesce(NOT simple OR table_ref = ft OR group_id = fg, FALSE)""",
    "coerced_answers": """WITH o AS (SELECT DISTINCT answer_id, question_id, value FROM normalized_answers), g AS (SELECT question_id AS id, count(*) AS n, any_value(value) AS v, count(value) AS k FROM o GROUP BY 1)
SELECT id, CASE WHEN k = 1 AND NOT isnan(v) AND NOT isinf(v) THEN round(v, 4) END AS value, CASE WHEN k = 0 THEN 'no value' WHEN k > 1 THEN k || ' values' WHEN isnan(v) THEN 'NaN' WHEN isinf(v) THEN 'infinite' END AS error FROM g""",
    "judged_questions": f"WITH {JUDGED} SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in _SCORES[4:])}, answer_correct, execution_correct, array_to_string(tags, ',') AS tags FROM j",
    "judged_summary": f"""WITH {JUDGED}, s AS (SELECT count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _SCORES)}, round(avg(CAST(answer_correct AS DOUBLE)), 6) AS answer_accuracy, round(avg(CAST(execution_correct AS DOUBLE)), 6) AS execution_accuracy FROM j)
SELECT *, round((table_f2 + answer_accuracy + execution_accuracy) / 3, 6) AS overall FROM s""",
    "submission_items": f"WITH {LATEST}, {ITEMS} SELECT id, answer, array_to_string(docs, ',') AS relevant_docs, array_to_string(tabs, ',') AS relevant_tables, array_to_string(paths, ',') AS paths FROM items",
    "submission_violations": f"""WITH {LATEST}, {ITEMS}, a2 AS (SELECT DISTINCT question_id AS id FROM normalized_answers WHERE converted)
SELECT 'no_documents' AS rule, 'warning' AS severity, id FROM items WHERE len(docs) = 0 UNION ALL SELECT 'no_tables', 'warning', id FROM items WHERE len(tabs) = 0
UNION ALL SELECT 'document_with_suffix', 'error', id FROM items WHERE len(list_filter(docs, lambda x: ends_with(x, '.txt'))) > 0
UNION ALL SELECT 'malformed_table', 'error', id FROM items WHERE len(list_filter(tabs, lambda t: NOT regexp_full_match(t, '.+[|]-?[0-9]+'))) > 0
UNION ALL SELECT 'table_of_other_document', 'warning', id FROM items WHERE len(docs) > 0 AND len(list_filter(tabs, lambda t: contains(t, '|') AND NOT list_contains(docs, regexp_extract(t, '^(.*)[|]', 1)))) > 0
UNION ALL SELECT 'question_missing', 'error', id FROM items WHERE coalesce(question, '') = '' UNION ALL SELECT 'plan_empty', 'warning', id FROM items
UNION ALL SELECT 'unknown_id', 'error', id FROM items ANTI JOIN a2 USING (id) UNION ALL SELECT 'absent_id', 'error', id FROM a2 ANTI JOIN items USING (id)""",
    "column_roles": f"WITH {ROLES} SELECT table_ref, col_idx, header, role, year, period, source_date FROM roles",
    "long_facts": f"""WITH {ROLES},
pl AS (SELECT table_ref, count(*) FILTER (role IN ('period', 'category')) = 0 AS plain FROM roles GROUP BY 1),
tc AS (SELECT n4.table_ref, row_idx, n4.col_idx, n4.cell, n4.value, coalesce(role, 'skip') AS role, header, year, period, source_date, coalesce(plain, TRUE) AS plain FROM n4 LEFT JOIN roles USING (table_ref, col_idx) LEFT JOIN pl USING (table_ref)),
rw AS (SELECT table_ref, row_idx, max(cell) FILTER (role = 'item') AS item, nullif(arg_min(cell, col_idx) FILTER (role = 'code'), '') AS item_code FROM tc GROUP BY ALL),
vv AS (SELECT * FROM tc WHERE value IS NOT NULL AND (role IN ('period', 'category') OR (plain AND role NOT IN ('item', 'code'))) QUALIFY NOT plain OR row_number() OVER (PARTITION BY table_ref, row_idx ORDER BY col_idx) = 1),
r1 AS (SELECT *, (table_ref, row_idx) NOT IN (SELECT (table_ref, row_idx) FROM vv) AS bare FROM rw WHERE item <> ''),
r2 AS (SELECT *, bare AND (regexp_matches(item, '^[IVX]+[.)]?\\s') OR (item = upper(item) AND length(item) > 3)) AS sec FROM r1),
r3 AS (SELECT *, sum(CASE WHEN sec THEN 1 ELSE 0 END) OVER (PARTITION BY table_ref ORDER BY row_idx) AS g, last_value(CASE WHEN sec THEN item END IGNORE NULLS) OVER (PARTITION BY table_ref ORDER BY row_idx) AS s FROM r2),
r4 AS (SELECT *, last_value(CASE WHEN bare AND NOT sec THEN item END IGNORE NULLS) OVER (PARTITION BY table_ref, g ORDER BY row_idx) AS c FROM r3),
r5 AS (SELECT table_ref, row_idx, item_code, concat_ws(' - ', CASE WHEN NOT contains(lower(item), lower(s)) THEN s END, CASE WHEN NOT contains(lower(item), lower(c)) THEN c END, item) AS item FROM r4),
un AS (SELECT DISTINCT ON (table_ref) table_ref, coalesce(nullif(trim(unit), ''), 'dong') AS unit, coalesce(unit_scale, 1.0) AS unit_scale FROM extracted_tables)
SELECT vv.table_ref, vv.row_idx, r5.item, r5.item_code, CAST(NULL AS VARCHAR) AS metric, FALSE AS is_derived, vv.year, coalesce(vv.period, 'unknown') AS period, vv.source_date, CASE WHEN vv.role <> 'skip' THEN vv.header END AS column_label, vv.value, un.unit, un.unit_scale
FROM vv JOIN r5 USING (table_ref, row_idx) JOIN un USING (table_ref)""",
    "noise_lines": f"""WITH {LINES} SELECT doc_id, count(*) FILTER (regexp_matches(line, '{PAGE_NOISE}')) AS page_lines, CAST(sum(length(regexp_replace({_squeezed("regexp_replace(line, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')")}, '[\\s\\p{{Z}}]+$', '', 'g'))) AS BIGINT) AS clean_chars FROM lines GROUP BY doc_id""",
}

SQL |= {
    "table_schema": f"""WITH f AS ({SQL['long_facts']}) SELECT table_ref, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(year AS VARCHAR)) FILTER (year IS NOT NULL)), ',') AS years,
array_to_string(list_sort(list(DISTINCT period)), ',') AS periods, array_to_string(list_sort(list(DISTINCT column_label) FILTER (column_label IS NOT NULL)), ',') AS labels FROM f GROUP BY table_ref""",
    "linked_groups": f"WITH {LATEST}, {CANDIDATES}, g AS (SELECT DISTINCT qid AS id, c.table_ref, group_id FROM c JOIN catalog USING (table_ref) WHERE group_id IS NOT NULL) SELECT id, group_id, string_agg(table_ref, ',' ORDER BY table_ref) AS tables FROM g GROUP BY id, group_id HAVING count(*) >= 2",
    "diagnosed_lookups": f"""WITH {LATEST}, {TYPED}, q AS (SELECT DISTINCT id || '|' || ticker || '|' || metric || '|' || year AS id, ticker, metric, year FROM (SELECT id, ticker, metric, unnest(years) AS year FROM (SELECT id, ticker, unnest(metrics) AS metric, years FROM (SELECT id, unnest(tickers) AS ticker, metrics, years FROM asked)))),
k AS (SELECT ticker, metric, list_sort(list(DISTINCT year)) AS years FROM typed GROUP BY ALL)
SELECT q.id, CASE WHEN q.ticker NOT IN (SELECT ticker FROM typed) THEN 'no_code' WHEN k.years IS NULL THEN 'no_metric' WHEN NOT list_contains(k.years, q.year) THEN 'no_year' ELSE 'found' END AS reason, coalesce(array_to_string(k.years, ','), '') AS years
FROM q LEFT JOIN k ON k.ticker = q.ticker AND k.metric = q.metric""",
    "item_anchors": f"""WITH {LATEST}, {CANDIDATES}, {cells('extracted_tables')}, k AS (SELECT id, {tokens('question')} AS t FROM asked), a AS (SELECT id, list_distinct(list_filter(t, lambda w: length(w) >= 2)) AS w, list_distinct({PHRASES}) AS p FROM k),
i AS (SELECT DISTINCT table_ref, trim(cell) AS item FROM cells WHERE col_idx = 0 AND trim(cell) <> ''), f AS (SELECT *, {fold('item')} AS f, {tokens('item')} AS t FROM i),
s AS (SELECT DISTINCT a.id, f.table_ref, f.item, round(len(list_intersect(w, t)) + 4 * len(list_filter(p, lambda x: contains(f.f, x))) - 0.02 * length(f.item), 4)::DOUBLE AS score FROM c JOIN a ON a.id = c.qid JOIN f USING (table_ref) WHERE c.rank <= 5),
k2 AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id, table_ref ORDER BY score DESC, item) <= 2)
SELECT id, table_ref, item, score, score = max(score) OVER (PARTITION BY id) AS first FROM k2""",
}
