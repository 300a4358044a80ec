"""The queries of the core operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import numbers, text
from tabulon.operators import analysis, companies, evaluation, extraction, normalization, programs, retrieval, submission, units
from tabulon.operators.oracle import SQL
from tabulon.sources import documents as sources
from tabulon.sources import sinks
from tabulon.session import checkpoint, spread, table
from tabulon.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return units.wrong_units(table(spark, d, "extracted_tables"), table(spark, d, "normalized_answers"), table(spark, d, "questions"), table(spark, d, "units"))


@query
def p4_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every amount of the tables in dong: the numbers of all columns but those of items, codes and notes."""
    tables = table(spark, d, "extracted_tables")
    factors = units.table_units(tables, table(spark, d, "units")).select("table_ref", "right_unit", "factor")
    once = tables.select("table_ref", F.get("header_rows", F.lit(0)).alias("h")).dropDuplicates(["table_ref"])
    # The columns left out are told by their heads, in the row of the table itself: no join of cells with columns.
    other = F.filter(F.transform("h", lambda x, i: F.when(text.fold(x).rlike(units.NO_AMOUNTS), i)), lambda i: i.isNotNull())
    kept = factors.join(once.select("table_ref", other.alias("_other")), "table_ref")
    cells = normalization.cells(tables).where("col_idx >= 1").withColumn("amount", numbers.parse_number(F.col("cell"))).where("amount IS NOT NULL")
    joined = cells.join(kept, "table_ref").where(~F.coalesce(F.array_contains("_other", F.col("col_idx")), F.lit(False)))
    return joined.select("table_ref", "row_idx", "col_idx", "right_unit", (F.col("amount") * F.col("factor")).alias("dong"))


@query
def p4_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every answer in the unit that its question asks for."""
    answers = units.answer_units(table(spark, d, "normalized_answers"), table(spark, d, "questions"), table(spark, d, "units"))
    return answers.select("answer_id", "right_unit", "common")


# --- scalars


@query
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


@query
def question_phrases(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "questions").select("id", "question").dropDuplicates(["id"])
    return once.select("id", F.array_join(text.phrases(F.col("question")), "|").alias("phrases"))


@query
def table_names(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "table_catalog").select("table_ref", "doc_id", "position", "title").distinct()
    return once.select("table_ref", text.slug(F.col("title")).alias("slug"), text.safe_name(F.col("doc_id"), F.col("position")).alias("file"))


@query
def parsed_numbers(spark: SparkSession, d: str) -> DataFrame:
    cells = normalization.cells(table(spark, d, "extracted_tables"))
    return cells.select("table_ref", "row_idx", "col_idx", numbers.parse_number(F.col("cell")).alias("value")).where("value IS NOT NULL")


@query
def context_units(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "extracted_tables").select("table_ref", "title", "context_before").dropDuplicates(["table_ref"])
    unit = numbers.context_unit(F.concat_ws(" ", "title", "context_before"))
    return once.select("table_ref", unit.alias("unit"), F.when(unit.isNotNull(), numbers.divisor(unit)).otherwise(1.0).alias("scale"))


@query
def column_periods(spark: SparkSession, d: str) -> DataFrame:
    """The period of each column head; of the columns of a table with one year and period the first counts."""
    once = table(spark, d, "extracted_tables").select("table_ref", "doc_id", "header_rows").dropDuplicates(["table_ref"])
    heads = once.select("table_ref", sources.last_year(F.col("doc_id")).alias("y"), F.posexplode(F.get("header_rows", F.lit(0))).alias("col_idx", "header"))
    p = heads.withColumn("p", numbers.column_period(F.col("header"), F.col("y"))).where("p IS NOT NULL")
    flat = p.select("table_ref", "col_idx", "p.year", "p.period", "p.source_date")
    nth = F.row_number().over(Window.partitionBy("table_ref", "year", "period").orderBy("col_idx"))
    return flat.withColumn("_n", nth).where("_n = 1").drop("_n")


@query
def question_constraints(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    once = table(spark, d, "questions").select("id", "question").dropDuplicates(["id"])
    years = F.array_join(numbers.question_years(q).cast("array<string>"), ",")
    return once.select("id", numbers.requested_period(q).alias("period"), numbers.asked_unit(q).alias("unit"), years.alias("years"), numbers.report_type(q).alias("type"))


@query
def question_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Codes in brackets are trusted; without any, capitals that the catalog knows."""
    once = table(spark, d, "questions").select("id", "question").dropDuplicates(["id"])
    trusted = F.regexp_extract_all("question", F.lit(r"\(([A-Z][A-Z0-9]{2,4})\)"), F.lit(1))
    words = F.filter(F.split("question", "[^A-Za-z0-9]+"), lambda w: w.rlike("^[A-Z][A-Z0-9]{2,4}$"))
    exploded = once.select("id", F.explode(F.array_distinct(F.when(F.size(trusted) > 0, trusted).otherwise(words))).alias("ticker"))
    known = table(spark, d, "table_catalog").select("ticker").where("ticker IS NOT NULL").distinct()
    return exploded.join(known, "ticker", "left_semi").select("id", "ticker")


@query
def question_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = analysis.metrics(table(spark, d, "questions"), table(spark, d, "metric_terms"))
    return found.select("id", F.array_join("metrics", ",").alias("metrics"), "needs_derived")


@query
def question_shapes(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d)
    text_ = analysis.expanded(F.col("question"), F.col("metrics"), F.col("tickers"), F.col("years"))
    return q.select("id", analysis.is_comparison(F.col("question")).alias("compares"), analysis.is_aggregate(F.col("question")).alias("aggregates"), text_.alias("expanded"))


@query
def fact_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metric that the first cell of each row names, if it names one."""
    items = normalization.cells(table(spark, d, "extracted_tables")).where("col_idx = 0 AND trim(cell) <> ''").select("table_ref", "row_idx", "cell")
    names = analysis.listed(table(spark, d, "metric_terms"), "surface", "metric")
    found = items.withColumn("s", analysis.find_terms(F.col("cell"), names)).where(F.size("s") > 0)
    return found.select("table_ref", "row_idx", F.get("s", F.lit(0))["key"].alias("metric"))


@query
def inherited_sections(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "extracted_tables").select("table_ref", "doc_id", "position", "section", "is_continuation").dropDuplicates(["table_ref"])
    return extraction.inherited(once).select("table_ref", F.col("section_or_before").alias("section"))


@query
def answers_in_asked_unit(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "questions").select(F.col("id").alias("question_id"), "question").dropDuplicates(["question_id"])
    once = table(spark, d, "normalized_answers").select("answer_id", "question_id", "raw_value").dropDuplicates(["answer_id"])
    joined = once.join(asked, "question_id").withColumn("unit", numbers.asked_unit(F.col("question")))
    return joined.select("answer_id", "unit", numbers.answer(F.col("raw_value"), F.col("unit")).alias("answer"), numbers.divisor(F.col("unit")).alias("divisor"))


# --- sources, catalog, sinks


@query
def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    return sources.documents(table(spark, d, "raw_documents").select("path", "text").dropDuplicates(["path"])).select("doc_id", "path", "ticker", "year", "report_type", "n_lines")


@query
def catalog_inferred(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "table_catalog").select("table_ref", "doc_id").distinct()
    ticker = F.nullif(F.regexp_extract(F.upper("doc_id"), "^([A-Z0-9]{3,5})_", 1), F.lit(""))
    return once.select("table_ref", ticker.alias("ticker"), sources.last_year(F.col("doc_id")).alias("year"), sources.report_type_of(F.col("doc_id")).alias("report_type"))


@query
def catalog_latest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.latest(table(spark, d, "table_catalog"), "table_ref", "ingested_at").select("table_ref", "doc_id", "position", "title", "unit", "ingested_at")


@query
def catalog_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same catalog, merged batch by batch from a file stream that reads what is there and stops."""
    return incremental.merged(spark, f"{d}/table_catalog.parquet", "table_ref", "ingested_at").select("table_ref", "doc_id", "position", "title", "unit", "ingested_at")


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return sinks.latest(table(spark, d, "table_catalog"), "table_ref", "ingested_at")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return sinks.latest(table(spark, d, "questions"), "id", "loaded_at")


@query
def filter_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The level at which each question's constraints are satisfied, and how many tables it admits: of classes, no table is looked at."""
    found = retrieval.admitted_classes(_questions(spark, d), _catalog(spark, d))
    return found.groupBy("id").agg(F.min("level").alias("level"), F.sum("n").alias("n_tables"))


@query
def cascade_without_unit(spark: SparkSession, d: str) -> DataFrame:
    """The same against the tables that state no unit, of which many questions find none of their code."""
    found = retrieval.admitted_classes(_questions(spark, d), _catalog(spark, d).where("unit IS NULL"))
    return found.groupBy("id").agg(F.min("level").alias("level"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tables"))


@query
def admitted_tables(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.admitted(_questions(spark, d), _catalog(spark, d))


@query
def questions_without_filter(spark: SparkSession, d: str) -> DataFrame:
    """Questions that find no table without a title by their code."""
    return retrieval.unfiltered(_questions(spark, d), _catalog(spark, d).where("title IS NULL"))


@query
def company_names(spark: SparkSession, d: str) -> DataFrame:
    return companies.names_in_questions(table(spark, d, "questions")).select("ticker", "name", companies.company_key(F.col("name")).alias("key"))


@query
def unique_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Ends of the names of companies of two to four words that belong to one only."""
    return companies.aliases(companies.names_in_questions(table(spark, d, "questions")))


@query
def question_codes(spark: SparkSession, d: str) -> DataFrame:
    """The codes of each question, by brackets, names of companies and codes that the list knows."""
    found = companies.tickers(table(spark, d, "questions"), companies.names_in_questions(table(spark, d, "questions")))
    return found.select("id", F.array_join("tickers", ",").alias("tickers"))


@query
def companies_of_reports(spark: SparkSession, d: str) -> DataFrame:
    """The companies that each report names, wherever in its text."""
    known = companies.entries(companies.names_in_questions(table(spark, d, "questions")))
    found = companies.resolved(_raw(spark, d), "doc_id", "text", known)
    return found.select("doc_id", F.array_join("tickers", ",").alias("tickers"))


@query
def unanswered(spark: SparkSession, d: str) -> DataFrame:
    """Questions that a run still has to answer: none of their answers is in the unit asked for."""
    done = table(spark, d, "normalized_answers").where("converted").select(F.col("question_id").alias("id")).distinct()
    return table(spark, d, "questions").select("id").distinct().join(done, "id", "left_anti")


# --- extraction


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_documents").select("doc_id", "text").dropDuplicates(["doc_id"])


@query
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("doc_id", extraction.table_count(F.col("text")).cast("long").alias("n"))


@query
def table_pages(spark: SparkSession, d: str) -> DataFrame:
    return extraction.page_of_lines(_raw(spark, d)).where(F.col("line").contains("<table")).select("doc_id", "line_no", "page")


@query
def dialect_votes(spark: SparkSession, d: str) -> DataFrame:
    return extraction.dialect_vote(_raw(spark, d))


@query
def table_blocks(spark: SparkSession, d: str) -> DataFrame:
    return extraction.blocks(_raw(spark, d))


@query
def noise_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = extraction.lines(_raw(spark, d))
    return lines.groupBy("doc_id").agg(F.count_if(extraction.is_page_noise(F.col("line"))).alias("page_lines"), F.sum(F.length(extraction.clean_line(F.col("line")))).alias("clean_chars"))


@query
def html_grids(spark: SparkSession, d: str) -> DataFrame:
    return extraction.html_tables(_raw(spark, d))


@query
def linked_by_text(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "html_tables").select("doc_id", "position", "char_start", "char_end", "n_cols").distinct()
    return extraction.linked_by_text(once, _raw(spark, d))


@query
def header_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = extraction.lines(_raw(spark, d)).where(extraction.is_header_line(F.col("line")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def text_tables(spark: SparkSession, d: str) -> DataFrame:
    found = extraction.text_tables(_raw(spark, d))
    return found.select("doc_id", "position", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"), "first_line", "n_cols", "page", "context_before")


@query
def detected_tables(spark: SparkSession, d: str) -> DataFrame:
    return extraction.detected(_raw(spark, d)).select("doc_id", "position", F.size("rows").alias("n_rows"), "n_cols", "page", "is_continuation", "source")


@query
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("doc_id", extraction.clean_text(F.col("text")).alias("text"))


@query
def wide_tables(spark: SparkSession, d: str) -> DataFrame:
    """The cells of each table in the width of its first head, under their columns."""
    once = table(spark, d, "extracted_tables").select("table_ref", "header_rows", "rows").dropDuplicates(["table_ref"])
    w = once.select("table_ref", extraction.wide(F.get("header_rows", F.lit(0)), F.col("rows")).alias("w"))
    rows = w.select("table_ref", "w.columns", F.posexplode("w.rows").alias("row_idx", "row"))
    return rows.select("table_ref", "row_idx", F.posexplode("row").alias("col_idx", "cell"), "columns").select("table_ref", "row_idx", "col_idx", F.get("columns", F.col("col_idx")).alias("column"), "cell")


@query
def loaded_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_documents").select("doc_id").distinct().select("doc_id", sources.loaded_report_type(F.col("doc_id")).alias("report_type"))


@query
def linked_tables(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "html_tables").select("doc_id", "position", "char_start", "char_end", "n_cols").distinct()
    return extraction.linked(once, 2000)


@query
def table_sections(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "extracted_tables").select("table_ref", "title", "context_before").dropDuplicates(["table_ref"])
    return once.select("table_ref", extraction.section(F.concat_ws("\n", "title", "context_before")).alias("section"), extraction.title(F.col("context_before")).alias("title"))


# --- normalization


def _grids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "html_tables").select("table_ref", "rows")


@query
def header_rows(spark: SparkSession, d: str) -> DataFrame:
    return normalization.header_row(_grids(spark, d))


@query
def column_names(spark: SparkSession, d: str) -> DataFrame:
    return normalization.column_names(normalization.cells(_grids(spark, d)).where("row_idx = 0").select("table_ref", "col_idx", "cell"))


@query
def column_statistics(spark: SparkSession, d: str) -> DataFrame:
    return normalization.column_statistics(normalization.cells(table(spark, d, "extracted_tables")))


@query
def column_roles(spark: SparkSession, d: str) -> DataFrame:
    return normalization.column_roles(table(spark, d, "extracted_tables"), table(spark, d, "raw_documents"))


@query
def long_facts(spark: SparkSession, d: str) -> DataFrame:
    return normalization.facts(table(spark, d, "extracted_tables"), table(spark, d, "raw_documents"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "metric_terms")
    derived = tuple(sorted({r["metric"] for r in terms.where("is_derived").select("metric").distinct().collect()}))  # of a list that fits an automaton
    return normalization.facts(table(spark, d, "extracted_tables"), table(spark, d, "raw_documents"), analysis.listed(terms, "surface", "metric"), derived)


@query
def fact_ambiguities(spark: SparkSession, d: str) -> DataFrame:
    """The items of each report that have several values for one year and period, over all its tables together."""
    rows = normalization.facts(table(spark, d, "extracted_tables"), table(spark, d, "raw_documents"))
    found = normalization.ambiguity_report(rows.withColumn("table_ref", F.substring_index("table_ref", "|", 1)))
    return found.select("table_ref", "item", F.array_join("codes", ",").alias("codes"), F.array_join("labels", ",").alias("labels"))


@query
def table_years(spark: SparkSession, d: str) -> DataFrame:
    return normalization.periods_by_year(normalization.facts(table(spark, d, "extracted_tables"), table(spark, d, "raw_documents")))


@query
def full_cards(spark: SparkSession, d: str) -> DataFrame:
    return normalization.full_cards(_catalog(spark, d), _facts(spark, d))


@query
def ambiguous_facts(spark: SparkSession, d: str) -> DataFrame:
    cells = normalization.cells(table(spark, d, "extracted_tables"))
    item = cells.where("col_idx = 0").select("table_ref", "row_idx", F.trim("cell").alias("item"))
    value = cells.where("col_idx >= 1").select("table_ref", "row_idx", F.col("col_idx").alias("year"), numbers.parse_number(F.col("cell")).alias("value")).where("value IS NOT NULL")
    return normalization.ambiguous(item.join(value, ["table_ref", "row_idx"]).withColumn("period", F.lit("annual")))


@query
def table_cards(spark: SparkSession, d: str) -> DataFrame:
    items = normalization.cells(table(spark, d, "extracted_tables")).where("col_idx = 0 AND trim(cell) <> ''").select("table_ref", "row_idx", F.trim("cell").alias("item"))
    return normalization.cards(_catalog(spark, d), items)


@query
def fallback_cards(spark: SparkSession, d: str) -> DataFrame:
    return normalization.card_or_fields(_catalog(spark, d))


# --- retrieval


@query
def term_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    frequencies = retrieval.term_frequencies(docs, "doc_id", "text")
    return retrieval.document_frequencies(frequencies, docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def document_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.size(text.tokens(F.col("text"))), F.lit(0)).cast("long").alias("n_terms")).withColumn("n_terms", F.greatest("n_terms", F.lit(0)))


def _metric_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metric_terms").select("surface").distinct().withColumn("query", F.col("surface"))


@query
def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.bm25(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text", _metric_queries(spark, d), "query", "surface", 10)
    return found.select("query", "doc_id", "score", "rank")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))


@query
def dense_ip(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _vector_queries(spark, d), 10).select("query", "vec_id", "score")


@query
def dense_l2(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _vector_queries(spark, d), 10, "l2").select("query", "vec_id", "score")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    dense = F.when(F.col("dense_kind") == "l2", -F.col("dense_score")).otherwise(F.col("dense_score"))
    return table(spark, d, "candidates").select("qid", "table_ref", "doc_id", "rank", "score", "bm25_score", dense.alias("dense")).dropDuplicates(["qid", "table_ref"])


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d)
    ranked = lambda c: rows.where(F.col(c).isNotNull()).select("qid", "table_ref", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "table_ref")).alias("rank"))
    return retrieval.fused_ranks(ranked("bm25_score"), ranked("dense"), "qid", "table_ref")


@query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over the cards that each question's constraints admit, fused with the dense ranking of the candidates.

    A question without a known code is held against the tables of its years; without these, against all.
    """
    questions, catalog = _questions(spark, d), _catalog(spark, d)
    allowed = retrieval.admitted(questions, catalog).select("id", "table_ref")
    free = questions.select("id").join(allowed.select("id").distinct(), "id", "left_anti")
    sparse = retrieval.bm25(normalization.card_or_fields(catalog), "table_ref", "card", questions, "id", "question", 150, allowed, free).select(F.col("id").alias("qid"), "table_ref", "rank")
    dense = _candidates(spark, d).where("dense IS NOT NULL")
    dense = dense.select("qid", "table_ref", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("dense"), "table_ref")).alias("rank")).where("rank <= 150")
    fused = retrieval.top(retrieval.fused_ranks(sparse, dense, "qid", "table_ref"), "qid", "table_ref", "score", 20)
    return fused.join(catalog.select("table_ref", "section", "title"), "table_ref", "left").select("qid", "table_ref", "rank", "score", "section")


@query
def rrf_bonus(spark: SparkSession, d: str) -> DataFrame:
    """The fused ranks with the raw scores, and the bonus of early tables for questions that name metrics."""
    rows = _candidates(spark, d)
    ranked = lambda c: rows.where(F.col(c).isNotNull()).select("qid", "table_ref", F.col(c).alias("score"), F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "table_ref")).alias("rank"))
    asked = _questions(spark, d).select(F.col("id").alias("qid"), "metrics")
    return retrieval.fused_scores(ranked("bm25_score"), ranked("dense"), asked, "qid", "table_ref")


@query
def dense_allowed(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of the query's own label, for every hundredth vector as query."""
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"), "label")
    pairs = asked.select("query", "label").join(vectors.select("vec_id", "label"), "label").select("query", "vec_id")
    return retrieval.nearest_of(pairs, vectors, "vec_id", "embedding", asked.select("query", "v"), 10).select("query", "vec_id", "score", "rank")


@query
def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The whole of retrieval: filter, expanded question, BM25 and vectors under the filter, 150 of each, fused, the best 50."""
    questions, catalog = _questions(spark, d), _catalog(spark, d)
    allowed = checkpoint(retrieval.admitted(questions, catalog).select("id", "table_ref"))
    cards = normalization.card_or_fields(catalog)
    wide = questions.select("id", "metrics", analysis.expanded(F.col("question"), F.col("metrics"), F.col("tickers"), F.col("years")).alias("q"))
    free = questions.select("id").join(allowed.select("id").distinct(), "id", "left_anti")
    sparse = retrieval.bm25(cards, "table_ref", "card", wide, "id", "q", 150, allowed, free).select(F.col("id").alias("qid"), "table_ref", "rank", "score")
    encoder = retrieval.hashing_encoder()
    # Each card and question is encoded once, however many pairs it is in.
    vectors = checkpoint(retrieval.encoded(spread(cards), "table_ref", "card", encoder))
    asked = retrieval.encoded(spread(wide), "id", "q", encoder).select(F.col("id").alias("query"), "v")
    dense = retrieval.nearest_of(allowed.select(F.col("id").alias("query"), "table_ref"), vectors, "table_ref", "v", asked, 150)
    fused = retrieval.fused_scores(sparse, dense.select(F.col("query").alias("qid"), "table_ref", "rank", "score"), wide.select(F.col("id").alias("qid"), "metrics"), "qid", "table_ref")
    best = retrieval.top(fused, "qid", "table_ref", "score", 50)
    return best.join(catalog.select("table_ref", "doc_id", "section", "title"), "table_ref", "left").select("qid", "table_ref", "rank", "score", "sparse_score", "dense_score", "doc_id", "section")


@query
def selected_tables(spark: SparkSession, d: str) -> DataFrame:
    """What is kept of each question's candidates: as many as it needs, codes, years and statements covered, linked tables behind."""
    catalog = _catalog(spark, d).select("table_ref", "ticker", "year", "section", "group_id", "parent_table_ref", "next_table_ref")
    pool = _candidates(spark, d).select("qid", "table_ref", "rank", "score").join(catalog, "table_ref")
    return retrieval.selected(pool, _questions(spark, d), "qid", "table_ref")


@query
def content_rerank(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of each question, the first 35 by what their cards say, the tail behind them."""
    questions, catalog = _questions(spark, d), _catalog(spark, d)
    q = questions.select(F.col("id").alias("qid"), text.phrases(F.col("question")).alias("p"), F.filter(text.tokens(F.col("question")), lambda w: F.length(w) >= 2).alias("w"))
    cards = normalization.card_or_fields(catalog).select("table_ref", text.fold(F.col("card")).alias("t"))
    pool = _candidates(spark, d).join(q, "qid").join(cards, "table_ref")
    scored = pool.select("qid", "table_ref", "rank", "score", retrieval.phrase_score(F.col("p"), F.col("w"), F.col("t")).alias("content"))
    return retrieval.content_ordered(scored, "qid", "table_ref")


@query
def content_order(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of each question: the first 35 by what their rows say (or the card of a table without rows), the tail behind them."""
    questions, catalog = _questions(spark, d), _catalog(spark, d)
    q = questions.select(F.col("id").alias("qid"), "question", text.phrases(F.col("question")).alias("p"), F.filter(text.tokens(F.col("question")), lambda w: F.length(w) >= 2).alias("w"))
    rows = retrieval.contents(normalization.facts(table(spark, d, "extracted_tables"), table(spark, d, "raw_documents")))
    cards = normalization.card_or_fields(catalog).join(catalog.select("table_ref", "section"), "table_ref")
    texts = cards.join(rows, "table_ref", "full").select("table_ref", "section", text.fold(F.coalesce("content", "card")).alias("t"))
    pool = _candidates(spark, d).join(q, "qid", "left").join(texts, "table_ref", "left")
    content = retrieval.phrase_score(F.col("p"), F.col("w"), F.col("t")) + retrieval.cash_flow_score(F.col("question"), F.col("t"), F.col("section"))
    scored = pool.select("qid", "table_ref", "rank", "score", F.when(F.col("p").isNull() | F.col("t").isNull(), 0).otherwise(content).alias("content"))
    return retrieval.content_ordered(scored, "qid", "table_ref")


def _shape(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d)
    size = retrieval.budget(F.size("tickers"), F.size("years"), F.col("needs_derived"), 24)
    return q.select(F.col("id").alias("qid"), size.alias("budget"), "tickers")


@query
def adaptive_cut(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).join(_shape(spark, d), "qid")
    return retrieval.cut(rows.select("qid", "table_ref", "rank", "score", "budget"), "qid", F.col("budget")).select("qid", "table_ref", "rank")


@query
def coverage_repair(spark: SparkSession, d: str) -> DataFrame:
    pool = _candidates(spark, d).join(_catalog(spark, d).select("table_ref", "ticker"), "table_ref").select("qid", "table_ref", "rank", "ticker")
    needed = _shape(spark, d).select("qid", F.explode("tickers").alias("ticker")).distinct()
    return retrieval.covering(pool, adaptive_cut(spark, d).select("qid", "table_ref"), needed, "qid", "table_ref", "ticker")


@query
def linked_expansion(spark: SparkSession, d: str) -> DataFrame:
    links = _catalog(spark, d).select("table_ref", "group_id", "parent_table_ref", "next_table_ref")
    pool = _candidates(spark, d).select("qid", "table_ref").join(links, "table_ref")
    return retrieval.with_linked(adaptive_cut(spark, d).select("qid", "table_ref"), pool, "qid", "table_ref")


# --- programs


@query
def order_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One lookup over orders: the first urgent one of 1995, in thousands."""
    facts = table(spark, d, "orders").select(F.col("o_orderpriority").alias("item"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("table_ref"), F.col("o_orderkey").alias("row_idx"))
    return programs.lookup(facts, "urgent", 1995).select(numbers.rounded(F.col("value") / 1e3).alias("thousands"))


def _typed_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the terms that were matched: the metric of a table's code and year, its value being the term's number."""
    matched = table(spark, d, "term_matches").where("metric IS NOT NULL").select("match_id", "table_ref", "metric").dropDuplicates(["match_id"])
    listed = _catalog(spark, d).select("table_ref", "ticker", "year").where("ticker IS NOT NULL AND year IS NOT NULL")
    return matched.join(listed, "table_ref").select("ticker", "year", "metric", F.lit("annual").alias("period"), "table_ref", F.col("match_id").alias("row_idx"), F.col("match_id").cast("double").alias("value"))


@query
def derived_metrics(spark: SparkSession, d: str) -> DataFrame:
    return programs.derived(_typed_facts(spark, d)).select("ticker", "year", "metric", F.round("value", 6).alias("value"))


def _asked_facts(spark: SparkSession, d: str) -> DataFrame:
    """What each question asks for, one row for each of its codes, metrics and years."""
    q = _questions(spark, d).select("id", F.explode("tickers").alias("ticker"), "metrics", "years").select("id", "ticker", F.explode("metrics").alias("metric"), "years")
    asked = q.select("id", "ticker", "metric", F.explode("years").alias("year"))
    return asked.select(F.concat_ws("|", F.col("id").cast("string"), "ticker", "metric", F.col("year").cast("string")).alias("id"), "ticker", "metric", "year", F.lit("annual").alias("period")).distinct()


@query
def diagnosed_lookups(spark: SparkSession, d: str) -> DataFrame:
    found = programs.diagnosed(_asked_facts(spark, d), _typed_facts(spark, d))
    return found.select("id", "reason", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@query
def item_anchors(spark: SparkSession, d: str) -> DataFrame:
    items = normalization.cells(table(spark, d, "extracted_tables")).where("col_idx = 0 AND trim(cell) <> ''").select("table_ref", F.trim("cell").alias("item"))
    pairs = _candidates(spark, d).where("rank <= 5").select(F.col("qid").alias("id"), "table_ref")
    return programs.anchors(pairs, _questions(spark, d), items)


@query
def linked_groups(spark: SparkSession, d: str) -> DataFrame:
    selected = _candidates(spark, d).select(F.col("qid").alias("id"), "table_ref")
    return programs.linked_groups(selected, _catalog(spark, d)).select("id", "group_id", F.array_join("tables", ",").alias("tables"))


@query
def table_schema(spark: SparkSession, d: str) -> DataFrame:
    rows = programs.table_schema(normalization.facts(table(spark, d, "extracted_tables"), table(spark, d, "raw_documents")))
    return rows.select("table_ref", "n_items", *(F.array_join(c, ",").alias(c) for c in ("years", "periods", "labels")))


@query
def relaxed_answers(spark: SparkSession, d: str) -> DataFrame:
    """For each code, metric and year of each question the first fact, or one of another year where it has none."""
    return programs.relaxed(_asked_facts(spark, d), _typed_facts(spark, d))


@query
def bound_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables that each question's plan works on, of its first five candidates."""
    selected = _candidates(spark, d).where("rank <= 5").select(F.col("qid").alias("id"), "rank", "table_ref")
    return programs.bound(selected, _questions(spark, d), _catalog(spark, d)).select("id", "table_ref", "variable")


@query
def coerced_answers(spark: SparkSession, d: str) -> DataFrame:
    """The one value of each question's answers, or why there is none."""
    values = table(spark, d, "normalized_answers").dropDuplicates(["answer_id"]).groupBy(F.col("question_id").alias("id")).agg(F.collect_list(F.col("value").cast("string")).alias("v"))
    return values.select("id", submission.coerced(F.col("v")).alias("c")).select("id", F.round("c.value", 4).alias("value"), "c.error")


@query
def lookup_largest(spark: SparkSession, d: str) -> DataFrame:
    """For each customer segment the value of its first order of each year, in millions."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate"))
    first = rows.groupBy("c_mktsegment", "year").agg(F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("value"))
    return first.select("c_mktsegment", "year", numbers.rounded(F.col("value") / 1e6).alias("millions"))


@query
def concat_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The parts of a table that a page break parts, put together, then the lookup of each priority."""
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("item"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("row_idx"))
    parts = programs.concatenated(orders.where("year < 1998").withColumn("part", F.lit(1)), orders.where("year >= 1998").withColumn("part", F.lit(2)))
    found = [programs.lookup(parts, p, order=("part", "row_idx")).select(F.lit(p).alias("o_orderpriority"), "value") for p in ("1-urgent", "2-high", "3-medium", "4-not specified", "5-low")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _yearly(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("gross"), F.sum(net).alias("net"))


@query
def ratio_by_nation(spark: SparkSession, d: str) -> DataFrame:
    rows = _yearly(spark, d).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = rows.groupBy("s_nationkey", "year").agg(F.sum("net").alias("a"), F.sum("gross").alias("b"))
    named = sums.join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nation has 25 rows
    return named.select("n_name", "year", F.round(programs.ratio(F.col("a"), F.col("b")), 4).alias("margin"))


@query
def growth_by_nation(spark: SparkSession, d: str) -> DataFrame:
    rows = _yearly(spark, d).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "year").agg(F.sum("net").alias("net"))
    before = F.lag("net").over(Window.partitionBy("s_nationkey").orderBy("year"))
    first, start = F.first("net").over(Window.partitionBy("s_nationkey").orderBy("year")), F.first("year").over(Window.partitionBy("s_nationkey").orderBy("year"))
    return rows.select("s_nationkey", "year", F.round(programs.growth(F.col("net"), before), 4).alias("growth"), F.round(programs.cagr(first, F.col("net"), F.col("year") - start), 4).alias("cagr"))


@query
def best_year(spark: SparkSession, d: str) -> DataFrame:
    rows = _yearly(spark, d).select("l_suppkey", "year", F.round("net", 2).alias("net"))
    best = programs.extreme(rows, ["l_suppkey"], "net", "year")
    return best.select("l_suppkey", F.col("year").cast("double").alias("best_year"), "net")


@query
def peer_share(spark: SparkSession, d: str) -> DataFrame:
    rows = _yearly(spark, d).select("year", F.round(programs.ratio(F.col("net"), F.col("gross")), 6).alias("margin"), F.round("net", 2).alias("net"))
    out = programs.share_above_median(rows, ["year"], "margin", "net")
    return out.select("year", F.round("median", 4).alias("median"), F.round("share", 4).alias("share"))


@query
def opening_balances(spark: SparkSession, d: str) -> DataFrame:
    """Orders to date at the end of each year, and at its start."""
    yearly = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    to_date = Window.partitionBy("o_custkey").orderBy("year")
    closing = F.sum("v").over(to_date.rowsBetween(Window.unboundedPreceding, 0))
    opening = F.coalesce(F.sum("v").over(to_date.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return yearly.select("o_custkey", "year", F.round(opening, 2).alias("opening"), F.round(closing, 2).alias("closing"))


@query
def plan_ratio(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("total"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("done")
    )
    long = facts.select(F.col("c_mktsegment").alias("ticker"), "year", F.explode(F.array(F.struct(F.lit("profit_net").alias("metric"), F.col("done").alias("value")), F.struct(F.lit("rev_net").alias("metric"), F.col("total").alias("value")))).alias("m")).select("ticker", "year", "m.metric", "m.value")
    planned = programs.evaluate(long, programs.Plan("ratio", ("profit_net", "rev_net")))
    named = programs.derived(long, ("ros",)).select("ticker", "year", F.col("value").alias("same"))  # the same by its name
    return planned.join(named, ["ticker", "year"]).where("value = same").select("ticker", "year", F.round("value", 4).alias("value"))


# --- evaluation and checks


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """For each question the reports of its codes and years; its first answer as the gold one."""
    q = _questions(spark, d)
    listed = table(spark, d, "raw_documents").select("doc_id", "ticker", "year").dropDuplicates(["doc_id"])
    pairs = q.select("id", F.explode("tickers").alias("ticker"), "years").join(listed, "ticker").where(F.array_contains("years", F.col("year")))
    docs = pairs.groupBy("id").agg(F.array_sort(F.collect_set("doc_id")).alias("gold_docs"))
    answers = table(spark, d, "normalized_answers").groupBy(F.col("question_id").alias("id")).agg(F.min_by(F.col("raw_value") / F.coalesce("divisor", F.lit(1.0)), "answer_id").alias("gold_answer"))
    return q.select("id").join(docs, "id", "left").join(answers, "id", "left").select("id", F.coalesce("gold_docs", F.array().cast("array<string>")).alias("gold_docs"), "gold_answer")


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """For each question the reports of its ten first candidates in their order, and its first answer as it was given."""
    ranked = _candidates(spark, d).where("rank <= 10")
    docs = ranked.groupBy(F.col("qid").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "table_ref", "doc_id"))), lambda s: s["doc_id"]).alias("docs"))
    answers = table(spark, d, "normalized_answers").groupBy(F.col("question_id").alias("id")).agg(F.min_by("value", "answer_id").alias("answer"))
    return docs.join(answers, "id", "full_outer")


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluated(_gold(spark, d), _predictions(spark, d))


@query
def eval_questions(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _evaluated(spark, d).select("id", r("doc_precision"), r("doc_recall"), r("doc_f2"), r("doc_mrr"), "answer_correct")


@query
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(_evaluated(spark, d))


@query
def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.tag_counts(_evaluated(spark, d))


@query
def eval_funnel(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.funnel(_evaluated(spark, d))


@query
def worst_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = _evaluated(spark, d).select("id", F.round("doc_f2", 6).alias("doc_f2"))
    return rows.orderBy("doc_f2", "id").limit(20)  # a report of the worst twenty


@query
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.integrity(table(spark, d, "table_catalog").select("table_ref", "doc_id", "ticker"), table(spark, d, "raw_documents").select("doc_id", "ticker"))


@query
def index_checks(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.index_integrity(table(spark, d, "table_catalog"), table(spark, d, "extracted_tables"), table(spark, d, "candidates"))


def _gold_tables(spark: SparkSession, d: str) -> DataFrame:
    """For each question the tables of its codes and years."""
    q = _questions(spark, d).select("id", F.explode("tickers").alias("ticker"), "years").select("id", "ticker", F.explode("years").alias("year")).distinct()
    return q.join(_catalog(spark, d).select("ticker", "year", "table_ref"), ["ticker", "year"]).groupBy("id").agg(F.array_sort(F.collect_set("table_ref")).alias("gold_tables"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d).join(_gold_tables(spark, d), "id", "left")
    ranked = _candidates(spark, d).where("rank <= 10").groupBy(F.col("qid").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "table_ref"))), lambda x: x["table_ref"]).alias("tables"))
    # Every seventh question has no plan, so that its execution fails.
    planned = _predictions(spark, d).join(ranked, "id", "left").withColumn("plan", F.when(F.col("id") % 7 == 0, "").otherwise("lookup"))
    return evaluation.judged(gold, planned)


@query
def judged_questions(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _judged(spark, d).select("id", r("table_precision"), r("table_recall"), r("table_f2"), r("table_mrr"), "answer_correct", "execution_correct", F.array_join("tags", ",").alias("tags"))


@query
def judged_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.judged_summary(_judged(spark, d))


def _items(spark: SparkSession, d: str) -> DataFrame:
    ranked = _candidates(spark, d).where("rank <= 5").join(_catalog(spark, d).select("table_ref", "csv_path"), "table_ref", "left").select(F.col("qid").alias("id"), "rank", "table_ref", "doc_id", "csv_path")
    answers = table(spark, d, "normalized_answers").groupBy(F.col("question_id").alias("id")).agg(F.min_by("raw_value", "answer_id").alias("value"))
    return submission.items(_questions(spark, d), answers, ranked)


@query
def submission_items(spark: SparkSession, d: str) -> DataFrame:
    """Each question's item, from its first answer and five candidates, written as JSON and read again."""
    rows = submission.from_json(submission.to_json(_items(spark, d)))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("id", "answer", joined("relevant_docs"), joined("relevant_tables"), F.array_join("evidence.csv_path", ",").alias("paths"))


@query
def submission_violations(spark: SparkSession, d: str) -> DataFrame:
    """The rules that the items break, held against the questions that have an answer."""
    answered = table(spark, d, "normalized_answers").where("converted").select(F.col("question_id").alias("id"))
    return submission.violations(_items(spark, d), answered)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
