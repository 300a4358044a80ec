"""The stages from documents to results, each a plan over tables that the stage before has written.

A stage reads and writes parquet in a folder, so one that is there already is not run again, and a run that was
broken off goes on with the stage it stopped in. Answers are written in batches; a later run answers the ids that none
of them holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import text
from tabulon.operators import analysis, evaluation, extraction, normalization, programs, retrieval, submission
from tabulon.sources import documents as sources
from tabulon.sources import sinks


@dataclass
class Settings:
    """What a run is given. options: anything else, by dotted name."""

    documents: str = ""
    questions: str = ""
    terms: str = ""
    gold: str = ""
    out: str = "out"
    top_k: int = 150
    keep: int = 30
    most_tables: int = 24
    options: dict = field(default_factory=dict)

    def get(self, name: str, default=None):
        """A field, or an option such as "retrieval.k"; each part of the name is a level."""
        if hasattr(self, name):
            return getattr(self, name)
        value: object = self.options
        for part in name.split("."):
            if not isinstance(value, dict) or part not in value:
                return default
            value = value[part]
        return value


def _read(spark: SparkSession, s: Settings, name: str) -> DataFrame:
    return spark.read.parquet(f"{s.out}/{name}")


def _there(spark: SparkSession, s: Settings, name: str) -> bool:
    try:
        spark.read.parquet(f"{s.out}/{name}")
    except AnalysisException:
        return False
    return True


def _write(rows: DataFrame, s: Settings, name: str) -> None:
    rows.write.mode("overwrite").parquet(f"{s.out}/{name}")


def corpus(spark: SparkSession, s: Settings) -> dict[str, int]:
    """Documents to tables, facts and catalog. What was detected, written and skipped comes back."""
    documents = sources.documents(sources.read_texts(spark, s.documents), s.get("limit"))
    _write(documents, s, "documents")
    documents = _read(spark, s, "documents")
    found = extraction.detected(documents.select("doc_id", "text")).withColumn("table_ref", F.concat("doc_id", F.lit("|"), F.col("position").cast("string")))
    heads = normalization.header_row(found.select("table_ref", "rows")).withColumnRenamed("row_idx", "_h")
    headed = found.join(heads, "table_ref", "left").withColumn("_h", F.coalesce("_h", F.lit(0)))
    body = F.filter("rows", lambda r, i: i > F.col("_h"))
    context = F.col("context_before")
    tables = headed.select(
        "table_ref", "doc_id", "position", extraction.title(context).alias("title"), F.array(F.get("rows", F.col("_h"))).alias("header_rows"), body.alias("rows"), "page",
        "context_before", extraction.section(context).alias("section"), "is_continuation", "n_cols",
    )
    tables = extraction.inherited(tables).withColumn("section", F.col("section_or_before")).drop("section_or_before")
    from tabulon.functions.numbers import context_unit, divisor

    unit = context_unit(F.concat_ws(" ", "title", "context_before"))
    tables = tables.withColumn("unit", unit).withColumn("unit_scale", F.when(F.col("unit").isNotNull(), divisor(F.col("unit"))))
    _write(tables, s, "tables")
    tables = _read(spark, s, "tables")
    terms, derived = (), ()
    if s.terms:
        listed = spark.read.parquet(s.terms)
        terms, derived = analysis.listed(listed, "surface", "metric"), tuple(sorted({r["metric"] for r in listed.where("is_derived").select("metric").distinct().collect()}))
    facts = normalization.facts(tables, documents.select("doc_id", "year"), terms, derived)
    fields = documents.select("doc_id", "ticker", "year", "report_type")
    _write(facts.join(tables.select("table_ref", "doc_id"), "table_ref").join(fields.withColumnRenamed("year", "report_year"), "doc_id"), s, "facts")
    facts = _read(spark, s, "facts")
    written = facts.select("table_ref").distinct()
    listed = tables.join(written, "table_ref", "left_semi").join(fields, "doc_id", "left")
    named = listed.withColumn("filename", text.safe_name(F.col("doc_id"), F.col("position"))).withColumn("csv_path", F.concat(F.lit(submission.PREFIX), F.col("filename"))).withColumn("n_rows", F.size("rows"))
    cards = normalization.full_cards(named, facts)
    catalog = named.join(cards, "table_ref", "left").withColumn("ingested_at", F.current_timestamp())
    sinks.write_catalog(sinks.catalog_rows(catalog), f"{s.out}/catalog", "full")
    n = {"documents": documents.count(), "detected": tables.count(), "written": written.count()}
    return n | {"skipped": n["detected"] - n["written"]}


def index(spark: SparkSession, s: Settings, encoder: retrieval.Encoder | None = None) -> dict[str, int]:
    """Checks, then postings and vectors of the cards; as many as the catalog has keys."""
    catalog = _read(spark, s, "catalog")
    evaluation.gate(evaluation.integrity(catalog, _read(spark, s, "documents")))
    cards = normalization.card_or_fields(catalog)
    retrieval.write_index(retrieval.build_index(cards, "table_ref", "card"), f"{s.out}/postings")
    _write(retrieval.encoded(cards, "table_ref", "card", encoder or retrieval.hashing_encoder()), s, "vectors")
    held = evaluation.index_integrity(catalog, retrieval.read_index(spark, f"{s.out}/postings").postings, _read(spark, s, "vectors"))
    return {r["check"]: r["n"] for r in held.collect()}


def analyzed(spark: SparkSession, s: Settings) -> DataFrame:
    """Questions with all that is read from their text: codes, years, metrics, type, unit, period."""
    from tabulon.functions.numbers import asked_unit, question_years, report_type, requested_period

    raw = sources.read_questions(spark, s.questions).select(F.col("id").cast("int").alias("id"), "question").dropDuplicates(["id"])
    catalog = _read(spark, s, "catalog")
    names = sources.read_json(spark, s.get("companies"), "ticker string, name string") if s.get("companies") else catalog.select("ticker").where("ticker IS NOT NULL").distinct().withColumn("name", F.lit(""))
    from tabulon.operators import companies

    q = F.col("question")
    found = raw.join(companies.tickers(raw, names), "id").select(
        "id", "question", "tickers", question_years(q).alias("years"), report_type(q).alias("report_type"), asked_unit(q).alias("asked_unit"), requested_period(q).alias("requested_period")
    )
    if s.terms:
        return found.join(analysis.metrics(raw, spark.read.parquet(s.terms)), "id", "left")
    return found.withColumn("metrics", F.array().cast("array<string>")).withColumn("needs_derived", F.lit(False))


def retrieve(spark: SparkSession, s: Settings, encoder: retrieval.Encoder | None = None, scorer=None) -> dict[str, int]:
    """All questions to ranked tables: filter, both searches, fusion, re-ranking by a scorer and by content, selection."""
    _write(analyzed(spark, s), s, "analyzed")
    questions, catalog = _read(spark, s, "analyzed"), _read(spark, s, "catalog")
    allowed = retrieval.admitted(questions, catalog).select("id", "table_ref")
    wide = questions.select("id", "question", "metrics", analysis.expanded(F.col("question"), F.col("metrics"), F.col("tickers"), F.col("years")).alias("q"))
    free = questions.select("id").join(allowed.select("id").distinct(), "id", "left_anti")
    sparse = retrieval.search_index(retrieval.read_index(spark, f"{s.out}/postings"), wide, "id", "q", s.top_k, allowed, free)
    asked = retrieval.encoded(wide, "id", "q", encoder or retrieval.hashing_encoder()).withColumnRenamed("id", "query")
    dense = retrieval.nearest_of(allowed.select(F.col("id").alias("query"), "table_ref"), _read(spark, s, "vectors"), "table_ref", "v", asked, s.top_k)
    part = lambda d, i: d.select(F.col(i).alias("qid"), "table_ref", "rank", "score")
    fused = retrieval.top(retrieval.fused_scores(part(sparse, "id"), part(dense, "query"), wide.select(F.col("id").alias("qid"), "metrics"), "qid", "table_ref"), "qid", "table_ref", "score", s.top_k)
    texts = fused.join(questions.select(F.col("id").alias("qid"), "question"), "qid").join(normalization.card_or_fields(catalog), "table_ref")
    kept = retrieval.reranked(texts, "qid", "table_ref", scorer, "question", "card", 50, s.keep).join(fused.select("qid", "table_ref", "score"), ["qid", "table_ref"])
    contents = retrieval.contents(_read(spark, s, "facts")).select("table_ref", text.fold(F.col("content")).alias("t"))
    held = kept.join(questions.select(F.col("id").alias("qid"), "question"), "qid").join(contents, "table_ref", "left").join(catalog.select("table_ref", "section"), "table_ref", "left")
    words = F.filter(text.tokens(F.col("question")), lambda w: F.length(w) >= 2)
    score = retrieval.phrase_score(text.phrases(F.col("question")), words, F.col("t")) + retrieval.cash_flow_score(F.col("question"), F.col("t"), F.col("section"))
    ordered = retrieval.content_ordered(held.select("qid", "table_ref", "rank", "score", F.coalesce(score, F.lit(0)).alias("content")), "qid", "table_ref")
    _write(ordered.join(kept.select("qid", "table_ref", "score"), ["qid", "table_ref"]).join(catalog.drop("card", "filename"), "table_ref", "left"), s, "candidates")
    pool = _read(spark, s, "candidates")
    _write(retrieval.selected(pool, questions, "qid", "table_ref", s.get("adaptive", True), s.get("k", 5), s.most_tables), s, "selected")
    return {"questions": questions.count(), "candidates": pool.count(), "selected": _read(spark, s, "selected").count()}


#: What makes plans of questions: rows of (id, ticker, metric, year, period) that its answer needs. A model may stand in its place.
Planner = Callable[[DataFrame], DataFrame]


def plain_planner(questions: DataFrame) -> DataFrame:
    """One lookup for each question: its first code, metric and year."""
    first = lambda c: F.get(c, F.lit(0))
    return questions.select("id", first("tickers").alias("ticker"), first("metrics").alias("metric"), first("years").alias("year"), F.col("requested_period").alias("period"))


def answer(spark: SparkSession, s: Settings, planner: Planner = plain_planner, only: DataFrame | None = None) -> dict[str, int]:
    """The questions that have no answer yet: their plans over the facts of their selected tables, relaxed where they find nothing. From what retrieve() has written."""
    questions = _read(spark, s, "analyzed")
    done = _read(spark, s, "answers").select("id") if _there(spark, s, "answers") else None
    todo = questions if done is None else questions.join(done, "id", "left_anti")
    if only is not None:
        todo = todo.join(only.select("id"), "id", "left_semi")
    bound = programs.bound(_read(spark, s, "selected").select(F.col("qid").alias("id"), F.col("place").alias("rank"), "table_ref"), todo, _read(spark, s, "catalog"))
    facts = _read(spark, s, "facts").join(bound.select("table_ref").distinct(), "table_ref", "left_semi")
    typed = facts.where("metric IS NOT NULL").select("ticker", "metric", F.coalesce("year", "report_year").alias("year"), "period", "table_ref", "row_idx", (F.col("value") * F.col("unit_scale")).alias("value"))
    plans = planner(todo)
    values = plans.select("id").join(programs.relaxed(plans, typed), "id", "left")
    written = values.select("id", "value", "level", F.concat(F.lit("lookup level "), F.coalesce("level", F.lit(0)).cast("string")).alias("plan"))
    n = written.count()
    written.write.mode("append").parquet(f"{s.out}/answers")
    return {"answered": n}


def package(spark: SparkSession, s: Settings) -> dict[str, int]:
    """Items from answers and selected tables, checked, as one JSON file."""
    questions, catalog = _read(spark, s, "analyzed"), _read(spark, s, "catalog")
    ranked = _read(spark, s, "selected").select(F.col("qid").alias("id"), F.col("place").alias("rank"), "table_ref").join(catalog.select("table_ref", "doc_id", "csv_path"), "table_ref")
    _write(submission.items(questions, _read(spark, s, "answers"), ranked), s, "items")
    rows = _read(spark, s, "items")
    broken = submission.violations(rows, questions)
    errors = broken.where("severity = 'error'").count()
    sinks.write_json(rows.orderBy("id"), f"{s.out}/results.json")
    return {"items": rows.count(), "errors": errors}


def judge(spark: SparkSession, s: Settings) -> dict[str, list[dict]]:
    """The report of the items against gold(id, gold_docs, gold_tables, gold_answer)."""
    rows = _read(spark, s, "items").select("id", F.col("relevant_docs").alias("docs"), F.col("relevant_tables").alias("tables"), "answer", "plan")
    return evaluation.report(evaluation.judged(spark.read.parquet(s.gold), rows))


STAGES = {"corpus": (corpus, "catalog"), "index": (index, "vectors"), "retrieve": (retrieve, "selected"), "answer": (answer, "answers"), "package": (package, "items"), "judge": (judge, "")}


def run(spark: SparkSession, s: Settings, *stages: str) -> dict[str, object]:
    """The stages named, or with `all` those whose results aren't there yet."""
    out: dict[str, object] = {}
    every = not stages or "all" in stages
    for name in STAGES if every else stages:
        if name not in STAGES:
            raise ValueError(f"no such stage: {name}")
        stage, result = STAGES[name]
        if every and (name == "judge" and not s.gold or result and _there(spark, s, result)):
            continue
        out[name] = stage(spark, s)
    return out
