"""Results as they are handed in: from answers and ranked tables to items, their rules, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.numbers import answer as in_unit
from tabulon.functions.numbers import asked_unit

#: The values from which an answer in dong is brought to the unit asked for.
LARGE = 1e11
PREFIX = "data/"
#: Tables named as evidence where a plan names none.
EVIDENCE = 4
ITEM = (
    "id INT, question STRING, answer DOUBLE, relevant_docs ARRAY<STRING>, relevant_tables ARRAY<STRING>, "
    "evidence ARRAY<STRUCT<variable: STRING, csv_path: STRING>>, plan STRING"
)


def coerced(value: Column) -> Column:
    """struct(value, error) of a list that should hold one number: NaN, infinity, none or several are errors."""
    one = F.get(value, F.lit(0)).try_cast("double")
    error = (
        F.when(value.isNull() | (F.size(value) == 0), "no value").when(F.size(value) > 1, F.concat(F.size(value).cast("string"), F.lit(" values")))
        .when(one.isNull(), "no number").when(F.isnan(one), "NaN").when(F.abs(one) == float("inf"), "infinite")
    )
    return F.struct(F.when(error.isNull(), one).alias("value"), error.alias("error"))


def final_answer(value: Column, question: Column) -> Column:
    """A value as it is handed in: large ones in the millions or thousand millions asked for, others to two digits, 0 for none."""
    unit = asked_unit(question)
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(~usable | value.isNull(), 0.0).when((value >= LARGE) & unit.isin("trieu_dong", "ty_dong"), in_unit(value, unit)).otherwise(F.round(value, 2))


def relative_path(path: Column) -> Column:
    """A path of a table as it is handed in: slashes only, below the folder of tables."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")
    return F.when(plain.startswith(PREFIX), plain).otherwise(F.concat(F.lit(PREFIX), F.substring_index(plain, "/", -1)))


def items(questions: DataFrame, answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """One item per question: questions(id, question), answers(id, value[, plan]), ranked(id, rank, table_ref, doc_id, csv_path).

    Tables and documents come once each, in the order of their ranks; the evidence is the first tables'.
    """
    once = questions.select("id", "question").dropDuplicates(["id"])
    lists = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "table_ref", "doc_id", "csv_path"))).alias("_r"))
    plan = F.col("plan") if "plan" in answers.columns else F.lit("")
    joined = once.join(answers.select("id", "value", plan.alias("plan")), "id", "left").join(lists, "id", "left")
    listed = lambda c: F.coalesce(F.array_distinct(F.transform("_r", lambda s: s[c])), F.array().cast("array<string>"))
    first = F.slice(F.filter(F.coalesce("_r", F.array().cast("array<struct<rank:int,table_ref:string,doc_id:string,csv_path:string>>")), lambda s: s["csv_path"].isNotNull()), 1, EVIDENCE)
    evidence = F.transform(first, lambda s, i: F.struct(F.concat(F.lit("df"), (i + 1).cast("string")).alias("variable"), relative_path(s["csv_path"]).alias("csv_path")))
    return joined.select(
        F.col("id").cast("int").alias("id"), "question", final_answer(F.col("value"), F.col("question")).alias("answer"),
        listed("doc_id").alias("relevant_docs"), listed("table_ref").alias("relevant_tables"), evidence.alias("evidence"), F.coalesce("plan", F.lit("")).alias("plan"),
    )


def to_json(rows: DataFrame) -> DataFrame:
    """(id, json) of items."""
    return rows.select("id", F.to_json(F.struct(*rows.columns)).alias("json"))


def from_json(lines: DataFrame, column: str = "json") -> DataFrame:
    """Items of JSON lines; absent fields are empty, an absent answer is 0."""
    rows = lines.select(F.from_json(column, ITEM).alias("i")).select("i.*")
    return rows.fillna({"answer": 0.0, "question": "", "plan": ""}).select(
        "id", "question", "answer", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("relevant_docs", "array<string>"), ("relevant_tables", "array<string>"), ("evidence", "array<struct<variable:string,csv_path:string>>"))), "plan"
    )


#: Rules of an item, each true where it is broken, and how grave that is.
RULES = {
    "question_missing": ("error", "question IS NULL OR question = ''"),
    "answer_missing": ("error", "answer IS NULL"),
    "answer_not_finite": ("error", "answer IS NOT NULL AND (isnan(answer) OR abs(answer) = double('infinity'))"),
    "documents_not_listed": ("error", "relevant_docs IS NULL"),
    "no_documents": ("warning", "relevant_docs IS NOT NULL AND size(relevant_docs) = 0"),
    "document_with_suffix": ("error", "exists(relevant_docs, d -> endswith(d, '.txt'))"),
    "tables_not_listed": ("error", "relevant_tables IS NULL"),
    "no_tables": ("warning", "relevant_tables IS NOT NULL AND size(relevant_tables) = 0"),
    "malformed_table": ("error", "exists(relevant_tables, t -> NOT t RLIKE '^.+[|]-?[0-9]+$')"),
    "table_of_other_document": ("warning", "size(relevant_docs) > 0 AND exists(relevant_tables, t -> contains(t, '|') AND NOT array_contains(relevant_docs, regexp_extract(t, '^(.*)[|]', 1)))"),
    "evidence_not_listed": ("error", "evidence IS NULL"),
    "evidence_incomplete": ("error", "exists(evidence, e -> e.variable IS NULL OR e.csv_path IS NULL)"),
    "path_with_backslash": ("error", r"exists(evidence, e -> contains(e.csv_path, '\\'))"),
    "path_not_relative": ("error", "exists(evidence, e -> e.csv_path RLIKE '^(/|.:)')"),
    "path_elsewhere": ("error", f"exists(evidence, e -> NOT startswith(e.csv_path, '{PREFIX}'))"),
    "plan_missing": ("error", "plan IS NULL"),
    "plan_empty": ("warning", "plan IS NOT NULL AND trim(plan) = ''"),
    "variable_not_in_plan": ("warning", "plan <> '' AND exists(evidence, e -> NOT contains(plan, e.variable))"),
}


def violations(rows: DataFrame, expected: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(rule, severity, id) of every broken rule, all in one pass; repeated, unknown and absent ids; paths that files(csv_path) lacks."""
    checks = F.filter(F.array(*(F.when(F.expr(c), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, (s, c) in RULES.items())), lambda r: r.isNotNull())
    out = rows.select("id", F.explode(checks).alias("r")).select("r.rule", "r.severity", "id").distinct()
    error = lambda d, rule: d.select(F.lit(rule).alias("rule"), F.lit("error").alias("severity"), "id")
    out = out.unionByName(error(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "repeated_id"))
    if expected is not None:
        own, wanted = rows.select("id").distinct(), expected.select(F.col("id").cast("int").alias("id")).distinct()
        out = out.unionByName(error(own.join(wanted, "id", "left_anti"), "unknown_id")).unionByName(error(wanted.join(own, "id", "left_anti"), "absent_id"))
    if files is not None:
        named = rows.select("id", F.explode("evidence.csv_path").alias("csv_path"))
        out = out.unionByName(error(named.join(files.select("csv_path").distinct(), "csv_path", "left_anti").select("id").distinct(), "file_missing"))
    return out
