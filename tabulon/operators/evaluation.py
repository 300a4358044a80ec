"""Judging results: precision, recall, F2, reciprocal rank, answers; checks of catalogs, indexes and submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(found: Column, gold: Column) -> dict[str, Column]:
    """precision, recall and f2 of two lists as sets; both empty is right, one empty is wrong."""
    p, g = F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(gold, F.array().cast("array<string>")))
    n = F.size(F.array_intersect(p, g))
    precision = F.when(F.size(g) == 0, F.when(F.size(p) == 0, 1.0).otherwise(0.0)).when(F.size(p) == 0, 0.0).otherwise(n / F.size(p))
    recall = F.when(F.size(g) == 0, 1.0).when(F.size(p) == 0, 0.0).otherwise(n / F.size(g))
    f2 = F.coalesce(F.try_divide(5 * precision * recall, 4 * precision + recall), F.lit(0.0))
    return {"precision": precision, "recall": recall, "f2": f2}


def reciprocal_rank(found: Column, gold: Column, depth: int = 5) -> Column:
    """1 / place of the first hit among the first places of the list as it stands, else 0."""
    head = F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, depth)
    places = F.filter(F.transform(head, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda i: i.isNotNull())
    return F.when((F.size(gold) > 0) & (F.size(places) > 0), 1.0 / F.get(places, F.lit(0))).otherwise(0.0)


def same_answer(a: Column, b: Column, absolute: float = 1e-6, relative: float = 0.01) -> Column:
    """Whether an answer is right: within the absolute or relative tolerance of the gold one, or both null; NaN never."""
    off = F.abs(a - b)
    close = (off <= absolute) | ((b != 0) & (off <= relative * F.abs(b)))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).when(F.isnan(a) | F.isnan(b), False).otherwise(close)


#: Tags of what went wrong, each with its condition on the columns of evaluated().
TAGS = {
    "NO_DOCUMENT": "found_any = false",
    "WRONG_DOCUMENT": "found_any AND doc_recall = 0",
    "PARTIAL_DOCUMENTS": "doc_recall > 0 AND doc_recall < 1",
    "EXTRA_DOCUMENTS": "doc_recall > 0 AND doc_precision < 1",
    "MISSING_ANSWER": "answer IS NULL AND gold_answer IS NOT NULL",
    "WRONG_ANSWER": "answer IS NOT NULL AND NOT answer_correct",
}


def evaluated(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per gold id: measures of predictions(id, docs, answer) against gold(id, gold_docs, gold_answer); absent ones count as empty."""
    once = predictions.dropDuplicates(["id"])
    joined = gold.join(once, "id", "left")
    m = hits(F.col("docs"), F.col("gold_docs"))
    measured = joined.select(
        "id", "answer", "gold_answer", (F.coalesce(F.size("docs"), F.lit(0)) > 0).alias("found_any"),
        m["precision"].alias("doc_precision"), m["recall"].alias("doc_recall"), m["f2"].alias("doc_f2"),
        reciprocal_rank(F.col("docs"), F.col("gold_docs")).alias("doc_mrr"), same_answer(F.col("answer"), F.col("gold_answer")).alias("answer_correct"),
    )
    tags = F.filter(F.array(*(F.when(F.expr(c), F.lit(t)) for t, c in TAGS.items())), lambda t: t.isNotNull())
    return measured.withColumn("tags", tags)


def summary(rows: DataFrame) -> DataFrame:
    """The means over all questions, as one row."""
    mean = lambda c, n: F.round(F.avg(F.col(c).cast("double")), 6).alias(n)
    return rows.agg(F.count("*").alias("n"), mean("doc_precision", "precision"), mean("doc_recall", "recall"), mean("doc_f2", "f2"), mean("doc_mrr", "mrr"), mean("answer_correct", "answer_accuracy"))


#: Tags of a judged item, from the root of its failure on; a right one has the last.
FAILURES = {
    "TABLE_MISS": "size(gold_tables) > 0 AND NOT arrays_overlap(gold_tables, tables)",
    "DOC_MISS": "size(gold_docs) > 0 AND NOT arrays_overlap(gold_docs, docs)",
}
RANK_FAILURES = {
    "TABLE_BAD_RANK": "size(gold_tables) > 0 AND table_recall > 0 AND table_mrr < 1",
    "DOC_BAD_RANK": "size(gold_docs) > 0 AND doc_recall > 0 AND doc_mrr < 1",
}


def judged(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per gold id: documents, tables, answer and execution of predictions(id, docs, tables, answer, plan[, ran]) against gold(id, gold_docs, gold_tables, gold_answer).

    A plan has run where `ran` says so, else where it isn't empty; execution is right where it ran and the answer is right.
    """
    strings = F.array().cast("array<string>")
    once = predictions.dropDuplicates(["id"])
    ran = F.coalesce(F.col("ran"), F.trim(F.coalesce("plan", F.lit(""))) != "") if "ran" in once.columns else F.trim(F.coalesce("plan", F.lit(""))) != ""
    joined = gold.join(once, "id", "left")
    for c in ("gold_docs", "gold_tables", "docs", "tables"):
        joined = joined.withColumn(c, F.coalesce(c, strings))
    d, t = hits(F.col("docs"), F.col("gold_docs")), hits(F.col("tables"), F.col("gold_tables"))
    right = same_answer(F.col("answer"), F.col("gold_answer"))
    rows = joined.select(
        "id", "docs", "tables", "gold_docs", "gold_tables", "answer", "gold_answer", F.coalesce("plan", F.lit("")).alias("plan"),
        *(m[k].alias(f"{n}_{k}") for n, m in (("doc", d), ("table", t)) for k in ("precision", "recall", "f2")),
        reciprocal_rank(F.col("docs"), F.col("gold_docs")).alias("doc_mrr"), reciprocal_rank(F.col("tables"), F.col("gold_tables")).alias("table_mrr"),
        right.alias("answer_correct"), (ran & right).alias("execution_correct"),
    )
    listed = lambda rules: F.filter(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    rows = rows.withColumn("_miss", listed(FAILURES)).withColumn("_rank", listed(RANK_FAILURES))
    upstream = F.when(F.size("_miss") > 0, F.col("_miss")).otherwise(F.col("_rank"))
    answer_tag = (
        F.when(F.col("answer_correct"), None).when(F.trim("plan") == "", "QUERY_NO_CODE").when(~F.col("execution_correct") & F.col("answer").isNotNull(), "EXECUTION_ERROR").when(F.size(upstream) == 0, "ANSWER_MISMATCH")
    )
    tags = F.concat(upstream, F.when(answer_tag.isNotNull(), F.array(answer_tag)).otherwise(strings))
    return rows.withColumn("tags", F.when((F.size(tags) == 0) & F.col("answer_correct"), F.array(F.lit("SUCCESS"))).otherwise(tags)).drop("_miss", "_rank")


def judged_summary(rows: DataFrame) -> DataFrame:
    """The ten means over all questions and the overall one, of table F2, answers and execution; no question gives zeros."""
    mean = lambda c, n: F.coalesce(F.round(F.avg(F.col(c).cast("double")), 6), F.lit(0.0)).alias(n)
    means = [mean(f"{n}_{k}", f"{n}_{k}") for n in ("doc", "table") for k in ("precision", "recall", "f2", "mrr")]
    out = rows.agg(F.count("*").alias("n"), *means, mean("answer_correct", "answer_accuracy"), mean("execution_correct", "execution_accuracy"))
    return out.withColumn("overall", F.round((F.col("table_f2") + F.col("answer_accuracy") + F.col("execution_accuracy")) / 3, 6))


def report(rows: DataFrame, worst: int = 20) -> dict[str, list[dict]]:
    """A report for a person: the summary, counts of tags, the funnel and the worst questions; a few rows each."""
    found = rows.withColumn("found_any", F.size("docs") > 0)
    parts = {"summary": judged_summary(rows), "tags": tag_counts(rows).orderBy(F.desc("n"), "tag"), "funnel": funnel(found), "worst": rows.select("id", "table_f2", "doc_f2", "answer_correct", "tags").orderBy("table_f2", "doc_f2", "id").limit(worst)}
    return {name: [r.asDict() for r in part.collect()] for name, part in parts.items()}


def tag_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def funnel(rows: DataFrame) -> DataFrame:
    """(step, n, percent): how many questions have a document, the right one, and the right answer."""
    total = F.count("*")
    steps = {"all": F.lit(True), "any_document": F.col("found_any"), "right_document": F.col("doc_recall") > 0, "right_answer": F.col("answer_correct") & (F.col("doc_recall") > 0)}
    counted = rows.agg(total.alias("_n"), *(F.count_if(c).alias(s) for s, c in steps.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.col(s).alias("n")) for s in steps)))
    return counted.select("_n", pairs.alias("p")).select("p.step", "p.n", F.round(F.try_divide(F.col("p.n") * 100.0, F.col("_n")), 4).alias("percent"))


def integrity(catalog: DataFrame, documents: DataFrame, orphan_error: float = 0.05, coverage_error: float = 0.9) -> DataFrame:
    """(check, severity, n) of a catalog(table_ref, doc_id, ticker) against documents(doc_id, ticker)."""
    repeated = catalog.groupBy("table_ref").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n"))
    keys, docs = catalog.select("doc_id").distinct(), documents.select("doc_id").distinct()
    orphans, missing = keys.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("n")), docs.join(keys, "doc_id", "left_anti").agg(F.count("*").alias("n"))
    coverage = catalog.agg(F.count_if(F.col("ticker").isNotNull()).alias("n"), F.count("*").alias("all"))
    total = keys.agg(F.count("*").alias("all"))
    row = lambda d, name, severity: d.select(F.lit(name).alias("check"), severity.alias("severity"), F.col("n"))
    grade = lambda bad: F.when(F.col("n") == 0, "ok").when(bad, "error").otherwise("warning")
    return (
        row(repeated, "repeated_keys", grade(F.lit(True)))
        .unionByName(row(orphans.crossJoin(total), "tables_without_document", grade(F.col("n") > orphan_error * F.col("all"))))  # one row each
        .unionByName(row(missing, "documents_without_table", grade(F.lit(False))))
        .unionByName(row(coverage, "tables_with_code", F.when(F.col("n") < coverage_error * F.col("all"), "error").otherwise("ok")))
    )


def index_integrity(catalog: DataFrame, postings: DataFrame, vectors: DataFrame) -> DataFrame:
    """(check, expected, n, ok): an index must hold as many keys as the catalog."""
    count = lambda d, k: d.agg(F.count_distinct(k).alias("n"))
    expected = count(catalog, "table_ref").withColumnRenamed("n", "expected")
    parts = [count(d, "table_ref").crossJoin(expected).select(F.lit(n).alias("check"), "expected", "n", (F.col("n") == F.col("expected")).alias("ok")) for n, d in (("sparse", postings), ("dense", vectors))]
    return parts[0].unionByName(parts[1])


def gate(checks: DataFrame) -> None:
    """Stop if any check is an error."""
    bad = [r["check"] for r in checks.where("severity = 'error'").select("check").collect()]
    if bad:
        raise ValueError(f"integrity checks failed: {', '.join(sorted(bad))}")
