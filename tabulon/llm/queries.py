"""The queries of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import canonical, markup, matching, noise, packing, quality, ranking, tokens
from tabulon.session import checkpoint, partitions, spread, table

CAPACITY = 2048


def _record(source: str, key: str, *rest) -> list:
    return [F.lit(source).alias("source_table"), F.col(key).cast("string").alias("record_key"), *rest]


def _scan(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows go to Python, in parts enough for all cores."""
    return spread(table(spark, d, name).select(*columns))


def _once(rows: DataFrame, key: str) -> DataFrame:
    """Each record once, in parts enough for work in Python."""
    return rows.repartition(partitions(rows), key).dropDuplicates([key])


def _texts_and_cells(texts: DataFrame, source: str, cells: DataFrame) -> DataFrame:
    """(source_table, record_key, line_no, col_no, text): whole texts of raw_documents at line and column 0, and cells of source from 1."""
    whole = texts.select(*_record("raw_documents", "doc_id", F.lit(0).cast("long").alias("line_no"), F.lit(0).cast("long").alias("col_no"), "text"))
    return whole.unionByName(cells.select(*_record(source, "record_key", "line_no", "col_no", "text")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    metrics, titles = table(spark, d, "metric_terms"), table(spark, d, "title_terms")
    terms = table(spark, d, "term_matches").select("match_id", "metric", "surface")
    terms = terms.repartition(partitions(terms), "match_id").dropDuplicates(["match_id"])
    # The two lists are fixed tables, so the anti-joins broadcast them.
    terms = terms.join(F.broadcast(metrics.select("metric", "surface")), ["metric", "surface"], "left_anti")
    named = table(spark, d, "table_catalog").select("table_ref", "title").where(F.trim("title") != "")
    named = named.repartition(partitions(named), "table_ref").dropDuplicates(["table_ref"])
    named = named.join(F.broadcast(titles.select("title")), "title", "left_anti")
    a = matching.map_to_entries(terms, metrics.select(F.col("metric").alias("key"), "surface"), "surface", "metric")
    b = matching.map_to_entries(named, titles.select(F.col("title_key").alias("key"), F.col("title").alias("surface")), "title")
    return a.select(*_record("term_matches", "match_id", "entry")).unionByName(b.select(*_record("table_catalog", "table_ref", "entry")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    lines = markup.found_lines(_scan(spark, d, "raw_documents", "doc_id", "text"))
    cells = markup.found_cells(_scan(spark, d, "html_tables", "table_ref", "rows"))
    return lines.select(*_record("raw_documents", "record_key", "line_no", "col_no")).unionByName(cells.select(*_record("html_tables", "record_key", "line_no", "col_no")))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    texts = markup.cleaned(_once(table(spark, d, "raw_documents").select("doc_id", "text"), "doc_id"))
    cells = markup.cleaned_cells(_once(table(spark, d, "html_tables").select("table_ref", "rows"), "table_ref"))
    return _texts_and_cells(texts, "html_tables", cells)


_FIELDS = (("questions", "id", "question"), ("table_catalog", "table_ref", "title"), ("term_matches", "match_id", "surface"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [canonical.changed(table(spark, d, name).select(key, text), text).select(*_record(name, key)) for name, key, text in _FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        canonical.with_canonical(table(spark, d, name).select(key, text).dropDuplicates([key]), text, "form").select(*_record(name, key, F.col("form")))
        for name, key, text in _FIELDS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _scores(spark: SparkSession, d: str) -> DataFrame:
    dense = F.when(F.col("dense_kind") == "l2", -F.col("dense_score")).otherwise(F.col("dense_score"))
    scores = {"bm25": (F.col("bm25_score"), 1.0), "dense": (dense, 1.0), "rerank": (F.col("rerank_score"), 1.0)}
    return ranking.fused(table(spark, d, "candidates"), "qid", "table_ref", scores)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_of(_scores(spark, d), "qid", "table_ref")


def p5_order(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ordered(_scores(spark, d), "qid", "table_ref").select("qid", "table_ref", "position")


def _shared_lexicon(spark: SparkSession, documents: DataFrame, tables: DataFrame):
    return spark.sparkContext.broadcast(noise.lexicon(documents, tables))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    documents, tables = _scan(spark, d, "raw_documents", "doc_id", "text"), _scan(spark, d, "extracted_tables", "table_ref", "rows")
    shared = _shared_lexicon(spark, documents, tables)
    lines, cells = noise.found_lines(spark, documents, shared), noise.found_cells(spark, tables, shared)
    return lines.select(*_record("raw_documents", "record_key", "line_no", "col_no")).unionByName(cells.select(*_record("extracted_tables", "record_key", "line_no", "col_no")))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    documents, tables = _scan(spark, d, "raw_documents", "doc_id", "text"), _scan(spark, d, "extracted_tables", "table_ref", "rows")
    shared = _shared_lexicon(spark, documents, tables)
    texts, cells = noise.repaired(_once(documents, "doc_id"), shared), noise.repaired_cells(_once(tables, "table_ref"), shared)
    return _texts_and_cells(texts, "extracted_tables", cells)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_scan(spark, d, "documents", "doc_id", "text"))


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tokens.offsets(_scan(spark, d, "documents", "doc_id", "text"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode(tokens.encode(_scan(spark, d, "documents", "doc_id", "text")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.count(_scan(spark, d, "documents", "doc_id", "text")), CAPACITY)


def _classified(spark: SparkSession, d: str) -> DataFrame:
    common = quality.common_set(table(spark, d, "common_words"))
    stats = checkpoint(quality.statistics(_scan(spark, d, "documents", "doc_id", "text"), common))
    return quality.classified(stats, quality.fit(stats, common))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).where(F.col("kind") != "prose").select("doc_id")


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p1_found, p2_found, p2_clean, p3_found, p3_canonical, p5_found, p5_order, p6_found, p6_repaired,
        p7_ids, p7_offsets, p7_decoded, p8_containers, p9_found, p9_statistics,
    )
    return {f.__name__: f for f in every}


_INVERSE = """
CASE WHEN {p} < 0.02425 THEN {outer}
     WHEN {p} > 0.97575 THEN -({outer})
     ELSE (((((-39.69683028665376*power({p}-0.5,2)+220.9460984245205)*power({p}-0.5,2)-275.9285104469687)*power({p}-0.5,2)+138.3577518672690)*power({p}-0.5,2)-30.66479806614716)*power({p}-0.5,2)+2.506628277459239)*({p}-0.5)
        / (((((-54.47609879822406*power({p}-0.5,2)+161.5858368580409)*power({p}-0.5,2)-155.6989798598866)*power({p}-0.5,2)+66.80131188771972)*power({p}-0.5,2)-13.28068155288572)*power({p}-0.5,2)+1) END
"""


def _inverse(p: str) -> str:
    t = f"sqrt(-2*ln(least({p},1-{p})))"
    outer = (
        f"(((((-0.007784894002430293*{t}-0.3223964580411365)*{t}-2.400758277161838)*{t}-2.549732539343734)*{t}+4.374664141464968)*{t}+2.938163982698783)"
        f"/((((0.007784695709041462*{t}+0.3224671290700398)*{t}+2.445134137142996)*{t}+3.754408661907416)*{t}+1)"
    )
    return _INVERSE.format(p=p, outer=outer)


def _percentile(s: str) -> str:
    return f"(rank() OVER (PARTITION BY qid ORDER BY {s} NULLS FIRST) - 1 + count(*) OVER (PARTITION BY qid, {s}) / 2.0) / count(*) OVER (PARTITION BY qid) AS p_{s}"


_FUSED = f"""
WITH once AS (SELECT DISTINCT qid, table_ref, bm25_score AS bm25, CASE WHEN dense_kind = 'l2' THEN -dense_score ELSE dense_score END AS dense, rerank_score AS rerank
              FROM candidates WHERE qid IS NOT NULL),
p AS (SELECT qid, table_ref, {", ".join(map(_percentile, ("bm25", "dense", "rerank")))} FROM once),
z AS (SELECT qid, table_ref, round((({_inverse("p_bm25")}) + ({_inverse("p_dense")}) + ({_inverse("p_rerank")})) / 3, 9) AS combined FROM p),
r AS (SELECT qid, table_ref, CAST(row_number() OVER (PARTITION BY qid ORDER BY combined DESC, table_ref) AS INTEGER) AS position FROM z)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _FUSED + "SELECT qid, table_ref FROM r WHERE position = 1",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p5_order": _FUSED + "SELECT qid, table_ref, position FROM r",
    }
