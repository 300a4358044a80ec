"""Finding tables: constraints and their relaxation, BM25, exact vector search, fusion, selection."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.lookalikes import canonical
from tabulon.functions.lookalikes import fold as fold_text
from tabulon.functions.text import STOPWORDS, fold
from tabulon.session import checkpoint, spread

K1, B = 1.5, 0.75
RRF = 60


def term_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term): a row for each word of each text but stopwords. Words are told apart as rows, so that the test of each is compiled code."""
    words = spread(texts.select(id_col, text_col)).select(id_col, F.explode(F.split(fold(F.col(text_col)), "[^0-9a-z]+")).alias("term"))
    return words.where(~F.col("term").isin("", *STOPWORDS))


def term_frequencies(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)."""
    return term_rows(texts, id_col, text_col).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def _idf(n: int | Column) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))


def document_frequencies(frequencies: DataFrame, n: int) -> DataFrame:
    """(term, df, idf)."""
    df = F.count("*")
    return frequencies.groupBy("term").agg(df.alias("df")).withColumn("idf", _idf(n))


@dataclass
class Index:
    """An inverted index: postings(id, term, w), where w is the whole weight of a term in a text, and how many texts it is of."""

    postings: DataFrame
    n: int
    id_col: str


def build_index(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame | None = None) -> Index:
    """The index of all texts, those without words included in its statistics; terms(term): only these are kept.

    Texts are taken apart once: their frequencies are written to a checkpoint, and lengths, document frequencies and
    weights come from there.
    """
    n = texts.count()
    frequencies = checkpoint(term_frequencies(texts, id_col, text_col))
    lengths = frequencies.groupBy(id_col).agg(F.sum("tf").alias("_len"))
    mean = (lengths.agg(F.sum("_len")).first()[0] or 0) / max(n, 1)
    kept = frequencies if terms is None else frequencies.join(terms.select("term").distinct(), "term", "left_semi")
    idf = kept.groupBy("term").agg(F.count("*").alias("df")).select("term", _idf(n).alias("idf"))
    norm = F.lit(1 - B) + F.col("_len") * (B / (mean or 1.0))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm * K1)
    return Index(kept.join(lengths, id_col).join(idf, "term").select(id_col, "term", weight.alias("w")), n, id_col)


def write_index(index: Index, path: str, buckets: int = 64) -> None:
    """An index as parquet, its postings by ranges of a hash of their term, so that a few terms read a few files."""
    hashed = index.postings.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    hashed.repartitionByRange("part", index.id_col).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    spark = index.postings.sparkSession
    spark.createDataFrame([(index.n, index.id_col, buckets)], "n long, id_col string, buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def read_index(spark: SparkSession, path: str) -> Index:
    about = spark.read.schema("n long, id_col string, buckets int").json(f"{path}/about").first()
    return Index(spark.read.parquet(f"{path}/postings").drop("part"), about["n"], about["id_col"])


def search_index(index: Index, queries: DataFrame, query_id: str, query_text: str, k: int, allowed: DataFrame | None = None, free: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best texts of each query with a score above 0.

    Statistics are those of all texts, also under `allowed` (query_id, id), which restricts the join to pairs that a
    filter admits; queries of `free` (query_id) are held against all texts nevertheless.
    """
    asked = term_rows(queries, query_id, query_text).distinct()
    weighted, id_col = index.postings, index.id_col
    if allowed is None:
        pairs = asked.join(weighted, "term")
    else:  # the admitted pairs first: their terms are far fewer than the postings of all terms
        pairs = allowed.select(query_id, id_col).distinct().join(asked, query_id).join(weighted, [id_col, "term"])
        if free is not None:
            pairs = pairs.unionByName(asked.join(free.select(query_id), query_id, "left_semi").join(weighted, "term"))
    scored = pairs.groupBy(query_id, id_col).agg(F.round(F.sum("w"), 6).alias("score")).where("score > 0")
    return top(scored, query_id, id_col, "score", k)


def bm25(texts: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_id: str, query_text: str, k: int, allowed: DataFrame | None = None, free: DataFrame | None = None) -> DataFrame:
    """As search_index(), over an index made for these queries."""
    terms = term_rows(queries, query_id, query_text).select("term")
    return search_index(build_index(texts, id_col, text_col, terms), queries, query_id, query_text, k, allowed, free)


def top(rows: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """The k best rows of each group with their rank; ties by item. Catalyst limits groups before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(score), item)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Queries that are held against the vectors at once; more are taken in blocks of this size.
QUERY_BLOCK = 2048


def nearest(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """(query, id, score, rank): the exact k nearest vectors of each of queries(query, v). metric: ip, or l2 (minus the squared distance).

    Each task multiplies its vectors with a block of queries and passes on its own k best, so k rows a task and query are shuffled.
    """
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.DoubleType())])
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    parts = []
    for i in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        held = block.collect()
        names = np.array([r["query"] for r in held], np.int64)
        q = np.array([r["v"] for r in held], np.float64).reshape(len(held), -1)

        def run(batches: Iterator[pa.RecordBatch], names=names, q=q) -> Iterator[pa.RecordBatch]:
            best_ids = np.zeros((len(names), 0), np.int64)
            best = np.zeros((len(names), 0))
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                ids = batch.column(0).to_numpy()
                v = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
                s = q @ v.T
                if metric == "l2":
                    s = 2 * s - (q**2).sum(1)[:, None] - (v**2).sum(1)[None, :]
                s = np.round(s, 6) + 0.0  # no minus zero
                ids_all = np.concatenate([best_ids, np.broadcast_to(ids, s.shape)], 1)
                all_scores = np.concatenate([best, s], 1)
                order = np.lexsort((ids_all, -all_scores), axis=1)[:, :k]
                best_ids, best = np.take_along_axis(ids_all, order, 1), np.take_along_axis(all_scores, order, 1)
            width = best.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, width)), pa.array(best_ids.ravel()), pa.array(best.ravel())], schema.names)

        parts.append(vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top(out, "query", id_col, "score", k)


def nearest_of(pairs: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """As nearest(), among the pairs(query, id) that a filter admits: two equi-joins, and products of vectors in the JVM."""
    joined = pairs.select("query", id_col).distinct().join(queries.select("query", "v"), "query").join(vectors.select(id_col, F.col(vector_col).alias("_v")), id_col)
    sums = lambda f: F.aggregate(F.zip_with(F.col("v"), F.col("_v"), lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda t, x: t + x)
    score = sums(lambda x, y: x * y) if metric == "ip" else -sums(lambda x, y: (x - y) * (x - y))
    return top(joined.select("query", id_col, (F.round(score, 6) + 0.0).alias("score")), "query", id_col, "score", k)


class Encoder(Protocol):
    """What turns texts into vectors: a model of any kind, called with a column. prefix is put before each text, as some models ask for."""

    def __call__(self, text: Column) -> Column: ...


def hashing_encoder(size: int = 256, prefix: str = "") -> Encoder:
    """An encoder without a model: signed hashes of the words and word pairs of a text, of length 1; a text without words gives zeros."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(size, np.float32)
            words = re.findall("[0-9a-z]+", fold_text(prefix + (text or "")))
            for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = zlib.crc32(w.encode())
                v[h % size] += 1.0 if h >> 31 else -1.0
            norm = float(np.linalg.norm(v))
            out.append((v / norm if norm else v).tolist())
        return pd.Series(out)

    return encode


def encoded(texts: DataFrame, id_col: str, text_col: str, encoder: Encoder) -> DataFrame:
    """(id, v): the vectors of texts, to be written once and searched by nearest() or nearest_of()."""
    return texts.select(id_col, encoder(F.coalesce(text_col, F.lit(""))).alias("v"))


def reranked(ranked: DataFrame, group: str, item: str, scorer: Callable[[Column, Column], Column] | None, query: str, text: str, head: int = 50, keep: int = 30) -> DataFrame:
    """(group, item, rank): the first `head` rows ordered by scorer(query, text), the others behind them as they were; `keep` of all.

    Without a scorer, and for a row that it gives no score, the old order stands.
    """
    rows = ranked.withColumn("_s", F.when(F.col("rank") <= head, scorer(F.col(query), F.col(text))) if scorer else F.lit(None).cast("double"))
    order = Window.partitionBy(group).orderBy((F.col("rank") > head).cast("int"), F.col("_s").desc_nulls_last(), "rank", item)
    return rows.select(group, item, F.row_number().over(order).alias("rank")).where(F.col("rank") <= keep)


#: What is added for a table near the beginning of its report where a question names metrics.
EARLY, EARLY_TABLES = 0.003, 12


def fused_scores(sparse: DataFrame, dense: DataFrame, questions: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, score, sparse_score, dense_score): fused_ranks() of lists(group, item, rank, score) with raw scores, 0 where one list lacks an item.

    items of the first EARLY_TABLES positions of their report (in item, behind the stroke) get a bonus where questions(group, metrics) names metrics.
    """
    part = lambda d, n: d.select(group, item, (1.0 / (RRF + F.col("rank"))).alias("s"), *(F.col("score").alias(m) if m == n else F.lit(None).cast("double").alias(m) for m in ("sparse_score", "dense_score")))
    both = part(sparse, "sparse_score").unionByName(part(dense, "dense_score")).groupBy(group, item)
    fused = both.agg(F.sum("s").alias("_s"), *(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("sparse_score", "dense_score")))
    position = F.substring_index(item, "|", -1).try_cast("int")
    named = questions.select(group, (F.size(F.coalesce("metrics", F.array().cast("array<string>"))) > 0).alias("_m"))
    bonus = F.when(F.coalesce(F.col("_m"), F.lit(False)) & position.between(1, EARLY_TABLES), EARLY).otherwise(0.0)
    return fused.join(named, group, "left").select(group, item, F.round(F.col("_s") + bonus, 9).alias("score"), "sparse_score", "dense_score")


def fused_ranks(a: DataFrame, b: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, score): sum of 1 / (60 + rank) over two ranked lists; an item in one only gets the one share."""
    one = lambda d: d.select(group, item, (1.0 / (RRF + F.col("rank"))).alias("s"))
    return one(a).unionByName(one(b)).groupBy(group, item).agg(F.round(F.sum("s"), 9).alias("score"))


def admitted_classes(questions: DataFrame, catalog: DataFrame, tolerance: int = 0, wider: int = 2) -> DataFrame:
    """(id, level, ticker, year, report_type, n): the classes of tables that the strictest satisfiable constraints of a question admit.

    A class is a code, year and type with its number of tables, so the level is known before any table is looked at,
    and counts come from here. Levels: 1 code, year and type; 2 the same with more years; 3 code and year; 4 with more
    years; 5 code alone; 6 the year alone, for questions whose code no table has; 7, one row of nulls, no constraint.
    Years reach forward from those asked for.
    """
    classes = catalog.groupBy(F.upper("ticker").alias("ticker"), "year", F.col("report_type").alias("_type")).agg(F.count("*").alias("n"))
    one = questions.select("id", "tickers", F.coalesce("years", F.array().cast("array<int>")).alias("years"), "report_type").dropDuplicates(["id"])
    asked = one.select("id", F.explode(F.array_distinct(F.transform("tickers", F.upper))).alias("ticker"), "years", "report_type")
    has_years, has_type = F.size("years") > 0, F.col("report_type").isNotNull()
    in_years = lambda t: F.exists("years", lambda y: F.col("year").between(y, y + t))
    typed = ~has_type | F.coalesce(F.col("report_type") == F.col("_type"), F.lit(False))
    level = (
        F.when((~has_years | in_years(tolerance)) & typed, 1)
        .when(has_years & in_years(wider) & typed, 2)
        .when(~has_years | in_years(tolerance), 3)
        .when(has_years & in_years(wider), 4)
        .otherwise(5)
    )
    by_code = asked.join(classes, "ticker").select("id", level.alias("level"), "ticker", "year", F.col("_type").alias("report_type"), "n")
    codeless = one.join(by_code.select("id").distinct(), "id", "left_anti")
    by_year = codeless.select("id", F.explode(F.array_distinct("years")).alias("_y")).join(classes, F.col("_y") == F.col("year")).select("id", F.lit(6).alias("level"), "ticker", "year", F.col("_type").alias("report_type"), "n")
    none = lambda t: F.lit(None).cast(t)
    total = classes.agg(F.sum("n").alias("n"))
    free = codeless.join(by_year.select("id").distinct(), "id", "left_anti").select("id").crossJoin(F.broadcast(total))  # one row
    every = by_code.unionByName(by_year).unionByName(free.select("id", F.lit(7).alias("level"), none("string").alias("ticker"), none("int").alias("year"), none("string").alias("report_type"), "n"))
    best = every.groupBy("id").agg(F.min("level").alias("level"))
    return every.join(best, ["id", "level"])


def admitted(questions: DataFrame, catalog: DataFrame, tolerance: int = 0, wider: int = 2, sections: DataFrame | None = None) -> DataFrame:
    """(id, level, table_ref): the tables of the classes admitted, of levels 1 to 6; questions of level 7 search the whole catalog (see unfiltered).

    sections(id, section): where a question names some, only their tables.
    """
    found = admitted_classes(questions, catalog, tolerance, wider).where("level < 7")
    listed = catalog.select("table_ref", F.upper("ticker").alias("_t"), F.col("year").alias("_y"), F.col("report_type").alias("_r"), (F.col("section") if "section" in catalog.columns else F.lit(None).cast("string")).alias("section"))
    same = F.col("ticker").eqNullSafe(F.col("_t")) & F.col("year").eqNullSafe(F.col("_y")) & F.col("report_type").eqNullSafe(F.col("_r"))
    rows = found.join(listed, same).select("id", "level", "table_ref", "section")
    if sections is not None:
        named = rows.join(sections.select("id").distinct(), "id", "left_semi").join(sections.select("id", "section").distinct(), ["id", "section"], "left_semi")
        rows = named.select(*rows.columns).unionByName(rows.join(sections.select("id").distinct(), "id", "left_anti").select(*rows.columns))
    return rows.select("id", "level", "table_ref")


def unfiltered(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """The ids of questions whose code admits no table: those of levels 6 and 7."""
    asked = questions.select("id", F.explode_outer("tickers").alias("ticker")).withColumn("ticker", F.upper("ticker"))
    known = asked.join(catalog.select(F.upper("ticker").alias("ticker")).distinct(), "ticker", "left_semi").select("id").distinct()
    return questions.select("id").distinct().join(known, "id", "left_anti")


def phrase_score(phrases: Column, words: Column, text: Column) -> Column:
    """6 for each phrase and 2 for each word of a question that a folded text holds."""
    holds = lambda a: F.size(F.filter(F.array_distinct(a), lambda p: F.contains(text, p)))
    return 6 * holds(phrases) + 2 * holds(words)


#: What a question says that asks for a balance, and one that asks for cash flows; in lower case with accents, for folded "quỹ" is also a quarter and "dòng tiền" a currency.
BALANCE, CASH_FLOW = "số dư|cuối năm|đầu năm|tại ngày|quỹ|ngành", "lưu chuyển tiền|dòng tiền|tiền thuần từ"


@F.pandas_udf(T.StringType())
def _plain(questions: pd.Series) -> pd.Series:
    return questions.map(lambda q: canonical(q).lower(), na_action="ignore")


def cash_flow_score(question: Column, text: Column, section: Column) -> Column:
    """-10 for a cash-flow table where a question asks for a balance and not for cash flows, 6 where it does ask for them, else 0."""
    asked = _plain(question)
    is_table = F.coalesce(F.contains(text, F.lit("luu chuyen tien")) | F.coalesce(section == "cash_flow", F.lit(False)), F.lit(False))
    return F.when(~is_table, 0).when(asked.rlike(CASH_FLOW), 6).when(asked.rlike(BALANCE), -10).otherwise(0)


def contents(facts: DataFrame, most: int = 120) -> DataFrame:
    """(table_ref, content): the items, then the column labels of the first facts of each table."""
    place = F.row_number().over(Window.partitionBy("table_ref").orderBy("row_idx", "year", "period", "column_label", "item"))
    first = facts.select("table_ref", "item", "column_label", place.alias("_k")).where(F.col("_k") <= most)
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", c))), lambda s: s[c]), " ")
    return first.groupBy("table_ref").agg(F.concat_ws(" ", listed("item"), listed("column_label")).alias("content"))


def content_ordered(scored: DataFrame, group: str, item: str, head: int = 35) -> DataFrame:
    """scored(group, item, rank, score, content) in a new order: the first `head` by content and score, the others behind them as they were, without a content."""
    first = F.col("rank") <= head
    whole = F.col("content") * 10 + F.col("score")
    order = Window.partitionBy(group).orderBy(F.when(first, 0).otherwise(1), F.desc(F.when(first, whole)), F.desc(F.when(first, F.col("score"))), F.when(~first, F.col("rank")), item)
    return scored.select(group, item, F.when(first, F.col("content")).alias("content"), F.row_number().over(order).alias("rank"))


def budget(n_tickers: Column, n_years: Column, derived: Column, most: int) -> Column:
    """How many tables a question needs."""
    return (
        F.when(n_tickers >= 2, F.least(F.lit(most), n_tickers * F.least(F.lit(2), F.greatest(F.lit(1), n_years))))
        .when(n_years >= 2, F.least(F.lit(most), F.greatest(F.least(F.lit(2), n_years * 2), n_years * 2)))
        .when(derived, 3)
        .otherwise(2)
    )


def cut(ranked: DataFrame, group: str, size: Column, ratio: float = 0.35, least: int = 1) -> DataFrame:
    """The first rows of each group within its size whose score is at least `ratio` of the first row's; never fewer than `least`."""
    first = ranked.groupBy(group).agg(F.min_by("score", "rank").alias("_first"))
    return ranked.join(first, group).where((F.col("rank") <= size) & ((F.col("score") >= ratio * F.col("_first")) | (F.col("rank") <= least))).drop("_first")


def covering(pool: DataFrame, chosen: DataFrame, required: DataFrame, group: str, item: str, key: str) -> DataFrame:
    """chosen with the best row of the pool for each (group, key) of required that none of chosen covers."""
    missing = required.join(chosen.join(pool.select(group, item, key), [group, item]).select(group, key).distinct(), [group, key], "left_anti")
    best = pool.join(missing, [group, key]).groupBy(group, key).agg(F.min_by(item, "rank").alias(item))
    return chosen.select(group, item).unionByName(best.select(group, item)).distinct()


#: Derived metrics that need both statements.
BOTH_STATEMENTS = ("roe", "roa", "debt_to_equity", "current_ratio", "quick_ratio", "roe_pct", "roa_pct", "debt_equity", "ratio_current", "ratio_quick")


def repaired_coverage(pool: DataFrame, chosen: DataFrame, questions: DataFrame, group: str, item: str, most: int = 24) -> DataFrame:
    """(group, item, place): chosen(group, item, rank) so completed that all codes, years and statements of a question have a table.

    In turn: for each code (of two or more) without a table the best of pool(group, item, rank, ticker, year, section),
    in place of the last table of a code that has several where `most` are chosen; for each year without a table the
    best of it; for derived metrics that need both statements the best of a missing one. A pool is a question's ranked
    candidates, which retrieval cuts to a few hundred, so one task holds it whole.
    """
    lists = questions.select(F.col("id").alias(group), "tickers", "years", "metrics", "needs_derived")
    marked = pool.select(group, item, "rank", "ticker", "year", "section").join(chosen.select(group, item, F.lit(True).alias("_chosen")), [group, item], "left").join(lists, group)
    schema = T.StructType([pool.schema[group], pool.schema[item], T.StructField("place", T.IntegerType())])

    def complete(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", item], kind="stable").reset_index(drop=True)
        tables = rows[[item, "ticker", "year", "section"]].to_dict("records")
        picked = [t for t, c in zip(tables, rows["_chosen"].fillna(False).astype(bool), strict=True) if c]
        first = rows.iloc[0]
        codes = [str(c).upper() for c in (first["tickers"] if first["tickers"] is not None else [])]
        wanted = [int(y) for y in (first["years"] if first["years"] is not None else [])]
        named = set(first["metrics"] if first["metrics"] is not None else [])
        code = lambda t: str(t["ticker"] or "").upper()
        best = lambda test: next((t for t in tables if test(t) and not any(t is p for p in picked)), None)
        if len(codes) >= 2:
            for c in codes:
                if any(code(p) == c for p in picked):
                    continue
                found = best(lambda t, c=c: code(t) == c)
                if found is None:
                    continue
                if len(picked) < most:
                    picked.append(found)
                    continue
                counts = Counter(map(code, picked))
                spare = next((i for i in reversed(range(len(picked))) if counts[code(picked[i])] > 1), None)
                if spare is not None:
                    picked[spare] = found
        for y in wanted:
            if len(picked) < most and not any(p["year"] == y for p in picked):
                found = best(lambda t, y=y: t["year"] == y)
                if found is not None:
                    picked.append(found)
        if first["needs_derived"] and named & set(BOTH_STATEMENTS):
            for s in ("income_statement", "balance_sheet"):
                if len(picked) < most and not any(p["section"] == s for p in picked):
                    found = best(lambda t, s=s: t["section"] == s)
                    if found is not None:
                        picked.append(found)
        return pd.DataFrame({group: first[group], item: [p[item] for p in picked], "place": range(1, len(picked) + 1)}).astype({"place": "int32"})

    return marked.groupBy(group).applyInPandas(complete, schema)


def selected(pool: DataFrame, questions: DataFrame, group: str, item: str, adaptive: bool = True, k: int = 5, most: int = 24) -> DataFrame:
    """(group, item, place): what is kept of a ranked pool: the first k, or as many as the question needs, with coverage repaired and linked tables behind."""
    if not adaptive:
        return pool.where(F.col("rank") <= k).select(group, item, F.col("rank").cast("int").alias("place"))
    size = budget(F.size("tickers"), F.size("years"), F.col("needs_derived"), most)
    sized = pool.join(questions.select(F.col("id").alias(group), size.alias("_size")), group)
    chosen = cut(sized, group, F.col("_size")).select(group, item, "rank")
    placed = repaired_coverage(pool, chosen, questions, group, item, most)
    both = with_linked(placed.select(group, item), pool, group, item).join(placed, [group, item], "left").join(pool.select(group, item, "rank"), [group, item], "left")
    order = Window.partitionBy(group).orderBy(F.col("place").asc_nulls_last(), "rank", item)
    return both.select(group, item, F.row_number().over(order).alias("place")).where(F.col("place") <= most)


def with_linked(chosen: DataFrame, pool: DataFrame, group: str, item: str) -> DataFrame:
    """chosen with the rows of the pool one link away: of the same group of tables, or named as parent or next, either way.

    Each kind of link is an equi-join of its own, so none is a nested loop.
    """
    links = chosen.join(pool, [group, item])
    keyed = lambda a, b: links.select(group, F.col(a).alias("_k")).where("_k IS NOT NULL").distinct().join(
        pool.select(group, item, F.col(b).alias("_k")).where("_k IS NOT NULL"), [group, "_k"]
    ).select(group, item)
    kinds = (("group_id", "group_id"), ("parent_table_ref", item), ("next_table_ref", item), (item, "parent_table_ref"), (item, "next_table_ref"))
    out = chosen.select(group, item)
    for a, b in kinds:
        out = out.unionByName(keyed(a, b))
    return out.distinct()
