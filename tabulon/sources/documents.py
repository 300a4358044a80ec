"""Reading document trees, questions and catalogs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of a document's name that make it the report of a parent company alone.
SEPARATE = "separate|rieng|_me|cong_ty_me|parent"


def read_texts(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of all text files under root. Files that can't be read are skipped; bytes that are no UTF-8 are read as Latin-1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", text.alias("text"))


def doc_id(path: Column) -> Column:
    """The file's name without suffix and without `_extracted`."""
    return F.regexp_extract(path, r"([^/]+?)(_extracted)?\.[A-Za-z0-9]+$", 1)


def _nearest(path: Column, pattern: str) -> Column:
    folders = F.reverse(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1))
    return F.get(F.filter(folders, lambda p: p.rlike(pattern)), F.lit(0))


def ticker_of(path: Column) -> Column:
    """The nearest folder that is a code, else the head of the document's id."""
    return F.coalesce(_nearest(path, "^[A-Z][A-Z0-9]{2,4}$"), F.nullif(F.regexp_extract(doc_id(path), "^([A-Z0-9]{3,5})_", 1), F.lit("")))


def last_year(name: Column) -> Column:
    """The last year of the 20th or 21st century in a name."""
    found = F.regexp_extract_all(name, F.lit(r"((19|20)[0-9]{2})"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("int"))


def year_of(path: Column) -> Column:
    return F.coalesce(_nearest(path, "^(19|20)[0-9]{2}$").cast("int"), last_year(doc_id(path)))


def report_type_of(name: Column) -> Column:
    """separate or consolidated, by a document's name."""
    return F.when(F.lower(name).rlike(SEPARATE), F.lit("separate")).otherwise(F.lit("consolidated"))


def loaded_report_type(name: Column) -> Column:
    """As report_type_of(), by the document's name alone: unknown where it tells neither."""
    flat = F.regexp_replace(F.lower(name), "[_-]", "")
    return F.when(flat.rlike("separate|rieng|congtyme|parent"), "separate").when(flat.rlike("consolidated|hopnhat"), "consolidated").otherwise("unknown")


def n_lines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def documents(texts: DataFrame, limit: int | None = None) -> DataFrame:
    """raw_documents of (path, text): all, or the first `limit` by path of those that could be read."""
    path = F.col("path")
    rows = texts if limit is None else texts.where("text IS NOT NULL").orderBy("path").limit(limit)
    return rows.select(
        doc_id(path).alias("doc_id"), "path", "text", ticker_of(path).alias("ticker"), year_of(path).alias("year"),
        report_type_of(doc_id(path)).alias("report_type"), n_lines(F.col("text")).alias("n_lines"),
    )


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a JSON list or object, or of a file of JSON lines, blank ones skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", str(not path.rstrip("/").endswith(("l", "lines"))).lower()).json(path)


def read_catalog(spark: SparkSession, path: str, tables: str | None = None) -> DataFrame:
    """A catalog with code, year and type told anew from the document's name; an empty or absent one is rebuilt from table files where they are."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        rows = None
    if rows is None or rows.isEmpty():
        if tables is None:
            raise FileNotFoundError(f"no catalog at {path}")
        rows = rebuilt_catalog(spark, tables)
    return rows.withColumns(catalog_fields(F.col("doc_id")))


def catalog_fields(name: Column) -> dict[str, Column]:
    """Code, year and type of a document's tables, by its name."""
    return {"ticker": F.nullif(F.regexp_extract(F.upper(name), "^([A-Z0-9]{3,5})_", 1), F.lit("")), "year": last_year(name), "report_type": report_type_of(name)}


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file, of a JSON list, or of an object with a list `questions` or `data`."""
    raw = spark.read.option("multiLine", str(not path.endswith("l")).lower()).json(path)
    for name in ("questions", "data"):
        if name in raw.columns:
            return raw.select(F.inline(name))
    return raw


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a head, a byte order mark allowed."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("encoding", "UTF-8").csv(path)


#: Of each table file the rows that are looked at, and the different items of a card.
SAMPLED_ROWS, CARD_ITEMS = 30, 15


def rebuilt_catalog(spark: SparkSession, path: str, suffix: str = "_table_", item: str = "item") -> DataFrame:
    """A minimal catalog from the names and items of table files: the first different ones of the first rows, as they appear.

    Titles, sections and links can't be told from them.
    """
    lines = spark.read.option("header", "true").csv(path)
    first = item if item in lines.columns else lines.columns[0]
    placed = lines.select(F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), F.trim(first).alias("item"))
    # A file of a table lies in one block, whose rows are numbered in their order.
    kept = placed.withColumn("_k", F.row_number().over(Window.partitionBy("filename").orderBy("_b", "_i"))).where(F.col("_k") <= SAMPLED_ROWS)
    seen = kept.where(F.length("item") > 2).groupBy("filename", "item").agg(F.min("_k").alias("_k"))
    listed = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_k", "item"))), lambda s: s["item"]), 1, CARD_ITEMS)
    items = kept.select("filename").distinct().join(seen.groupBy("filename").agg(listed.alias("items")), "filename", "left")
    doc, position = F.regexp_extract("filename", f"^(.*){suffix}([0-9]+)[.]csv$", 1), F.regexp_extract("filename", f"^(.*){suffix}([0-9]+)[.]csv$", 2).try_cast("int")
    named = items.where(F.col("filename").rlike(f"^.*{suffix}[0-9]+[.]csv$"))
    return named.select(F.concat(doc, F.lit("|"), position.cast("string")).alias("table_ref"), doc.alias("doc_id"), position.alias("position"), "filename", F.coalesce(F.array_join("items", "; "), F.lit("")).alias("card"))
