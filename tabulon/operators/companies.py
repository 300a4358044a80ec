"""Companies by their names: a dictionary, the aliases that can be derived from it, and the codes that a question names."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.text import fold
from tabulon.operators.analysis import find_terms, listed

#: Words of a legal form, folded, taken out in this order.
LEGAL_FORMS = ("cong ty co phan", "cong ty tnhh mtv", "cong ty tnhh", "tong cong ty", "ctcp", "tmcp", "mtv", "tnhh", "cong ty")
#: Words and phrases, folded, that tell no company from another.
GENERIC = (
    "xanh", "viet", "nam", "vietnam", "dau", "khi", "dien", "luc", "thep", "sua", "nhua", "dam", "than", "cao", "su", "xay", "dung", "dich", "vu", "khu", "phat", "trien", "cong", "nghiep", "tong", "quan", "ly",
    "dau tu", "phat trien", "tap doan", "san xuat", "thuong mai", "viet nam", "ha noi", "sai gon", "ho chi minh", "thanh pho ho chi minh", "mien nam", "mien bac", "mien trung", "ngan hang", "chung khoan",
    "bat dong san", "cong nghiep", "cong nghe", "quoc te", "xuat nhap khau", "khu cong nghiep", "phat trien khu cong nghiep",
)
#: The words of an alias, and its fewest letters.
ALIAS_WORDS, ALIAS_LETTERS = (2, 4), 6
NAMES = "ticker string, name string"


def company_key(name: Column) -> Column:
    """A name folded, without its legal form and punctuation."""
    flat = fold(name)
    for form in LEGAL_FORMS:
        flat = F.replace(flat, F.lit(form), F.lit(" "))
    return F.trim(F.regexp_replace(flat, "[^0-9a-z]+", " "))


def read_names(spark: SparkSession, *paths: str) -> DataFrame:
    """(ticker, name) of the first of the CSV files that is there, by place of column; without any an empty list."""
    for path in paths:
        if "://" in path or Path(path).exists():
            rows = spark.read.option("header", "true").csv(path)
            code, name = rows.columns[:2]
            return rows.select(F.upper(F.trim(code)).alias("ticker"), F.trim(name).alias("name")).where("ticker <> ''")
    return spark.createDataFrame([], NAMES)


def names_in_questions(questions: DataFrame) -> DataFrame:
    """(ticker, name) of the companies that questions name in full before the code in brackets."""
    pattern = r"(Công ty [^()?.,:;]{3,80}) \(([A-Z][A-Z0-9]{2,4})\)"
    found = questions.where(F.col("question").rlike(pattern)).select(F.regexp_extract("question", pattern, 2).alias("ticker"), F.regexp_extract("question", pattern, 1).alias("name"))
    return found.distinct()


def aliases(names: DataFrame) -> DataFrame:
    """(alias, ticker): ends of two to four words of the names' keys that no other company's name ends with and that aren't generic."""
    keyed = names.select("ticker", company_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    words = keyed.withColumn("_w", F.split("key", " "))
    low, high = ALIAS_WORDS
    ends = F.transform(F.filter(F.sequence(F.lit(low), F.lit(high)), lambda k: k <= F.size("_w")), lambda k: F.array_join(F.slice("_w", F.size("_w") - k + 1, k), " "))
    found = words.select("ticker", F.explode(ends).alias("alias")).where(F.length("alias") >= ALIAS_LETTERS)
    plain = ~F.col("alias").isin(*GENERIC) & ~F.forall(F.split("alias", " "), lambda w: w.isin(*GENERIC))
    unique = found.where(plain).groupBy("alias").agg(F.count_distinct("ticker").alias("_n"), F.min("ticker").alias("ticker")).where("_n = 1")
    return unique.join(keyed.select(F.col("key").alias("alias")).distinct(), "alias", "left_anti").select("alias", "ticker")


def entries(names: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """(alias, ticker): whole names, derived aliases, and brands(ticker, name) of the companies of the list."""
    own = names.select(company_key(F.col("name")).alias("alias"), "ticker").where("alias <> ''")
    out = own.unionByName(aliases(names))
    if brands is not None:
        known = brands.join(names.select("ticker").distinct(), "ticker", "left_semi")
        out = out.unionByName(known.select(company_key(F.col("name")).alias("alias"), "ticker"))
    return out.groupBy("alias").agg(F.min("ticker").alias("ticker"))


def resolved(texts: DataFrame, id_col: str, text_col: str, known: DataFrame) -> DataFrame:
    """(id_col, tickers): the companies that each text names, the longest name first, none within another's place, in the order of their places."""
    terms = listed(known, "alias", "ticker")
    found = texts.select(id_col, find_terms(company_key(F.col(text_col)), terms).alias("_s"))
    return found.select(id_col, F.array_distinct(F.transform("_s", lambda s: s["key"])).alias("tickers"))


def tickers(questions: DataFrame, names: DataFrame, brands: DataFrame | None = None, never: tuple[str, ...] = (), words: tuple[str, ...] = ()) -> DataFrame:
    """(id, tickers) of each question, the surest sign first.

    Codes in brackets are trusted; then companies by name; capitals that the list knows only where nothing was found;
    then small letters and letters with digits that it knows. never: capitals that are no code; words: small letters that are words.
    """
    once = questions.select("id", "question").dropDuplicates(["id"])
    codes = sorted({r["ticker"] for r in names.select("ticker").distinct().collect()})  # the list of companies, which resolved() holds too
    known = entries(names, brands)
    named = resolved(once, "id", "question", known).withColumnRenamed("tickers", "_named")
    q = F.col("question")
    kept = lambda a: F.filter(a, lambda c: ~c.isin(*never) if never else F.lit(True))
    listed_only = lambda a: F.filter(a, lambda c: c.isin(*codes) if codes else F.lit(True))
    bracketed = kept(F.regexp_extract_all(q, F.lit(r"\(([A-Z][A-Z0-9]{2,4})\)"), F.lit(1)))
    parts = F.split(q, "[^A-Za-z0-9]+")
    bare = listed_only(kept(F.filter(parts, lambda w: w.rlike(r"^[A-Z]{3,5}\d?$"))))
    small = F.filter(parts, lambda w: w.rlike(r"^[a-z]{3,5}\d?$|^[A-Za-z]{2,4}\d{1,2}$"))
    if words:
        small = F.filter(small, lambda w: ~F.lower(w).isin(*words))
    small = F.filter(kept(F.transform(small, lambda w: F.upper(w))), lambda c: c.isin(*codes) if codes else F.lit(False))
    joined = once.join(named, "id", "left").withColumn("_named", F.coalesce("_named", F.array().cast("array<string>")))
    sure = F.array_distinct(F.concat(bracketed, F.col("_named")))
    return joined.select("id", F.array_distinct(F.concat(sure, F.when(F.size(sure) == 0, bare).otherwise(F.array().cast("array<string>")), small)).alias("tickers"))
