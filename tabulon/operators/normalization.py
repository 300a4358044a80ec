"""From grids to facts: tall cells, roles of columns, hierarchy, one fact per row and value column; cards of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.numbers import column_period, parse_number
from tabulon.functions.text import fold
from tabulon.operators.analysis import find_terms

#: Words of the heads of columns of items, folded, and patterns of heads of columns that hold no amounts.
ITEM_HINTS = ("chi tieu", "khoan muc", "noi dung", "dien giai", "item", "description")
SKIP_HINTS = r"thuyet minh|\bnote\b|\bstt\b"


def cells(tables: DataFrame, rows: str = "rows", first_row: int = 0) -> DataFrame:
    """(table_ref, row_idx, col_idx, cell) of each cell of tables(table_ref, rows), from 0; each table once."""
    once = tables.select("table_ref", rows).dropDuplicates(["table_ref"])
    tall = once.select("table_ref", F.posexplode(rows).alias("row_idx", "_row")).where(F.col("row_idx") >= first_row)
    return tall.select("table_ref", (F.col("row_idx") - first_row).alias("row_idx"), F.posexplode("_row").alias("col_idx", "cell"))


def header_row(tables: DataFrame) -> DataFrame:
    """(table_ref, row_idx): of the first three rows that which looks most like a head, if one does."""
    scored = cells(tables).where("row_idx < 3").groupBy("table_ref", "row_idx").agg(
        F.round(F.avg(F.trim("cell").rlike(r"^[0-9.,()\s-]+$").cast("double")) - F.when(F.max(F.col("cell").rlike("(19|20)[0-9]{2}")), 0.3).otherwise(0.0), 9).alias("score")
    )
    best = scored.groupBy("table_ref").agg(F.min(F.struct("score", "row_idx")).alias("_b"))
    return best.where(F.col("_b.score") < 0.6).select("table_ref", F.col("_b.row_idx").alias("row_idx"))


def column_names(heads: DataFrame) -> DataFrame:
    """(table_ref, col_idx, name) of heads(table_ref, col_idx, cell): spaces collapsed, blank ones numbered, repeated ones suffixed."""
    plain = F.trim(F.regexp_replace(F.coalesce("cell", F.lit("")), r"\s+", " "))
    base = F.when(plain == "", F.concat(F.lit("col_"), F.col("col_idx").cast("string"))).otherwise(plain)
    named = heads.withColumn("_base", base)
    k = F.row_number().over(Window.partitionBy("table_ref", "_base").orderBy("col_idx")) - 1
    return named.select("table_ref", "col_idx", F.when(k > 0, F.concat("_base", F.lit("_"), k.cast("string"))).otherwise(F.col("_base")).alias("name"))


def column_statistics(tall: DataFrame) -> DataFrame:
    """(table_ref, col_idx, n, numeric, coded, texts, mean_length) of each column of tall cells."""
    text = F.trim(F.coalesce("cell", F.lit("")))
    # Each cell is parsed once, before it is aggregated.
    tall = tall.select("table_ref", "col_idx", text.alias("_t")).withColumn("_number", parse_number(F.col("_t")).isNotNull())
    filled, number = F.col("_t") != "", F.col("_number")
    return tall.groupBy("table_ref", "col_idx").agg(
        F.sum(filled.cast("int")).alias("n"),
        F.sum((filled & number).cast("int")).alias("numeric"),
        F.sum((filled & F.col("_t").rlike("^[0-9]{2,3}[a-z]?$")).cast("int")).alias("coded"),
        F.sum((filled & ~number).cast("int")).alias("texts"),
        F.round(F.avg(F.when(filled, F.length("_t"))), 4).alias("mean_length"),
    )


def column_roles(tables: DataFrame, years: DataFrame) -> DataFrame:
    """(table_ref, col_idx, header, role, year, period, source_date) of each column.

    Roles: item, code, period, category, skip. The item column has a hint in its head, else is the one with most text;
    of the columns with one year and period the first counts, the others are skipped.
    """
    once = tables.select("table_ref", "doc_id", "header_rows").dropDuplicates(["table_ref"])
    heads = once.join(years.select("doc_id", "year").dropDuplicates(["doc_id"]).withColumnRenamed("year", "_report_year"), "doc_id", "left")
    heads = heads.select("table_ref", "_report_year", F.posexplode(F.get("header_rows", F.lit(0))).alias("col_idx", "header"))
    stats = column_statistics(cells(tables))
    joined = heads.join(stats, ["table_ref", "col_idx"])
    parsed = column_period(F.col("header"), F.col("_report_year"))
    joined = joined.withColumn("_p", parsed)
    hint = fold(F.col("header")).rlike("|".join(ITEM_HINTS))
    texty = F.col("texts") / F.greatest("n", F.lit(1)) * F.least(F.coalesce("mean_length", F.lit(0.0)) / 10, F.lit(1.0))
    whole = Window.partitionBy("table_ref")
    score = F.when(F.col("_p").isNotNull(), -1.0).otherwise(F.when(hint, 10.0).otherwise(F.when(texty > 0.3, texty).otherwise(-1.0)))
    joined = joined.withColumn("_score", score)
    best = F.max(F.struct("_score", (-F.col("col_idx")).alias("i"))).over(whole)
    is_item = (best["i"] == -F.col("col_idx")) & (best["_score"] > 0)
    joined = joined.withColumn("_item", is_item)
    nth = F.row_number().over(Window.partitionBy("table_ref", "_p.year", "_p.period").orderBy("col_idx"))
    flat = fold(F.col("header"))
    is_code = flat.rlike(r"\b(ma|code)\b") | ((F.col("n") >= 3) & (F.col("coded") / F.col("n") > 0.7))
    role = (
        F.when(F.col("_item"), "item")
        .when(F.col("_p").isNotNull(), F.when(nth == 1, "period").otherwise("skip"))
        .when(is_code, "code")
        .when(flat.rlike(SKIP_HINTS), "skip")
        .when((F.col("n") > 0) & (F.col("numeric") / F.col("n") >= 0.6), "category")
        .otherwise("skip")
    )
    return joined.select("table_ref", "col_idx", "header", role.alias("role"), F.col("_p.year").alias("year"), F.col("_p.period").alias("period"), F.col("_p.source_date").alias("source_date"))


def facts(tables: DataFrame, years: DataFrame, terms: tuple[tuple[str, str], ...] = (), derived: tuple[str, ...] = ()) -> DataFrame:
    """One row per body row and value column, with 13 columns: table_ref, row_idx, item, item_code, metric, is_derived, year, period, source_date, column_label, value, unit, unit_scale.

    Rows without any number head the rows below them: one in capitals or with a Roman number opens a section, another
    a category; their names are put before an item that doesn't hold them already. A table without a column of a
    period or category gives the first number of each row. terms: (folded surface, metric) of the metrics to be named,
    looked for in the prefixed item, then in the item alone; without a unit of its own a table is in dong.
    """
    roles = column_roles(tables, years)
    tall = cells(tables).join(roles, ["table_ref", "col_idx"], "left").withColumn("role", F.coalesce("role", F.lit("skip")))
    plain = roles.groupBy("table_ref").agg((F.count_if(F.col("role").isin("period", "category")) == 0).alias("_plain"))
    tall = tall.join(plain, "table_ref", "left").withColumn("_t", F.trim(F.coalesce("cell", F.lit(""))))
    is_value = F.col("role").isin("period", "category") | (F.coalesce("_plain", F.lit(True)) & ~F.col("role").isin("item", "code"))
    tall = tall.withColumn("_v", F.when(is_value, parse_number(F.col("_t"))))
    text, value = F.col("_t"), F.col("_v")
    found = F.struct("col_idx", "role", "year", "period", "source_date", F.when(F.col("role") != "skip", F.col("header")).alias("column_label"), value.alias("value"))
    rows = tall.groupBy("table_ref", "row_idx").agg(
        F.max(F.when(F.col("role") == "item", text)).alias("item"),
        F.nullif(F.min_by(text, F.when(F.col("role") == "code", F.col("col_idx"))), F.lit("")).alias("item_code"),
        F.array_sort(F.collect_list(F.when(value.isNotNull(), found))).alias("values"),
        F.first("_plain", True).alias("_plain"),
    ).where("item <> ''")
    rows = rows.withColumn("values", F.when(F.coalesce("_plain", F.lit(True)), F.slice("values", 1, 1)).otherwise(F.col("values")))
    headed = rows.withColumn("_head", F.when(F.size("values") == 0, F.col("item")))
    is_section = F.col("_head").rlike(r"^[IVX]+[.)]?\s") | ((F.col("_head") == F.upper("_head")) & (F.length("_head") > 3))
    order = Window.partitionBy("table_ref").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    headed = headed.withColumn("_section", F.when(is_section, F.col("_head"))).withColumn("_n", F.sum(F.coalesce(is_section.cast("int"), F.lit(0))).over(order))
    within = Window.partitionBy("table_ref", "_n").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last("_section", True).over(order)
    category = F.last(F.when(F.col("_head").isNotNull() & F.coalesce(~is_section, F.lit(True)), F.col("_head")), True).over(within)
    named = headed.withColumn("_s", section).withColumn("_c", category).where(F.size("values") > 0)
    lacks = lambda c: F.when(~F.contains(F.lower("item"), F.lower(c)), F.col(c))
    prefixed = F.concat_ws(" - ", lacks("_s"), lacks("_c"), "item")
    named = named.withColumn("_own", F.col("item")).withColumn("item", prefixed)
    if terms:
        first = lambda c: F.get(find_terms(F.col(c), terms), F.lit(0))["key"]
        named = named.withColumn("metric", F.coalesce(first("item"), first("_own")))
    else:
        named = named.withColumn("metric", F.lit(None).cast("string"))
    units = tables.select("table_ref", *(c for c in ("unit", "unit_scale") if c in tables.columns)).dropDuplicates(["table_ref"])
    for c, kind in (("unit", "string"), ("unit_scale", "double")):
        if c not in units.columns:
            units = units.withColumn(c, F.lit(None).cast(kind))
    flat = named.select("table_ref", "row_idx", "item", "item_code", "metric", F.explode("values").alias("v")).join(units, "table_ref", "left")
    is_derived = F.col("metric").isin(*derived) if derived else F.lit(False)
    return flat.select(
        "table_ref", "row_idx", "item", "item_code", "metric", F.coalesce(is_derived, F.lit(False)).alias("is_derived"), "v.year", F.coalesce("v.period", F.lit("unknown")).alias("period"), "v.source_date",
        "v.column_label", "v.value", F.coalesce(F.nullif(F.trim("unit"), F.lit("")), F.lit("dong")).alias("unit"), F.coalesce("unit_scale", F.lit(1.0)).alias("unit_scale"),
    )


def ambiguous(rows: DataFrame) -> DataFrame:
    """(item, year, period, n_values) of the facts of which there is more than one value; nulls are keys like others."""
    return rows.groupBy("item", "year", "period").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def ambiguity_report(rows: DataFrame, items: int = 4, marks: int = 6) -> DataFrame:
    """(table_ref, item, codes, labels): of each table the first ambiguous items, with the codes and column labels that tell their values apart."""
    found = rows.groupBy("table_ref", "item", "year", "period").agg(F.count_distinct("value").alias("n"), F.collect_set("item_code").alias("_c"), F.collect_set("column_label").alias("_l"), F.min("row_idx").alias("_o")).where("n > 1")
    whole = found.groupBy("table_ref", "item").agg(F.min("_o").alias("_o"), F.array_distinct(F.flatten(F.collect_list("_c"))).alias("_c"), F.array_distinct(F.flatten(F.collect_list("_l"))).alias("_l"))
    ranked = whole.withColumn("_k", F.row_number().over(Window.partitionBy("table_ref").orderBy("_o", "item"))).where(F.col("_k") <= items)
    return ranked.select("table_ref", "item", F.slice(F.array_sort("_c"), 1, marks).alias("codes"), F.slice(F.array_sort("_l"), 1, marks).alias("labels"))


def periods_by_year(rows: DataFrame) -> DataFrame:
    """(table_ref, years): the years of facts in order, each with its known periods in the order in which they first appear: "2019 (closing, opening), 2020"."""
    seen = rows.where("year IS NOT NULL").groupBy("table_ref", "year", "period").agg(F.min(F.struct("row_idx", F.coalesce("column_label", F.lit("")))).alias("_o"))
    known = F.when(F.col("period").isNotNull() & (F.col("period") != "unknown"), F.struct("_o", "period"))
    yearly = seen.groupBy("table_ref", "year").agg(F.transform(F.array_sort(F.collect_list(known)), lambda s: s["period"]).alias("_p"))
    one = F.when(F.size("_p") > 0, F.concat(F.col("year").cast("string"), F.lit(" ("), F.array_join("_p", ", "), F.lit(")"))).otherwise(F.col("year").cast("string"))
    return yearly.groupBy("table_ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", one.alias("t")))), lambda s: s["t"]), ", ").alias("years"))


def full_cards(catalog: DataFrame, rows: DataFrame, items: int = 30, metrics: int = 15, labels: int = 12) -> DataFrame:
    """(table_ref, card): the whole text by which a table is found: catalog fields, first items and metrics, years with their periods, column labels that are no dates, and the key."""
    known = first_seen(rows.where("metric IS NOT NULL"), "table_ref", "metric", "row_idx", metrics)
    dated = column_period(F.col("column_label"), F.lit(None).cast("int")).isNotNull()
    heads = first_seen(rows.where(F.col("column_label").isNotNull() & (F.trim("column_label") != "") & ~dated), "table_ref", "column_label", "row_idx", labels)
    own = cards(catalog, rows.select("table_ref", "row_idx", "item"), items)
    joined = own.join(known, "table_ref", "left").join(periods_by_year(rows), "table_ref", "left").join(heads, "table_ref", "left")
    part = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c))
    parts = [F.col("card"), part("metrics", F.array_join("metrics", ", ")), part("years", F.col("years")), part("columns", F.array_join("column_labels", "; ")), part("table", F.col("table_ref"))]
    return joined.select("table_ref", F.concat_ws("\n", *(F.when(c != "", c) for c in parts)).alias("card"))


def first_seen(rows: DataFrame, key: str, value: str, order: str, most: int) -> DataFrame:
    """(key, <value>s): up to so many different values of each key, in the order in which they appear."""
    seen = rows.groupBy(key, value).agg(F.min(order).alias("_o"))
    ranked = seen.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_o", value))).where(F.col("_k") <= most)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", value))), lambda s: s[value]).alias(f"{value}s"))


def cards(catalog: DataFrame, items: DataFrame, most: int = 30) -> DataFrame:
    """(table_ref, card): the text by which a table is found, from its catalog row and first items; empty parts are left out."""
    found = first_seen(items, "table_ref", "item", "row_idx", most)
    part = lambda name, c: F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.concat(F.lit(f"{name}: "), F.col(c).cast("string")))
    listed = F.when(F.size("items") > 0, F.concat(F.lit("items: "), F.array_join("items", "; ")))
    parts = [part("ticker", "ticker"), part("year", "year"), part("type", "report_type"), part("section", "section"), part("title", "title"), part("unit", "unit"), listed]
    return catalog.join(found, "table_ref", "left").select("table_ref", F.concat_ws("\n", *parts).alias("card"))


def card_or_fields(catalog: DataFrame) -> DataFrame:
    """(table_ref, card): the card, or where it is blank the fields of the catalog row."""
    fields = F.concat_ws(" ", "ticker", F.col("year").cast("string"), "report_type", "section", "title", "unit")
    return catalog.select("table_ref", F.coalesce(F.nullif(F.trim("card"), F.lit("")), fields).alias("card"))
