"""Programs over facts: lookups, ratios, growth, extremes, peer groups; a plan of data in place of generated code."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import fold, phrases, tokens


def lookup(facts: DataFrame, item: str, year: int | None = None, order: tuple[str, ...] = ("table_ref", "row_idx")) -> DataFrame:
    """(value): of the first fact whose item holds the text, letters of any case; one row, null if there is none."""
    rows = facts.where(F.contains(F.lower("item"), F.lit(item.lower())))
    if year is not None:
        rows = rows.where(F.col("year") == year)
    return rows.agg(F.min_by("value", F.struct(*order)).alias("value"))


def concatenated(*parts: DataFrame) -> DataFrame:
    """The rows of tables that a page break parts, as one table; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def ratio(a: Column, b: Column, factor: float = 100.0) -> Column:
    """a / b times a factor; null where b is 0 or either is null."""
    return F.try_divide(a, b) * factor


def growth(now: Column, before: Column) -> Column:
    """Change against the size of what was before, in percent."""
    return F.try_divide(now - before, F.abs(before)) * 100


def cagr(first: Column, last: Column, years: Column) -> Column:
    """Mean yearly growth in percent; null unless both ends have one sign."""
    quotient = F.try_divide(last, first)
    return F.when((quotient > 0) & (years > 0), (F.pow(quotient, 1.0 / years) - 1) * 100)


@dataclass(frozen=True)
class Formula:
    """A ratio of sums of metrics: those added, those taken off, those below the line, and the factor."""

    above: tuple[str, ...]
    below: tuple[str, ...]
    less: tuple[str, ...] = ()
    factor: float = 1.0


#: Derived metrics and the terms that they are made of. A term that the facts lack leaves the metric null.
DERIVED = {
    "roe": Formula(("profit_net",), ("equity_total",), factor=100.0),
    "roa": Formula(("profit_net",), ("assets_total",), factor=100.0),
    "ros": Formula(("profit_net",), ("rev_net",), factor=100.0),
    "debt_to_equity": Formula(("liab_total",), ("equity_total",)),
    "current_ratio": Formula(("assets_curr",), ("liab_curr",)),
    "quick_ratio": Formula(("assets_curr",), ("liab_curr",), less=("inventory_net",)),
    "gross_margin": Formula(("profit_gross",), ("rev_net",), factor=100.0),
    "net_margin": Formula(("profit_net",), ("rev_net",), factor=100.0),
}


def derived(facts: DataFrame, names: tuple[str, ...] = tuple(DERIVED)) -> DataFrame:
    """(ticker, year, metric, value) of derived metrics over facts(ticker, year, metric, value), all of them in one pass.

    Of several facts of one metric the least value counts, so that the result doesn't depend on the order of rows.
    growth and cagr, which go over years, are plans of their own.
    """
    formulas = {n: DERIVED[n] for n in names}
    terms = sorted({t for f in formulas.values() for t in (*f.above, *f.below, *f.less)})
    wide = facts.where(F.col("metric").isin(*terms)).groupBy("ticker", "year").agg(*(F.min(F.when(F.col("metric") == t, F.col("value"))).alias(t) for t in terms))
    total = lambda ts: sum((F.col(t) for t in ts[1:]), F.col(ts[0]))
    value = lambda f: F.try_divide(total(f.above) - (total(f.less) if f.less else F.lit(0.0)), total(f.below)) * f.factor
    every = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), value(f).alias("value")) for n, f in formulas.items())))
    return wide.select("ticker", "year", every.alias("m")).select("ticker", "year", "m.metric", "m.value").where("value IS NOT NULL")


def bound(selected: DataFrame, questions: DataFrame, links: DataFrame) -> DataFrame:
    """(id, rank, table_ref, variable): the tables that a question's plan works on, of selected(id, rank, table_ref).

    A simple question (nothing derived, one code and one year at most) takes its first table, with those of the same
    group; another all that are selected. Variables are numbered by rank.
    """
    shape = questions.select("id", (~F.col("needs_derived") & (F.size("tickers") <= 1) & (F.size("years") <= 1)).alias("_simple"))
    rows = selected.join(shape, "id").join(links.select("table_ref", "group_id"), "table_ref", "left")
    first = rows.groupBy("id").agg(F.min_by(F.struct("table_ref", "group_id"), F.struct("rank", "table_ref")).alias("_f"))
    kept = ~F.col("_simple") | (F.col("table_ref") == F.col("_f.table_ref")) | (F.col("group_id") == F.col("_f.group_id"))
    order = Window.partitionBy("id").orderBy("rank", "table_ref")
    return rows.join(first, "id").where(F.coalesce(kept, F.lit(False))).select("id", "rank", "table_ref", F.concat(F.lit("df"), F.row_number().over(order).cast("string")).alias("variable"))


def relaxed(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, level, value): for each of asked(id, ticker, metric, year, period) the first fact of the strictest constraints that have one.

    Levels: 1 code, metric, year and period; 2 without the period; 3 without the year, the latest; null constraints
    hold always. The join is on code and metric; a fact is kept only as the best of its level.
    """
    own = facts.groupBy("ticker", "metric", "year", "period").agg(F.min_by("value", F.struct("table_ref", "row_idx")).alias("value"))
    pairs = asked.alias("a").join(own.alias("f"), ["ticker", "metric"])
    same = lambda c: F.col(f"a.{c}").isNull() | F.coalesce(F.col(f"a.{c}") == F.col(f"f.{c}"), F.lit(False))
    level = F.when(same("year") & same("period"), 1).when(same("year"), 2).otherwise(3)
    best = F.min(F.struct(level.alias("level"), (-F.coalesce("f.year", F.lit(0))).alias("y"), F.coalesce("f.period", F.lit("")).alias("p"), F.col("f.value").alias("value")))
    return pairs.groupBy("id").agg(best.alias("b")).select("id", "b.level", "b.value")


def diagnosed(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, reason, years): why asked(id, ticker, metric, year, period) finds no fact, and the years that its code and metric have.

    Reasons: no_code, no_metric (of that code), no_year, no_period, found; null constraints hold always.
    """
    known = facts.select("ticker").distinct().withColumn("_code", F.lit(True))
    same = facts.groupBy("ticker", "metric").agg(F.array_sort(F.collect_set("year")).alias("years"), F.collect_set(F.struct("year", "period")).alias("_p"))
    joined = asked.join(known, "ticker", "left").join(same, ["ticker", "metric"], "left")
    of_year = F.filter("_p", lambda p: F.col("year").isNull() | (p["year"] == F.col("year")))
    reason = (
        F.when(F.col("_code").isNull(), "no_code").when(F.col("_p").isNull(), "no_metric").when(F.size(of_year) == 0, "no_year")
        .when(F.col("period").isNotNull() & ~F.exists(of_year, lambda p: F.coalesce(p["period"] == F.col("period"), F.lit(False))), "no_period").otherwise("found")
    )
    return joined.select("id", reason.alias("reason"), F.coalesce("years", F.array().cast("array<int>")).alias("years"))


def anchors(pairs: DataFrame, questions: DataFrame, items: DataFrame, most: int = 2) -> DataFrame:
    """(id, table_ref, item, score, first): of each table of pairs(id, table_ref) the items(table_ref, item) that a question means most likely; first where no table has a better one.

    A point for each word they share, four for each phrase of the question that the item holds, less a little for its length.
    """
    asked = questions.select("id", F.array_distinct(F.filter(tokens(F.col("question")), lambda w: F.length(w) >= 2)).alias("_w"), F.array_distinct(phrases(F.col("question"))).alias("_p"))
    named = items.select("table_ref", "item").distinct().select("table_ref", "item", fold(F.col("item")).alias("_f"), tokens(F.col("item")).alias("_t"))
    rows = pairs.select("id", "table_ref").distinct().join(asked, "id").join(named, "table_ref")
    held = F.size(F.filter("_p", lambda p: F.contains(F.col("_f"), p)))
    score = F.round(F.size(F.array_intersect("_w", "_t")) + 4 * held - 0.02 * F.length("item"), 4)
    best = Window.partitionBy("id", "table_ref").orderBy(F.desc("score"), "item")
    kept = rows.select("id", "table_ref", "item", score.alias("score")).withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= most)
    top = kept.groupBy("id").agg(F.max("score").alias("_top"))
    return kept.join(top, "id").select("id", "table_ref", "item", "score", (F.col("score") == F.col("_top")).alias("first"))


def linked_groups(selected: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group_id, tables): the tables of one group, two or more, that a question has been given: they are read as one."""
    rows = selected.select("id", "table_ref").distinct().join(links.select("table_ref", "group_id").where("group_id IS NOT NULL"), "table_ref")
    return rows.groupBy("id", "group_id").agg(F.array_sort(F.collect_set("table_ref")).alias("tables")).where(F.size("tables") >= 2)


def table_schema(facts: DataFrame) -> DataFrame:
    """(table_ref, n_items, years, periods, labels): what the facts of a table hold, for a planner."""
    years = F.array_sort(F.collect_set(F.col("year").cast("string")))
    return facts.groupBy("table_ref").agg(F.count_distinct("item").alias("n_items"), years.alias("years"), F.array_sort(F.collect_set("period")).alias("periods"), F.array_sort(F.collect_set("column_label")).alias("labels"))


def extreme(rows: DataFrame, group: list[str], criterion: str, target: str, largest: bool = True) -> DataFrame:
    """For each group the target where the criterion is largest (smallest); of equals the least target."""
    sign = -1 if largest else 1
    best = F.min(F.struct((sign * F.col(criterion)).alias("c"), F.col(target).alias("t")))
    rows = rows.where(F.col(criterion).isNotNull())
    return rows.groupBy(*group).agg(best.alias("_b")).select(*group, F.col("_b.t").alias(target), (sign * F.col("_b.c")).alias(criterion))


def share_above_median(rows: DataFrame, group: list[str], criterion: str, value: str) -> DataFrame:
    """(group, median, share): of the sum of value, the percentage of the members whose criterion is above the median."""
    middle = rows.groupBy(*group).agg(F.median(criterion).alias("median"))
    above = F.sum(F.when(F.col(criterion) > F.col("median"), F.col(value)).otherwise(0.0))
    joined = rows.join(middle, group) if group else rows.crossJoin(F.broadcast(middle))  # one row of one number
    return joined.groupBy(*group, "median").agg((F.try_divide(above, F.sum(value)) * 100).alias("share"))


@dataclass(frozen=True)
class Plan:
    """What to compute: data, never code. operation: lookup, ratio, growth, cagr, argmax or peer_share."""

    operation: str
    metrics: tuple[str, ...]
    tickers: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    unit: str = "none"
    options: dict = field(default_factory=dict, hash=False)


def evaluate(facts: DataFrame, plan: Plan) -> DataFrame:
    """(ticker, year, value) of a plan over facts(ticker, year, metric, value); absent terms give null values, not errors; of several facts the least value counts."""
    rows = facts.where(F.col("metric").isin(*plan.metrics))
    if plan.tickers:
        rows = rows.where(F.col("ticker").isin(*plan.tickers))
    if plan.years:
        rows = rows.where(F.col("year").isin(*plan.years))
    wide = rows.groupBy("ticker", "year").agg(*(F.min(F.when(F.col("metric") == m, F.col("value"))).alias(f"m{i}") for i, m in enumerate(plan.metrics)))
    if plan.operation == "lookup":
        return wide.select("ticker", "year", F.col("m0").alias("value"))
    if plan.operation == "ratio":
        return wide.select("ticker", "year", ratio(F.col("m0"), F.col("m1"), plan.options.get("factor", 100.0)).alias("value"))
    if plan.operation in ("growth", "cagr"):
        ends = wide.groupBy("ticker").agg(F.min_by("m0", "year").alias("a"), F.max_by("m0", "year").alias("b"), F.min("year").alias("y0"), F.max("year").alias("year"))
        value = growth(F.col("b"), F.col("a")) if plan.operation == "growth" else cagr(F.col("a"), F.col("b"), F.col("year") - F.col("y0"))
        return ends.select("ticker", "year", value.alias("value"))
    if plan.operation == "argmax":
        scored = wide.withColumn("c", ratio(F.col("m0"), F.col("m1")) if len(plan.metrics) > 1 else F.col("m0"))
        return extreme(scored, ["ticker"], "c", "year").select("ticker", "year", F.col("year").cast("double").alias("value"))
    if plan.operation == "peer_share":
        scored = wide.withColumn("c", ratio(F.col("m0"), F.col("m1")))
        return share_above_median(scored, ["year"], "c", "m0").select(F.lit(None).cast("string").alias("ticker"), "year", F.col("share").alias("value"))
    raise ValueError(f"no such operation: {plan.operation}")
