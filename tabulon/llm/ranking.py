"""One ranking from several scores on different scales (problem 5).

Within each group a score becomes its empirical percentile, ties averaged; the inverse normal distribution makes it
a deviate; the weighted mean of the deviates orders the group.

Defined cases: repeated rows count once; a row without a score stands below all rows of its group that have it, for
it was not found worth scoring, and shares the mean percentile of such rows; where a whole group lacks a score, that
score is neutral; ties of the mean are broken by the item's key; an empty table gives an empty table; groups with a
null key are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import checkpoint

#: A group with more rows than this is cut at quantiles of each score into slices of about as many rows.
GROUP_ROWS = 200_000
#: The most such quantiles: a group of over EDGES * GROUP_ROWS rows has slices of a share of 1 / EDGES of it, which are sorted on disk.
EDGES = 1023
#: Keys that the rows without a score are spread over.
SALTS = 64

#: Coefficients of the rational approximation of the inverse normal distribution (error below 1.2e-9).
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """The deviate whose normal distribution function is p, for 0 < p < 1; a JVM-side expression."""
    tail = F.sqrt(F.lit(-2.0) * F.log(F.least(p, F.lit(1.0) - p)))
    outer = _poly(_C, tail) / (_poly(_D, tail) * tail + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    inner = _poly(_A, r) * q / (_poly(_B, r) * r + F.lit(1.0))
    return F.when(p < 0.02425, outer).when(p > 1 - 0.02425, -outer).otherwise(inner)


def _less_than(value: Column) -> Callable[[Column], Column]:
    return lambda e: e < value


def _hot(rows: DataFrame, group: str, group_rows: int) -> DataFrame:
    """(group, _n) of the groups with more than group_rows rows: at most one for each group_rows rows of the table."""
    return rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > group_rows)


def _edges(score: str, group_rows: int) -> Column:
    """Values of a score that cut a group of _n rows into slices of about group_rows, EDGES of them at most."""
    every = F.percentile_approx(score, [i / (EDGES + 1) for i in range(1, EDGES + 1)], 10 * EDGES)
    step = F.greatest(F.lit(1), F.floor(F.lit(EDGES + 1) / F.ceil(F.max("_n") / F.lit(group_rows)))).cast("int")
    return F.array_distinct(F.filter(every, lambda e, i: (i + 1) % step == 0))


def percentiles(df: DataFrame, group: str, scores: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """df with p_<score>, (number below + half of the ties) / rows, for each of the scores; nulls come first.

    Groups of more than group_rows rows are taken out and ranked in slices; the others by windows over a group.
    """
    # At most one hot group for each group_rows rows: a few bytes for what fills a task.
    hot = F.broadcast(_hot(df, group, group_rows))
    small = small_percentiles(df.join(hot, group, "left_anti"), group, scores)
    return small.unionByName(sliced_percentiles(df.join(hot, group), group, scores, group_rows))


def sliced_percentiles(df: DataFrame, group: str, scores: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """As percentiles(), for rows with the size of their group as _n: ranked in slices between quantiles of the score.

    Equal scores are in one slice and are only counted there, by a partial aggregate, not ordered; the rank of each
    value is joined back to its rows, those without a score spread over SALTS keys.
    """
    edges = df.groupBy(group).agg(*(_edges(s, group_rows).alias(f"_e_{s}") for s in scores))
    out = df.join(F.broadcast(edges), group)  # one row of each hot group
    for s in scores:
        below = F.size(F.filter(f"_e_{s}", _less_than(F.col(s))))
        out = out.withColumn(f"_s_{s}", F.when(F.col(s).isNull(), F.lit(-1)).otherwise(F.coalesce(below, F.lit(0))))
    out = out.drop(*(f"_e_{s}" for s in scores)).withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    for s in scores:
        counted = out.groupBy(group, f"_s_{s}", s).agg(F.count("*").alias("_ties"))
        of_slice = counted.groupBy(group, f"_s_{s}").agg(F.sum("_ties").alias("_in"))
        lower = Window.partitionBy(group).orderBy(f"_s_{s}").rowsBetween(Window.unboundedPreceding, -1)
        of_slice = of_slice.select(group, f"_s_{s}", F.coalesce(F.sum("_in").over(lower), F.lit(0)).alias("_lower"))
        inside = Window.partitionBy(group, f"_s_{s}").orderBy(F.col(s)).rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_below", F.coalesce(F.sum("_ties").over(inside), F.lit(0)))
        spread = F.when(F.col(s).isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        ranks = counted.join(of_slice, [group, f"_s_{s}"]).select(
            F.col(group).alias("_g"), F.col(s).alias("_v"), F.explode(spread).alias("_k"), (F.col("_below") + F.col("_lower") + F.col("_ties") / 2).alias(f"p_{s}")
        )
        own = F.when(F.col(s).isNull(), F.col("_salt")).otherwise(0)
        out = out.withColumn("_own", own).join(ranks, (F.col(group) == F.col("_g")) & F.col(s).eqNullSafe(F.col("_v")) & (F.col("_own") == F.col("_k"))).drop("_g", "_v", "_k", "_own")
        out = out.withColumn(f"p_{s}", F.col(f"p_{s}") / F.col("_n"))
    return out.drop("_n", "_salt", *(f"_s_{s}" for s in scores))


def small_percentiles(df: DataFrame, group: str, scores: list[str]) -> DataFrame:
    """As percentiles(), for groups known to be small: one shuffle on the group, windows on top of it."""
    whole = Window.partitionBy(group)
    for s in scores:
        order = Window.partitionBy(group).orderBy(F.col(s))
        ties = Window.partitionBy(group, s)
        df = df.withColumn(f"p_{s}", (F.rank().over(order) - 1 + F.count("*").over(ties) / 2) / F.count("*").over(whole))
    return df


def fused(df: DataFrame, group: str, item: str, scores: dict[str, tuple[Column, float]], group_rows: int = GROUP_ROWS) -> DataFrame:
    """(group, item, z_<score>..., combined) with one row for each item of each group.

    scores: by name, the score, larger being better, and its weight.
    """
    rows = df.where(F.col(group).isNotNull()).select(group, item, *(c.cast("double").alias(n) for n, (c, _) in scores.items())).distinct()
    names = list(scores)
    ranked = percentiles(rows, group, names, group_rows)
    z = [inverse_normal(F.col(f"p_{n}")).alias(f"z_{n}") for n in names]
    total = sum(w for _, w in scores.values())
    mean = sum((F.col(f"z_{n}") * F.lit(w / total) for n, (_, w) in scores.items()), F.lit(0.0))
    return ranked.select(group, item, *z).withColumn("combined", F.round(mean, 9))


def first_of(fused_rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item) that stands first in each group; aggregated before it is shuffled."""
    best = F.min(F.struct((-F.col("combined")).alias("c"), F.col(item).alias("item")))
    return fused_rows.groupBy(group).agg(best.alias("_b")).select(group, F.col("_b.item").alias(item))


def ordered(fused_rows: DataFrame, group: str, item: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(group, item, combined, position): the whole order of each group, from 1.

    The fused rows are read from a checkpoint, for a hot group needs them for its quantiles, its slices and its order.
    """
    rows = checkpoint(fused_rows.select(group, item, "combined"))
    hot = F.broadcast(_hot(rows, group, group_rows))  # as in percentiles()
    best = [F.desc("combined"), F.col(item)]
    small = rows.join(hot, group, "left_anti").withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*best)))
    large = rows.join(hot, group)
    edges = large.groupBy(group).agg(_edges("combined", group_rows).alias("_e"))
    sliced = large.join(F.broadcast(edges), group).withColumn("_s", F.size(F.filter("_e", lambda e: e >= F.col("combined")))).drop("_e")
    lower = Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    of_slice = sliced.groupBy(group, "_s").agg(F.count("*").alias("_in")).select(group, "_s", F.coalesce(F.sum("_in").over(lower), F.lit(0)).alias("_lower"))
    inside = Window.partitionBy(group, "_s").orderBy(*best)
    large = sliced.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(of_slice), [group, "_s"])
    return small.unionByName(large.select(group, item, "combined", (F.col("_r") + F.col("_lower")).cast("int").alias("position")))
