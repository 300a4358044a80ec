"""Filling fixed-capacity containers with items by exact-complement hashing (problem 8).

The sizes of items are at most the capacity, so the corpus is described by a histogram of at most `capacity` counts,
whatever its length. The plan is made on that histogram: each container opens with the largest size left; single,
pair and triple sums of sizes are indexed, and a combination that fills the gap exactly is consumed under the
counts, as many times as they allow; where none does, the largest size that fits goes in (best fit) and the rest of
the gap is looked up again. The plan is then joined back to the items by their rank within their size.

Defined cases: items of size 0 or null get no container; an item larger than the capacity is split into full pieces
and a rest; items are otherwise whole; items of one size are placed by a hash of their ids, so that the result is the same however they are split; repeated rows go by their order among equals; an empty
table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.session import checkpoint

#: Rows of one size that are ranked in one task at most; a more frequent size is split by ranges of a hash of its ids.
GROUP_ROWS = 200_000
#: Values of the hash of an id.
HASHES = 2**31


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of containers, {size: items of it in each}) that use up the counts."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    patterns: list[tuple[int, dict[int, int]]] = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return patterns
        used = {top: 1}
        gap = capacity - top
        while gap:
            found = _complement(left, used, gap)
            if found is None:
                size = min(gap, top)
                while size and left[size] <= used.get(size, 0):
                    size -= 1
                if not size:
                    break
                found = (size,)
            for size in found:
                used[size] = used.get(size, 0) + 1
                gap -= size
        n = min(int(left[size]) // k for size, k in used.items())
        for size, k in used.items():
            left[size] -= n * k
        patterns.append((n, used))


def _complement(left: np.ndarray, used: dict[int, int], gap: int) -> tuple[int, ...] | None:
    """One, two or three available sizes that sum to gap, larger ones first; None if there are none."""
    free = left[: gap + 1].copy()
    for size, k in used.items():
        if size <= gap:
            free[size] -= k
    if free[gap] > 0:
        return (gap,)
    has = free > 0
    pair = _pair(free, has, gap)
    if pair:
        return pair
    for first in np.flatnonzero(has[1:])[::-1] + 1:
        if 3 * first < gap:
            break
        free[first] -= 1
        has[first] = free[first] > 0
        rest = _pair(free, has, int(gap - first))
        free[first] += 1
        has[first] = True
        if rest:
            return (int(first), *rest)
    return None


def _pair(free: np.ndarray, has: np.ndarray, total: int) -> tuple[int, int] | None:
    low = np.arange(1, (total + 1) // 2)
    hits = low[has[low] & has[total - low]]
    if len(hits):
        return int(total - hits[0]), int(hits[0])
    if total % 2 == 0 and total and free[total // 2] > 1:
        return total // 2, total // 2
    return None


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(id_col, piece, start, size, container) of each piece of each item with a size above 0.

    piece counts from 0 and start is the piece's offset in its item. Containers are numbered from 0.
    """
    # Measuring is the dear part and its result is two numbers a row, so it is written once and read from there.
    items = checkpoint(sizes.select(F.col(id_col), F.col(size_col).cast("long").alias("total")).where("total > 0"))
    full = F.floor(F.col("total") / capacity)
    whole = items.where(F.col("total") >= capacity).select(id_col, F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    whole = whole.select(id_col, F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("size"))
    rest = items.where(F.col("total") % capacity > 0).select(
        id_col, full.cast("int").alias("piece"), (full * capacity).alias("start"), (F.col("total") % capacity).alias("size")
    )
    counts = {r["size"]: r["n"] for r in rest.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    patterns = plan(counts, capacity)
    n_rest = sum(n for n, _ in patterns)

    ranked = _ranked(rest, id_col, max(counts.values(), default=0))
    ranges: dict[int, list[tuple[int, int, int]]] = {}  # by size: first rank, first container, containers
    at = dict.fromkeys(counts, 0)
    first = 0
    for n, used in patterns:
        for size, k in used.items():
            for _ in range(k):
                ranges.setdefault(size, []).append((at[size], first))
                at[size] += n
        first += n
    starts = {s: (np.array([a for a, _ in r]), np.array([b for _, b in r])) for s, r in ranges.items()}

    @F.pandas_udf(T.LongType())
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(size), np.int64)
        size, rank = size.to_numpy(), rank.to_numpy()
        for s in np.unique(size):
            where = np.flatnonzero(size == s)
            ranks, containers = starts[int(s)]
            k = np.searchsorted(ranks, rank[where], "right") - 1
            out[where] = containers[k] + rank[where] - ranks[k]
        return pd.Series(out)

    placed = ranked.select(id_col, "piece", "start", "size", container("size", "rank").alias("container"))
    # A full piece is alone in its container; its number is its rank after those of the plan.
    n_full = items.agg(F.sum(full)).first()[0] or 0
    alone = _ranked(whole, id_col, n_full).select(id_col, "piece", "start", "size", (F.col("rank") + n_rest).alias("container"))
    return placed.unionByName(alone)


def _ranked(items: DataFrame, id_col: str, most: int) -> DataFrame:
    """items with `rank`, from 0 within each size, by a hash of the id, then by id and piece.

    most: the rows of the most frequent size. Sizes are ranked in ranges of the hash, so many that no task ranks more
    than about GROUP_ROWS rows of one; the ranks are the same however many there are.
    """
    buckets = max(1, -(-int(most) // GROUP_ROWS))
    hashed = items.withColumn("_h", F.pmod(F.xxhash64(F.col(id_col), F.col("piece")), F.lit(HASHES)))
    salted = hashed.withColumn("_bucket", F.floor(F.col("_h") * buckets / HASHES))
    before = Window.partitionBy("size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = salted.groupBy("size", "_bucket").agg(F.count("*").alias("_n")).select("size", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("size", "_bucket").orderBy("_h", id_col, "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(inner) - 1).join(offset, ["size", "_bucket"])
    return ranked.withColumn("rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_h", "_bucket", "_rank", "_before")
