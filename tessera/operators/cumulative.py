"""Sums over all smaller values, without a task that orders them all; and pairs in order by two values.

Values are cut into stretches at quantiles of the rows, so an outlier takes no more than its own stretch and a
value that many rows share is a stretch of its own, in which nothing is smaller than anything else. A first
pass adds up each stretch, of which there is a fixed number; the sums of the stretches before are then known,
and a window within each stretch gives the rest. Cuts are numbers in the plan, so both passes agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cuts at most. Twice as many stretches, and their square where there are two values, come to the driver as numbers.
CUTS, CUTS_OF_PAIRS = 1024, 128
#: Relative error of the quantiles, in stretches.
ACCURACY = 20


def _constant(numbers: Iterable[float], kind: str = "double") -> Column:
    """An array of numbers as one literal of the plan."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast(f"array<{kind}>")


def cuts_of(rows: DataFrame, values: Sequence[str], most: int = CUTS) -> list[list[float]]:
    """Per column the values, ascending, that cut its rows into stretches of about equal numbers. Nulls count for none."""
    shares = _constant((i + 1) / (most + 1) for i in range(most))
    found = rows.agg(*(F.percentile_approx(v, shares, F.lit(most * ACCURACY)).alias(f"c{i}") for i, v in enumerate(values))).first()
    return [sorted({float(x) for x in c or []}) for c in found]


def stretch(value: Column, cuts: Sequence[float]) -> Column:
    """Number of the stretch: 2 i + 1 for the value of cut i alone, 2 i for values below it and above the one before."""
    if not cuts:
        return F.lit(0)
    # Two steps, as a search for a word turns to a page first: of blocks, then within one.
    size = max(1, int(len(cuts) ** 0.5))
    block = F.size(F.filter(_constant(cuts[::size]), lambda c: c <= value))
    inside = F.slice(_constant(cuts), F.greatest((block - 1) * size + 1, F.lit(1)), size)
    upto = F.when(block == 0, 0).otherwise((block - 1) * size + F.size(F.filter(inside, lambda c: c <= value)))
    last = F.element_at(_constant(cuts), F.greatest(upto, F.lit(1)).cast("int"))
    return (2 * upto - F.when((upto > 0) & (last == value), 1).otherwise(0)).cast("int")


def below(rows: DataFrame, value: str, sums: Sequence[str]) -> DataFrame:
    """The rows with `below_<sum>` for each of `sums`: its total over rows of a smaller value. value: a column of doubles without nulls; what is added up are whole numbers."""
    (cuts,) = cuts_of(rows, [value])
    dealt = rows.withColumn("_stretch", stretch(F.col(value), cuts))
    totals = {r["_stretch"]: r for r in dealt.groupBy("_stretch").agg(*(F.sum(s).alias(s) for s in sums)).collect()}
    earlier = {s: [0, *accumulate(totals[k][s] or 0 if k in totals else 0 for k in range(2 * len(cuts)))] for s in sums}
    # Rows of one value are one row here, so that a window holds distinct values of one stretch.
    per = dealt.groupBy("_stretch", value).agg(*(F.sum(s).alias(s) for s in sums))
    inside = Window.partitionBy("_stretch").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = {s: F.element_at(_constant(n, "bigint"), F.col("_stretch") + 1) for s, n in earlier.items()}
    summed = per.select(F.col(value).alias("_value"), *((F.coalesce(F.sum(s).over(inside), F.lit(0)) + before[s]).alias(f"below_{s}") for s in sums))
    return rows.join(summed, F.col(value) == F.col("_value")).drop("_value")


def _ordered(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> int:
    """Pairs of a row with p and one without whose x and y both are smaller, by merging halves: n log^2 n steps."""
    by = np.lexsort((~p, x))
    # Of equal x those with p come first, so that none before them is of the same x.
    y, p = np.unique(y, return_inverse=True)[1][by].astype(np.int64), p[by]
    n, total, size = len(y), 0, 1
    wide, at = n + 1, np.arange(n)
    while size < n:
        block, right = at // (2 * size), (at // size) % 2 == 1
        left = np.sort((block * wide + y)[~right & ~p])
        asked = right & p
        total += int((np.searchsorted(left, (block * wide + y)[asked]) - np.searchsorted(left, (block * wide)[asked])).sum())
        size *= 2
    return total


def ordered_pairs(rows: DataFrame, positive: str, first: str, second: str) -> int:
    """Pairs of a positive row and a negative one in which the positive one is greater by both values.

    Both values are cut into stretches. Pairs in different stretches by both are counted on the grid of stretches; pairs in one
    stretch by the first value, or by the second and not by the first, within that stretch, which is bounded by the cuts."""
    points = rows.select(F.col(positive).alias("p"), F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b")).where("p is not null and a is not null and b is not null")
    a_cuts, b_cuts = cuts_of(points, ["a", "b"], CUTS_OF_PAIRS)
    dealt = points.select("p", "a", "b", stretch(F.col("a"), a_cuts).alias("i"), stretch(F.col("b"), b_cuts).alias("j"))
    grid = np.zeros((2, 2 * len(a_cuts) + 1, 2 * len(b_cuts) + 1), np.int64)
    for r in dealt.groupBy("p", "i", "j").count().collect():
        grid[int(r["p"]), r["i"], r["j"]] = r["count"]
    smaller = grid[0].cumsum(0).cumsum(1)[:-1, :-1]
    total = int((grid[1][1:, 1:] * smaller).sum())

    def within(batch: pd.DataFrame) -> pd.DataFrame:
        x = batch["x"].to_numpy()
        return pd.DataFrame({"n": [_ordered(x, batch["y"].to_numpy(), batch["p"].to_numpy(bool))]})

    # A stretch of one value (odd) has no pairs. By the second value, rows of one stretch of the first were counted already.
    by_first = dealt.where("i % 2 = 0").select(F.lit(0).alias("side"), F.col("i").alias("at"), "p", F.col("a").alias("x"), F.col("b").alias("y"))
    by_second = dealt.where("j % 2 = 0").select(F.lit(1).alias("side"), F.col("j").alias("at"), "p", F.col("i").cast("double").alias("x"), F.col("b").alias("y"))
    found = by_first.unionByName(by_second).groupBy("side", "at").applyInPandas(within, "n long")
    return total + int(found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
