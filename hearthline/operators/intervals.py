"""Joins of times with intervals, and of intervals with each other, by dyadic blocks of time.

An interval is laid on blocks whose length is a power of four (in microseconds) between a sixteenth and a quarter of its own, so that it
touches 4 to 17 of them, and most of what meets it in a block lies inside it. A time is put into its block of each length that any
interval has, of which there are few: intervals of all lengths from a second to ten years have fifteen. Both meet by key and
block, so the work is about that of the rows and the results, also for a key with very many intervals, overlapping or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = tuple[str, ...]


def _level(first: str, last: str) -> Column:
    """Binary logarithm of the block's length, an even number."""
    length = F.col(last).cast("double") - F.col(first).cast("double") + 1
    return F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1.0))) / 2) * 2 - 2, F.lit(0)).cast("int")


def times_in(points: DataFrame, at: str, intervals: DataFrame, first: str, last: str, keys: list[tuple[str, str]]) -> DataFrame:
    """Pairs of a row of points and a row of intervals with first <= at <= last: all columns of both.

    at, first and last are whole numbers, as microseconds; rows without one of them have no pairs, and neither have intervals that
    end before they begin. keys pairs columns of points with those of intervals, which are equal; the two frames have no name in common.
    """
    spans = intervals.where(F.col(first) <= F.col(last)).withColumn("_level", _level(first, last))
    spans = spans.withColumn("_block", F.explode(F.expr(f"sequence(shiftright(`{first}`, _level), shiftright(`{last}`, _level))")))
    levels = F.broadcast(intervals.where(F.col(first) <= F.col(last)).select(F.array_sort(F.collect_set(_level(first, last))).alias("_levels")))  # one row
    dealt = points.where(F.col(at).isNotNull()).crossJoin(levels).withColumn("_on", F.explode("_levels")).withColumn("_in", F.expr(f"shiftright(`{at}`, _on)")).drop("_levels")
    same = (F.col("_on") == F.col("_level")) & (F.col("_in") == F.col("_block"))
    for a, b in keys:
        same = same & (F.col(a) == F.col(b))
    return dealt.join(spans, same & F.col(at).between(F.col(first), F.col(last))).drop("_on", "_in", "_level", "_block")
