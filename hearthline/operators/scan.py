"""Scans over long series in two phases, so that one series is many tasks.

A series is cut into chunks of ``chunk_s`` seconds. Windows run within a chunk; one summary row a chunk is taken of what
they leave, a window over the summaries of a series gives each chunk what came before (or comes after) it, and the rows of a chunk
are corrected by it. Rows are shuffled once, by series and chunk, and the join of the summaries keeps that partitioning. A task thus
holds the rows of ``chunk_s`` seconds of a series, and the window over summaries one row for each such stretch.

A series whose key has a null is one chunk, as it can't be joined.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions.time import micros

Keys = tuple[str, ...]
#: Seconds of a chunk: thirty days.
CHUNK_S = 30 * 86_400
_FIRST = -(1 << 62)


def unnamed(keys: Keys) -> Column:
    """Whether a key has a null."""
    return reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys), F.lit(False))


def with_chunk(df: DataFrame, keys: Keys, ts: str, chunk_s: float) -> DataFrame:
    """_chunk: number of the row's chunk, in order of time; rows without a time come first, as in a window."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.DateType):
        us = F.unix_date(ts).cast("long") * 86_400_000_000
    else:
        us = F.col(ts) if isinstance(kind, T.LongType) else micros(df, ts)
    return df.withColumn("_chunk", F.when(unnamed(keys), F.lit(0)).otherwise(F.coalesce(F.floor(us / F.lit(int(chunk_s * 1_000_000))).cast("long"), F.lit(_FIRST))))


def segmented(df: DataFrame, keys: Keys, order: Keys, chunk_s: float, local: Callable[[DataFrame, WindowSpec], DataFrame], summary: dict[str, Column], carried: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """df with the columns that local adds within chunks, and those that carried leaves, the same in all rows of a chunk.

    summary: aggregates of a chunk's rows, local columns included. carried takes these by series and chunk, and a window over the
    series' chunks in order; what it leaves besides these two goes to the rows. order begins with the time, or with
    microseconds. Where a series has no summary, as its key has a null, carried columns are null.
    """
    df = local(with_chunk(df, keys, order[0], chunk_s), Window.partitionBy(*keys, "_chunk").orderBy(*order))
    per = df.where(~unnamed(keys))
    per = carried(per.groupBy(*keys, "_chunk").agg(*(c.alias(n) for n, c in summary.items())), Window.partitionBy(*keys).orderBy("_chunk"))
    names = [c for c in df.columns if c != "_chunk"]
    return df.join(per, [*keys, "_chunk"], "left").select(*names, *(c for c in per.columns if c not in (*keys, "_chunk")))


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def up_to(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def behind(order: Keys) -> Column:
    """Sort key of a row in max_by and min_by, nulls first as in a window."""
    return F.struct(*(x for c in order for x in (F.col(c).isNotNull(), F.col(c))))


def running_sum(df: DataFrame, column: str, keys: Keys, order: Keys, name: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """name: the sum of column up to each row; column has no nulls."""
    out = segmented(
        df, keys, order, chunk_s,
        lambda d, w: d.withColumn("_own", F.sum(column).over(up_to(w))),
        {"_all": F.sum(column)},
        lambda d, w: d.withColumn("_off", F.sum("_all").over(before(w))).drop("_all"),
    )
    return out.withColumn(name, F.col("_own") + F.coalesce(F.col("_off"), F.lit(0).cast(out.schema["_own"].dataType))).drop("_own", "_off")


def turns(df: DataFrame, flag: str, keys: Keys, order: Keys, name: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """name: how often up to each row the flag was another than in the row before; null before the first row."""
    row = F.struct(F.col(flag).alias("f"))

    def local(d: DataFrame, w: WindowSpec) -> DataFrame:
        # a series whose key has a null is one chunk: its first row counts here
        first = (F.row_number().over(w) == 1) & unnamed(keys)
        turned = ((F.row_number().over(w) > 1) | first) & ~F.col(flag).eqNullSafe(F.lag(flag).over(w))
        return d.withColumn("_turn", turned.cast("long")).withColumn("_own", F.sum("_turn").over(up_to(w)))

    def carried(d: DataFrame, w: WindowSpec) -> DataFrame:
        # a chunk's first row against the last one of the chunk before
        d = d.withColumn("_edge", (~F.col("_head")["f"].eqNullSafe(F.lag("_tail").over(w)["f"])).cast("long"))
        return d.withColumn("_off", F.sum("_edge").over(up_to(w)) + F.coalesce(F.sum("_many").over(before(w)), F.lit(0))).drop("_head", "_tail", "_many", "_edge")

    out = segmented(df, keys, order, chunk_s, local, {"_many": F.sum("_turn"), "_head": F.min_by(row, behind(order)), "_tail": F.max_by(row, behind(order))}, carried)
    return out.withColumn(name, F.col("_own") + F.coalesce("_off", F.lit(0))).drop("_turn", "_own", "_off")


def neighbours(df: DataFrame, column: str, keys: Keys, ts: str, place: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """_v0, _p0: value and place of the last row with a value up to here; _v1, _p1: of the next from here on. Ordered by ts."""
    here = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), F.col(place).alias("p")))
    time = F.when(here.isNotNull(), F.col(ts))

    def local(d: DataFrame, w: WindowSpec) -> DataFrame:
        # backwards in time for the next value: a frame to the end of the partition is computed anew for each row
        back = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(ts))
        return d.withColumns({"_n0": F.last(here, ignorenulls=True).over(up_to(w)), "_n1": F.last(here, ignorenulls=True).over(up_to(back))})

    def carried(d: DataFrame, w: WindowSpec) -> DataFrame:
        back = Window.partitionBy(*keys).orderBy(F.desc("_chunk"))
        return d.withColumns({"_c0": F.last("_l", ignorenulls=True).over(before(w)), "_c1": F.last("_f", ignorenulls=True).over(before(back))}).drop("_f", "_l")

    out = segmented(df, keys, (ts,), chunk_s, local, {"_f": F.min_by(here, time), "_l": F.max_by(here, time)}, carried)
    near = {i: F.coalesce(f"_n{i}", f"_c{i}") for i in (0, 1)}
    return out.withColumns({f"_{x}{i}": near[i][x] for i in (0, 1) for x in ("v", "p")}).drop("_n0", "_n1", "_c0", "_c1")
