"""Exact quantiles of groups of any size.

A group of up to ``LARGE`` values is what one task may hold. The values of a larger one are put into bins between approximate
quantiles, whose sketches Spark merges; the bins only shape the work. Their counts say in which bin each wanted rank lies, and at
which place, and only these bins' values, some thousandth of the group each, go on to be ordered, as value counts. So
no task gets a large group, and results are those of sorting it.

Quantiles are linear between ranks, as by (n - 1) q. Nulls and NaN are left out; null keys are a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.sources.io import kept

#: Most values of a group in one task, and about how many bins a larger group has: a square less one.
LARGE, SIDE = 100_000, 32
BINS = SIDE * SIDE - 1


def _same(df: DataFrame, other: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """other with keys renamed, and the condition that they are equal, nulls too."""
    other = other.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    return other, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.lit(True))


def _met(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    other, same = _same(df, other, keys)
    out = df.join(other, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"_k{i}" for i in range(len(keys))))


def _values(df: DataFrame, keys: list[str], column: str, *more: str) -> DataFrame:
    x = F.col(column).cast("double")
    return df.select(*keys, *more, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))


def _bounds(values: DataFrame, keys: list[str], large: int) -> DataFrame:
    """(keys, _b, _r): approximate quantiles of the groups of more than large values, and every SIDE-th of them, written."""
    sizes = kept(values.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > large), "large-groups")
    if sizes.isEmpty():
        return sizes.select(*keys, F.array(F.lit(0.0)).alias("_b"), F.array(F.lit(0.0)).alias("_r"))
    at = [i / (BINS + 1) for i in range(1, BINS + 1)]
    bounds = _met(values, sizes.drop("_n"), keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("_x", at, 10_000).alias("_b"))
    return kept(bounds.withColumn("_r", F.filter("_b", lambda b, i: (i + 1) % SIDE == 0)), "group-bounds")


def _binned(values: DataFrame, bounds: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """(keys, more, _x, _bin) of the groups with bounds: how many bounds are below _x, first among every SIDE-th, then among those between two of them."""
    below = lambda part: F.size(F.filter(part, lambda b: b < F.col("_x")))
    rough = _met(values, bounds, keys).withColumn("_i", below(F.col("_r")) * SIDE)
    return rough.select(*keys, *more, "_x", (F.col("_i") + below(F.slice("_b", F.col("_i") + 1, SIDE - 1))).cast("int").alias("_bin"))


def quantiles(df: DataFrame, keys: list[str], column: str, at: dict[str, float], large: int | None = None) -> DataFrame:
    """(keys, a column for each of at): exact quantiles of each group that has values."""
    values = _values(df, keys, column)
    bounds = _bounds(values, keys, LARGE if large is None else large)
    plain = lambda v: v.groupBy(*keys).agg(*(F.percentile("_x", q).alias(n) for n, q in at.items()))
    if bounds.isEmpty():
        return plain(values)
    binned = _binned(values, bounds, keys)
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumns({"_to": F.sum("_c").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(w)})
    place = F.array(*(F.struct(F.lit(n).alias("name"), (F.lit(q) * (F.col("_n") - 1)).alias("pos")) for n, q in at.items()))
    asked = counts.select(*keys, "_bin", (F.col("_to") - F.col("_c")).alias("_from"), "_to", F.explode(place).alias("_q"))
    asked = asked.withColumn("_end", F.explode(F.array(F.floor("_q.pos"), F.ceil("_q.pos")))).where("_from <= _end and _end < _to")
    asked = kept(asked.select(*keys, "_bin", F.col("_q.name").alias("_name"), F.col("_q.pos").alias("_pos"), "_end", (F.col("_end") - F.col("_from")).alias("_at")), "wanted-ranks")
    inside = _met(binned, asked.select(*keys, "_bin").distinct().withColumnRenamed("_bin", "_kb"), keys).where("_bin = _kb")
    order = inside.groupBy(*keys, "_bin", "_x").agg(F.count("*").alias("_c"))
    order = order.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    found = _met(order, asked.withColumnRenamed("_bin", "_kb"), keys).where("_bin = _kb and _at < _upto and _at >= _upto - _c")
    weight = F.col("_pos") - F.floor("_pos")
    # the rank below and the one above, each by its nearness; both are one where the position is whole
    ends = lambda n: (F.max(F.when((F.col("_name") == n) & (F.col("_end") == F.floor("_pos")), F.col("_x"))), F.max(F.when((F.col("_name") == n) & (F.col("_end") == F.ceil("_pos")), F.col("_x"))), F.max(F.when(F.col("_name") == n, weight)))
    picked = []
    for n in at:
        low, high, share = ends(n)
        picked.append((low + (high - low) * share).alias(n))
    out = found.groupBy(*keys).agg(*picked)
    return out.unionByName(plain(_met(values, bounds.select(*keys), keys, "left_anti"))) if keys else out


def quantiles_from(df: DataFrame, keys: list[str], column: str, level: str, at: dict[str, float], large: int | None = None) -> DataFrame:
    """(keys, level, a column for each of at): for each level from 0 to a group's greatest, exact quantiles of its rows of that level or a higher one.

    level: a column of small whole numbers from 0 on. A row goes on once, whatever the number of levels. A group of up to large values is one row of
    value counts, from which all levels are read. In a larger one counts by bin and level,
    cumulated from the highest level down, tell the bin and place of each rank, and each bin picks its own.
    """
    values = _values(df, keys, column, level).where(F.col(level) >= 0)
    bounds = _bounds(values, keys, LARGE if large is None else large)
    names, shares = [*at], np.array([*at.values()])
    fields = [values.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField(level, T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of, levels, found = [], [], [np.empty((0, len(names)))]
            for i, (x, t, c) in enumerate(zip(b["_x"], b["_l"], b["_c"])):
                for least in range(int(t.max()) + 1):
                    here = t >= least
                    to = c[here].cumsum()
                    pos = shares * (to[-1] - 1)
                    low, high = (x[here][np.searchsorted(to, end(pos), side="right")] for end in (np.floor, np.ceil))
                    found.append((low + (high - low) * (pos - np.floor(pos)))[None])
                    of.append(i)
                    levels.append(least)
            out = b[keys].iloc[of].reset_index(drop=True)
            out[level] = np.array(levels, dtype=np.int32)
            out[names] = np.concatenate(found)
            yield out[schema.names]

    small = _met(values, bounds.select(*keys), keys, "left_anti") if keys else values.where(F.lit(bounds.isEmpty()))
    rows = small.groupBy(*keys, level, "_x").agg(F.count("*").alias("_c")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_x", F.col(level).alias("_l"), "_c"))).alias("_g"))
    few = rows.where(F.size("_g") > 0).select(*keys, *(F.col(f"_g.{c}").alias(c) for c in ("_x", "_l", "_c"))).mapInPandas(read, schema)
    if bounds.isEmpty():
        return few
    binned = _binned(values, bounds, keys, level)

    def wanted(counts: pd.DataFrame) -> pd.DataFrame:
        bins, b = np.unique(counts["_bin"].to_numpy(), return_inverse=True)
        table = np.zeros((int(counts[level].max()) + 1, len(bins)), dtype=np.int64)
        table[counts[level].to_numpy(), b] = counts["_c"].to_numpy()
        to = table[::-1].cumsum(axis=0)[::-1].cumsum(axis=1)  # levels x bins
        out = []
        for t, row in enumerate(to):
            pos = shares * (row[-1] - 1)
            for end in (0, 1):
                rank = (np.ceil(pos) if end else np.floor(pos)).astype(np.int64)
                i = np.searchsorted(row, rank, side="right")
                out.append(pd.DataFrame({"_bin": bins[i].astype(np.int32), "_t": np.int32(t), "_q": np.arange(len(shares), dtype=np.int32), "_end": np.int32(end), "_at": rank - np.where(i > 0, row[i - 1], 0), "_w": pos - np.floor(pos)}))
        out = pd.concat(out)
        for k in keys:
            out[k] = counts[k].iloc[0]
        return out[[*keys, "_bin", "_t", "_q", "_end", "_at", "_w"]]

    def picked(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_x", kind="stable")
        x, t, c = (rows[n].to_numpy() for n in ("_x", level, "_c"))
        found = np.empty(len(asked))
        asked = asked.reset_index(drop=True)
        for least, at_level in asked.groupby("_t"):
            here = t >= least
            found[at_level.index] = x[here][np.searchsorted(c[here].cumsum(), at_level["_at"].to_numpy(), side="right")]
        return asked.assign(_v=found)[[*keys, "_t", "_q", "_end", "_w", "_v"]]

    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    head = key_ddl + ", " if keys else ""
    counts = binned.groupBy(*keys, "_bin", level).agg(F.count("*").alias("_c"))
    asked = kept(counts.groupBy(*keys).applyInPandas(wanted, f"{head}_bin int, _t int, _q int, _end int, _at long, _w double"), "wanted-levels")
    inside = _met(binned, asked.select(*keys, "_bin").distinct().withColumnRenamed("_bin", "_kb"), keys).where("_bin = _kb").groupBy(*keys, "_bin", level, "_x").agg(F.count("*").alias("_c"))
    found = inside.groupBy(*keys, "_bin").cogroup(asked.groupBy(*keys, "_bin")).applyInPandas(picked, f"{head}_t int, _q int, _end int, _w double, _v double")
    end = lambda q, e: F.max(F.when((F.col("_q") == q) & (F.col("_end") == e), F.col("_v")))
    columns = [(end(i, 0) + (end(i, 1) - end(i, 0)) * F.max(F.when(F.col("_q") == i, F.col("_w")))).alias(n) for i, n in enumerate(names)]
    return found.groupBy(*keys, F.col("_t").alias(level)).agg(*columns).unionByName(few)


def joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with other's columns for equal keys, nulls included; all rows of df stay."""
    return _met(df, other, keys, "left")
