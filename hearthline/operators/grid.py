"""Regular grids: resampling and interpolation that knows its limits. Bins are counted from 1970 in whole steps.

Grids are laid out, and gaps filled, by chunks of a series (see ``scan``), so that a long one is many tasks; means of a
filled grid are taken without laying it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.time import from_micros, micros, seconds_between
from hearthline.operators.scan import CHUNK_S, neighbours, segmented, unnamed

Keys = tuple[str, ...]
LONG = ("id", "property")


def _binned(df: DataFrame, step_s: int, ts: str) -> DataFrame:
    us = micros(df, ts)
    return df.withColumns({"_us": us, "_bin": us - F.pmod(us, F.lit(int(step_s) * 1_000_000))})


def _full_grid(bins: DataFrame, step_s: int, keys: Keys, chunk_s: float = CHUNK_S, least: int = 0) -> DataFrame:
    """Every bin of a key from its first to its last, with the values where there are any. least: keys whose _n adds up to less are left out."""
    step = int(step_s) * 1_000_000
    span = bins.groupBy(*keys).agg(F.min("_bin").alias("_a"), F.max("_bin").alias("_b"), *([F.sum("_n").alias("_n")] if least else []))
    if least:
        span = span.where(F.col("_n") >= least)
        bins = bins.drop("_n")
    # a whole number of bins a chunk; each chunk's bins are laid out in a task of their own
    wide = max(1, int(chunk_s * 1_000_000) // step) * step
    chunks = span.select(*keys, "_a", "_b", F.explode(F.sequence(F.floor(F.col("_a") / wide).cast("long"), F.floor(F.col("_b") / wide).cast("long"))).alias("_chunk")).repartition(*keys, "_chunk")
    every = F.sequence(F.greatest("_a", F.col("_chunk") * wide), F.least("_b", (F.col("_chunk") + 1) * wide - step), F.lit(step))
    return chunks.select(*keys, F.explode(every).alias("_bin")).join(bins, [*keys, "_bin"], "left")


def resample_first(df: DataFrame, step_s: int, column: str = "value", keys: Keys = LONG, ts: str = "timestamp", chunk_s: float = CHUNK_S, least: int = 0) -> DataFrame:
    """The first value in each bin, and null in bins without one; all bins from the key's first row to its last. Keys of fewer than least values are left out."""
    b = _binned(df, step_s, ts)
    count = [F.count(column).alias("_n")] if least else []
    bins = b.groupBy(*keys, "_bin").agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col("_us"))).alias(column), *count)
    return _full_grid(bins, step_s, keys, chunk_s, least).select(*keys, from_micros(df, ts, F.col("_bin")).alias(ts), column)


#: Summaries by name; an empty bin sums up to 0 and counts 0, its mean is null. "first" takes a bin's mean, as means of equal steps do.
SUMMARIES = {"add": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg, "count": F.count, "first": F.avg}


def resample_agg(df: DataFrame, step_s: int, how: str = "mean", column: str = "value", keys: Keys = LONG, ts: str = "timestamp", every: bool = True) -> DataFrame:
    """A summary of each bin; with every, also of the empty ones in between."""
    bins = _binned(df, step_s, ts).groupBy(*keys, "_bin").agg(SUMMARIES[how](F.col(column)).alias(column))
    if every:
        bins = _full_grid(bins, step_s, keys)
        if how in ("add", "count"):
            bins = bins.fillna(0, [column])
    return bins.select(*keys, from_micros(df, ts, F.col("_bin")).alias(ts), column)


def _neighbours(df: DataFrame, column: str, keys: Keys, order: str) -> DataFrame:
    """As ``scan.neighbours``, for a series within one task."""
    here = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), F.col(order).alias("p")))
    w = Window.partitionBy(*keys)
    # backwards in time for the next value: a frame to the end of the partition is computed anew for each row
    for i, o in ((0, F.asc(order)), (1, F.desc(order))):
        near = F.last(here, ignorenulls=True).over(w.orderBy(o).rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("_n", near).withColumns({f"_v{i}": F.col("_n.v"), f"_p{i}": F.col("_n.p")}).drop("_n")
    return df


def _linear(x: str) -> Column:
    span = F.col("_p1") - F.col("_p0")
    return F.when(span == 0, F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(x) - F.col("_p0")) / span)


def fill_limited(df: DataFrame, step_s: int, limit: int | None, column: str = "value", keys: Keys = LONG, ts: str = "timestamp", chunk_s: float = CHUNK_S) -> DataFrame:
    """A regular grid's gaps filled linearly in time, at most limit rows after each value; after the last value it is held as long."""
    df = neighbours(df.withColumn("_us", micros(df, ts)), column, keys, "_us", "_us", chunk_s)
    after = (F.col("_us") - F.col("_p0")) / F.lit(int(step_s) * 1_000_000)
    value = F.when(F.col("_p1").isNull(), F.col("_v0")).otherwise(_linear("_us"))
    if limit is not None:
        value = F.when(after <= limit, value)
    return df.withColumn(column, F.when(F.col("_p0").isNotNull(), value)).drop("_us", "_v0", "_v1", "_p0", "_p1")


def filled_means(df: DataFrame, step_s: int, target_s: int, limit: int | None, column: str = "value", keys: Keys = LONG, ts: str = "timestamp", chunk_s: float = CHUNK_S, least: int = 0) -> DataFrame:
    """Means at target_s of ``fill_limited`` over ``resample_first``, without laying out the grid. Keys of fewer than least values are left out.

    From one bin with a value to the next the filled grid is a straight line, so its ends give what it adds to a target step: a row for each
    such stretch and target step takes the place of one for each bin. A null key's values don't count, as in ``resample_first``.
    """
    step, target = int(step_s) * 1_000_000, int(target_s) * 1_000_000
    has = F.col("_v").isNotNull() & ~unnamed(keys)
    bins = _binned(df, step_s, ts).groupBy(*keys, "_bin").agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col("_us"))).cast("double").alias("_v"), F.count(column).alias("_n"))
    span = bins.groupBy(*keys).agg(F.min("_bin").alias("_a"), F.max("_bin").alias("_b"), F.min(F.when(has, F.col("_bin"))).alias("_first"), F.sum("_n").alias("_n")).where(F.col("_n") >= least)
    here = F.struct(F.col("_v").alias("v"), F.col("_bin").alias("p"))
    ends = segmented(
        bins.where(has).drop("_n"), keys, ("_bin",), chunk_s,
        lambda d, w: d.withColumn("_next", F.lead(here).over(w)),
        {"_f": F.min_by(here, "_bin")},
        lambda d, w: d.withColumn("_later", F.lead("_f").over(w)).drop("_f"),
    )
    after = F.coalesce("_next", "_later")
    ends = ends.select(*keys, F.col("_bin").alias("_from"), "_v", after["v"].alias("_v1"), after["p"].alias("_p1")).join(span.select(*keys, "_b"), [*keys])
    ends = ends.withColumn("_to", F.coalesce(F.col("_p1") - step, F.col("_b"))).drop("_b")
    none = F.lit(None).cast("double")
    before = span.where(F.col("_first").isNull() | (F.col("_first") > F.col("_a"))).select(*keys, F.col("_a").alias("_from"), none.alias("_v"), none.alias("_v1"), F.lit(None).cast("long").alias("_p1"), F.coalesce(F.col("_first") - step, F.col("_b")).alias("_to"))
    parts = ends.unionByName(before)
    inside = lambda us: F.col(us) - F.pmod(F.col(us), F.lit(target))
    parts = parts.withColumn("_t", F.explode(F.sequence(inside("_from"), inside("_to"), F.lit(target))))
    # first bin from a time on; the target's step need not be a whole number of bins
    bin_from = lambda us: us + F.pmod(-us, F.lit(step))
    parts = parts.withColumns({"_lo": F.greatest("_from", bin_from(F.col("_t"))), "_hi": F.least("_to", bin_from(F.col("_t") + target) - step)}).where("_lo <= _hi")
    held = F.col("_hi") if limit is None else F.least("_hi", F.col("_from") + limit * step)
    parts = parts.withColumn("_k", F.when(F.col("_v").isNotNull(), F.greatest((held - F.col("_lo")) / F.lit(step) + 1, F.lit(0.0))).otherwise(0.0))
    # the middle of the line's bins, from the first of them
    past = F.col("_lo") - F.col("_from") + (F.col("_k") - 1) * F.lit(step / 2)
    value = F.when(F.col("_p1").isNull() | (past == 0), F.col("_v")).otherwise(F.col("_v") + (F.col("_v1") - F.col("_v")) * past / (F.col("_p1") - F.col("_from")))
    out = parts.groupBy(*keys, "_t").agg(F.sum(F.when(F.col("_k") > 0, F.col("_k") * value)).alias("_s"), F.sum("_k").alias("_k"))
    return out.select(*keys, from_micros(df, ts, F.col("_t")).alias(ts), F.when(F.col("_k") > 0, F.col("_s") / F.col("_k")).alias(column))


def interpolate_time(df: DataFrame, step_s: int, target_s: int, limit: int | None, column: str = "value", keys: Keys = LONG, ts: str = "timestamp", as_integer: bool = False, chunk_s: float = CHUNK_S) -> DataFrame:
    """First values at step_s, gaps filled up to limit rows, means at target_s. Series of two values or fewer are left out.

    as_integer restores whole numbers, halves to even.
    """
    out = filled_means(df, step_s, target_s, limit, column, keys, ts, chunk_s, least=3)
    return out.withColumn(column, F.rint(column).cast("long")) if as_integer else out


def fill_text(df: DataFrame, step_s: int, target_s: int, limit: int, column: str, keys: Keys = LONG, ts: str = "timestamp") -> DataFrame:
    """Texts: first at step_s, held for limit rows, first at target_s."""
    df = resample_first(df, step_s, column, keys, ts)
    df = neighbours(df.withColumn("_us", micros(df, ts)), column, keys, "_us", "_us")
    held = F.when((F.col("_us") - F.col("_p0")) <= limit * int(step_s) * 1_000_000, F.col("_v0"))
    df = df.withColumn(column, held).drop("_us", "_v0", "_v1", "_p0", "_p1")
    return resample_first(df, target_s, column, keys, ts)


def interpolate_gap_limit(df: DataFrame, sources: list[str], targets: list[str], max_rows: int, keys: Keys = ("id",), ts: str = "timestamp", compat: bool = False) -> DataFrame:
    """Gaps (rows where a source is missing) of up to max_rows rows are filled linearly by row number in the targets; longer ones not at all.

    compat also hides the targets of the last valid row before a gap that is too long.
    """
    from hearthline.operators.mask import all_present

    w = Window.partitionBy(*keys).orderBy(ts)
    df = df.withColumns({"_i": F.row_number().over(w).cast("long"), "_ok": all_present(sources)})
    df = df.withColumn("_g", F.sum(F.col("_ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.count_if(~F.col("_ok")).over(Window.partitionBy(*keys, "_g"))
    df = df.withColumn("_gap", gap)
    for c in targets:
        df = _neighbours(df, c, keys, "_i")
        value = F.when(F.col(c).isNotNull(), F.col(c)).when(~F.col("_ok") & (F.col("_gap") <= max_rows) & F.col("_p0").isNotNull() & F.col("_p1").isNotNull(), _linear("_i"))
        if compat:
            value = F.when(~(F.col("_ok") & (F.col("_gap") > max_rows)), value)
        df = df.withColumn(c, value).drop("_v0", "_v1", "_p0", "_p1")
    return df.drop("_i", "_ok", "_g", "_gap")


def sample_intervals(df: DataFrame, target_min: int, limit_min: int = 60, keys: Keys = LONG, ts: str = "timestamp", column: str = "value") -> DataFrame:
    """By series: modal interval in whole minutes (halves to even, smallest of equals), upsample step and fill limit.

    The step is the greatest common divisor of the modal interval and the target. Series of two values or fewer are only
    marked as ignored.
    """
    gap = F.rint(seconds_between(F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts)), F.col(ts)) / 60).cast("long")
    df = df.where(F.col(column).isNotNull()).withColumn("_gap", gap)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.mode("_gap", True).alias("_mode"))
    mode = F.when(F.col("n") > 2, F.col("_mode"))
    divisors = F.filter(F.sequence(F.lit(1), F.lit(target_min)), lambda d: (F.lit(target_min) % d == 0) & (F.col("modal_interval__min") % d == 0))
    out = out.withColumn("modal_interval__min", mode).withColumn("upsample__min", F.when(F.col("modal_interval__min").isNotNull(), F.array_max(divisors).cast("long")))
    limit = F.greatest(F.floor(F.lit(limit_min) / F.col("upsample__min")) - 1, F.lit(1)).cast("long")
    return out.withColumns({"limit": F.when(F.col("upsample__min").isNotNull(), limit), "note": F.when(F.col("n") <= 2, "Ignoring")}).drop("_mode")


def weather_resample(df: DataFrame, columns: dict[str, float], target_s: int, keys: Keys = ("id",), ts: str = "timestamp") -> DataFrame:
    """Hourly weather to target_s: first at 15 minutes, linear without limit, mean; columns gives a factor for each, and negative values become 0 where it isn't 1."""
    cells = F.array(*(F.struct(F.lit(c).alias("property"), (F.col(c) * f).cast("double").alias("value")) for c, f in columns.items()))
    long = df.select(*keys, ts, F.explode(cells).alias("_c")).select(*keys, ts, "_c.property", "_c.value")
    long = interpolate_time(long, 900, target_s, None, keys=(*keys, "property"), ts=ts)
    out = long.groupBy(*keys, ts).pivot("property", [*columns]).agg(F.first("value"))
    return out.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c, f in columns.items() if f != 1})
