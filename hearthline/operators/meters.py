"""Cumulative meters: repair, timestamps in telegrams, and average power."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hearthline.functions.time import from_micros, seconds_between, with_instants
from hearthline.functions.units import joules_per_unit, power_name
from hearthline.operators.grid import fill_limited, resample_first
from hearthline.operators.mask import filter_min_max, filter_static_outliers
from hearthline.operators.scan import CHUNK_S, before, behind, segmented, up_to

Keys = tuple[str, ...]


def cumulative_to_power(df: DataFrame, keys: Keys = ("id",), ts: str = "timestamp") -> DataFrame:
    """Each cumulative energy or gas column becomes the average power since the row before; negative or unknown steps give null."""
    w = Window.partitionBy(*keys).orderBy(ts)
    step = seconds_between(F.lag(ts).over(w), F.col(ts))
    new, old = {}, []
    for c in df.columns:
        if power_name(c):
            p = (F.col(c) - F.lag(c).over(w)) * F.lit(joules_per_unit(c)) / step
            new[power_name(c)] = F.when(p >= 0, p)
            old.append(c)
    return df.withColumns(new).drop(*old)


def meter_reading_repair(df: DataFrame, column: str = "value", keys: Keys = ("id", "property"), ts: str = "timestamp", tie: Keys = (), chunk_s: float = CHUNK_S) -> DataFrame:
    """Readings that fall below the one before go, with the first one; what still falls is a change of meter and adds nothing.

    The column becomes the sum of the steps since the first reading that is left. Series are scanned by chunks of chunk_s seconds: whether a
    chunk's first reading stays hangs on the chunk before, so its step, and the step from it to the next one left, are taken from the summaries.
    """
    order, v = (ts, *tie), F.col(column).cast("double")
    rise = lambda a, b: F.coalesce(F.greatest(b - a, F.lit(0.0)), F.lit(0.0))

    def local(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns({"_at": F.row_number().over(w), "_left": F.coalesce(v - F.lag(v).over(w) >= 0, F.lit(False))})
        # the last one left before each row, the chunk's first reading aside
        d = d.withColumn("_was", F.last(F.when(F.col("_left"), v), ignorenulls=True).over(before(w)))
        d = d.withColumn("_step", F.when(F.col("_left"), rise(F.col("_was"), v)).otherwise(F.lit(0.0)))
        return d.withColumn("_own", F.sum("_step").over(up_to(w)))

    def carried(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_stays", F.coalesce(F.col("_first.v") >= F.lag("_final").over(w)["v"], F.lit(False)))
        d = d.withColumn("_second", F.when(F.col("_stays") & F.col("_next").isNotNull(), rise(F.col("_first.v"), F.col("_next"))).otherwise(F.lit(0.0)))
        head, tail = F.when(F.col("_stays"), F.col("_first.v")).otherwise(F.col("_next")), F.coalesce("_end", F.when(F.col("_stays"), F.col("_first.v")))
        d = d.withColumns({"_tail": tail, "_head": head}).withColumn("_cross", rise(F.last("_tail", ignorenulls=True).over(before(w)), F.col("_head")))
        return d.withColumn("_base", F.coalesce(F.sum(F.col("_sum") + F.col("_second") + F.col("_cross")).over(before(w)), F.lit(0.0)) + F.col("_cross")).drop("_first", "_final", "_next", "_end", "_sum", "_tail", "_head", "_cross")

    row, left = F.struct(v.alias("v")), F.when(F.col("_left"), behind(order))
    summary = {"_first": F.min_by(row, behind(order)), "_final": F.max_by(row, behind(order)), "_next": F.min_by(v, left), "_end": F.max_by(v, left), "_sum": F.sum("_step")}
    out = segmented(df, keys, order, chunk_s, local, summary, carried).where(F.col("_left") | ((F.col("_at") == 1) & F.coalesce("_stays", F.lit(False))))
    second = F.when(F.col("_at") > 1, F.col("_second")).otherwise(F.lit(0.0))
    return out.withColumn(column, F.col("_own") + F.coalesce(F.col("_base") + second, F.lit(0.0))).drop("_at", "_left", "_was", "_step", "_own", "_stays", "_second", "_base")


def meter_use(df: DataFrame, step_s: int, limit: int, column: str = "value", keys: Keys = ("id", "property"), ts: str = "timestamp", tie: Keys = ()) -> DataFrame:
    """Repaired readings on a grid, filled up to limit rows, as use per step."""
    grid = fill_limited(resample_first(meter_reading_repair(df, column, keys, ts, tie), step_s, column, keys, ts), step_s, limit, column, keys, ts)
    return grid.withColumn(column, F.lead(column).over(Window.partitionBy(*keys).orderBy(ts)) - F.col(column))


def _telegram_parts(c: Column) -> tuple[Column, Column]:
    """The clock's reading, null if malformed, and its sign."""
    plain = F.when(c.rlike(r"^\d{12}[WS]?$"), F.try_to_timestamp(F.concat(F.lit("20"), F.substring(c, 1, 12)), F.lit("yyyyMMddHHmmss")))
    return plain, F.substring(c, 13, 1)


def telegram_time(c: str | Column, zone: str = "Europe/Amsterdam") -> Column:
    """The UTC time of YYMMDDhhmmss with S (summer, +2 h) or W (winter, +1 h), or without either in local time; null if malformed.

    A local time that comes twice is the first of both; ``meter_timestamp_parse`` tells them by order.
    """
    plain, sign = _telegram_parts(F.col(c) if isinstance(c, str) else c)
    hours = lambda h: F.timestamp_add("HOUR", F.lit(-h), plain)
    return F.when(sign == "S", hours(2)).when(sign == "W", hours(1)).otherwise(F.to_utc_timestamp(plain, zone))


def meter_timestamp_parse(df: DataFrame, telegram: str, limit: int = 2, keys: Keys = ("id",), ts: str = "timestamp", zone: str = "Europe/Amsterdam") -> DataFrame:
    """Row times from the meter's own clock; up to limit missing ones in a row are interpolated, others go, and so do equal times of a key.

    Telegrams without a sign are in local time; in the hour that comes twice those after a fall of the clock, in the rows' order, are in its second pass.
    """
    plain, sign = _telegram_parts(F.col(telegram))
    df = with_instants(df.withColumn("_local", F.when(sign == "", plain)), "_local", [*keys], [ts], zone, "_told").drop("_local")
    w = Window.partitionBy(*keys).orderBy(ts)
    us = F.unix_micros(F.coalesce(F.col("_told"), telegram_time(telegram, zone))).cast("double")
    df = df.withColumns({"_i": F.row_number().over(w).cast("long"), "_u": us}).drop("_told")
    back, ahead = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_i"), F.desc("_i")))
    known = lambda x: F.when(F.col("_u").isNotNull(), F.col(x))
    df = df.withColumns({f"_{x}0": F.last(known(c), ignorenulls=True).over(back) for x, c in (("u", "_u"), ("i", "_i"))} | {f"_{x}1": F.last(known(c), ignorenulls=True).over(ahead) for x, c in (("u", "_u"), ("i", "_i"))})
    after = F.col("_i") - F.col("_i0")
    between = F.col("_u0") + (F.col("_u1") - F.col("_u0")) * after / (F.col("_i1") - F.col("_i0"))
    time = F.coalesce("_u", F.when(after <= limit, F.coalesce(between, F.col("_u0"))))
    df = df.withColumn("_t", F.round(time).cast("long")).where("_t is not null")
    first = F.row_number().over(Window.partitionBy(*keys, "_t").orderBy("_i"))
    df = df.withColumn("_n", first).where("_n = 1")
    return df.withColumn(ts, from_micros(df, ts, F.col("_t"))).drop("_i", "_u", "_u0", "_u1", "_i0", "_i1", "_t", "_n")


def property_preprocess(df: DataFrame, step_s: int, target_s: int, limit: int, low=None, high=None, n_sigma: float | None = None, cumulative: bool = False, column: str = "value", keys: Keys = ("id", "property"), ts: str = "timestamp", tie: Keys = ()) -> DataFrame:
    """The whole way of one property: meter repair, range, outliers, grid, filling, mean per target step (use per step for meters)."""
    from hearthline.operators.grid import interpolate_time

    if cumulative:
        return meter_use(df, target_s, limit, column, keys, ts, tie)
    df = filter_min_max(df, column, low, high)
    if n_sigma is not None:
        df = df.withColumn("_k", F.concat_ws("|", *keys))
        df = filter_static_outliers(df, column, n_sigma, id_col="_k").drop("_k")
    return interpolate_time(df, step_s, target_s, limit, column, keys, ts)


def home_dataset(df: DataFrame, properties: dict[str, dict], step_s: int, weather: DataFrame | None = None, powers: dict[str, tuple[list[str], float]] | None = None, ts: str = "timestamp") -> DataFrame:
    """Wide rows of all homes: each property prepared by its own options, weather joined by time, and uses as mean powers.

    powers names columns of power in W by the use columns that they are the sum of and the J in one unit; these go. A use
    is spread over the seconds to the home's next row; the last row has no power.
    """
    parts = [property_preprocess(df.where(F.col("property") == p), step_s, step_s, keys=("id", "property"), ts=ts, **options) for p, options in properties.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    out = long.groupBy("id", ts).pivot("property", [*properties]).agg(F.first("value"))
    out = out if weather is None else out.join(weather, ts)
    if not powers:
        return out
    from hearthline.operators.islands import interval_seconds

    out = interval_seconds(out, ("id",), ts)
    known = F.when(F.col("interval__s") > 0, F.col("interval__s"))
    total = lambda columns: reduce(lambda a, b: a + b, map(F.col, columns))
    out = out.withColumns({name: total(columns) * F.lit(float(unit)) / known for name, (columns, unit) in powers.items()})
    return out.drop(*{c for columns, _ in powers.values() for c in columns})


def room_dataset(rooms: DataFrame, columns: list[str], sources: list[str] | None = None, weather: DataFrame | None = None, ts: str = "timestamp") -> DataFrame:
    """Prepared room values with a column for each source and property, <source>_<property>, and weather joined by time."""
    from hearthline.operators.pivot import unstack_source

    out = unstack_source(rooms, columns, sources, ("id", ts), F.col("source_type"))
    return out if weather is None else out.join(weather, ts)


def room_preprocess(df: DataFrame, co2: str, target_s: int, limit_s: int = 5400, outside_ppm: float = 415.0, margin: float = 1.0, keys: Keys = ("id", "source_type"), ts: str = "timestamp") -> DataFrame:
    """Room sensors: CO2 under 5 and constant sensors are hidden, the base line is set, and 15-minute values interpolated to target_s."""
    from hearthline.operators.calibrate import co2_baseline_adjust
    from hearthline.operators.grid import interpolate_time

    df = df.withColumn("_k", F.concat_ws("|", *keys))
    df = filter_min_max(df, co2, low=5)
    flat = F.stddev_samp(co2).over(Window.partitionBy("_k")) == 0
    df = df.withColumn("_f", flat).withColumn(co2, F.when(~F.coalesce("_f", F.lit(False)), F.col(co2))).drop("_f", "_k")
    df = co2_baseline_adjust(df, co2, outside_ppm, margin, keys)
    return interpolate_time(df, 900, target_s, max(limit_s // 900 - 1, 1), co2, keys, ts)
