"""Filters and masks. A mask hides a value by null and keeps its row; comparisons with null hide nothing."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.sources.io import kept

_OPS = {
    "=": lambda c, v: c == v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "<>": lambda c, v: c != v,
}


def _has(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing[0]!r}")


def compare(c: str | Column, op: str, value) -> Column:
    return _OPS[op](F.col(c) if isinstance(c, str) else c, value)


def filter_value_op(df: DataFrame, column: str, op: str, value) -> DataFrame:
    return df.where(compare(column, op, value))


def filter_between(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def filter_in(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(values)) if values else df.where(F.lit(False))


def filter_period(df: DataFrame, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """Rows from start to end, both included; None is open."""
    for bound, keep in ((start, lambda b: F.col(ts) >= b), (end, lambda b: F.col(ts) <= b)):
        df = df if bound is None else df.where(keep(bound))
    return df


def filter_half_open_period(df: DataFrame, start, end, ts: str = "timestamp") -> DataFrame:
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def select_measurements(df: DataFrame, ids=None, categories=None, types=None, units=None, properties=None) -> DataFrame:
    """Long rows of the given ids, sources, units and properties; text properties are left out and values become doubles."""
    for column, values in (("id", ids), ("source_category", categories), ("source_type", types), ("property", properties)):
        df = df if values is None else df.where(F.col(column).isin(list(values)))
    if units is not None:
        df = df.where(reduce(lambda a, b: a | b, (F.endswith("property", F.lit(f"__{u}")) for u in units), F.lit(False)))
    return df.where(~F.endswith("property", F.lit("__str"))).withColumn("value", F.col("value").cast("string").try_cast("double"))


def filter_min_max(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Values below low or above high become null."""
    _has(df, column)
    out = F.lit(False)
    for bound, outside in ((low, lambda b: F.col(column) < b), (high, lambda b: F.col(column) > b)):
        out = out if bound is None else out | outside(bound)
    return df.withColumn(column, F.when(out, F.lit(None)).otherwise(F.col(column)))


def filter_static_outliers(df: DataFrame, column: str, n_sigma: float = 3, per_id: bool = True, id_col: str = "id") -> DataFrame:
    """Null where the distance to the mean is over n_sigma population deviations; constant values stay."""
    _has(df, column)
    if per_id:
        w = Window.partitionBy(id_col)
        df2 = df.withColumns({"_m": F.avg(column).over(w), "_s": F.stddev_pop(column).over(w)})
    else:
        df2 = df.crossJoin(F.broadcast(df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))))  # one row
    far = (F.col("_s") > 0) & (F.abs(F.col(column) - F.col("_m")) / F.col("_s") > n_sigma)
    return df2.withColumn(column, F.when(far, F.lit(None)).otherwise(F.col(column))).drop("_m", "_s")


def remove_measurement_outliers(df: DataFrame, column: str, n_sigma: float = 3) -> DataFrame:
    """Null where the distance to the overall mean is over n_sigma sample deviations."""
    about = F.broadcast(df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s")))  # one row
    far = (F.col("_s") > 0) & (F.abs(F.col(column) - F.col("_m")) > n_sigma * F.col("_s"))
    return df.crossJoin(about).withColumn(column, F.when(far, F.lit(None)).otherwise(F.col(column))).drop("_m", "_s")


def remove_weather_outliers(df: DataFrame, columns: list[str], n_sigma: float = 3) -> DataFrame:
    """Column by column: rows far from the mean (sample deviation) lose all their values, before the next column is looked at.

    Between columns the rows are written, so that no column's means read the whole chain again.
    """
    for i, c in enumerate(columns):
        if i:
            df = kept(df, "weather-outliers")
        about = F.broadcast(df.agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s")))  # one row
        far = F.coalesce((F.col("_s") > 0) & (F.abs(F.col(c) - F.col("_m")) > n_sigma * F.col("_s")), F.lit(False))
        df = df.crossJoin(about).withColumn("_far", far)
        df = df.withColumns({k: F.when(~F.col("_far"), F.col(k)) for k in columns}).drop("_m", "_s", "_far")
    return df


def filter_std_zero(df: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    """Null for ids whose values don't vary; an id with a single value keeps it."""
    _has(df, column)
    flat = F.stddev_samp(column).over(Window.partitionBy(id_col)) == 0
    return df.withColumn("_flat", flat).withColumn(column, F.when(F.col("_flat"), F.lit(None)).otherwise(F.col(column))).drop("_flat")


def filter_std_zero_per_source(df: DataFrame, column: str, values: list[str], keys: tuple[str, ...] = ("id", "source_type")) -> DataFrame:
    """All values of the rows of an (id, source) whose column doesn't vary become null."""
    flat = F.coalesce(F.stddev_samp(column).over(Window.partitionBy(*keys)) == 0, F.lit(False))
    return df.withColumn("_flat", flat).withColumns({c: F.when(~F.col("_flat"), F.col(c)) for c in values}).drop("_flat")


def filter_electricity_meters(df: DataFrame, use: list[str], ret: list[str], version: str, least: float, id_col: str = "id") -> DataFrame:
    """Hides meter readings that can't be right.

    Uses below least or from meters before version 3 go (all uses of the row for either reason); returns stay if they
    reach least, or are 0 at an id none of whose return columns ever reaches it.
    """
    low_use = reduce(lambda a, b: a | b, (F.coalesce(F.col(c) < least, F.lit(False)) for c in use))
    old = F.coalesce(F.col(version) < 3, F.lit(False))
    w = Window.partitionBy(id_col)
    none_back = reduce(and_, (F.coalesce(F.max(c).over(w) < least, F.lit(True)) for c in ret))
    df = df.withColumns({"_bad_use": low_use | old, "_old": old, "_none": none_back})
    df = df.withColumns({c: F.when(~F.col("_bad_use"), F.col(c)) for c in use})
    df = df.withColumns({c: F.when(~F.col("_old") & ((F.col(c) >= least) | ((F.col(c) == 0) & F.col("_none"))), F.col(c)) for c in ret})
    return df.drop("_bad_use", "_old", "_none")


filter_electricity_meters_fast = filter_electricity_meters


def occupancy_validity_filter(df: DataFrame, homes: DataFrame, occupancy: str, onboarded: str, size: str, id_col: str = "id") -> DataFrame:
    """Occupancy becomes null until the whole household is on board; unknown household sizes leave it."""
    df = df.join(homes.select(id_col, size), id_col, "left")
    short = F.col(size).isNotNull() & (F.col(onboarded).isNull() | (F.col(onboarded) < F.col(size)))
    return df.withColumn(occupancy, F.when(~short, F.col(occupancy))).drop(onboarded, size)


def drop_ids_single_source(df: DataFrame, sources: tuple[str, ...], source_col: str = "source_category", id_col: str = "id") -> DataFrame:
    """Only ids that have rows of at least one of the sources."""
    keep = df.groupBy(id_col).agg(F.count_if(F.col(source_col).isin(list(sources))).alias("_n")).where("_n > 0")
    return df.join(keep.select(id_col), id_col, "left_semi")


def all_present(columns: list[str]) -> Column:
    """Whether every column has a value; true for none."""
    return reduce(and_, (F.col(c).isNotNull() for c in columns), F.lit(True))


def mask_all_required(df: DataFrame, columns: list[str] | None = None, flag: str = "sane") -> DataFrame:
    return df.withColumn(flag, all_present(df.columns if columns is None else columns))


def burning(flag: str, valve: str) -> Column:
    """The burner serves this purpose and the gas valve is open."""
    return F.coalesce(F.col(flag) & F.col(valve), F.lit(False))


def rename_values(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Values by the table; others stay."""
    return df.replace(names, subset=[column])


def rekey(df: DataFrame, table: DataFrame, id_col: str, new: str) -> DataFrame:
    """The id by the table (id_col, new); rows without one go."""
    return df.join(table.select(id_col, new), id_col).drop(id_col).withColumnRenamed(new, id_col)


def return_fill_zero(df: DataFrame, ret: list[str], use: list[str]) -> DataFrame:
    """Missing return power is 0 where all uses are known."""
    known = all_present(use)
    return df.withColumns({c: F.when(F.col(c).isNull() & known, F.lit(0.0)).otherwise(F.col(c)) for c in ret})


def combine_meters(df: DataFrame, hi_use: str, lo_use: str, hi_ret: str, lo_ret: str) -> DataFrame:
    """use, ret and net power; null if a part is."""
    df = df.withColumns({"e_use__W": F.col(hi_use) + F.col(lo_use), "e_ret__W": F.col(hi_ret) + F.col(lo_ret)})
    return df.withColumn("e_net__W", F.col("e_use__W") - F.col("e_ret__W"))


def cast_by_property_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns to the types of the table; 'boolean' takes 'True' and 'False' alone; what doesn't fit is null."""
    return df.withColumns({c: F.when(F.col(c) == "True", True).when(F.col(c) == "False", False) if t == "boolean" else F.col(c).try_cast(t) for c, t in types.items()})


def normalize_number_strings(df: DataFrame, column: str = "value") -> DataFrame:
    """Without a trailing point and zeros."""
    return df.withColumn(column, F.regexp_replace(column, r"\.0+$", ""))


def clip_column(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    from hearthline.functions.physics import clip

    return df.withColumn(column, clip(column, low, high))
