"""Counts, coverage, summaries and error metrics. All are grouped aggregates of one pass unless they say otherwise.

Medians and quartiles are exact and take groups of any size (see ``order_stats``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.physics import quotient
from hearthline.functions.time import seconds_between
from hearthline.operators.mask import all_present
from hearthline.operators.order_stats import joined, quantiles, quantiles_from


def count_total(parts: list[DataFrame]) -> DataFrame:
    """One row with the number of rows of all parts together."""
    counts = [p.agg(F.count("*").alias("n")) for p in parts]
    return reduce(lambda a, b: a.union(b), counts).agg(F.sum("n").alias("n_measurements"))


def min_max_time(df: DataFrame, keys: list[str], ts: str = "timestamp") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


def size_per_group(df: DataFrame, keys: list[str], pivot: str | None = None, values: list | None = None) -> DataFrame:
    grouped = df.groupBy(*keys)
    return grouped.agg(F.count("*").alias("n")) if pivot is None else grouped.pivot(pivot, values).agg(F.count(F.lit(1))).fillna(0)


def describe_per_group(df: DataFrame, keys: list[str], column: str, large: int | None = None) -> DataFrame:
    """count, mean, std (sample), min, quartiles (exact, linear) and max; large: see ``order_stats``."""
    c = F.col(column)
    out = df.groupBy(*keys).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    out = joined(out, quantiles(df, keys, column, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, large), keys)
    return out.select(*keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def variance_per_id(df: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.var_samp(column).alias("variance"))


def count_non_null(df: DataFrame, columns: list[str], keys: list[str] | None = None, total: str | None = "total") -> DataFrame:
    """Values by key and column, and their sum."""
    out = df.groupBy(*(keys or ["id"])).agg(*(F.count(c).alias(c) for c in columns))
    return out.withColumn(total, reduce(lambda a, b: a + b, (F.col(c) for c in columns))) if total else out


def covered_time(df: DataFrame, columns: list[str], max_interval_s: float = 5400.0, mandatory: list[str] | None = None, keys: list[str] | None = None, ts: str = "timestamp") -> DataFrame:
    """Seconds by key and column: the gaps between neighbouring values that are no longer than max_interval_s.

    With mandatory columns, all_mandatory_props counts the rows that have them all. total sums all of these.
    """
    keys = keys or ["id"]
    if mandatory:
        df, columns = df.withColumn("all_mandatory_props", F.when(all_present(mandatory), F.lit(1.0))), [*columns, "all_mandatory_props"]
    # one row a value: each series is then a window of its own
    long = df.select(*keys, ts, F.explode(F.array(*(F.struct(F.lit(c).alias("p"), F.col(c).isNotNull().alias("v")) for c in columns))).alias("_c")).where("_c.v")
    long = long.select(*keys, ts, F.col("_c.p").alias("_p"))
    gap = seconds_between(F.lag(ts).over(Window.partitionBy(*keys, "_p").orderBy(ts)), F.col(ts))
    out = long.withColumn("_g", gap).groupBy(*keys).agg(*(F.coalesce(F.sum(F.when((F.col("_p") == c) & (F.col("_g") <= max_interval_s), F.col("_g"))), F.lit(0.0)).alias(c) for c in columns))
    return out.withColumn("total", reduce(lambda a, b: a + b, (F.col(c) for c in columns)))


def boolean_summary(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """For each boolean column: true, false and missing values, and their percentages with two decimals."""
    keys = keys or []
    cells = F.array(*(F.struct(F.lit(c).alias("property"), F.col(c).alias("v")) for c in columns))
    long = df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.property", "c.v")
    out = long.groupBy(*keys, "property").agg(F.count_if("v").alias("n_true"), F.count_if(~F.col("v")).alias("n_false"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.count("*").alias("_n"))
    return out.withColumns({f"pct_{x}": F.round(100 * F.col(f"n_{x}") / F.col("_n"), 2) for x in ("true", "false", "missing")}).drop("_n")


def bool_share(df: DataFrame, condition: Column, keys: list[str] | None = None, name: str = "share") -> DataFrame:
    """Share of rows where the condition holds, of those where it is known."""
    return df.groupBy(*(keys or [])).agg(F.avg(condition.cast("double")).alias(name))


def collect_ids_by_value(df: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """The sorted ids of each value; the lists grow with the number of ids, which are homes."""
    return df.groupBy(value).agg(F.sort_array(F.collect_set(id_col)).alias("ids"))


def mean_std_by(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))


def two_level_ratio(df: DataFrame, id_col: str, group: str, above: str, below: str) -> DataFrame:
    """Means by id, then by group: sum, mean and count of the means, and the ratio of the sums."""
    per = df.groupBy(id_col).agg(F.min(group).alias(group), F.avg(above).alias(above), F.avg(below).alias(below))
    out = per.groupBy(group).agg(F.sum(above).alias("_a"), F.sum(below).alias("_b"), F.avg(quotient(above, below)).alias("mean_ratio"), F.count("*").alias("n"))
    return out.select(group, "mean_ratio", "n", quotient("_a", "_b").alias("ratio_of_sums"))


def ratio_of_means(df: DataFrame, keys: list[str], above: str, below: str, name: str = "ratio") -> DataFrame:
    """Mean over mean of the rows that have both; infinite (or not a number) over a mean of zero."""
    both = F.col(above).isNotNull() & F.col(below).isNotNull()
    return df.where(both).groupBy(*keys).agg(quotient(F.avg(above), F.avg(below)).alias(name))


def method_comparison(df: DataFrame, base: str, methods: list[str], energy: str) -> DataFrame:
    """By method: mean difference to the base, and the sum of absolute differences over that of the energy."""
    cells = F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("v")) for m in methods))
    long = df.select(F.col(base).alias("_b"), F.col(energy).alias("_e"), F.explode(cells).alias("c")).select("_b", "_e", "c.method", "c.v")
    return long.groupBy("method").agg(F.avg(F.col("v") - F.col("_b")).alias("mean_difference"), quotient(F.sum(F.abs(F.col("v") - F.col("_b"))), F.sum("_e")).alias("relative_difference"))


def mae(a: str, b: str) -> Column:
    return F.avg(F.abs(F.col(a) - F.col(b)))


def rmse(a: str, b: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2)))


def rmae(df: DataFrame, a: str, b: str, window: int, keys: list[str], ts: str = "timestamp") -> DataFrame:
    """By key the mean absolute difference of the rolling means of full windows of some rows."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(1 - window, 0)
    df = df.withColumns({"_a": F.when(F.count(a).over(w) == window, F.avg(a).over(w)), "_b": F.when(F.count(b).over(w) == window, F.avg(b).over(w))})
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("rmae"))


def threshold_class(c: Column, low: float, high: float) -> Column:
    """green up to low, orange up to high, red from there on."""
    return F.when(c <= low, "green").when(c < high, "orange").when(c >= high, "red")


def error_stats(df: DataFrame, thresholds: dict[str, tuple[float, float]], keys: list[str] | None = None) -> DataFrame:
    """min, mean and max of error columns, and the class of the mean by the column's two thresholds."""
    keys = keys or []
    cells = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for c, (a, b) in thresholds.items()))
    long = df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    out = long.groupBy(*keys, "metric").agg(F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    level = F.when(F.col("mean") <= F.col("lo"), "green").when(F.col("mean") < F.col("hi"), "orange").when(F.col("mean") >= F.col("hi"), "red")
    return out.withColumn("level", level).drop("lo", "hi")


def period_means(df: DataFrame, jobs: DataFrame, columns: list[str], flags: list[str] = (), id_col: str = "id", ts: str = "timestamp") -> DataFrame:
    """Means over each job (end not included); flags count as false where they are missing."""
    from hearthline.operators.islands import job_rows

    rows = job_rows(df, jobs, id_col, ts)
    means = [F.avg(c).alias(f"avg_{c}") for c in columns] + [F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")).alias(f"avg_{c.removesuffix('__bool')}__0") for c in flags]
    return rows.groupBy(id_col, "start", "end").agg(*means)


def _medians(df: DataFrame, columns: list[str], keys: list[str], large: int | None) -> DataFrame:
    """The exact medians of several columns, for every group of df."""
    out = df.select(*keys).distinct()
    for c in columns:
        out = joined(out, quantiles(df, keys, c, {c: 0.5}, large), keys)
    return out


def median_learned(df: DataFrame, columns: list[str], duration: str, least: float, id_col: str = "id", large: int | None = None) -> DataFrame:
    return _medians(df.where(F.col(duration) >= least), columns, [id_col], large)


def median_when(df: DataFrame, column: str, flag: str, keys: list[str] | None = None, large: int | None = None) -> DataFrame:
    return _medians(df.where(F.col(flag)), [column], keys or ["id"], large)


def _level(weight: str, first: int, last: int, step: int) -> Column:
    """How many of the thresholds after the first a weight reaches; null where it reaches none."""
    return F.when(F.col(weight) >= first, F.floor((F.least(F.col(weight), F.lit(last)) - first) / step).cast("int"))


def weighted_stats_by_threshold(df: DataFrame, column: str, weight: str, first: int, last: int, step: int, keys: list[str] | None = None, large: int | None = None) -> DataFrame:
    """For thresholds from first to last: median, weighted mean and weighted deviation of the rows whose weight reaches them.

    Sums are taken by the highest threshold that a row reaches, and cumulated from above; medians see ``order_stats.quantiles_from``.
    """
    keys = keys or []
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_x"), F.col(weight).alias("_w"), _level(weight, first, last, step).alias("_level")).where("_level is not null")
    sums = rows.groupBy(*keys, "_level").agg(F.sum("_w").alias("_s"), F.sum(F.col("_w") * F.col("_x")).alias("_sx"), F.sum(F.col("_w") * F.col("_x") ** 2).alias("_sxx"))
    # a level that no row has as its highest is reached by those above
    every = sums.groupBy(*keys).agg(F.max("_level").alias("_most")).select(*keys, F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("_level"))
    sums = joined(every, sums, [*keys, "_level"])
    above = Window.partitionBy(*keys).orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({c: F.sum(c).over(above) for c in ("_s", "_sx", "_sxx")})
    out = joined(sums, quantiles_from(rows, keys, "_x", "_level", {"median": 0.5}, large), [*keys, "_level"])
    mean = F.col("_sx") / F.col("_s")
    return out.select(*keys, (F.col("_level") * step + first).alias("threshold"), "median", mean.alias("mean"), F.sqrt(F.greatest(F.col("_sxx") / F.col("_s") - mean * mean, F.lit(0.0))).alias("std"))


def quartiles_by_threshold(df: DataFrame, column: str, weight: str, first: int, last: int, step: int, keys: list[str], large: int | None = None) -> DataFrame:
    """For thresholds from first to last the quartiles of the rows whose weight reaches them; groups and thresholds without a value have no row."""
    rows = df.select(*keys, F.col(column).alias("_x"), _level(weight, first, last, step).alias("_level"))
    out = quantiles_from(rows, keys, "_x", "_level", {"q1": 0.25, "median": 0.5, "q3": 0.75}, large)
    return out.select(*keys, (F.col("_level") * step + first).alias("threshold"), "q1", "median", "q3")


def group_median_mean_std(df: DataFrame, keys: list[str], column: str, large: int | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    return joined(out, quantiles(df, keys, column, {"median": 0.5}, large), keys).select(*keys, "median", "mean", "std")


def flow_regression(df: DataFrame, y: str, x: str, delta: str, least_delta: float, keys: list[str] | None = None) -> DataFrame:
    """By key the line y ~ x over the rows whose delta is large enough: slope, intercept, value at 100, R2; null for single rows."""
    ok = (F.col(delta) >= least_delta) & F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.where(ok).groupBy(*(keys or ["id"])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))
    several = F.col("n") > 1
    out = out.withColumns({c: F.when(several, F.col(c)) for c in ("slope", "intercept", "r2")})
    return out.withColumn("at_100", F.col("intercept") + 100 * F.col("slope"))


def threshold_retention(df: DataFrame, keep: Column, id_col: str = "id") -> DataFrame:
    """One row: share of rows that stay, and the smallest share of an id with that id."""
    per = df.groupBy(id_col).agg(F.count_if(keep).alias("k"), F.count("*").alias("n"))
    worst = F.min(F.struct((F.col("k") / F.col("n")).alias("share"), F.col(id_col).alias("id")))
    return per.agg((F.sum("k") / F.sum("n")).alias("share"), worst.alias("w")).select("share", F.col("w.share").alias("smallest_share"), F.col("w.id").alias("smallest_id"))


def interval_summary(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """mean, std, min, max and mode (the smallest of equals)."""
    return df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), F.mode(column, True).alias("mode"))


def suspect_share(df: DataFrame, column: str, low: float, high: float, keys: list[str], places: DataFrame | None = None, cell: str = "cell") -> DataFrame:
    """Values out of range, all values, the fraction, and the number of ids that have any; with places (id, cell) also the sorted cells of these ids."""
    bad = (F.col(column) < low) | (F.col(column) > high)
    more = []
    if places is not None:
        df = df.join(places.select("id", F.col(cell).alias("_cell")), "id", "left")
        more = [F.array_sort(F.collect_set(F.when(bad, F.col("_cell")))).alias("cells")]
    out = df.groupBy(*keys).agg(F.count_if(bad).alias("n_suspect"), F.count(column).alias("n"), F.count_distinct(F.when(bad, F.col("id"))).alias("n_ids"), *more)
    return out.withColumn("fraction", F.col("n_suspect") / F.col("n"))


def lookup_ranges(df: DataFrame, model: str, x: str, y: str, value: str) -> DataFrame:
    """Ranges of both axes where a model has values."""
    return df.where(F.col(value).isNotNull()).groupBy(model).agg(F.min(x).alias(f"min_{x}"), F.max(x).alias(f"max_{x}"), F.min(y).alias(f"min_{y}"), F.max(y).alias(f"max_{y}"))


def lookup_means(df: DataFrame, model: str, y: str, value: str) -> DataFrame:
    """The mean of a model's values at each y, across all x."""
    return df.groupBy(model, y).agg(F.avg(value).alias(value))


def spread_ratios(df: DataFrame, column: str) -> DataFrame:
    lo, mid, hi = F.min(column), F.avg(column), F.max(column)
    return df.agg(quotient(hi, mid).alias("max_mean"), quotient(mid, lo).alias("mean_min"), quotient(hi, lo).alias("max_min"))


def availability(df: DataFrame, mandatory: list[str], id_col: str = "id", ts: str = "timestamp") -> DataFrame:
    """(timestamp, id, available) of all ids: whether all mandatory values are there, from the first to the last timestamp at which any id has them."""
    df = df.withColumn("_ok", all_present(mandatory))
    span = F.broadcast(df.where("_ok").agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")))  # one row
    rows = df.join(span, F.col(ts).between(F.col("_a"), F.col("_b")))
    return rows.groupBy(ts, id_col).agg(F.bool_or("_ok").alias("available"))


def availability_matrix(df: DataFrame, mandatory: list[str], ids: list, id_col: str = "id", ts: str = "timestamp") -> DataFrame:
    """By timestamp whether each id has all mandatory values, from the first to the last timestamp at which any id has."""
    df = df.withColumn("_ok", all_present(mandatory))
    span = F.broadcast(df.where("_ok").agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")))  # one row
    rows = df.join(span, F.col(ts).between(F.col("_a"), F.col("_b")))
    return rows.groupBy(ts).pivot(id_col, ids).agg(F.bool_or("_ok"))


def histogram_bins(df: DataFrame, column: str, n: int = 200, keys: list[str] | None = None, density: bool = False) -> DataFrame:
    """Counts of n bins of equal width from the least to the greatest value, which is in the last bin."""
    keys = keys or []
    df = df.where(F.col(column).isNotNull())
    span = df.agg(F.min(column).cast("double").alias("_a"), F.max(column).cast("double").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / n
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(column) - F.col("_a")) / width), F.lit(n - 1))).cast("int")
    out = df.crossJoin(F.broadcast(span)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"), F.first("_a").alias("_a"), F.first(width).alias("_w"))
    out = out.withColumns({"low": F.col("_a") + F.col("bin") * F.col("_w"), "high": F.col("_a") + (F.col("bin") + 1) * F.col("_w")})
    if density:
        out = out.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)) / F.col("_w"))
    return out.drop("_a", "_w")


def boxplot_stats(df: DataFrame, keys: list[str], column: str, large: int | None = None) -> DataFrame:
    """Quartiles (exact), the mean, and the ends of the whiskers (1.5 times the box)."""
    box = joined(df.groupBy(*keys).agg(F.avg(column).alias("mean")), quantiles(df, keys, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, large), keys)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = df.join(box.select(*keys, (F.col("q1") - reach).alias("_a"), (F.col("q3") + reach).alias("_b")), keys).where(F.col(column).between(F.col("_a"), F.col("_b")))
    ends = ends.groupBy(*keys).agg(F.min(column).alias("low_whisker"), F.max(column).alias("high_whisker"))
    return box.select(*keys, "q1", "median", "q3", "mean").join(ends, keys, "left")


def top_values(df: DataFrame, column: str, n: int = 10, mask: Column | None = None) -> DataFrame:
    """The most frequent values; the smaller value first among equals."""
    df = df if mask is None else df.where(mask)
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)
