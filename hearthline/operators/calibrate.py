"""Calibration of one kind of sensor by another, and of CO2 by its base line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.physics import quotient


def calibration_factors(df: DataFrame, column: str, a: str, b: str, least_rows: int, day: Column, source: str = "source_type", id_col: str = "id") -> DataFrame:
    """By id the means over days of the daily mean and sample deviation of two source types.

    Days count if each source has least_rows rows or more and both its mean and its deviation. Values that are all the same have none at all:
    the deviation of many such, summed up in parts, comes out of rounding.
    """
    deviation = F.when((F.min(column) == F.max(column)) & (F.count(column) > 1), F.lit(0.0)).otherwise(F.stddev_samp(column))
    daily = df.where(F.col(source).isin(a, b)).groupBy(id_col, day.alias("_day"), source).agg(F.avg(column).alias("m"), deviation.alias("s"), F.count("*").alias("n")).where(F.col("n") >= least_rows)
    both = daily.groupBy(id_col, "_day").agg(*(F.max(F.when(F.col(source) == x, F.col(v))).alias(f"{n}_{k}") for k, x in (("a", a), ("b", b)) for n, v in (("mean", "m"), ("std", "s")))).dropna()
    return both.groupBy(id_col).agg(*(F.avg(c).alias(c) for c in ("mean_a", "std_a", "mean_b", "std_b")))


def create_calibrated(df: DataFrame, factors: DataFrame, column: str, a: str, source: str = "source_type", id_col: str = "id") -> DataFrame:
    """df and, as source <a>_calibrated, the rows of source a moved and stretched to the other's mean and deviation; null without factors.

    A source without any deviation can't be stretched: its values come out infinite, or not a number at the mean itself.
    """
    rows = df.where(F.col(source) == a).join(factors, id_col, "left")
    value = quotient(F.col(column) - F.col("mean_a"), "std_a") * F.col("std_b") + F.col("mean_b")
    return df.unionByName(rows.withColumns({column: value, source: F.lit(f"{a}_calibrated")}).select(*df.columns))


def co2_baseline_adjust(df: DataFrame, column: str, outside_ppm: float, margin: float, keys: tuple[str, ...] = ("id", "source_type")) -> DataFrame:
    """Values shifted so that the least of each sensor is the outside level plus a margin; sensors without a value stay."""
    shift = F.lit(float(outside_ppm + margin)) - F.min(column).over(Window.partitionBy(*keys))
    return df.withColumn("_shift", shift).withColumn(column, F.col(column) + F.col("_shift")).drop("_shift")
