"""Comparison of regimes around changes: metrics of periods, and correction for unlike circumstances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def localize_per_row(df: DataFrame, text: str, zone: str, name: str = "changed") -> DataFrame:
    """The instant of a naive time text in the row's own zone; null if it isn't a time, unchanged without a zone."""
    t = F.try_to_timestamp(F.col(text))
    return df.withColumn(name, F.when(F.col(zone).isNull(), t).otherwise(F.to_utc_timestamp(t, F.col(zone))))


def regime_metrics(df: DataFrame, keep: Column, duration: str, means: list[str], label: str = "number", id_col: str = "id") -> DataFrame:
    """By id and regime the total duration and the means, over the periods kept; ids with one regime only are left out."""
    out = df.where(keep & F.col(label).isNotNull()).groupBy(id_col, label).agg(F.sum(duration).alias(duration), *(F.avg(c).alias(c) for c in means))
    return out.withColumn("_n", F.count("*").over(Window.partitionBy(id_col))).where("_n >= 2").drop("_n")


def time_weighted_correction(df: DataFrame, duration: str, delta: str, infiltration: str, ventilation: str, internal: str, energy: str, co2: str, id_col: str = "id") -> DataFrame:
    """Energy and CO2 as they would have been under the id's average circumstances.

    Averages are weighted by duration. Demand is delta + infiltration + ventilation - internal gain, 0 at least; the
    factor is the average demand over the period's, 1 where the period's is 0.
    """
    w = Window.partitionBy(id_col)
    parts = (delta, infiltration, ventilation, internal)
    average = {f"_avg_{i}": F.sum(F.col(c) * F.col(duration)).over(w) / F.sum(F.when(F.col(c).isNotNull(), F.col(duration))).over(w) for i, c in enumerate(parts)}
    demand = lambda a, b, c, d: F.when((a + b + c - d).isNotNull(), F.greatest(a + b + c - d, F.lit(0.0)))
    df = df.withColumns(average).withColumn("demand", demand(*map(F.col, parts)))
    df = df.withColumn("corrected_demand", demand(*(F.col(f"_avg_{i}") for i in range(4)))).drop(*average)
    df = df.withColumn("factor", F.when(F.col("demand") == 0, F.lit(1.0)).otherwise(F.col("corrected_demand") / F.col("demand")))
    return df.withColumns({"corrected_energy": F.col(energy) * F.col("factor"), "corrected_co2": F.col(co2) * F.col("factor")})
