"""Masks and bins of measurements that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators.grid import SUMMARIES
from hearthline.operators.mask import filter_min_max


def resample_stream(df: DataFrame, step: str, lateness: str, how: str = "mean", column: str = "value", keys: tuple[str, ...] = ("id", "property"), ts: str = "timestamp", low=None, high=None) -> DataFrame:
    """A summary of each bin of the stream, out once the watermark has passed its end; values out of range are hidden first.

    step and lateness are intervals such as '15 minutes'. State is kept for open bins only.
    """
    df = filter_min_max(df, column, low, high).withWatermark(ts, lateness)
    out = df.groupBy(*keys, F.window(ts, step).alias("_w")).agg(SUMMARIES[how](F.col(column)).alias(column))
    return out.select(*keys, F.col("_w.start").alias(ts), column)
