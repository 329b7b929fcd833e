"""Time arithmetic on timestamps with or without a zone, in microseconds and seconds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_STEP = re.compile(r"\s*(\d*)\s*(min|T|s|S|h|H|d|D|w|W)\s*\Z")
_SECONDS = {"min": 60, "t": 60, "s": 1, "h": 3600, "d": 86400, "w": 604800}


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column of either kind."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{column}`)")
    return F.unix_micros(column)


def from_micros(df: DataFrame, like: str, us: Column) -> Column:
    """The timestamp of the same kind as the column like."""
    if isinstance(df.schema[like].dataType, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", us, F.expr(EPOCH))
    return F.timestamp_micros(us)


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """end - start in seconds, as a double."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)


def shifted(ts: str | Column, seconds: float | Column) -> Column:
    """ts moved by some seconds."""
    s = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return F.timestamp_add("MICROSECOND", F.round(s * 1e6).cast("long"), F.col(ts) if isinstance(ts, str) else ts)


def floor_to(df: DataFrame, column: str, step_s: int) -> Column:
    """The start of the step that the timestamp lies in; steps are counted from 1970."""
    us, step = micros(df, column), F.lit(int(step_s) * 1_000_000)
    return from_micros(df, column, us - F.pmod(us, step))


def parse_step(text: str) -> int:
    """Seconds of a step such as '15T', '5min', '2h' or 'D'."""
    m = _STEP.match(text)
    if not m:
        raise ValueError(f"not a step: {text!r}")
    return int(m[1] or 1) * _SECONDS[m[2].lower()]


def local_date(ts: str | Column, zone: str) -> Column:
    """The calendar day in the zone of an instant held in UTC."""
    return F.to_date(F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, zone))


def with_instants(df: DataFrame, local: str, keys: list[str], order: list[str], zone: str, name: str) -> DataFrame:
    """name: the UTC time of a local one. In the hour that comes twice when clocks go back it is the first of both, until a series' local times fall back within it.

    Only rows of such an hour are ordered, by series and day; the others are not shuffled.
    """
    early = F.to_utc_timestamp(local, zone)
    late = F.timestamp_add("HOUR", F.lit(1), early)
    df = df.withColumn("_twice", F.coalesce((F.from_utc_timestamp(late, zone) == F.col(local)) & (F.from_utc_timestamp(early, zone) == F.col(local)), F.lit(False)))
    w = Window.partitionBy(*keys, F.to_date(local)).orderBy(*order)
    fell = F.coalesce((F.col(local) < F.lag(local).over(w)).cast("int"), F.lit(0))
    twice = df.where("_twice").withColumn("_fell", fell)
    second = F.sum("_fell").over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0
    twice = twice.withColumn(name, F.when(second, late).otherwise(early)).drop("_fell")
    return df.where("not _twice").withColumn(name, early).unionByName(twice).drop("_twice")


def weekday_number(name: str | Column) -> Column:
    """ISO number of an English weekday name, null for others."""
    c = F.lower(F.col(name) if isinstance(name, str) else name)
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    return F.nullif(F.array_position(F.array(*map(F.lit, days)), c), F.lit(0)).cast("int")
