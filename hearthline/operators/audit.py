"""A log of what a preparation step did: counts before and after.

``audited`` counts in jobs of its own when the log is read; ``observed`` counts in the pass that computes the steps' result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _counts(df: DataFrame, columns: list[str], id_col: str, side: str) -> DataFrame:
    return df.agg(F.count("*").alias(f"rows_{side}"), F.count_distinct(id_col).alias(f"ids_{side}"), *(F.count(c).alias(f"{c}_{side}") for c in columns))


def audit_step(step: str, before: DataFrame, after: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """One row: rows, ids and values of the columns before and after."""
    a = _counts(before, columns, id_col, "before")
    return F.broadcast(a).crossJoin(F.broadcast(_counts(after, columns, id_col, "after"))).select(F.lit(step).alias("step"), "*")  # one row each


def audited(columns: list[str], log: list[DataFrame], id_col: str = "id") -> Callable:
    """Decorator of a step DataFrame -> DataFrame that appends its row to the log; nothing runs until the log is read."""

    def around(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(step)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            out = step(df, *args, **options)
            log.append(audit_step(step.__name__, df, out, columns, id_col))
            return out

        return run

    return around


def observed(columns: list[str], log: list[tuple[str, Observation, Observation]], id_col: str = "id") -> Callable:
    """Decorator of a step DataFrame -> DataFrame that is counted as its result is computed, without a job of its own.

    A frame that the step reads twice is counted twice, and one that an action reads in part only in part. Ids are told by their distinct
    values in each task, which are as many as its homes.
    """
    counts = lambda: [F.count(F.lit(1)).alias("rows"), F.size(F.collect_set(id_col)).alias("ids"), *(F.count(c).alias(c) for c in columns)]

    def around(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(step)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            before, after = Observation(), Observation()
            log.append((step.__name__, before, after))
            return step(df.observe(before, *counts()), *args, **options).observe(after, *counts())

        return run

    return around


def observed_log(spark: SparkSession, log: list[tuple[str, Observation, Observation]], columns: list[str]) -> DataFrame:
    """The rows of audit_step for observed steps whose result has been computed; it waits for one that hasn't."""
    names = ["rows", "ids", *columns]
    schema = "step string, " + ", ".join(f"`{n}_{side}` long" for side in ("before", "after") for n in names)
    return spark.createDataFrame([(step, *(int(o.get[n]) for o in (before, after) for n in names)) for step, before, after in log], schema)
