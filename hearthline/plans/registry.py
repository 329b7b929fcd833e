"""Registered queries, and the views of the test tables that they share.

The table events stands for raw measurements (user_id is the id, event_type the property, the parity of event_id the
source); its daily means by id stand for prepared wide rows. Queries are written with library functions, their SQL by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PROPERTIES = ["click", "error", "purchase", "signup", "view"]

#: Common table expressions by name, in the order in which they may build on each other.
VIEWS = {
    "m": "SELECT event_id, user_id AS id, CASE WHEN user_id % 3 = 0 THEN 'device' ELSE 'cloud_feed' END AS source_category, 's' || (event_id % 2) AS source_type, ts AS timestamp, event_type AS property, value FROM events",
    "w": "SELECT id, date_trunc('day', timestamp) AS timestamp, " + ", ".join(f"avg(value) FILTER (property = '{p}') AS {p}" for p in PROPERTIES) + " FROM m GROUP BY id, date_trunc('day', timestamp)",
}


def query(sql: str | None = None) -> Callable:
    """Registers a function by its name without the leading q_. sql may use the views above."""

    def add(f: Callable) -> Callable:
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            used = [v for v in VIEWS if _uses(sql, v)]
            if "w" in used and "m" not in used:
                used.insert(0, "m")
            text = sql.strip()
            views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
            SQL[name] = text if not used else f"WITH {views}, {text.removeprefix('WITH ')}" if text.startswith("WITH ") else f"WITH {views} {text}"
        return f

    return add


def _uses(sql: str, view: str) -> bool:
    import re

    return bool(re.search(rf"\b(FROM|JOIN)\s+{view}\b", sql))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as long measurements."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("id"), F.when(F.col("user_id") % 3 == 0, "device").otherwise("cloud_feed").alias("source_category"),
        F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("source_type"), F.col("ts").alias("timestamp"), F.col("event_type").alias("property"), "value",
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means by id, a column for each property."""
    m = measurements(spark, sf_dir)
    day = F.date_trunc("DAY", "timestamp").cast(m.schema["timestamp"].dataType).alias("timestamp")
    return m.groupBy("id", day).pivot("property", PROPERTIES).agg(F.avg("value"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show, after a step off decimal ties, which engines round differently."""
    return df.select(*(F.round(F.col(c) + F.lit(3e-9), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
