"""Thermostat programs: validity, changes, and weekly steps of set points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.time import weekday_number

STEPS = "array<struct<weekday:string,start_time:string,temp_set__degC:double>>"


def fill_valid_to(df: DataFrame, keys: tuple[str, ...] = ("id",), tie: tuple[str, ...] = (), last: str = "2100-12-31 00:00:00") -> DataFrame:
    """A missing valid_to is the next valid_from of the same key; the last is far off."""
    following = F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from", *tie))
    end = F.lit(last).cast(df.schema["valid_from"].dataType)
    return df.withColumn("valid_to", F.coalesce("valid_to", following, end))


def invalid_intervals(df: DataFrame) -> DataFrame:
    return df.where(F.col("valid_from") > F.col("valid_to"))


def program_changes(df: DataFrame, program: str = "program", keys: tuple[str, ...] = ("id",), order: tuple[str, ...] = ("valid_from",)) -> DataFrame:
    """Entries that each program has added and removed against the one before of the same key."""
    before = F.lag(program).over(Window.partitionBy(*keys).orderBy(*order))
    df = df.withColumn("_b", before).where("_b is not null")
    return df.withColumns({"added": F.array_except(program, "_b"), "removed": F.array_except("_b", program)}).drop("_b")


def parse_program(df: DataFrame, program: str, activities: str) -> DataFrame:
    """Entries of the active program of a JSON object, with temperatures by activity number.

    program: {"ActiveTimeProgram": n, "HeatingProgram<n>": [{"weekday", "start_time", "activity"}]}; activities: {"<number>": temperature}.
    """
    entry = "array<struct<weekday:string,start_time:string,activity:int>>"
    every = F.from_json(F.col(program), "map<string,string>")
    active = F.concat(F.lit("HeatingProgram"), F.element_at(every, "ActiveTimeProgram"))
    entries = F.from_json(F.element_at(every, active), entry)
    warm = F.from_json(F.col(activities), "map<string,double>")
    steps = F.transform(entries, lambda e: F.struct(e["weekday"].alias("weekday"), e["start_time"].alias("start_time"), F.element_at(warm, e["activity"].cast("string")).alias("temp_set__degC")))
    return df.withColumn("steps", steps)


def conflicting_entries(df: DataFrame, steps: str = "steps", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Weekday and time for which a program has more than one temperature."""
    rows = df.select(*keys, F.inline(steps))
    return rows.groupBy(*keys, "weekday", "start_time").agg(F.count_distinct("temp_set__degC").alias("n")).where("n > 1")


def program_steps(df: DataFrame, steps: str = "steps", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Set points by minute of the week, each until the next; the week's last goes round to its first."""
    rows = df.select(*keys, F.inline(steps))
    clock = F.split("start_time", ":")
    minute = (weekday_number("weekday") - 1) * 1440 + clock[0].cast("int") * 60 + clock[1].cast("int")
    rows = rows.select(*keys, minute.alias("minute"), "temp_set__degC")
    w = Window.partitionBy(*keys).orderBy("minute")
    following = F.coalesce(F.lead("minute").over(w), F.min("minute").over(Window.partitionBy(*keys)) + 7 * 1440)
    return rows.withColumn("minutes", following - F.col("minute"))
