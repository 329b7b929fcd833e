"""From long to wide and back, and joins of sources.

Pivots take their list of values, so that no job runs to find them; without one it is read from the distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.time import micros
from hearthline.operators.intervals import times_in
from hearthline.operators.mask import cast_by_property_types

#: Most values that may become columns, or rows for each row, without being named.
MOST_COLUMNS = 1_000
LONG_KEY = ("id", "source_category", "source_type", "timestamp")


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_on_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def concat_measurements(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def to_properties(df: DataFrame, properties: list[str], types: dict[str, str] | None = None, keys: tuple[str, ...] = LONG_KEY) -> DataFrame:
    """A column for each property; of several values of one key and property the smallest is taken."""
    out = df.groupBy(*keys).pivot("property", properties).agg(F.min("value"))
    return cast_by_property_types(out, types) if types else out


def unstack_source(df: DataFrame, columns: list[str], labels: list[str] | None = None, keys: tuple[str, ...] = ("id", "timestamp"), prefix: Column | None = None, drop_empty: bool = True) -> DataFrame:
    """Columns <category>_<type>_<property> for each source; several rows of one cell are averaged, columns without a value dropped.

    With labels and without drop_empty nothing runs until the result is read; to find empty columns takes a pass over df.
    """
    label = F.concat_ws("_", "source_category", "source_type") if prefix is None else prefix
    df = df.withColumn("_label", label)
    if labels is None:
        labels = _observed(df.select("_label"), "labels")
    cells = {f"{p}_{c}": F.when(F.col("_label") == p, F.col(c)) for p in labels for c in columns}
    # a column has a mean if the source has any value of it, which needs no grouping
    if not drop_empty:
        return df.groupBy(*keys).agg(*(F.avg(v).alias(c) for c, v in cells.items()))
    found = df.agg(*(F.count(v).alias(c) for c, v in cells.items())).first().asDict() if cells else {}
    return df.groupBy(*keys).agg(*(F.avg(v).alias(c) for c, v in cells.items() if found[c])) if any(found.values()) else df.select(*keys).distinct()


def _observed(df: DataFrame, what: str) -> list:
    """The sorted distinct values of the one column, no more than a table can have columns."""
    found = [r[0] for r in df.where(F.col(df.columns[0]).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} {what}: name those that become columns")
    return sorted(found)


def encode_categorical_bool(df: DataFrame, prop: str, names: dict[str, str], categories: list[str] | None = None) -> DataFrame:
    """Each row of the property becomes a row for each category with 'True' or 'False'; other rows stay.

    The new property is the category by the table (its own name if it isn't there) in lower case with _ for spaces and
    the suffix __bool. A missing value is 'False' everywhere. Categories are those given, or the observed ones.
    """
    own = df.where(F.col("property") == prop)
    if categories is None:
        categories = _observed(own.select("value"), "categories")
    name = {c: names.get(c, c).lower().replace(" ", "_") + "__bool" for c in categories}
    cells = F.array(*(F.struct(F.lit(name[c]).alias("p"), F.when(F.col("value") == c, "True").otherwise("False").alias("v")) for c in categories))
    rows = own.select("*", F.explode(cells).alias("_c")).withColumns({"property": F.col("_c.p"), "value": F.col("_c.v")}).drop("_c")
    return df.where(F.col("property") != prop).withColumn("value", F.col("value").cast("string")).unionByName(rows)


def outer_align(series: dict[str, DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """A column for each series on all keys that any of them has."""
    parts = [df.select(*keys, F.lit(name).alias("_s"), F.col(value).alias("_v")) for name, df in series.items()]
    return concat_measurements(*parts).groupBy(*keys).agg(*(F.min(F.when(F.col("_s") == name, F.col("_v"))).alias(name) for name in series))


def cross_join_series(df: DataFrame, series: DataFrame, category: str, kind: str, id_col: str = "id") -> DataFrame:
    """Long rows of one common series (timestamp, property, value) for every id, after those of df."""
    ids = df.select(id_col).distinct()
    more = ids.crossJoin(F.broadcast(series)).withColumns({"source_category": F.lit(category), "source_type": F.lit(kind)})
    return df.unionByName(more.select(*df.columns))


def star_join(facts: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """Inner joins along (dimension, column here, its key); Spark broadcasts those it knows to be small."""
    for d, here, key in dimensions:
        d = d.withColumnRenamed(key, "_k") if key != here else d.withColumn("_k", F.col(key)).drop(key)
        facts = facts.join(d, facts[here] == d["_k"]).drop("_k")
    return facts


def left_join_dims(df: DataFrame, *dimensions: tuple[DataFrame, list[str]]) -> DataFrame:
    return reduce(lambda a, d: a.join(d[0], d[1], "left"), dimensions, df)


def merge_predictions(df: DataFrame, predicted: DataFrame, keys: list[str], prefix: str = "predicted_") -> DataFrame:
    """Predictions in place of any that df already has."""
    return df.drop(*(c for c in df.columns if c.startswith(prefix))).join(predicted, keys, "left")


def latest_per_key(df: DataFrame, keys: list[str], ts: str = "timestamp") -> DataFrame:
    """All rows that hold the greatest time of their key."""
    last = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    return df.join(last, [*keys, ts], "left_semi")


def asof_label_regime(periods: DataFrame, changes: DataFrame, label: str = "number", id_col: str = "id", at: str = "changed") -> DataFrame:
    """Periods that hold no change get the label of the last change before their start, or null; the others are null too.

    Both tables meet on the id in one sorted union, in which each period stands at its end and goes along whole. The last
    change at or before the end is a running maximum; if it lies before the start, the period holds none.
    """
    whole = F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(periods.columns))).alias("_row")
    ends = periods.select(F.col(id_col).alias("_id"), F.col("end").alias("_t"), F.lit(1).alias("_e"), F.col("start").alias("_start"), whole)
    marks = changes.select(F.col(id_col).alias("_id"), F.col(at).alias("_t"), F.lit(0).alias("_e"), F.struct(F.col(at).alias("_at"), F.col(label).alias("_l")).alias("_c"))
    # a change at the very time of a period's end comes first and counts as inside
    w = Window.partitionBy("_id").orderBy("_t", "_e").rowsBetween(Window.unboundedPreceding, 0)
    seen = ends.unionByName(marks, allowMissingColumns=True).withColumn("_last", F.max("_c").over(w)).where("_e = 1")
    found = F.when((F.col("_last._at") < F.col("_start")) & F.col("_t").isNotNull(), F.col("_last._l"))
    return seen.select(*(F.col(f"_row._{i}").alias(c) for i, c in enumerate(periods.columns)), found.alias(label))


def valid_interval_lookup(df: DataFrame, programs: DataFrame, id_col: str = "id", ts: str = "timestamp") -> DataFrame:
    """Rows with each program valid at their time, in (valid_from, valid_to]; programs of an id may overlap (see ``intervals``)."""
    p = programs.withColumns({"_first": micros(programs, "valid_from") + 1, "_last": micros(programs, "valid_to")}).withColumnRenamed(id_col, "_id")
    return times_in(df.withColumn("_us", micros(df, ts)), "_us", p, "_first", "_last", [(id_col, "_id")]).drop("_id", "_us", "_first", "_last")


def locations_expand(weather: DataFrame, homes: DataFrame, place: list[str], rows_a_task: int = 20_000_000) -> DataFrame:
    """The rows of each place for every home there, without the place.

    The result may be far larger than both inputs, and places few: the homes of a place are dealt to as many slices as its rows of the result
    need, and its weather goes to each of these.
    """
    sizes = weather.groupBy(*place).agg(F.count("*").alias("_w")).join(homes.groupBy(*place).agg(F.count("*").alias("_h")), place)
    # never more slices than homes, or a slice would have none
    sizes = sizes.select(*place, F.least(F.col("_h"), F.ceil(F.col("_h") * F.col("_w") / F.lit(rows_a_task))).cast("int").alias("_slices"))
    tasks = max(sizes.agg(F.sum("_slices")).first()[0] or 1, 1)
    dealt = homes.join(sizes, place).withColumn("_slice", F.pmod(F.xxhash64(*homes.columns), F.col("_slices")).cast("int")).drop("_slices")
    spread = weather.join(sizes, place).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    # the number of tasks is given, as the shuffled rows are few and would be put together again
    n = min(4 * tasks, 20_000) if tasks > 1 else 1
    return spread.repartition(n, *place, "_slice").join(dealt.repartition(n, *place, "_slice"), [*place, "_slice"]).drop(*place, "_slice")


def index_align_inner(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values of both frames side by side on their common keys."""
    side = lambda df, s: df.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in columns))
    return side(before, "before").join(side(after, "after"), keys)
