"""Reading and writing: stages, CSV, station weather, meter JSON, databases. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import datetime as dt
import gzip
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import batched, groupby, pairwise
from operator import itemgetter
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions.time import with_instants


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-hearthline-")
    return f"{base}/hearthline/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what comes after doesn't compute it twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_stage(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A Parquet stage; NaN becomes null."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def write_stage(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str] = ["id"], ts: str = "timestamp", path: str | None = None, buckets: int | None = None, rows_a_bucket: int = 5_000_000) -> DataFrame:
    """A stage as a table in buckets by the keys, sorted by key and time: windows and joins by these keys need no shuffle of it, read anew.

    The number of buckets follows the number of rows, if it isn't given; tables that are joined should have the same. Each bucket is one
    file. Of series longer than a bucket, cut the key (see ``scan.with_chunk``) and give the chunk as a key too.
    """
    n = buckets or max(1, -(-df.count() // rows_a_bucket))
    writer = df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys, ts).format("parquet").option("path", path or scratch(df.sparkSession, name))
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The path in the file system that driver and executors mount; None for one of another kind."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _folder(column: str, value: str) -> str:
    """The name of a partition's folder."""
    return "=".join(re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", t) for t in (column, value))


def _write_table(name: str, batches: Iterator[pa.RecordBatch]) -> None:
    writer = None
    for some in batched(batches, 100):
        writer = writer or pq.ParquetWriter(name, some[0].schema)
        writer.write_table(pa.Table.from_batches(some))
    writer.close()


def _write_in_tasks(df: DataFrame, path: str, id_col: str, ending: str, write: Callable[[str, Iterator[pa.RecordBatch]], None]) -> None:
    """A mounted folder with a folder for each id and in it a file for each _file, written by write(name, its rows without both columns).

    Each file is written by the task that holds its rows, under a name of its own until it is whole; the folder has its name once all are.
    Spark's writer starts some processes for each local file (to set its rights, where Hadoop's native library is missing), which
    for small homes costs many times as much as the rows.
    """
    if os.path.exists(path):
        raise FileExistsError(path)
    stage = f"{os.path.dirname(path)}/_{os.path.basename(path)}-{uuid.uuid4().hex}"
    names = [c for c in df.columns if c not in (id_col, "_file")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for b in batches:
                homes, files = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_home", "_file"))
                rows = b.select(names)
                cuts = np.flatnonzero((homes[1:] != homes[:-1]) | (files[1:] != files[:-1])) + 1
                for i, j in pairwise([0, *cuts.tolist(), b.num_rows]) if b.num_rows else ():
                    yield (homes[i], int(files[i])), rows.slice(i, j - i)

        n = 0
        for (home, file), rows in groupby(pieces(), itemgetter(0)):
            folder = f"{stage}/{_folder(id_col, home)}"
            os.makedirs(folder, exist_ok=True)
            temporary = f"{folder}/.{uuid.uuid4().hex}"
            write(temporary, (r for _, r in rows))
            os.replace(temporary, f"{folder}/part-{file:05d}{ending}")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    home = F.coalesce(F.nullif(F.col(id_col).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    dealt = df.withColumn("_home", home).repartition("_home", "_file").sortWithinPartitions("_home", "_file").select("_home", "_file", *names)
    os.makedirs(stage)
    try:
        dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()
        open(f"{stage}/_SUCCESS", "wb").close()
        os.rename(stage, path)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def write_per_home(df: DataFrame, path: str, id_col: str = "id", rows_a_file: int = 5_000_000) -> None:
    """A folder of Parquet files for each id; rows are dealt by id, so that each folder has few files, and a home of more than rows_a_file rows is dealt to several tasks."""
    sizes = df.groupBy(F.col(id_col).alias("_home")).agg(F.ceil(F.count("*") / F.lit(rows_a_file)).cast("int").alias("_files")).where("_files > 1")
    dealt = df.join(sizes, F.col(id_col) == F.col("_home"), "left").withColumn("_file", F.pmod(F.xxhash64(*df.columns), F.coalesce("_files", F.lit(1)))).select(*df.columns, "_file")
    mounted = _mounted(df.sparkSession, path)
    plain = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if mounted and all(isinstance(f.dataType, plain) for f in df.schema if f.name != id_col):
        _write_in_tasks(dealt, mounted, id_col, ".parquet", _write_table)
    else:
        dealt.repartition(id_col, "_file").select(*df.columns).write.partitionBy(id_col).parquet(path)


def write_csv_per_home(df: DataFrame, path: str, id_col: str = "id", ts: str = "timestamp", zone: str = "UTC") -> None:
    """A folder of gzipped CSV for each id, with ISO times and their offset."""
    offset = F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX") if zone == "UTC" else F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd'T'HH:mm:ss")
    df = df.withColumn(ts, offset)
    mounted, names = _mounted(df.sparkSession, path), [c for c in df.columns if c != id_col]
    if not mounted or len(names) < 2:  # to_csv fails on a lone null
        df.repartition(id_col).write.partitionBy(id_col).option("header", True).option("compression", "gzip").csv(path)
        return
    header = df.sparkSession.range(1).select(F.to_csv(F.struct(*(F.lit(n).alias(n) for n in names)))).first()[0]

    def write(name: str, batches: Iterator[pa.RecordBatch]) -> None:
        with gzip.open(name, "wb", 6) as f:
            f.write(f"{header}\n".encode())
            for b in batches:
                f.write("".join(f"{line}\n" for line in b.column(0).to_pylist()).encode())

    lines = df.select(id_col, F.lit(0).alias("_file"), F.to_csv(F.struct(*names)).alias("_line"))
    _write_in_tasks(lines, mounted, id_col, ".csv.gz", write)


def read_csv_house(spark: SparkSession, paths: str | list[str], start: str | None = None, end: str | None = None, properties: list[str] | None = None) -> DataFrame:
    """(datetime, property, value) files with the time as text, in a period with both ends, and the unix time as timestamp."""
    df = spark.read.option("header", True).schema("datetime string, property string, value double").csv(paths)
    df = df.withColumn("datetime", F.to_timestamp_ntz("datetime", F.lit("yyyy-MM-dd HH:mm:ss")))
    for bound, keep in ((start, lambda b: F.col("datetime") >= b), (end, lambda b: F.col("datetime") <= b)):
        df = df if bound is None else df.where(keep(F.lit(bound).cast("timestamp_ntz")))
    df = df if properties is None else df.where(F.col("property").isin(properties))
    return df.withColumn("timestamp", F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("datetime")))


def read_csv_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Monthly files of (grid_area, date_time with offset, value in MJ/m3) as (grid_area, timestamp, gas_hhv__J_m_3)."""
    df = spark.read.option("header", True).schema("grid_area string, date_time string, value double").csv(paths)
    at = F.try_to_timestamp(F.col("date_time"), F.lit("yyyy-MM-dd'T'HH:mm:ssXX"))
    return df.select("grid_area", at.alias("timestamp"), (F.col("value") * 1e6).alias("gas_hhv__J_m_3"))


def read_lookup_matrix(spark: SparkSession, path: str, schema: str, keys: list[str], column: str, value: str, scale: float = 1.0) -> DataFrame:
    """A CSV matrix as rows (keys, column, value); the column names are numbers."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    out = df.unpivot([F.col(k) for k in keys], [F.col(f"`{c}`") for c in df.columns if c not in keys], column, value)
    return out.select(*keys, (F.col(column).cast("double") * scale).alias(column), value)


def day_bounds(first: dt.datetime | None, last: dt.datetime | None, zone: str = "UTC") -> tuple[str | None, str | None]:
    """The days, in the source's zone, that a query for a period asks for: an hour before the first day, and an hour after the last one's end."""
    at, hour = ZoneInfo(zone), dt.timedelta(hours=1)
    low = None if first is None else f"{(first - hour).astimezone(at):%Y-%m-%d}"
    return low, None if last is None else f"{(last + dt.timedelta(days=1) + hour).astimezone(at):%Y-%m-%d}"


def read_jdbc_table(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, fetch: int = 100_000, **options) -> DataFrame:
    """A database table, in parallel parts by a numeric column (name, low, high, parts). Filters on it are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch, **options)
    if partition:
        name, low, high, parts = partition
        reader = reader.options(partitionColumn=name, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def raw_measurements(tables: dict[str, DataFrame], ids: list, names: list[str], first: dt.datetime | None = None, last: dt.datetime | None = None, rename: dict[str, str] | None = None, zone: str = "UTC", home_zone: str = "Europe/Amsterdam") -> DataFrame:
    """(id, device_name, source, timestamp, property, value, unit) from the six tables of the normalised database.

    measurement (device_id, property_id, timestamp, value), property (id, name, unit), device (id, name, building_id,
    device_type_id), device_type (id, name), building (id, account_id), account (id, pseudonym). Times are naive in zone and
    come out naive in home_zone; both day bounds count in. Filters reach the tables' own scans.
    """
    low, high = day_bounds(first, last, zone)
    t = {n: df.select(*(F.col(c).alias(f"{n}_{c}") for c in df.columns)) for n, df in tables.items()}
    rows = t["measurement"]
    rows = rows if low is None else rows.where(F.col("measurement_timestamp") >= F.lit(low).cast("timestamp_ntz"))
    rows = rows if high is None else rows.where(F.col("measurement_timestamp") <= F.lit(high).cast("timestamp_ntz"))
    rows = rows.join(t["property"].where(F.col("property_name").isin(names)), F.col("measurement_property_id") == F.col("property_id"))
    rows = rows.join(t["device"], F.col("measurement_device_id") == F.col("device_id")).join(t["building"], F.col("device_building_id") == F.col("building_id"))
    rows = rows.join(t["account"].where(F.col("account_pseudonym").isin(ids)), F.col("building_account_id") == F.col("account_id")).join(t["device_type"], F.col("device_device_type_id") == F.col("device_type_id"))
    at = F.convert_timezone(F.lit(zone), F.lit(home_zone), F.col("measurement_timestamp"))
    out = rows.select(F.col("account_pseudonym").alias("id"), "device_name", F.col("device_type_name").alias("source"), at.alias("timestamp"), F.col("property_name").alias("property"), F.col("measurement_value").alias("value"), F.col("property_unit").alias("unit"))
    out = out.dropDuplicates(["id", "timestamp", "source", "device_name", "property", "value"])
    return out if not rename else out.replace(rename, subset=["property"])


def star_measurements(measurement: DataFrame, properties: DataFrame, devices: DataFrame, ids: list | None = None, names: list[str] | None = None, first=None, last=None, rename: dict[str, str] | None = None) -> DataFrame:
    """(id, source_type, timestamp, property, value) from normalised tables, filtered by id, property and time, without duplicates.

    measurement has (device_id, property_id, timestamp, value), properties (property_id, property), devices (device_id, id, source_type).
    """
    df = measurement
    for bound, keep in ((first, lambda b: F.col("timestamp") >= b), (last, lambda b: F.col("timestamp") < b)):
        df = df if bound is None else df.where(keep(bound))
    properties = properties if names is None else properties.where(F.col("property").isin(names))
    devices = devices if ids is None else devices.where(F.col("id").isin(ids))
    df = df.join(properties, "property_id").join(devices, "device_id")
    df = df if not rename else df.replace(rename, subset=["property"])
    return df.select("id", "source_type", "timestamp", "property", "value").dropDuplicates()


def read_rawdata(df: DataFrame, start, end, ts: str = "timestamp") -> DataFrame:
    """Distinct rows of a period with both ends, with the time as ISO text and in unix seconds."""
    rows = df.where(F.col(ts).between(start, end)).distinct()
    return rows.withColumns({"iso": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), "unix": F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts))})


def import_vendor_export(df: DataFrame, names: dict[str, str], category: str, kind: str, id_col: str = "pseudonym") -> DataFrame:
    """Vendor measurements by our property names; others go."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    df = df.withColumn("property", table[F.col("measurement_name")]).where("property is not null")
    return df.select(F.col(id_col).cast("long").alias("id"), F.lit(category).alias("source_category"), F.lit(kind).alias("source_type"), "timestamp", "property", F.col("value").try_cast("double").alias("value"))


def import_meter_json(df: DataFrame, columns: list[str], rates: dict[int, str], zone: str = "Europe/Amsterdam", id_col: str = "pseudonym") -> DataFrame:
    """Readings of cells with [{"rate", "date", "quantity"}, ...]; bad JSON and unknown rates are left out, local times become UTC.

    In the hour that comes twice when clocks go back, readings are in its second pass once the times of a property fall back, in the order of the cells.
    """
    shape = "array<struct<rate:int,date:string,quantity:double>>"
    cells = F.flatten(F.array(*(F.coalesce(F.from_json(c, shape), F.array().cast(shape)) for c in columns)))
    names = F.create_map(*(F.lit(x) for pair in rates.items() for x in pair))
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(cells).alias("_place", "r")).withColumn("property", names[F.col("r.rate")])
    rows = rows.withColumn("_local", F.try_to_timestamp(F.col("r.date"))).where("property is not null and _local is not null")
    rows = with_instants(rows, "_local", ["id", "property"], ["_place"], zone, "timestamp")
    return rows.select("id", "timestamp", "property", F.col("r.quantity").alias("value"))


def parse_station_weather(lines: DataFrame, names: list[str], stations: DataFrame | None = None, line: str = "value") -> DataFrame:
    """Hourly station text: station, YYYYMMDD, hour 1..24, then the named numbers; # starts a comment.

    The time is that of the hour's start in UTC. Station coordinates are joined if given; incomplete rows go.
    """
    parts = F.split(F.col(line), ",")
    df = lines.where(~F.col(line).startswith("#") & (F.trim(F.col(line)) != ""))
    day = F.try_to_timestamp(F.trim(parts[1]), F.lit("yyyyMMdd"))
    at = F.timestamp_add("HOUR", F.trim(parts[2]).try_cast("int") - F.lit(1), day)
    out = df.select(F.trim(parts[0]).try_cast("int").alias("station"), at.alias("timestamp"), *(F.trim(parts[i + 3]).try_cast("double").alias(n) for i, n in enumerate(names)))
    return (out if stations is None else out.join(stations, "station", "left")).dropna()


def naive_table(df: DataFrame, zone: str, durations: list[str] = ()) -> DataFrame:
    """For spreadsheets: local times without zone, TRUE and FALSE as text, durations in seconds."""
    def cell(c: str, kind: str) -> Column:
        if kind == "timestamp":
            return F.from_utc_timestamp(c, zone).cast("timestamp_ntz")
        if kind == "boolean":
            return F.when(F.col(c), "TRUE").when(~F.col(c), "FALSE")
        if kind.startswith("interval day") or c in durations:
            return F.col(c).cast("interval second").cast("double") if kind.startswith("interval") else F.col(c).cast("double")
        return F.col(c)

    return df.select(*(cell(c, k).alias(c) for c, k in df.dtypes))


def export_naive_table(df: DataFrame, path: str, zone: str, durations: list[str] = ()) -> None:
    naive_table(df, zone, durations).write.option("header", True).csv(path)
