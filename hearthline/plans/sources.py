"""Queries of sources and sinks: what was written is read again."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthline.plans.registry import measurements, query, table
from hearthline.sources import io


@query("SELECT * REPLACE (CASE WHEN value > 400 THEN NULL ELSE value END AS value) FROM m")
def q_read_parquet_stage(spark, sf):
    path = io.scratch(spark, "stage")
    m = measurements(spark, sf).withColumn("value", F.when(F.col("value") > 400, F.lit(float("nan"))).otherwise(F.col("value")))
    io.write_stage(m, path)
    return io.read_stage(spark, path, m.schema)


@query("SELECT event_id, id, value FROM m")
def q_write_parquet_stage(spark, sf):
    path = io.scratch(spark, "stage")
    io.write_stage(measurements(spark, sf).select("event_id", "id", "value"), path)
    return spark.read.parquet(path)


@query("SELECT event_id, id, timestamp, value, value - lag(value) OVER (PARTITION BY id ORDER BY timestamp, event_id) AS change FROM m")
def q_write_bucketed_stage(spark, sf):
    stage = io.write_bucketed(measurements(spark, sf).select("event_id", "id", "timestamp", "value"), "stage_" + uuid.uuid4().hex, buckets=4)
    return stage.withColumn("change", F.col("value") - F.lag("value").over(Window.partitionBy("id").orderBy("timestamp", "event_id")))


@query("SELECT event_id, id, value FROM m")
def q_write_per_home(spark, sf):
    path = io.scratch(spark, "homes")
    io.write_per_home(measurements(spark, sf).select("event_id", "id", "value"), path)
    return spark.read.schema("event_id bigint, value double, id bigint").parquet(path)


@query("SELECT event_id, id, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, value FROM m")
def q_write_csv_per_home(spark, sf):
    path = io.scratch(spark, "homes-csv")
    zone = spark.conf.get("spark.sql.session.timeZone")
    # the events' naive times are UTC, so they are shown in the session's zone as they are
    m = measurements(spark, sf).select("event_id", "id", F.from_utc_timestamp(F.to_utc_timestamp(F.col("timestamp").cast("timestamp"), zone), zone).alias("timestamp"), "value")
    io.write_csv_per_home(m, path)
    out = spark.read.option("header", True).schema("event_id bigint, timestamp string, value double, id bigint").csv(path)
    return out.withColumn("timestamp", F.concat(F.substring("timestamp", 1, 19), F.lit("Z")))


@query("SELECT date_trunc('second', timestamp) AS datetime, property, value, epoch(date_trunc('second', timestamp))::bigint AS timestamp FROM m WHERE date_trunc('second', timestamp) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00' AND property IN ('click', 'view')")
def q_read_csv_house(spark, sf):
    path = io.scratch(spark, "house")
    measurements(spark, sf).select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "property", "value").write.option("header", True).csv(path)
    return io.read_csv_house(spark, path, "2024-01-05 00:00:00", "2024-01-06 12:00:00", ["click", "view"])


@query("SELECT property AS grid_area, date_trunc('second', timestamp) AS timestamp, value * 1e6 AS gas_hhv__J_m_3 FROM m")
def q_read_csv_union(spark, sf):
    paths = [io.scratch(spark, f"month{i}") for i in (0, 1)]
    m = measurements(spark, sf).select("event_id", F.col("property").alias("grid_area"), F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000")).alias("date_time"), "value")
    for i, p in enumerate(paths):
        m.where(F.col("event_id") % 2 == i).drop("event_id").write.option("header", True).csv(p)
    out = io.read_csv_union(spark, paths)
    return out.withColumn("timestamp", F.to_utc_timestamp("timestamp", spark.conf.get("spark.sql.session.timeZone")).cast("timestamp_ntz"))


@query("""SELECT DISTINCT c_custkey AS id, 'device ' || o_orderkey AS device_name, n_name AS source, (l_shipdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Amsterdam' AS timestamp, CASE p_brand WHEN 'Brand#1' THEN 'first' ELSE p_brand END AS property, l_quantity AS value, 'unit ' || p_brand AS unit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN nation ON n_nationkey = o_orderkey % 25
WHERE p_brand IN ('Brand#1', 'Brand#2') AND c_custkey < 100 AND l_shipdate >= TIMESTAMP '1995-12-31 00:00:00' AND l_shipdate <= TIMESTAMP '1999-01-01 00:00:00'""")
def q_read_jdbc_measurements(spark, sf):
    t = lambda n: table(spark, sf, n)
    tables = {
        "measurement": t("lineitem").select(F.col("l_orderkey").alias("device_id"), F.col("l_partkey").alias("property_id"), F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("value")),
        "property": t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.concat(F.lit("unit "), "p_brand").alias("unit")),
        "device": t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("device "), F.col("o_orderkey")).alias("name"), F.col("o_custkey").alias("building_id"), (F.col("o_orderkey") % 25).alias("device_type_id")),
        "device_type": t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "building": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("account_id")),
        "account": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pseudonym")),
    }
    first, last = (dt.datetime(*d, tzinfo=dt.UTC) for d in ((1996, 1, 1), (1998, 12, 31)))
    return io.raw_measurements(tables, [*range(100)], ["Brand#1", "Brand#2"], first, last, {"Brand#1": "first"})


@query("""SELECT DISTINCT o_custkey AS id, s_name AS source_type, l_shipdate AS timestamp, CASE p_brand WHEN 'Brand#1' THEN 'first' ELSE p_brand END AS property, l_quantity AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_brand IN ('Brand#1', 'Brand#2') AND o_custkey < 100 AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1999-01-01 00:00:00'""")
def q_read_jdbc_by_home(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("property_id"), "l_suppkey", F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("value"))
    measured = li.withColumn("device_id", F.struct("l_orderkey", "l_suppkey")).drop("l_orderkey", "l_suppkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    devices = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(orders, "l_orderkey").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("source_type")), "l_suppkey")
    devices = devices.select(F.struct("l_orderkey", "l_suppkey").alias("device_id"), "id", "source_type")
    props = table(spark, sf, "part").select(F.col("p_partkey").alias("property_id"), F.col("p_brand").alias("property"))
    at = lambda y: F.expr(f"TIMESTAMP_NTZ'{y}-01-01 00:00:00'")
    return io.star_measurements(measured, props, devices, [*range(100)], ["Brand#1", "Brand#2"], at(1996), at(1999), {"Brand#1": "first"})


@query("SELECT c_custkey AS house, n_name AS location, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def q_read_jdbc_dims(spark, sf):
    c, n, r = (table(spark, sf, x) for x in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("house"), F.col("n_name").alias("location"), F.col("r_name").alias("region"))


@query("SELECT DISTINCT id, timestamp, property, value, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS iso, floor(epoch(timestamp))::bigint AS unix FROM m WHERE id = 7 AND timestamp BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def q_read_rawdata(spark, sf):
    m = measurements(spark, sf).where("id = 7").select("id", "timestamp", "property", "value")
    at = lambda d: F.expr(f"TIMESTAMP_NTZ'2024-01-{d} 00:00:00'")
    return io.read_rawdata(m, at("03"), at("20"))


@query("SELECT id, 'batch_import' AS source_category, 'vendor' AS source_type, timestamp, CASE property WHEN 'click' THEN 'temp__degC' ELSE 'power__W' END AS property, value FROM m WHERE property IN ('click', 'view')")
def q_import_vendor_export(spark, sf):
    raw = measurements(spark, sf).select(F.col("id").cast("string").alias("pseudonym"), "timestamp", F.col("property").alias("measurement_name"), F.col("value").cast("string").alias("value"))
    return io.import_vendor_export(raw, {"click": "temp__degC", "view": "power__W"}, "batch_import", "vendor")


@query("SELECT id, date_trunc('second', timestamp) - INTERVAL 1 HOUR AS timestamp, CASE property WHEN 'click' THEN 'e_use_hi_cum__kWh' ELSE 'g_use_cum__m3' END AS property, value FROM m WHERE property IN ('click', 'view')")
def q_import_meter_json(spark, sf):
    rate = F.when(F.col("property") == "click", 180).when(F.col("property") == "view", 181).otherwise(999)
    entry = F.struct(rate.alias("rate"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("value").alias("quantity"))
    m = measurements(spark, sf)
    cells = m.groupBy(F.col("id").alias("pseudonym")).agg(F.to_json(F.collect_list(F.when(F.col("event_id") % 2 == 0, entry))).alias("a"), F.to_json(F.collect_list(F.when(F.col("event_id") % 2 == 1, entry))).alias("b"), F.lit("not json").alias("c"))
    out = io.import_meter_json(cells, ["a", "b", "c"], {180: "e_use_hi_cum__kWh", 181: "g_use_cum__m3"})
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("SELECT id::int AS station, date_trunc('hour', timestamp) AS timestamp, value AS temp, 50 + s_suppkey * 0.1::double AS lat FROM m JOIN supplier ON s_suppkey = id WHERE value < 300")
def q_parse_station_weather(spark, sf):
    path = io.scratch(spark, "stations")
    value = F.when(F.col("value") < 300, F.col("value").cast("string")).otherwise("")
    m = measurements(spark, sf).select(F.concat_ws(",", F.lpad(F.col("id").cast("string"), 5, " "), F.date_format("timestamp", "yyyyMMdd"), F.lpad((F.hour("timestamp") + 1).cast("string"), 5, " "), value).alias("value"))
    spark.createDataFrame([("# station, day, hour, temp",)], "value string").union(m).write.text(path)
    stations = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("station"), (50 + F.col("s_suppkey") * 0.1).alias("lat"))
    out = io.parse_station_weather(spark.read.text(path), ["temp"], stations)
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("SELECT event_id, CASE WHEN value > 50 THEN 'TRUE' ELSE 'FALSE' END AS high, date_trunc('second', timestamp) + INTERVAL 1 HOUR AS timestamp FROM m")
def q_export_naive_table(spark, sf):
    path = io.scratch(spark, "export")
    zone = spark.conf.get("spark.sql.session.timeZone")
    m = measurements(spark, sf).select("event_id", (F.col("value") > 50).alias("high"), F.date_trunc("SECOND", F.col("timestamp").cast("timestamp")).alias("timestamp"))
    io.export_naive_table(m, path, "Europe/Amsterdam")
    return spark.read.option("header", True).schema("event_id bigint, high string, timestamp timestamp_ntz").csv(path)
