"""Queries of filters and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import mask as k
from hearthline.plans.registry import measurements, query, rounded, table, wide


@query("SELECT * FROM m WHERE value >= 400")
def q_filter_value_op(spark, sf):
    return k.filter_value_op(measurements(spark, sf), "value", ">=", 400)


@query("SELECT * FROM m WHERE value BETWEEN 10 AND 20")
def q_filter_between(spark, sf):
    return k.filter_between(measurements(spark, sf), "value", 10, 20)


@query("SELECT * FROM m WHERE property IN ('click', 'view')")
def q_filter_in(spark, sf):
    return k.filter_in(measurements(spark, sf), "property", ["click", "view"])


@query("SELECT * FROM m WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-07 00:00:00'")
def q_filter_period(spark, sf):
    at = lambda d: F.expr(f"TIMESTAMP_NTZ'2024-01-{d} 00:00:00'")
    return k.filter_period(measurements(spark, sf), at("05"), at("07"))


@query("SELECT * FROM m WHERE timestamp >= TIMESTAMP '2024-01-08 00:00:00' AND timestamp < TIMESTAMP '2024-01-15 00:00:00'")
def q_filter_half_open_period(spark, sf):
    at = lambda d: F.expr(f"TIMESTAMP_NTZ'2024-01-{d} 00:00:00'")
    return k.filter_half_open_period(measurements(spark, sf), at("08"), at("15"))


@query("SELECT event_id, id, source_category, source_type, timestamp, property || '__W' AS property, value FROM m WHERE property = 'click' AND source_type = 's1' AND id IN (1, 2, 3, 4, 5, 6, 7, 8, 9)")
def q_select_measurements(spark, sf):
    unit = F.when(F.col("property") == "click", "__W").when(F.col("property") == "view", "__str").otherwise("__degC")
    df = measurements(spark, sf).withColumn("property", F.concat("property", unit)).withColumn("value", F.col("value").cast("string"))
    return k.select_measurements(df, ids=range(1, 10), types=["s1"], units=["W", "str"])


@query("SELECT * REPLACE (CASE WHEN value < 5 OR value > 100 THEN NULL ELSE value END AS value) FROM m")
def q_filter_min_max(spark, sf):
    return k.filter_min_max(measurements(spark, sf), "value", 5, 100)


@query("SELECT * REPLACE (CASE WHEN value < 5 THEN 5 WHEN value > 100 THEN 100 ELSE value END AS value) FROM m")
def q_clip_column(spark, sf):
    return k.clip_column(measurements(spark, sf), "value", 5.0, 100.0)


@query("""WITH s AS (SELECT id, avg(value) AS mu, stddev_pop(value) AS sd FROM m GROUP BY id)
SELECT m.* REPLACE (CASE WHEN sd > 0 AND abs(value - mu) / sd > 2.5 THEN NULL ELSE value END AS value) FROM m JOIN s USING (id)""")
def q_filter_static_outliers(spark, sf):
    return k.filter_static_outliers(measurements(spark, sf), "value", 2.5)


@query("SELECT m.* REPLACE (CASE WHEN abs(value - (SELECT avg(value) FROM m)) > 3 * (SELECT stddev_samp(value) FROM m) THEN NULL ELSE value END AS value) FROM m")
def q_remove_measurement_outliers(spark, sf):
    return k.remove_measurement_outliers(measurements(spark, sf), "value", 3)


@query("""WITH a AS (SELECT id, timestamp, click, view, coalesce(abs(click - (SELECT avg(click) FROM w)) > 2 * (SELECT stddev_samp(click) FROM w), false) AS far FROM w),
b AS (SELECT id, timestamp, CASE WHEN NOT far THEN click END AS click, CASE WHEN NOT far THEN view END AS view FROM a),
c AS (SELECT *, coalesce(abs(view - (SELECT avg(view) FROM b)) > 2 * (SELECT stddev_samp(view) FROM b), false) AS far FROM b)
SELECT id, timestamp, round(CASE WHEN NOT far THEN click END + 3e-9, 6) AS click, round(CASE WHEN NOT far THEN view END + 3e-9, 6) AS view FROM c""")
def q_remove_weather_outliers(spark, sf):
    return rounded(k.remove_weather_outliers(wide(spark, sf).select("id", "timestamp", "click", "view"), ["click", "view"], 2))


@query("""WITH x AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN 7.0 ELSE value END AS value) FROM m), s AS (SELECT id FROM x GROUP BY id HAVING stddev_samp(value) = 0)
SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM s) THEN NULL ELSE value END AS value) FROM x""")
def q_filter_std_zero(spark, sf):
    df = measurements(spark, sf).withColumn("value", F.when(F.col("id") % 5 == 0, 7.0).otherwise(F.col("value")))
    return k.filter_std_zero(df, "value")


@query("""WITH x AS (SELECT id, source_type, timestamp, event_id, CASE WHEN id % 5 = 0 AND source_type = 's1' THEN 7.0 ELSE value END AS value, value * 2 AS other FROM m),
s AS (SELECT id, source_type, coalesce(stddev_samp(value) = 0, false) AS flat FROM x GROUP BY ALL)
SELECT id, source_type, timestamp, event_id, CASE WHEN NOT flat THEN value END AS value, CASE WHEN NOT flat THEN other END AS other FROM x JOIN s USING (id, source_type)""")
def q_filter_std_zero_per_source(spark, sf):
    df = measurements(spark, sf).select("id", "source_type", "timestamp", "event_id", F.when((F.col("id") % 5 == 0) & (F.col("source_type") == "s1"), 7.0).otherwise(F.col("value")).alias("value"), (F.col("value") * 2).alias("other"))
    return k.filter_std_zero_per_source(df, "value", ["value", "other"])


_METERS = """WITH x AS (SELECT id, timestamp, click AS hi, view AS lo, CASE WHEN id % 4 = 0 THEN 0 ELSE purchase END AS rhi, CASE WHEN id % 4 = 0 THEN 1 ELSE signup END AS rlo, (id % 6) AS version FROM w),
n AS (SELECT id, coalesce(max(rhi) < 5, true) AND coalesce(max(rlo) < 5, true) AS none FROM x GROUP BY id)
SELECT x.id, timestamp, version,
  round(CASE WHEN coalesce(version < 3, false) OR coalesce(hi < 5, false) OR coalesce(lo < 5, false) THEN NULL ELSE hi END + 3e-9, 6) AS hi,
  round(CASE WHEN coalesce(version < 3, false) OR coalesce(hi < 5, false) OR coalesce(lo < 5, false) THEN NULL ELSE lo END + 3e-9, 6) AS lo,
  round(CASE WHEN NOT coalesce(version < 3, false) AND (rhi >= 5 OR (rhi = 0 AND none)) THEN rhi END + 3e-9, 6) AS rhi,
  round(CASE WHEN NOT coalesce(version < 3, false) AND (rlo >= 5 OR (rlo = 0 AND none)) THEN rlo END + 3e-9, 6) AS rlo
FROM x JOIN n USING (id)"""


@query(_METERS)
def q_filter_electricity_meters(spark, sf):
    solar = F.col("id") % 4 == 0
    df = wide(spark, sf).select("id", "timestamp", F.col("click").alias("hi"), F.col("view").alias("lo"), F.when(solar, 0.0).otherwise(F.col("purchase")).alias("rhi"), F.when(solar, 1.0).otherwise(F.col("signup")).alias("rlo"), (F.col("id") % 6).alias("version"))
    return rounded(k.filter_electricity_meters(df, ["hi", "lo"], ["rhi", "rlo"], "version", 5))


@query(_METERS)
def q_filter_electricity_meters_fast(spark, sf):
    return q_filter_electricity_meters(spark, sf)


@query("""SELECT w.id, timestamp, round(CASE WHEN c_nationkey % 5 IS NOT NULL AND (view IS NULL OR view < c_nationkey % 5 * 20) THEN NULL ELSE click END + 3e-9, 6) AS occupancy
FROM w LEFT JOIN customer ON c_custkey = w.id AND c_nationkey < 20""")
def q_occupancy_validity_filter(spark, sf):
    homes = table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5 * 20).alias("size"))
    df = wide(spark, sf).select("id", "timestamp", F.col("click").alias("occupancy"), F.col("view").alias("onboarded"))
    return rounded(k.occupancy_validity_filter(df, homes, "occupancy", "onboarded", "size"))


@query("SELECT * FROM m WHERE id IN (SELECT id FROM m WHERE source_category = 'device')")
def q_drop_ids_single_source(spark, sf):
    return k.drop_ids_single_source(measurements(spark, sf), ("device",))


@query("SELECT id, timestamp, click IS NOT NULL AND view IS NOT NULL AS sane FROM w")
def q_mask_all_required(spark, sf):
    return k.mask_all_required(wide(spark, sf).select("id", "timestamp", "click", "view"), ["click", "view"]).select("id", "timestamp", "sane")


@query("SELECT id, timestamp, coalesce(click > 100 AND view > 50, false) AS ch, coalesce(error > 100 AND view > 50, false) AS dhw, coalesce(view <= 50, false) AS closed FROM w")
def q_named_masks(spark, sf):
    df = wide(spark, sf).select("id", "timestamp", (F.col("click") > 100).alias("c"), (F.col("error") > 100).alias("d"), (F.col("view") > 50).alias("v"))
    return df.select("id", "timestamp", k.burning("c", "v").alias("ch"), k.burning("d", "v").alias("dhw"), F.coalesce(~F.col("v"), F.lit(False)).alias("closed"))


@query("SELECT event_id, CASE property WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' ELSE property END AS property FROM m")
def q_rename_values(spark, sf):
    return k.rename_values(measurements(spark, sf).select("event_id", "property"), "property", {"click": "tap", "view": "look"})


@query("SELECT event_id, 100000 + c_nationkey * 1000 + m.id AS id, value FROM m JOIN customer ON c_custkey = m.id WHERE c_nationkey < 20")
def q_rekey_pseudonym(spark, sf):
    names = table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("id"), (100000 + F.col("c_nationkey") * 1000 + F.col("c_custkey")).alias("pseudonym"))
    return k.rekey(measurements(spark, sf).select("event_id", "id", "value"), names, "id", "pseudonym")


@query("SELECT id, timestamp, round(CASE WHEN signup IS NULL AND click IS NOT NULL AND view IS NOT NULL THEN 0 ELSE signup END + 3e-9, 6) AS signup FROM w")
def q_return_fill_zero(spark, sf):
    return rounded(k.return_fill_zero(wide(spark, sf), ["signup"], ["click", "view"]).select("id", "timestamp", "signup"))


@query("SELECT id, timestamp, round(click + view + 3e-9, 6) AS e_use__W, round(purchase + signup + 3e-9, 6) AS e_ret__W, round(click + view - (purchase + signup) + 3e-9, 6) AS e_net__W FROM w")
def q_combine_meters(spark, sf):
    return rounded(k.combine_meters(wide(spark, sf), "click", "view", "purchase", "signup").select("id", "timestamp", "e_use__W", "e_ret__W", "e_net__W"))


@query("""SELECT event_id, CASE WHEN value > 100 THEN true WHEN value > 50 THEN false END AS flag, TRY_CAST(CASE WHEN value > 10 THEN round(value) END AS SMALLINT) AS small, TRY_CAST(CASE WHEN id % 2 = 0 THEN value END AS DOUBLE) AS number FROM m""")
def q_cast_by_property_types(spark, sf):
    flag = F.when(F.col("value") > 100, "True").when(F.col("value") > 50, "False").otherwise("neither")
    small = F.when(F.col("value") > 10, F.round("value").cast("long").cast("string")).otherwise("few")
    df = measurements(spark, sf).select("event_id", flag.alias("flag"), small.alias("small"), F.when(F.col("id") % 2 == 0, F.col("value").cast("string")).otherwise("x").alias("number"))
    return k.cast_by_property_types(df, {"flag": "boolean", "small": "short", "number": "double"})


@query("SELECT event_id, id::varchar || CASE WHEN id % 2 = 0 THEN '' ELSE '.05' END AS value FROM m")
def q_normalize_number_strings(spark, sf):
    df = measurements(spark, sf).select("event_id", F.concat(F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ".000").otherwise(".05")).alias("value"))
    return k.normalize_number_strings(df)
