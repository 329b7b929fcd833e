"""Queries of resampling, interpolation, meters and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthline.operators import calibrate as c
from hearthline.operators import grid as g
from hearthline.operators import meters as e
from hearthline.plans.registry import measurements, query, rounded, table, wide

H12, DAY = 43_200, 86_400
#: Seconds of a chunk of a series: the tables' series are cut into several.
CHUNK = 7 * DAY


def _first(step: int, source: str = "m", keys: str = "id, property") -> str:
    """SQL of the full grid f with the first value of each bin."""
    us = step * 1_000_000
    return f"""b AS (SELECT {keys}, epoch_us(timestamp) // {us} * {us} AS b, arg_min(value, epoch_us(timestamp)) AS value FROM {source} WHERE value IS NOT NULL GROUP BY {keys}, b),
sp AS (SELECT {keys}, unnest(range(min(epoch_us(timestamp) // {us} * {us}), max(epoch_us(timestamp)) + 1, {us})) AS b FROM {source} GROUP BY {keys}),
f AS (SELECT {keys}, sp.b AS b, b.value FROM sp LEFT JOIN b USING ({keys}, b))"""


def _filled(step: int, limit: int | None, keys: str = "id, property") -> str:
    """SQL of l: the grid f with gaps filled, at most limit rows after a value."""
    cond = f"(b - p0) <= {limit * step * 1_000_000}" if limit is not None else "true"
    return f"""n AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN value IS NOT NULL THEN b END IGNORE NULLS) OVER a AS p0,
  first_value(value IGNORE NULLS) OVER z AS v1, first_value(CASE WHEN value IS NOT NULL THEN b END IGNORE NULLS) OVER z AS p1 FROM f
  WINDOW a AS (PARTITION BY {keys} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY {keys} ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT {keys}, b, CASE WHEN {cond} THEN CASE WHEN p1 IS NULL OR p1 = p0 THEN v0 ELSE v0 + (v1 - v0) * (b - p0) / (p1 - p0) END END AS value FROM n)"""


def _mean(step: int, keys: str = "id, property") -> str:
    us = step * 1_000_000
    return f"SELECT {keys}, make_timestamp(b // {us} * {us}) AS timestamp, round(avg(value) + 3e-9, 6) AS value FROM l GROUP BY {keys}, b // {us}"


@query(f"WITH {_first(H12)} SELECT id, property, make_timestamp(b) AS timestamp, value FROM f")
def q_resample_first(spark, sf):
    return g.resample_first(measurements(spark, sf), H12, chunk_s=CHUNK)


@query(f"""WITH {_first(DAY)}, s AS (SELECT id, property, epoch_us(timestamp) // 86400000000 * 86400000000 AS b, sum(value) AS value FROM m GROUP BY ALL)
SELECT id, property, make_timestamp(b) AS timestamp, round(coalesce(s.value, 0) + 3e-9, 6) AS value FROM sp LEFT JOIN s USING (id, property, b)""")
def q_resample_agg(spark, sf):
    return rounded(g.resample_agg(measurements(spark, sf), DAY, "add"))


_M3 = "m3 AS (SELECT * FROM m QUALIFY count(value) OVER (PARTITION BY id, property) > 2)"


@query(f"WITH {_M3}, {_first(H12, 'm3')}, {_filled(H12, 3)} {_mean(2 * DAY)}".replace("FROM m3", "FROM m3"))
def q_interpolate_time(spark, sf):
    return rounded(g.interpolate_time(measurements(spark, sf), H12, 2 * DAY, 3, chunk_s=CHUNK))


_GAP = """x AS (SELECT id, timestamp, click, click IS NOT NULL AND view IS NOT NULL AS ok, row_number() OVER (PARTITION BY id ORDER BY timestamp) AS i FROM w),
y AS (SELECT *, sum(ok::int) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM x), z AS (SELECT *, count_if(NOT ok) OVER (PARTITION BY id, g) AS gap,
 last_value(click IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN click IS NOT NULL THEN i END IGNORE NULLS) OVER a AS p0, first_value(click IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN click IS NOT NULL THEN i END IGNORE NULLS) OVER b AS p1
 FROM y WINDOW a AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT id, timestamp, round(CASE WHEN click IS NOT NULL THEN click WHEN NOT ok AND gap <= 2 AND p0 IS NOT NULL AND p1 IS NOT NULL THEN v0 + (v1 - v0) * (i - p0) / (p1 - p0) END + 3e-9, 6) AS click FROM z"""


@query("WITH " + _GAP)
def q_interpolate_gap_limit(spark, sf):
    return rounded(g.interpolate_gap_limit(wide(spark, sf).select("id", "timestamp", "click", "view"), ["click", "view"], ["click"], 2).drop("view"))


@query("""WITH x AS (SELECT id, property, round_even((epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY id, property ORDER BY timestamp))) / 60e6, 0)::bigint AS gap FROM m),
k AS (SELECT id, property, gap, count(*) AS k FROM x WHERE gap IS NOT NULL GROUP BY ALL), o AS (SELECT id, property, gap FROM k QUALIFY row_number() OVER (PARTITION BY id, property ORDER BY k DESC, gap) = 1),
n AS (SELECT id, property, count(*) AS n FROM m GROUP BY ALL)
SELECT id, property, n, CASE WHEN n > 2 THEN gap END AS modal_interval__min, CASE WHEN n > 2 THEN gcd(gap, 60) END AS upsample__min, CASE WHEN n > 2 THEN greatest(floor(60 / gcd(gap, 60)) - 1, 1)::bigint END AS "limit", CASE WHEN n <= 2 THEN 'Ignoring' END AS note
FROM n LEFT JOIN o USING (id, property)""")
def q_sample_intervals(spark, sf):
    return g.sample_intervals(measurements(spark, sf), 60)


_CLOCK = "wx AS (SELECT id, 'temp' AS property, date_trunc('hour', timestamp) AS timestamp, avg(value) AS value FROM m WHERE property = 'click' GROUP BY 1, 3), wx3 AS (SELECT * FROM wx QUALIFY count(value) OVER (PARTITION BY id) > 2)"


@query(f"WITH {_CLOCK}, {_first(900, 'wx3')}, {_filled(900, None)} SELECT id, make_timestamp(b // 21600000000 * 21600000000) AS timestamp, round(avg(value) + 3e-9, 6) AS temp FROM l GROUP BY id, b // 21600000000")
def q_weather_resample(spark, sf):
    hour = F.date_trunc("HOUR", "timestamp").cast("timestamp_ntz").alias("timestamp")
    hourly = measurements(spark, sf).where("property = 'click'").groupBy("id", hour).agg(F.avg("value").alias("temp"))
    return rounded(g.weather_resample(hourly, {"temp": 1.0}, 21_600))


@query("SELECT id, timestamp, round(click - view * 2 / 3 + 3e-9, 6) AS value FROM w")
def q_effective_outdoor_temp(spark, sf):
    from hearthline.functions.physics import effective_outdoor_temperature

    return rounded(wide(spark, sf).select("id", "timestamp", effective_outdoor_temperature("click", "view").alias("value")))


@query("""WITH x AS (SELECT id, timestamp, sum(coalesce(click, 50) - 40) OVER o AS e, sum(coalesce(view, 1)) OVER o AS g FROM w WINDOW o AS (PARTITION BY id ORDER BY timestamp ROWS UNBOUNDED PRECEDING)),
y AS (SELECT id, timestamp, epoch(timestamp) - epoch(lag(timestamp) OVER o) AS dt, e - lag(e) OVER o AS de, g - lag(g) OVER o AS dg FROM x WINDOW o AS (PARTITION BY id ORDER BY timestamp))
SELECT id, timestamp, round(CASE WHEN de >= 0 THEN de * 3.6e6 / dt END + 3e-9, 3) AS e_use__W, round(CASE WHEN dg >= 0 THEN dg * 35.17e6 / dt END + 3e-9, 3) AS g_use_hhv__W FROM y""")
def q_cumulative_to_power(spark, sf):
    w = Window.partitionBy("id").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    df = wide(spark, sf).select("id", "timestamp", F.sum(F.coalesce("click", F.lit(50)) - 40).over(w).alias("e_use_cum__kWh"), F.sum(F.coalesce("view", F.lit(1))).over(w).alias("g_use_cum__m3"))
    return rounded(e.cumulative_to_power(df), 3)


@query("""WITH x AS (SELECT o_custkey AS id, o_orderkey, o_orderdate AS timestamp, o_totalprice AS v, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders),
y AS (SELECT *, v - lag(v) OVER (PARTITION BY id ORDER BY timestamp, o_orderkey) AS d2 FROM x WHERE d >= 0)
SELECT id, o_orderkey, timestamp, round(sum(CASE WHEN d2 > 0 THEN d2 ELSE 0 END) OVER (PARTITION BY id ORDER BY timestamp, o_orderkey ROWS UNBOUNDED PRECEDING) + 3e-9, 3) AS value FROM y""")
def q_meter_reading_repair(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("value"))
    return rounded(e.meter_reading_repair(df, keys=("id",), tie=("o_orderkey",), chunk_s=100 * DAY), 3)


@query("""WITH x AS (SELECT id, event_id, timestamp, row_number() OVER (PARTITION BY id ORDER BY timestamp) AS i, CASE WHEN event_id % 6 IN (0, 1, 2) THEN epoch_us(date_trunc('second', timestamp)) - CASE event_id % 6 WHEN 0 THEN 3600000000 WHEN 1 THEN 7200000000 ELSE 3600000000 END END AS u FROM m),
y AS (SELECT *, last_value(u IGNORE NULLS) OVER a AS u0, last_value(CASE WHEN u IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, first_value(u IGNORE NULLS) OVER b AS u1, first_value(CASE WHEN u IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1 FROM x
  WINDOW a AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
z AS (SELECT id, event_id, i, round(coalesce(u, CASE WHEN i - i0 <= 2 THEN coalesce(u0 + (u1 - u0)::double * (i - i0) / (i1 - i0), u0) END))::bigint AS t FROM y)
SELECT id, event_id, make_timestamp(t // 1000000 * 1000000) AS timestamp FROM z WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY i) = 1""")
def q_meter_timestamp_parse(spark, sf):
    k = F.col("event_id") % 6
    text = F.date_format("timestamp", "yyMMddHHmmss")
    df = measurements(spark, sf).withColumn("telegram", F.when(k == 0, F.concat(text, F.lit("W"))).when(k == 1, F.concat(text, F.lit("S"))).when(k == 2, text).otherwise("garbage"))
    return e.meter_timestamp_parse(df, "telegram").select("id", "event_id", F.date_trunc("SECOND", "timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("""WITH x AS (SELECT id, event_id, TIMESTAMP '2024-10-26 22:00:00' + to_microseconds(epoch_us(timestamp) // 1000000 * 1000000 % 21600000000) AS u FROM m),
l AS (SELECT *, u + CASE WHEN u < TIMESTAMP '2024-10-27 01:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS l FROM x),
d AS (SELECT id, l, u, CASE WHEN l >= TIMESTAMP '2024-10-27 02:00:00' AND l < TIMESTAMP '2024-10-27 03:00:00' THEN 1 ELSE 0 END AS twice FROM l),
f AS (SELECT *, CASE WHEN twice = 1 AND l < lag(l) OVER (PARTITION BY id, twice ORDER BY u) THEN 1 ELSE 0 END AS fell FROM d),
g AS (SELECT *, sum(fell) OVER (PARTITION BY id, twice ORDER BY u ROWS UNBOUNDED PRECEDING) AS passes FROM f)
SELECT DISTINCT id, l - CASE WHEN twice = 1 AND passes = 0 OR l < TIMESTAMP '2024-10-27 02:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS timestamp FROM g""")
def q_doubled_hour(spark, sf):
    """Every event in the six hours around the end of summer time, read from clocks that show local time without a sign."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', timestamp) div 1000000 * 1000000 % 21600000000")
    df = measurements(spark, sf).select("id", F.timestamp_add("MICROSECOND", us, F.lit("2024-10-26 22:00:00").cast("timestamp")).alias("timestamp"))
    df = df.withColumn("telegram", F.date_format(F.from_utc_timestamp("timestamp", "Europe/Amsterdam"), "yyMMddHHmmss"))
    return e.meter_timestamp_parse(df, "telegram").select("id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


_K3 = "k3 AS (SELECT id, property, timestamp, CASE WHEN sd > 0 AND abs(value - mu) / sd > 2 THEN NULL ELSE value END AS value FROM (SELECT *, avg(value) OVER (PARTITION BY id) AS mu, stddev_pop(value) OVER (PARTITION BY id) AS sd FROM (SELECT id, property, timestamp, CASE WHEN value BETWEEN 5 AND 300 THEN value END AS value FROM m WHERE property = 'click'))), k4 AS (SELECT * FROM k3 QUALIFY count(value) OVER (PARTITION BY id) > 2)"


@query(f"WITH {_K3}, {_first(H12, 'k4')}, {_filled(H12, 3)} {_mean(DAY)}")
def q_property_preprocess(spark, sf):
    df = measurements(spark, sf).where("property = 'click'").select("id", "property", "timestamp", "value")
    return rounded(e.property_preprocess(df, H12, DAY, 3, 5, 300, 2))


_HOME = f"hm AS (SELECT id, property, timestamp, CASE WHEN property = 'click' AND (value < 5 OR value > 300) THEN NULL ELSE value END AS value FROM m WHERE property IN ('click', 'view')), hm3 AS (SELECT * FROM hm QUALIFY count(value) OVER (PARTITION BY id, property) > 2), {_first(DAY, 'hm3')}, {_filled(DAY, 2)}"


@query(f"""WITH {_HOME}, nat AS (SELECT date_trunc('day', timestamp) AS timestamp, avg(value) AS temp FROM m GROUP BY 1),
h AS (SELECT l.id, make_timestamp(b) AS timestamp, max(value) FILTER (property = 'click') AS click, max(value) FILTER (property = 'view') AS view, any_value(temp) AS temp FROM l JOIN nat ON nat.timestamp = make_timestamp(b) GROUP BY 1, 2),
i AS (SELECT *, coalesce(epoch(lead(timestamp) OVER (PARTITION BY id ORDER BY timestamp)) - epoch(timestamp), 0) AS s FROM h)
SELECT id, timestamp, round(click + 3e-9, 6) AS click, round(temp + 3e-9, 6) AS temp, round(s + 3e-9, 6) AS interval__s, round(CASE WHEN s > 0 THEN (view + click) * 3.6e6 / s END + 3e-9, 6) AS e_use__W FROM i""")
def q_home_dataset(spark, sf):
    from hearthline.plans.tables import national

    weather = national(spark, sf).select("timestamp", F.col("value").alias("temp"))
    m = measurements(spark, sf)
    # the same uses by two names: the high tariff's column goes into the power, the other stays
    m = m.unionByName(m.where("property = 'click'").withColumn("property", F.lit("click_hi")))
    out = e.home_dataset(m, {"click": {"limit": 2, "low": 5, "high": 300}, "click_hi": {"limit": 2, "low": 5, "high": 300}, "view": {"limit": 2}}, DAY, weather, {"e_use__W": (["view", "click_hi"], 3.6e6)})
    return rounded(out)


_ROOM = """rk AS (SELECT id, source_type, timestamp, CASE WHEN value >= 5 THEN value END AS value FROM m WHERE property = 'view'),
rs AS (SELECT *, stddev_samp(value) OVER (PARTITION BY id, source_type) AS sd FROM rk), rb AS (SELECT id, source_type, timestamp, CASE WHEN NOT coalesce(sd = 0, false) THEN value END AS value FROM rs),
ra AS (SELECT id, source_type, timestamp, value + (416.0 - min(value) OVER (PARTITION BY id, source_type)) AS value FROM rb), r3 AS (SELECT * FROM ra QUALIFY count(value) OVER (PARTITION BY id, source_type) > 2)"""


@query(f"""WITH {_ROOM}, {_first(900, 'r3', 'id, source_type')}, {_filled(900, 5, 'id, source_type')}, rm AS ({_mean(DAY, 'id, source_type')}), nat AS (SELECT date_trunc('day', timestamp) AS timestamp, avg(value) AS temp FROM m GROUP BY 1)
SELECT id, rm.timestamp, max(value) FILTER (source_type = 's0') AS s0_co2, max(value) FILTER (source_type = 's1') AS s1_co2, round(any_value(temp) + 3e-9, 6) AS temp FROM rm JOIN nat USING (timestamp) GROUP BY id, rm.timestamp""")
def q_room_preprocess(spark, sf):
    from hearthline.plans.tables import national

    df = measurements(spark, sf).where("property = 'view'").select("id", "source_type", "timestamp", F.col("value").alias("co2"))
    weather = national(spark, sf).select("timestamp", F.col("value").alias("temp"))
    return rounded(e.room_dataset(e.room_preprocess(df, "co2", DAY), ["co2"], ["s0", "s1"], weather))


# ---- calibration

_FACTORS = """d AS (SELECT id, date_trunc('day', timestamp) AS day, source_type, avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM m GROUP BY ALL),
y AS (SELECT a.id, a.m AS mean_a, a.s AS std_a, b.m AS mean_b, b.s AS std_b FROM d a JOIN d b ON a.id = b.id AND a.day = b.day WHERE a.source_type = 's0' AND b.source_type = 's1' AND a.n >= 2 AND b.n >= 2),
k AS (SELECT id, avg(mean_a) AS mean_a, avg(std_a) AS std_a, avg(mean_b) AS mean_b, avg(std_b) AS std_b FROM y GROUP BY id)"""


def _factors(spark, sf):
    return c.calibration_factors(measurements(spark, sf), "value", "s0", "s1", 2, F.to_date("timestamp"))


@query(f"WITH {_FACTORS} SELECT id, round(mean_a + 3e-9, 6) AS mean_a, round(std_a + 3e-9, 6) AS std_a, round(mean_b + 3e-9, 6) AS mean_b, round(std_b + 3e-9, 6) AS std_b FROM k")
def q_calibration_factors(spark, sf):
    return rounded(_factors(spark, sf))


@query(f"""WITH {_FACTORS} SELECT event_id, source_type, round(value + 3e-9, 6) AS value FROM m
UNION ALL SELECT event_id, 's0_calibrated', round((value - mean_a) / std_a * std_b + mean_b + 3e-9, 6) FROM m LEFT JOIN k USING (id) WHERE source_type = 's0'""")
def q_create_calibrated(spark, sf):
    return rounded(c.create_calibrated(measurements(spark, sf), _factors(spark, sf), "value", "s0").select("event_id", "source_type", "value"))


@query("SELECT event_id, round(value + (416.0 - min(value) OVER (PARTITION BY id, source_type)) + 3e-9, 6) AS value FROM m")
def q_co2_baseline_adjust(spark, sf):
    return rounded(c.co2_baseline_adjust(measurements(spark, sf), "value", 415.0, 1.0).select("event_id", "value"))
