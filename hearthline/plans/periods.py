"""Queries of runs, periods and interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import islands as k
from hearthline.plans.registry import measurements, query, rounded, table, wide

TIE = ("event_id",)
#: Seconds of a chunk of a series: the month of the table is cut into several.
CHUNK = 5 * 86_400

#: Runs of samples over 50 in SQL, by the difference of two row numbers.
_RUNS = """o AS (SELECT *, row_number() OVER (PARTITION BY id, property ORDER BY timestamp, event_id) AS a FROM m),
h AS (SELECT *, a - row_number() OVER (PARTITION BY id, property ORDER BY timestamp, event_id) AS g FROM o WHERE value > {0}),
p AS (SELECT id, property, g, min(timestamp) AS "start", max(timestamp) AS "end", count(*) AS n_samples FROM h GROUP BY ALL)"""


def _high(spark, sf, value=50.0, singles=False):
    return k.periods_by_value(measurements(spark, sf), ">", value, tie=TIE, singles=singles, chunk_s=CHUNK)


@query(f"""WITH {_RUNS.format(50)}, q AS (SELECT * FROM p WHERE n_samples > 1),
r AS (SELECT *, max("end") OVER (PARTITION BY id, property ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
s AS (SELECT *, sum(CASE WHEN epoch("start") - epoch(reach) > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY id, property ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS n FROM r),
c AS (SELECT id, property, n, min("start") AS "start", max("end") AS "end" FROM s GROUP BY ALL)
SELECT property, count(*) AS n_periods, round(sum(epoch("end") - epoch("start")), 1) AS total_s FROM c GROUP BY property""")
def q_high_value_periods(spark, sf):
    found = k.close_period_gaps(_high(spark, sf), 6 * 3600, ("id", "property"), CHUNK)
    return k.period_delta(found).groupBy("property").agg(F.count("*").alias("n_periods"), F.round(F.sum("duration_s"), 1).alias("total_s"))


@query(f'WITH {_RUNS.format(50)} SELECT id, property, "start", "end", n_samples FROM p WHERE n_samples > 1')
def q_periods_by_value(spark, sf):
    return _high(spark, sf)


_STEPS = """s AS (SELECT *, lag(value) OVER x AS v0, lag(timestamp) OVER x AS t0, row_number() OVER x AS a FROM m WINDOW x AS (PARTITION BY id, property ORDER BY timestamp, event_id)),
h AS (SELECT *, a - row_number() OVER (PARTITION BY id, property ORDER BY timestamp, event_id) AS g FROM s WHERE {0})
SELECT id, property, min(t0) AS "start", max(timestamp) AS "end", count(*) AS n_steps FROM h GROUP BY id, property, g"""


@query("WITH " + _STEPS.format("value > v0"))
def q_periods_relative(spark, sf):
    return k.periods_relative(measurements(spark, sf), ">", tie=TIE, chunk_s=CHUNK)


@query("WITH " + _STEPS.format("abs(value - v0) < 20 AND epoch(timestamp) - epoch(t0) < 604800"))
def q_periods_custom(spark, sf):
    near = lambda a, b, ta, tb: (F.abs(b - a) < 20) & (k.seconds_between(ta, tb) < 604_800)
    return k.periods_custom(measurements(spark, sf), near, tie=TIE, chunk_s=CHUNK)


@query(f"""WITH {_RUNS.format(20)}, q AS (SELECT * FROM p),
r AS (SELECT *, max("end") OVER (PARTITION BY id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
s AS (SELECT *, sum(CASE WHEN epoch("start") - epoch(reach) > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT id, min("start") AS "start", max("end") AS "end" FROM s GROUP BY id, n""")
def q_close_period_gaps(spark, sf):
    return k.close_period_gaps(_high(spark, sf, 20.0, True), 3600, chunk_s=CHUNK)


@query(f"""WITH {_RUNS.format(100)}, u AS (SELECT id, "start", "end" FROM p WHERE property = 'click' UNION ALL SELECT id, "start", "end" FROM p WHERE property = 'view'),
r AS (SELECT *, max("end") OVER (PARTITION BY id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
s AS (SELECT *, sum(CASE WHEN "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT id, min("start") AS "start", max("end") AS "end" FROM s GROUP BY id, n""")
def q_periods_union(spark, sf):
    p = _high(spark, sf, 100.0, True)
    return k.periods_union(p.where("property = 'click'"), p.where("property = 'view'"))


@query(f"""WITH {_RUNS.format(50)} SELECT a.id, greatest(a."start", b."start") AS "start", least(a."end", b."end") AS "end"
FROM p a JOIN p b ON a.id = b.id AND a."start" <= b."end" AND b."start" <= a."end" WHERE a.property = 'click' AND b.property = 'view'""")
def q_periods_intersect(spark, sf):
    p = _high(spark, sf, 50.0, True)
    return k.periods_intersect(p.where("property = 'click'"), p.where("property = 'view'"))


@query(f'WITH {_RUNS.format(100)} SELECT id, property, "start" - INTERVAL 3600 SECOND AS "start", "end" + INTERVAL 3600 SECOND AS "end" FROM p WHERE n_samples > 1')
def q_period_extend(spark, sf):
    return k.period_extend(_high(spark, sf, 100.0), 3600).drop("n_samples")


@query(f'WITH {_RUNS.format(100)} SELECT id, property, "start" + INTERVAL 3600 SECOND AS "start", "end" - INTERVAL 3600 SECOND AS "end" FROM p WHERE n_samples > 1')
def q_period_shrink(spark, sf):
    return k.period_shrink(_high(spark, sf, 100.0), 3600).drop("n_samples")


@query(f'WITH {_RUNS.format(100)} SELECT id, property, "start", round((epoch_us("end") - epoch_us("start")) / 1e6 + 3e-9, 6) AS duration_s FROM p WHERE n_samples > 1')
def q_period_delta(spark, sf):
    return rounded(k.period_delta(_high(spark, sf, 100.0)).drop("end", "n_samples"))


@query(f"""WITH {_RUNS.format(100)}, o2 AS (SELECT id, property, CASE WHEN id % 7 = 0 THEN NULL ELSE "start" END AS "start", CASE WHEN id % 5 = 0 THEN NULL ELSE "end" END AS "end" FROM p WHERE n_samples > 1)
SELECT *, row_number() OVER (PARTITION BY id ORDER BY "start" ASC NULLS FIRST, "end" ASC NULLS LAST, property)::int AS place FROM o2""")
def q_period_order(spark, sf):
    p = _high(spark, sf, 100.0).withColumns({"start": F.when(F.col("id") % 7 != 0, F.col("start")), "end": F.when(F.col("id") % 5 != 0, F.col("end"))}).drop("n_samples")
    return p.withColumn("place", F.row_number().over(k.Window.partitionBy("id").orderBy(*k.period_order(p), "property")))


@query("""WITH x AS (SELECT *, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING)::bigint AS island FROM m)
SELECT event_id, id, island FROM x WHERE value >= 50""")
def q_filtered_islands(spark, sf):
    df = measurements(spark, sf).withColumn("ok", F.col("value") >= 50)
    return k.filtered_islands(df, "ok", tie=TIE, chunk_s=CHUNK).select("event_id", "id", "island")


@query("""WITH x AS (SELECT *, value > 50 AS f, lag(value > 50) OVER (PARTITION BY id ORDER BY timestamp, event_id) AS pf FROM m)
SELECT event_id, sum(CASE WHEN pf IS DISTINCT FROM f THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING)::bigint AS streak_id FROM x""")
def q_streak_ids(spark, sf):
    return k.streak_ids(measurements(spark, sf).withColumn("f", F.col("value") > 50), "f", tie=TIE, chunk_s=CHUNK).select("event_id", "streak_id")


_SANE = """x AS (SELECT m.*, {0} AS g, value > 20 AS f, coalesce(epoch_us(lead(timestamp) OVER o) - epoch_us(timestamp), 0) / 1e6 AS len, row_number() OVER o - row_number() OVER q AS r
FROM m WINDOW o AS (PARTITION BY id, {0} ORDER BY timestamp, event_id), q AS (PARTITION BY id, {0}, value > 20 ORDER BY timestamp, event_id)),
s AS (SELECT id, g, min(timestamp) AS "start", max(timestamp) AS "end", sum(len) AS len, count(*) AS n FROM x WHERE f GROUP BY id, g, r),
t AS (SELECT *, sum(n) OVER (PARTITION BY id, g) AS total, row_number() OVER (PARTITION BY id, g ORDER BY len DESC, "start") AS k FROM s)
SELECT id, {1} "start", "end", round((epoch_us("end") - epoch_us("start")) / 1e6 + 3e-9, 6) AS duration_s FROM t WHERE k = 1 AND total >= 2 AND epoch_us("end") - epoch_us("start") >= {2} * 1e6"""


@query("WITH " + _SANE.format("0", "", 86400))
def q_longest_sane_streak(spark, sf):
    df = measurements(spark, sf).withColumn("sane", F.col("value") > 20)
    return rounded(k.longest_sane_streak(df, "sane", threshold_s=86_400, tie=TIE))


_WINDOW = 'floor((epoch_us(timestamp) - (SELECT min(epoch_us(timestamp)) FROM m)) / (7 * 86400 * 1e6))::bigint'


@query("WITH " + _SANE.format(_WINDOW, 'g AS "window",', 43200))
def q_periodic_learn_list(spark, sf):
    return rounded(k.periodic_learn_list(measurements(spark, sf).withColumn("sane", F.col("value") > 20), "sane", 7, 43_200))


@query("""WITH x AS (SELECT id, timestamp, lag(timestamp) OVER (PARTITION BY id ORDER BY timestamp) AS p FROM w WHERE click IS NOT NULL),
y AS (SELECT *, sum(CASE WHEN epoch(timestamp) - epoch(p) > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS r FROM x),
z AS (SELECT id, min(timestamp) AS "start", max(timestamp) AS "end" FROM y GROUP BY id, r)
SELECT *, epoch("end") - epoch("start") AS duration_s FROM z WHERE epoch("end") - epoch("start") >= 86400""")
def q_valid_learn_list(spark, sf):
    return k.valid_learn_list(wide(spark, sf), ["click"], 86_400, 86_400)


def weeks(spark, sf):
    """A job for each id and week."""
    return k.weekly_slices(measurements(spark, sf)).select("id", "start", k.shifted("start", 604_800).alias("end"))


_WEEKS = """d AS (SELECT id, date_trunc('day', min(timestamp)) AS day FROM m GROUP BY id),
sl AS (SELECT m.id, floor((epoch(timestamp) - epoch(day)) / 604800)::bigint AS slice, max(timestamp) AS last, any_value(day) AS day FROM m JOIN d USING (id) GROUP BY m.id, slice),
weeks AS (SELECT id, slice, day + slice * INTERVAL 7 DAY AS "start", last FROM sl WHERE epoch(last) - epoch(day + slice * INTERVAL 7 DAY) >= 86400)"""


@query(f"WITH {_WEEKS} SELECT * FROM weeks")
def q_weekly_slices(spark, sf):
    return k.weekly_slices(measurements(spark, sf))


@query(f'WITH {_WEEKS} SELECT m.id, m.event_id, weeks."start" FROM m JOIN weeks ON m.id = weeks.id AND m.timestamp >= weeks."start" AND m.timestamp < weeks."start" + INTERVAL 7 DAY')
def q_job_rows(spark, sf):
    return k.job_rows(measurements(spark, sf), weeks(spark, sf)).select("id", "event_id", "start")


_INFO = """x AS (SELECT id, timestamp, epoch(timestamp) - epoch(lag(timestamp) OVER (PARTITION BY id ORDER BY timestamp)) AS step FROM w),
i AS (SELECT id, min(timestamp) AS "start", max(timestamp) AS "end", min(step) AS step__s, min(step) = max(step) AS regular, count(*) AS n_rows FROM x GROUP BY id)"""


@query(f"WITH {_INFO} SELECT *, step__s * n_rows AS duration_s FROM i")
def q_time_info(spark, sf):
    return k.time_info(wide(spark, sf))


@query(f"WITH {_INFO} SELECT CASE WHEN bool_and(regular) AND min(step__s) = max(step__s) THEN min(step__s) END AS step__s FROM i WHERE step__s IS NOT NULL")
def q_consistent_interval(spark, sf):
    return k.consistent_interval(wide(spark, sf))


@query("""WITH x AS (SELECT id, timestamp, click IS NOT NULL AS f, coalesce(epoch(lead(timestamp) OVER o) - epoch(timestamp), 0) AS len, row_number() OVER o - row_number() OVER q AS r
FROM w WINDOW o AS (PARTITION BY id ORDER BY timestamp), q AS (PARTITION BY id, click IS NOT NULL ORDER BY timestamp)),
s AS (SELECT id, sum(len) AS len FROM x WHERE f GROUP BY id, r)
SELECT id, """ + ", ".join(f'sum(len) FILTER (len > {lo}{f" AND len <= {hi}" if hi else ""}) AS "{n}"' for (n, hi), lo in zip(k.DURATION_BINS.items(), [60, 300, 600, 900, 1800, 3600, 86400, 604800, 2592000])) + " FROM s WHERE len > 60 GROUP BY id")
def q_streak_durations(spark, sf):
    return k.streak_durations(wide(spark, sf), "click")


@query("SELECT event_id, coalesce(epoch_us(lead(timestamp) OVER (PARTITION BY id ORDER BY timestamp, event_id)) - epoch_us(timestamp), 0) / 1e6 AS interval__s FROM m")
def q_interval_seconds(spark, sf):
    return k.interval_seconds(measurements(spark, sf), tie=TIE).select("event_id", "interval__s")


@query("""WITH x AS (SELECT id, timestamp, click > 80 AS s, view AS e, coalesce(lag(click > 80) OVER o, false) AS b, coalesce(lead(click > 80) OVER o, false) AS a FROM w WINDOW o AS (PARTITION BY id ORDER BY timestamp)), SEL AS (SELECT
""".replace(", SEL AS (SELECT", " SELECT") + ", ".join(f"round({f}(e) FILTER ({c}) + 3e-9, 6) AS {g}_{n}" for n, c in {"before_on": "NOT s AND a", "after_on": "s AND NOT b", "before_off": "s AND NOT a", "after_off": "NOT s AND b"}.items() for g, f in (("mean", "avg"), ("median", "median"))) + " FROM x")
def q_state_transitions(spark, sf):
    df = wide(spark, sf).withColumn("on", F.col("click") > 80)
    return rounded(k.state_transitions(df, "on", "view"))


@query("""WITH x AS (SELECT id, timestamp, CASE WHEN click < 60 THEN true WHEN click > 100 THEN false END AS ev FROM w)
SELECT id, timestamp, last_value(ev IGNORE NULLS) OVER (PARTITION BY id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS "on" FROM x""")
def q_hysteresis_state(spark, sf):
    df = wide(spark, sf).withColumn("target", F.lit(80.0))
    return k.hysteresis_state(df, "click", "target", 20, 20).select("id", "timestamp", "on")


@query("""WITH x AS (SELECT *, coalesce(error > 80, false) AS opens, coalesce(purchase > 150, false) OR (coalesce(signup > 120, false) AND NOT coalesce(error > 80, false))
  OR coalesce(click - lag(click) OVER o > 60, false) OR coalesce(view - lag(view) OVER o > 60, false) AS closes FROM w WINDOW o AS (PARTITION BY id ORDER BY timestamp)),
y AS (SELECT *, last_value(CASE WHEN opens AND NOT closes THEN 1 WHEN closes AND NOT opens THEN -1 END IGNORE NULLS) OVER (PARTITION BY id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS st FROM x)
SELECT id, timestamp, round(CASE WHEN st = 1 AND coalesce(signup IS NOT NULL, false) THEN click END + 3e-9, 6) AS ch_click, round(CASE WHEN st = 1 AND signup IS NOT NULL THEN view END + 3e-9, 6) AS ch_view FROM y""")
def q_ch_temperature_mask(spark, sf):
    df = wide(spark, sf).withColumns({"ch": F.col("error") > 80, "dhw": F.col("purchase") > 150, "speed": F.when(F.col("signup") > 120, 100).when(F.col("signup").isNotNull(), 50)})
    return rounded(k.ch_temperature_mask(df, "click", "view", "ch", "dhw", "speed", 60, order=("timestamp",)).select("id", "timestamp", "ch_click", "ch_view"))


@query("""WITH x AS (SELECT *, click IS NOT NULL AND view IS NOT NULL AS ok FROM w),
y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp) - row_number() OVER (PARTITION BY id, ok ORDER BY timestamp) AS r FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY id, ok, r ORDER BY timestamp) AS i, count(*) OVER (PARTITION BY id, ok, r) AS n FROM y)
SELECT id, timestamp, round(CASE WHEN ok AND n >= 3 AND i > 1 AND i <= n - 1 THEN click END + 3e-9, 6) AS click, round(CASE WHEN ok AND n >= 3 AND i > 1 AND i <= n - 1 THEN view END + 3e-9, 6) AS view FROM z""")
def q_clip_streak_edges(spark, sf):
    return rounded(k.clip_streak_edges(wide(spark, sf).select("id", "timestamp", "click", "view"), ["click", "view"], 1, 1, 3))


@query("SELECT id, timestamp, round(CASE WHEN view > error THEN 0 ELSE coalesce(lead(click) OVER (PARTITION BY id ORDER BY timestamp), click) END + 3e-9, 6) AS flow_set_proxy FROM w")
def q_setpoint_proxy(spark, sf):
    return rounded(k.setpoint_proxy(wide(spark, sf), "click", "view", "error").select("id", "timestamp", "flow_set_proxy"))


@query("""WITH j AS (SELECT o_custkey AS id, o_orderkey, o_orderdate FROM orders) SELECT id, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY id ORDER BY o_orderdate, o_orderkey)::int AS number FROM j""")
def q_sequence_number(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderdate")
    return df.withColumn("number", F.row_number().over(k.Window.partitionBy("id").orderBy("o_orderdate", "o_orderkey")))
