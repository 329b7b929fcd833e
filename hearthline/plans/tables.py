"""Queries of joins, pivots, counts and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import pivot as p
from hearthline.operators import stats as s
from hearthline.plans.periods import _WEEKS, weeks
from hearthline.plans.registry import PROPERTIES, measurements, query, rounded, table, wide

P = PROPERTIES
#: Groups of more values are told in bins: the tables' groups are.
LARGE = 300


@query("SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events")
def q_dedup_rows(spark, sf):
    return p.dedup_rows(table(spark, sf, "events").select("user_id", "event_type", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour")))


@query("SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id, property ORDER BY timestamp, event_id) = 1")
def q_dedup_on_key(spark, sf):
    return p.dedup_on_key(measurements(spark, sf), ["id", "property"], ["timestamp", "event_id"])


@query("SELECT event_id, value FROM m WHERE property = 'click' UNION ALL SELECT event_id, value FROM m WHERE property = 'view'")
def q_concat_measurements(spark, sf):
    m = measurements(spark, sf).select("event_id", "value", "property")
    return p.concat_measurements(m.where("property = 'click'"), m.where("property = 'view'")).drop("property")


@query("SELECT DISTINCT id, property FROM m WHERE value > 100 UNION SELECT DISTINCT id, property FROM m WHERE value < 1")
def q_union_distinct(spark, sf):
    m = measurements(spark, sf)
    return p.dedup_rows(p.concat_measurements(*(m.where(c).select("id", "property") for c in ("value > 100", "value < 1"))))


@query("SELECT id, source_category, source_type, timestamp, " + ", ".join(f"min(value) FILTER (property = '{x}') AS {x}" for x in P) + " FROM m GROUP BY ALL")
def q_to_properties(spark, sf):
    return p.to_properties(measurements(spark, sf), P)


@query("SELECT id, date_trunc('day', timestamp) AS timestamp, " + ", ".join(f"round(avg(value) FILTER (source_type = '{t}' AND source_category = '{c}') + 3e-9, 6) AS {c}_{t}_value" for c in ("cloud_feed", "device") for t in ("s0", "s1")) + " FROM m GROUP BY 1, 2")
def q_unstack_source(spark, sf):
    m = measurements(spark, sf)
    day = F.date_trunc("DAY", "timestamp").cast("timestamp_ntz")
    return rounded(p.unstack_source(m.withColumn("timestamp", day), ["value"], [f"{c}_{t}" for c in ("cloud_feed", "device") for t in ("s0", "s1")], drop_empty=False))


@query("""WITH k AS (SELECT event_id, id, source_type AS property, property AS value FROM m WHERE source_type = 's1'), c AS (SELECT DISTINCT value AS c FROM k)
SELECT event_id, id, CASE c WHEN 'click' THEN 'tap_on_it' ELSE c END || '__bool' AS property, CASE WHEN value = c THEN 'True' ELSE 'False' END AS value FROM k, c
UNION ALL SELECT event_id, id, source_type, property FROM m WHERE source_type <> 's1'""")
def q_encode_categorical_bool(spark, sf):
    df = measurements(spark, sf).select("event_id", "id", F.col("source_type").alias("property"), F.col("property").alias("value"))
    return p.encode_categorical_bool(df, "s1", {"click": "Tap on it"})


@query("SELECT id, timestamp, round(click + 3e-9, 6) AS click, round(view + 3e-9, 6) AS view FROM w WHERE click > 100 OR view > 100".replace("round(click + 3e-9, 6)", "round(CASE WHEN click > 100 THEN click END + 3e-9, 6)").replace("round(view + 3e-9, 6)", "round(CASE WHEN view > 100 THEN view END + 3e-9, 6)"))
def q_outer_align_on_ts(spark, sf):
    w = wide(spark, sf)
    part = lambda c: w.where(F.col(c) > 100).select("id", "timestamp", F.col(c).alias("value"))
    return rounded(p.outer_align({c: part(c) for c in ("click", "view")}, ["id", "timestamp"]))


_NATIONAL = "n AS (SELECT date_trunc('day', timestamp) AS timestamp, 'hhv' AS property, avg(value) AS value FROM m GROUP BY 1)"


def national(spark, sf):
    """Daily means over all ids, as one series for the whole country: a row a day."""
    m = measurements(spark, sf)
    day = F.date_trunc("DAY", "timestamp").cast("timestamp_ntz")
    return m.groupBy(day.alias("timestamp")).agg(F.avg("value").alias("value")).select("timestamp", F.lit("hhv").alias("property"), "value")


@query(f"""WITH {_NATIONAL} SELECT i.id, 'batch_import' AS source_category, 'EDSN' AS source_type, timestamp, property, round(value + 3e-9, 6) AS value FROM (SELECT DISTINCT id FROM m) i, n
UNION ALL SELECT id, source_category, source_type, timestamp, property, round(value + 3e-9, 6) FROM m""")
def q_cross_join_broadcast_series(spark, sf):
    return rounded(p.cross_join_series(measurements(spark, sf).drop("event_id"), national(spark, sf), "batch_import", "EDSN"))


@query("""SELECT l_orderkey, l_linenumber, o_orderdate, c_name, n_name, r_name, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey""")
def q_star_join(spark, sf):
    t = lambda n: table(spark, sf, n)
    out = p.star_join(t("lineitem"), (t("orders"), "l_orderkey", "o_orderkey"), (t("customer"), "o_custkey", "c_custkey"), (t("nation"), "c_nationkey", "n_nationkey"), (t("region"), "n_regionkey", "r_regionkey"), (t("supplier"), "l_suppkey", "s_suppkey"))
    return out.select("l_orderkey", "l_linenumber", "o_orderdate", "c_name", "n_name", "r_name", "s_name")


@query("SELECT c_custkey, c_nationkey, n_name, s.n AS n_suppliers FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey")
def q_left_join_dims(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    k = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n_suppliers"))
    return p.left_join_dims(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), (n, ["c_nationkey"]), (k, ["c_nationkey"]))


@query("SELECT event_id, c_name FROM m JOIN customer ON c_custkey = m.id")
def q_inner_join_dims(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return measurements(spark, sf).join(c, "id").select("event_id", "c_name")


@query(f"WITH {_NATIONAL} SELECT id, timestamp, round(click + 3e-9, 6) AS click, round(n.value + 3e-9, 6) AS temp_outdoor FROM w JOIN n USING (timestamp)")
def q_merge_weather_on_ts(spark, sf):
    weather = national(spark, sf).select("timestamp", F.col("value").alias("temp_outdoor"))
    return rounded(wide(spark, sf).select("id", "timestamp", "click").join(weather, "timestamp"))


@query("SELECT w.id, w.timestamp, round(x.med + 3e-9, 6) AS med FROM w LEFT JOIN (SELECT id, median(click) AS med FROM w GROUP BY id HAVING median(click) > 60) x ON x.id = w.id")
def q_map_dictionary(spark, sf):
    w = wide(spark, sf)
    return rounded(w.select("id", "timestamp").join(w.groupBy("id").agg(F.median("click").alias("med")).where("med > 60"), "id", "left"))


@query("SELECT id, timestamp, round(CASE WHEN click > 50 THEN click * 2 END + 3e-9, 6) AS predicted_click FROM w")
def q_merge_predictions(spark, sf):
    w = wide(spark, sf).select("id", "timestamp", "click")
    new = w.where("click > 50").select("id", "timestamp", (F.col("click") * 2).alias("predicted_click"))
    return rounded(p.merge_predictions(w.withColumn("predicted_click", F.lit(0.0)), new, ["id", "timestamp"]).drop("click"))


@query("SELECT c_custkey AS id, c_nationkey, round(x.learned_h + 3e-9, 6) AS learned_h FROM customer LEFT JOIN (SELECT id, median(view) AS learned_h FROM w GROUP BY id) x ON x.id = c_custkey")
def q_merge_learned(spark, sf):
    homes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    learned = wide(spark, sf).groupBy("id").agg(F.median("view").alias("learned_h"))
    return rounded(p.merge_predictions(homes, learned, ["id"], "learned_"))


@query("SELECT c_custkey AS id, s_name, s_acctbal FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def q_location_expand(spark, sf):
    weather = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("place"), "s_name", "s_acctbal")
    homes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("place"))
    return p.locations_expand(weather, homes, ["place"])


_CHANGES = """c AS (SELECT id, timestamp AS changed, row_number() OVER (PARTITION BY id ORDER BY timestamp, event_id) AS number FROM m WHERE property = 'signup' AND value > 60)"""


@query(f"""WITH {_WEEKS}, {_CHANGES}, x AS (SELECT id, "start", "start" + INTERVAL 7 DAY AS "end" FROM weeks)
SELECT id, "start", "end", CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.id = x.id AND changed BETWEEN x."start" AND x."end") THEN (SELECT max(number) FROM c WHERE c.id = x.id AND changed <= x."start") END::int AS number FROM x""")
def q_asof_label_regime(spark, sf):
    c = measurements(spark, sf).where("property = 'signup' and value > 60")
    w = p.Window.partitionBy("id").orderBy("timestamp", "event_id")
    return p.asof_label_regime(weeks(spark, sf), c.select("id", F.col("timestamp").alias("changed"), F.row_number().over(w).alias("number")))


@query("""WITH c AS (SELECT id, event_id AS program, timestamp AS valid_from, coalesce(lead(timestamp) OVER (PARTITION BY id ORDER BY timestamp, event_id), TIMESTAMP '2100-12-31 00:00:00') AS valid_to FROM m WHERE property = 'signup')
SELECT m.event_id, c.program FROM m JOIN c ON m.id = c.id AND m.timestamp > c.valid_from AND m.timestamp <= c.valid_to WHERE m.property = 'click'""")
def q_valid_interval_lookup(spark, sf):
    from hearthline.operators.schedules import fill_valid_to

    m = measurements(spark, sf)
    programs = m.where("property = 'signup'").select("id", F.col("event_id").alias("program"), F.col("timestamp").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return p.valid_interval_lookup(m.where("property = 'click'"), fill_valid_to(programs, tie=("program",))).select("event_id", "program")


@query("SELECT * FROM m QUALIFY timestamp = max(timestamp) OVER (PARTITION BY id, property)")
def q_semi_latest_per_key(spark, sf):
    return p.latest_per_key(measurements(spark, sf), ["id", "property"])


@query("SELECT id, property, max_by(value, (timestamp, event_id)) AS value FROM m GROUP BY ALL")
def q_latest_per_key(spark, sf):
    return measurements(spark, sf).groupBy("id", "property").agg(F.max_by("value", F.struct("timestamp", "event_id")).alias("value"))


@query("SELECT event_id FROM m WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def q_semi_anti_by_id(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "id")
    return measurements(spark, sf).join(o.where("o_orderstatus = 'P'"), "id", "left_semi").join(o.where("o_totalprice > 400000"), "id", "left_anti").select("event_id")


@query("SELECT id, timestamp, round(click + 3e-9, 6) AS click_before, round(CASE WHEN click BETWEEN 20 AND 150 THEN click END + 3e-9, 6) AS click_after FROM w WHERE id % 2 = 0")
def q_index_align_inner(spark, sf):
    from hearthline.operators.mask import filter_min_max

    w = wide(spark, sf)
    return rounded(p.index_align_inner(w, filter_min_max(w.where("id % 2 = 0"), "click", 20, 150), ["id", "timestamp"], ["click"]))


# ---- statistics


@query("SELECT (SELECT count(*) FROM events WHERE event_type = 'click') + (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS n_measurements")
def q_count_total_measurements(spark, sf):
    return s.count_total([table(spark, sf, "events").where("event_type = 'click'"), table(spark, sf, "orders").where("o_orderstatus = 'P'")])


@query('SELECT id, source_type, min(timestamp) AS "first", max(timestamp) AS "last" FROM m GROUP BY ALL')
def q_min_max_time_per_source(spark, sf):
    return s.min_max_time(measurements(spark, sf), ["id", "source_type"])


@query("SELECT id, count(*) FILTER (source_type = 's0') AS s0, count(*) FILTER (source_type = 's1') AS s1 FROM m GROUP BY id")
def q_size_per_group(spark, sf):
    return s.size_per_group(measurements(spark, sf), ["id"], "source_type", ["s0", "s1"])


@query("""SELECT property, count(value) AS "count", round(avg(value) + 3e-9, 6) AS mean, round(stddev_samp(value) + 3e-9, 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25) + 3e-9, 6) AS p25, round(quantile_cont(value, 0.5) + 3e-9, 6) AS p50,
round(quantile_cont(value, 0.75) + 3e-9, 6) AS p75, max(value) AS max FROM m GROUP BY property""")
def q_describe_per_group(spark, sf):
    return rounded(s.describe_per_group(measurements(spark, sf), ["property"], "value", LARGE))


@query("SELECT id, property, round(var_samp(value) + 3e-9, 6) AS variance FROM m GROUP BY ALL")
def q_variance_per_id(spark, sf):
    return rounded(s.variance_per_id(measurements(spark, sf), ["id", "property"]))


@query("SELECT id, " + ", ".join(f"count({x}) AS {x}" for x in P) + ", " + " + ".join(f"count({x})" for x in P) + " AS total FROM w GROUP BY id")
def q_count_non_null(spark, sf):
    return s.count_non_null(wide(spark, sf), P)


@query("SELECT source_category, source_type, count(CASE WHEN value > 20 THEN value END) AS high, count(CASE WHEN value > 100 THEN value END) AS higher FROM m GROUP BY ALL")
def q_non_null_per_source(spark, sf):
    df = measurements(spark, sf).withColumns({"high": F.when(F.col("value") > 20, F.col("value")), "higher": F.when(F.col("value") > 100, F.col("value"))})
    return s.count_non_null(df, ["high", "higher"], ["source_category", "source_type"], None)


_COVER = " UNION ALL ".join(f"SELECT id, '{c}' AS p, timestamp FROM w WHERE {cond}" for c, cond in {"click": "click IS NOT NULL", "view": "view IS NOT NULL", "all_mandatory_props": "click IS NOT NULL AND view IS NOT NULL"}.items())


@query(f"""WITH v AS ({_COVER}), g AS (SELECT id, p, epoch(timestamp) - epoch(lag(timestamp) OVER (PARTITION BY id, p ORDER BY timestamp)) AS gap FROM v)
SELECT id, coalesce(sum(gap) FILTER (p = 'click' AND gap <= 172800), 0) AS click, coalesce(sum(gap) FILTER (p = 'view' AND gap <= 172800), 0) AS view,
coalesce(sum(gap) FILTER (p = 'all_mandatory_props' AND gap <= 172800), 0) AS all_mandatory_props, coalesce(sum(gap) FILTER (gap <= 172800), 0) AS total FROM g GROUP BY id""")
def q_covered_time(spark, sf):
    return s.covered_time(wide(spark, sf), ["click", "view"], 172_800, ["click", "view"])


@query("""WITH b AS (SELECT 'click' AS property, click > 60 AS v FROM w UNION ALL SELECT 'view', view > 60 FROM w)
SELECT property, count_if(v)::bigint AS n_true, count_if(NOT v)::bigint AS n_false, count_if(v IS NULL)::bigint AS n_missing, round(100 * count_if(v) / count(*), 2) AS pct_true, round(100 * count_if(NOT v) / count(*), 2) AS pct_false, round(100 * count_if(v IS NULL) / count(*), 2) AS pct_missing FROM b GROUP BY property""")
def q_boolean_summary(spark, sf):
    return s.boolean_summary(wide(spark, sf).select((F.col("click") > 60).alias("click"), (F.col("view") > 60).alias("view")), ["click", "view"])


@query("SELECT id, round(avg(CASE WHEN click < 50 THEN 1.0 WHEN click >= 50 THEN 0.0 END) + 3e-9, 6) AS share FROM w GROUP BY id")
def q_bool_share(spark, sf):
    return rounded(s.bool_share(wide(spark, sf), F.col("click") < 50, ["id"]))


@query("SELECT n_regionkey AS version, array_to_string(list_sort(list(DISTINCT c_custkey)), ',') AS ids FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def q_collect_ids_by_value(spark, sf):
    df = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").alias("version"), F.col("c_custkey").alias("id"))
    return s.collect_ids_by_value(df, "version").select("version", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("SELECT timestamp, round(avg(click) + 3e-9, 6) AS mean, round(stddev_samp(click) + 3e-9, 6) AS std FROM w GROUP BY timestamp")
def q_mean_std_by_dim(spark, sf):
    return rounded(s.mean_std_by(wide(spark, sf), ["timestamp"], "click"))


@query("""WITH p AS (SELECT id, id % 4 AS version, avg(click) AS a, avg(view) AS b FROM w GROUP BY id) SELECT version, round(avg(a / b) + 3e-9, 6) AS mean_ratio, count(*) AS n, round(sum(a) / sum(b) + 3e-9, 6) AS ratio_of_sums FROM p GROUP BY version""")
def q_two_level_ratio(spark, sf):
    return rounded(s.two_level_ratio(wide(spark, sf).withColumn("version", F.col("id") % 4), "id", "version", "click", "view"))


@query("SELECT id, round(avg(click) / avg(view) + 3e-9, 6) AS ratio FROM w WHERE click IS NOT NULL AND view IS NOT NULL GROUP BY id")
def q_ratio_of_means(spark, sf):
    return rounded(s.ratio_of_means(wide(spark, sf), ["id"], "click", "view"))


@query("""SELECT 'view' AS method, round(avg(view - click) + 3e-9, 6) AS mean_difference, round(sum(abs(view - click)) / sum(error) + 3e-9, 6) AS relative_difference FROM w
UNION ALL SELECT 'signup', round(avg(signup - click) + 3e-9, 6), round(sum(abs(signup - click)) / sum(error) + 3e-9, 6) FROM w""")
def q_method_comparison(spark, sf):
    return rounded(s.method_comparison(wide(spark, sf), "click", ["view", "signup"], "error"))


@query("SELECT id, round(avg(abs(click - view)) + 3e-9, 6) AS mae FROM w GROUP BY id")
def q_mae(spark, sf):
    return rounded(wide(spark, sf).groupBy("id").agg(s.mae("click", "view").alias("mae")))


@query("SELECT id, round(sqrt(avg((click - view) ** 2)) + 3e-9, 6) AS rmse FROM w GROUP BY id")
def q_rmse(spark, sf):
    return rounded(wide(spark, sf).groupBy("id").agg(s.rmse("click", "view").alias("rmse")))


@query("""WITH r AS (SELECT id, CASE WHEN count(click) OVER x = 3 THEN avg(click) OVER x END AS a, CASE WHEN count(view) OVER x = 3 THEN avg(view) OVER x END AS b FROM w WINDOW x AS (PARTITION BY id ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT id, round(avg(abs(a - b)) + 3e-9, 6) AS rmae FROM r GROUP BY id""")
def q_rmae(spark, sf):
    return rounded(s.rmae(wide(spark, sf), "click", "view", 3, ["id"]))


@query("""WITH e AS (SELECT id, avg(abs(click - view)) AS mae, sqrt(avg((click - view) ** 2)) AS rmse FROM w GROUP BY id),
u AS (SELECT 'mae' AS metric, mae AS v, 50 AS lo, 80 AS hi FROM e UNION ALL SELECT 'rmse', rmse, 50, 70 FROM e), a AS (SELECT metric, min(v) AS min, avg(v) AS mean, max(v) AS max, min(lo) AS lo, min(hi) AS hi FROM u GROUP BY metric)
SELECT metric, round(min + 3e-9, 6) AS min, round(mean + 3e-9, 6) AS mean, round(max + 3e-9, 6) AS max, CASE WHEN mean <= lo THEN 'green' WHEN mean < hi THEN 'orange' WHEN mean >= hi THEN 'red' END AS level FROM a""")
def q_error_stats(spark, sf):
    df = wide(spark, sf).groupBy("id").agg(s.mae("click", "view").alias("mae"), s.rmse("click", "view").alias("rmse"))
    return rounded(s.error_stats(df, {"mae": (50, 80), "rmse": (50, 70)}))


@query(f"""WITH {_WEEKS} SELECT w.id, weeks."start", weeks."start" + INTERVAL 7 DAY AS "end", round(avg(click) + 3e-9, 6) AS avg_click, round(avg(coalesce(view > 60, false)::int) + 3e-9, 6) AS avg_high__0
FROM w JOIN weeks ON w.id = weeks.id AND w.timestamp >= weeks."start" AND w.timestamp < weeks."start" + INTERVAL 7 DAY GROUP BY ALL""")
def q_period_means(spark, sf):
    df = wide(spark, sf).withColumn("high__bool", F.col("view") > 60)
    return rounded(s.period_means(df, weeks(spark, sf), ["click"], ["high__bool"]))


def learned(spark, sf):
    """Orders as learning results: customer, duration in minutes, value."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("id"), "o_orderkey", (F.col("o_orderkey") % 240 + 1).alias("duration"), (F.col("o_totalprice") / 1000).alias("x"))


_LEARNED = "o AS (SELECT o_custkey AS id, o_orderkey, o_orderkey % 240 + 1 AS duration, o_totalprice / 1000 AS x FROM orders)"


@query(f"WITH {_LEARNED} SELECT id, round(median(x) + 3e-9, 6) AS x FROM o WHERE duration >= 100 GROUP BY id")
def q_median_learned(spark, sf):
    return rounded(s.median_learned(learned(spark, sf), ["x"], "duration", 100))


@query("SELECT id, round(median(click) + 3e-9, 6) AS click FROM w WHERE view > 60 GROUP BY id")
def q_median_when(spark, sf):
    return rounded(s.median_when(wide(spark, sf).withColumn("f", F.col("view") > 60), "click", "f"))


@query(f"""WITH {_LEARNED}, t AS (SELECT unnest(range(20, 241, 5)) AS threshold)
SELECT threshold::int AS threshold, round(median(x) + 3e-9, 6) AS median, round(sum(duration * x) / sum(duration) + 3e-9, 6) AS mean, round(sqrt(sum(duration * x * x) / sum(duration) - (sum(duration * x) / sum(duration)) ** 2) + 3e-9, 6) AS std FROM o JOIN t ON duration >= threshold GROUP BY threshold""")
def q_weighted_stats_by_threshold(spark, sf):
    return rounded(s.weighted_stats_by_threshold(learned(spark, sf), "x", "duration", 20, 240, 5, large=LARGE))


@query(f"""WITH {_LEARNED}, t AS (SELECT unnest(range(20, 241, 20)) AS threshold)
SELECT id, threshold::int AS threshold, round(quantile_cont(x, 0.25) + 3e-9, 6) AS q1, round(quantile_cont(x, 0.5) + 3e-9, 6) AS median, round(quantile_cont(x, 0.75) + 3e-9, 6) AS q3 FROM o JOIN t ON duration >= threshold GROUP BY ALL""")
def q_quartiles_by_threshold(spark, sf):
    return rounded(s.quartiles_by_threshold(learned(spark, sf), "x", "duration", 20, 240, 20, ["id"]))


@query("SELECT c_mktsegment, round(median(c_acctbal) + 3e-9, 6) AS median, round(avg(c_acctbal) + 3e-9, 6) AS mean, round(stddev_samp(c_acctbal) + 3e-9, 6) AS std FROM customer GROUP BY 1")
def q_group_median_mean_std(spark, sf):
    return rounded(s.group_median_mean_std(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", LARGE))


@query("""WITH r AS (SELECT l_suppkey AS id, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1)
SELECT id, n, round(CASE WHEN n > 1 THEN slope END, 3) AS slope, round(CASE WHEN n > 1 THEN intercept END, 3) AS intercept, round(CASE WHEN n > 1 THEN r2 END, 3) AS r2, round(CASE WHEN n > 1 THEN intercept + 100 * slope END, 3) AS at_100 FROM r""")
def q_flow_regression(spark, sf):
    return rounded(s.flow_regression(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "id"), "l_extendedprice", "l_quantity", "l_discount", 0.05), 3)


@query("""WITH p AS (SELECT id, count_if(value > 30) / count(*) AS share, count_if(value > 30) AS k, count(*) AS n FROM m GROUP BY id)
SELECT round(sum(k) / sum(n) + 3e-9, 6) AS share, round(min(share) + 3e-9, 6) AS smallest_share, (SELECT id FROM p ORDER BY share, id LIMIT 1) AS smallest_id FROM p""")
def q_threshold_retention(spark, sf):
    return rounded(s.threshold_retention(measurements(spark, sf), F.col("value") > 30))


@query("""WITH c AS (SELECT l_returnflag, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY ALL), q AS (SELECT l_returnflag, x AS mode FROM c QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, x) = 1)
SELECT l_returnflag, round(avg(l_quantity) + 3e-9, 6) AS mean, round(stddev_samp(l_quantity) + 3e-9, 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max, any_value(mode) AS mode FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1""")
def q_interval_summary(spark, sf):
    return rounded(s.interval_summary(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity"))


@query("""WITH c AS (SELECT c_custkey AS id, c_nationkey // 5 AS cell FROM customer) SELECT property, count_if(value < 1 OR value > 200)::bigint AS n_suspect, count(value) AS n, count(DISTINCT CASE WHEN value < 1 OR value > 200 THEN m.id END) AS n_ids, round(count_if(value < 1 OR value > 200) / count(value), 6) AS fraction,
array_to_string(list_sort(list(DISTINCT CASE WHEN value < 1 OR value > 200 THEN cell END)), ',') AS cells FROM m LEFT JOIN c ON c.id = m.id GROUP BY property""")
def q_suspect_share(spark, sf):
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_nationkey") / 5).alias("cell"))
    out = s.suspect_share(measurements(spark, sf), "value", 1, 200, ["property"], places, "cell")
    return rounded(out.withColumn("cells", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",")), 6)


@query("""WITH r AS (SELECT p_brand, min(p_size) AS min_p_size, max(p_size) AS max_p_size, min(p_partkey) AS min_p_partkey, max(p_partkey) AS max_p_partkey FROM part WHERE p_retailprice IS NOT NULL GROUP BY p_brand),
a AS (SELECT p_brand, p_partkey // 100 AS y, round(avg(p_retailprice) + 3e-9, 6) AS mean FROM part GROUP BY ALL) SELECT r.*, y, mean FROM r JOIN a USING (p_brand)""")
def q_lookup_ranges_means(spark, sf):
    part = table(spark, sf, "part")
    means = s.lookup_means(part.withColumn("y", F.floor(F.col("p_partkey") / 100)), "p_brand", "y", "p_retailprice").withColumnRenamed("p_retailprice", "mean")
    return rounded(s.lookup_ranges(part, "p_brand", "p_size", "p_partkey", "p_retailprice").join(means, "p_brand"))


@query("SELECT round(max(o_totalprice) / avg(o_totalprice) + 3e-9, 6) AS max_mean, round(avg(o_totalprice) / min(o_totalprice) + 3e-9, 6) AS mean_min, round(max(o_totalprice) / min(o_totalprice) + 3e-9, 6) AS max_min FROM orders")
def q_spread_ratios(spark, sf):
    return rounded(s.spread_ratios(table(spark, sf, "orders"), "o_totalprice"))


@query("""WITH b AS (SELECT id, timestamp, click IS NOT NULL AND view IS NOT NULL AS ok FROM w), a AS (SELECT min(timestamp) AS a, max(timestamp) AS b FROM b WHERE ok)
SELECT timestamp, id, bool_or(ok) AS available FROM b, a WHERE timestamp BETWEEN a.a AND a.b GROUP BY timestamp, id""")
def q_availability_matrix(spark, sf):
    return s.availability(wide(spark, sf), ["click", "view"])


@query("""WITH a AS (SELECT min(value) AS lo, (max(value) - min(value)) / 200 AS width FROM m), b AS (SELECT property, least(floor((value - lo) / width), 199)::int AS bin, lo, width FROM m, a)
SELECT property, bin, count(*) AS n, round(min(lo) + bin * min(width) + 3e-9, 6) AS low, round(min(lo) + (bin + 1) * min(width) + 3e-9, 6) AS high, round(count(*) / sum(count(*)) OVER (PARTITION BY property) / min(width) + 3e-9, 6) AS density FROM b GROUP BY property, bin""")
def q_histogram_bins(spark, sf):
    return rounded(s.histogram_bins(measurements(spark, sf), "value", 200, ["property"], density=True))


@query("""WITH b AS (SELECT property, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3, avg(value) AS mean FROM m GROUP BY 1)
SELECT property, round(any_value(q1) + 3e-9, 6) AS q1, round(any_value(median) + 3e-9, 6) AS median, round(any_value(q3) + 3e-9, 6) AS q3, round(any_value(mean) + 3e-9, 6) AS mean, min(value) AS low_whisker, max(value) AS high_whisker FROM m JOIN b USING (property) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY property""")
def q_boxplot_stats(spark, sf):
    return rounded(s.boxplot_stats(measurements(spark, sf), ["property"], "value", LARGE))


@query("SELECT l_quantity, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 ORDER BY n DESC, l_quantity LIMIT 10")
def q_top_values(spark, sf):
    return s.top_values(table(spark, sf, "lineitem"), "l_quantity", 10, F.col("l_returnflag") == "A")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def q_sort_by(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("SELECT * FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 1000")
def q_seeded_sample(spark, sf):
    from hearthline.operators.islands import seeded_sample

    return seeded_sample(table(spark, sf, "orders"), 1000, ["o_orderkey"])
