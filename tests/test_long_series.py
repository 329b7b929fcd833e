"""Scans in chunks, interval joins, order statistics and nearest points against plain brute force."""

import datetime as dt
import gzip
import math
import random
import statistics
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import fit, grid, intervals, islands, meters, order_stats, pivot, scan, spatial, stats

T0 = dt.datetime(2024, 1, 1)
CHUNKS = [0.5, 7, 60, 10**9]


def at(s):
    return None if s is None else T0 + dt.timedelta(seconds=s)


def series(seed, n=120):
    """Rows (n, id, property, timestamp, value) with ties of time, null times, values and keys, and gaps longer than chunks."""
    rng, rows = random.Random(seed), []
    for i, (key, prop) in enumerate([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (3, None)]):
        t = rng.randint(-50, 50)
        for _ in range(n if i < 3 else n // 4):
            t += rng.choice([0, 1, 1, 2, 5, 90])
            rows.append((len(rows), key, prop, at(None if rng.random() < 0.03 else t), None if rng.random() < 0.1 else float(rng.randint(0, 9))))
    rng.shuffle(rows)
    return rows


SCHEMA = "n long, id long, property string, timestamp timestamp_ntz, value double"


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[3] is not None, r[3] or T0, r[0])):
        out.setdefault((r[1], r[2]), []).append(r)
    return out


@pytest.mark.parametrize("chunk", CHUNKS)
def test_streaks_and_islands(spark, chunk):
    rows = series(1)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("f", F.col("value") > 4)
    got = {r["n"]: r["streak_id"] for r in islands.streak_ids(df, "f", ("id", "property"), tie=("n",), chunk_s=chunk).collect()}
    isle = {r["n"]: r["island"] for r in islands.filtered_islands(df, "f", ("id", "property"), tie=("n",), chunk_s=chunk).collect()}
    want, want_isle = {}, {}
    for some in grouped(rows).values():
        last, k, i = None, 0, 0
        for r in some:
            f = None if r[4] is None else r[4] > 4
            k += f is not last
            last = f
            want[r[0]] = k
            i += not f
            if f:
                want_isle[r[0]] = i
    assert got == want and isle == want_isle


@pytest.mark.parametrize("chunk", CHUNKS)
def test_periods(spark, chunk):
    rows = [r for r in series(2) if r[3] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in islands.periods_by_value(df, ">", 2, tie=("n",), singles=True, chunk_s=chunk).collect()), key=str)
    steps = sorted((tuple(r) for r in islands.periods_relative(df, ">=", tie=("n",), chunk_s=chunk).collect()), key=str)
    want, want_steps = [], []
    for key, some in grouped(rows).items():
        run, walk = [], []
        for before, r in zip([None, *some], [*some, None]):
            if r is not None and r[4] is not None and r[4] > 2:
                run.append(r[3])
            elif run:
                want.append((*key, run[0], run[-1], len(run)))
                run = []
            if r is not None and before is not None and None not in (r[4], before[4]) and r[4] >= before[4]:
                walk = walk or [before[3]]
                walk.append(r[3])
            elif walk:
                want_steps.append((*key, walk[0], walk[-1], len(walk) - 1))
                walk = []
    assert got == sorted(want, key=str) and steps == sorted(want_steps, key=str)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_meters(spark, chunk):
    rows = [r for r in series(3) if r[3] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["n"]: r["value"] for r in meters.meter_reading_repair(df, tie=("n",), chunk_s=chunk).collect()}
    want = {}
    for some in grouped(rows).values():
        left = [b for a, b in zip(some, some[1:]) if None not in (a[4], b[4]) and b[4] >= a[4]]
        total = 0.0
        for a, b in zip([None, *left], left):
            total += max(0.0, b[4] - a[4]) if a else 0.0
            want[b[0]] = total
    assert got == want and len(want) > 100


@pytest.mark.parametrize("chunk", CHUNKS)
def test_gaps_close_alike(spark, chunk):
    rng = random.Random(4)
    rows = []
    for key in (1, 1, 2, 2, None):
        for _ in range(40):
            s = rng.randint(0, 600)
            e = s + rng.choice([0, 1, 5, 20, -3])
            rows.append((key, None if rng.random() < 0.02 else at(s), None if rng.random() < 0.02 else at(e)))
    df = spark.createDataFrame(rows, "id long, start timestamp_ntz, end timestamp_ntz")
    for delta in (0, 4):
        got = sorted((tuple(r) for r in islands.close_period_gaps(df, delta, chunk_s=chunk).collect()), key=str)
        want, low, high = [], dt.datetime.min, dt.datetime.max
        for key in (1, 2, None):
            open_ = None
            for s, e in sorted((s or low, e or high) for k, s, e in rows if k == key):
                if open_ and (open_[1] == high or (s - open_[1]).total_seconds() <= delta):
                    open_[1] = max(open_[1], e)
                else:
                    if open_:
                        want.append(open_)
                    open_ = [s, e, key]
            want.append(open_)
        # periods that end before they begin may come twice alike
        named = {(k, None if s == low else s, None if e == high else e) for s, e, k in want}
        assert set(got) == named and len(got) == len(set(got))


@pytest.mark.parametrize("chunk", [1, 7, 10**9])
def test_grids_and_filling(spark, chunk):
    rows = [r for r in series(5) if r[3] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    shape = lambda d: {(r["id"], r["property"], r["timestamp"]): r["value"] for r in d.collect()}
    for limit in (None, 2):
        got = shape(grid.interpolate_time(df, 2, 6, limit, chunk_s=chunk))
        want = shape(grid.interpolate_time(df, 2, 6, limit))
        assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)
    some = grouped(rows)[(1, "a")]
    first, last = ((x - T0).total_seconds() // 2 * 2 for x in (some[0][3], some[-1][3]))
    mine = sorted((k[2] - T0).total_seconds() for k in shape(grid.resample_first(df, 2, chunk_s=chunk)) if k[:2] == (1, "a"))
    assert mine == [first + 2 * i for i in range(int((last - first) / 2) + 1)]


def test_running_sums_join_without_a_second_shuffle(spark):
    df = spark.createDataFrame(series(6), SCHEMA).withColumn("x", F.col("n"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scan.running_sum(df, "x", ("id", "property"), ("timestamp", "n"), "s", 60)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # the rows, the sums by chunk, and these by series and back
    assert plan.count("Exchange hashpartitioning") == 4 and "SinglePartition" not in plan


def test_times_in_intervals(spark):
    rng = random.Random(7)
    points = [(i, rng.choice([1, 2, None]), rng.choice([None, rng.randint(-10**6, 10**6), rng.randint(-50, 50)])) for i in range(300)]
    spans = []
    for i in range(120):
        a = rng.randint(-10**6, 10**6) if i % 2 else rng.randint(-60, 60)
        spans.append((i, rng.choice([1, 2, None]), rng.choice([None, a, a, a, a, a]), a + rng.choice([0, 1, 10, 1000, 10**5, -5, 2 * 10**6])))
    p = spark.createDataFrame(points, "p long, k long, t long")
    s = spark.createDataFrame(spans, "s long, j long, a long, b long")
    got = sorted((r["p"], r["s"]) for r in intervals.times_in(p, "t", s, "a", "b", [("k", "j")]).collect())
    assert got == sorted((i, j) for i, k, t in points for j, q, a, b in spans if None not in (k, q, t, a) and k == q and a <= t <= b)
    wide = spark.createDataFrame([(1, 1, -(1 << 62), 1 << 62)], "s long, j long, a long, b long")
    assert intervals.times_in(p, "t", wide, "a", "b", [("k", "j")]).count() == sum(k == 1 and t is not None for _, k, t in points)


def test_many_open_periods_and_jobs(spark):
    n = 150
    both = spark.range(n).selectExpr("1L as id", "cast(null as timestamp_ntz) as start", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) as end")
    assert islands.periods_intersect(both, both).count() == n * n
    rows = spark.range(2000).selectExpr("1L as id", "id as n", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) as timestamp")
    jobs = spark.range(1000).selectExpr("1L as id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, 2 * id) as start", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, 2 * id + 5) as end")
    assert islands.job_rows(rows, jobs).count() == sum(min(5, 2000 - 2 * i) for i in range(1000))
    programs = jobs.selectExpr("id", "start as valid_from", "end as valid_to")
    assert pivot.valid_interval_lookup(rows, programs).count() == sum(min(5, 1999 - 2 * i) for i in range(1000))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(8)
    data = {1: rng.normal(size=3001), 2: rng.integers(0, 3, 2500).astype(float), 3: np.array([5.0]), 4: np.concatenate([np.full(1500, 7.0), rng.exponential(size=700) ** 5]), None: rng.normal(size=1200)}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [(1, None), (2, float("nan")), (9, None)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(5)
    at_ = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    for large in (10, 1000, 10**6):
        got = {r["k"]: [r[c] for c in at_] for r in order_stats.quantiles(df, ["k"], "x", at_, large).collect()}
        assert got.keys() == data.keys()
        for k, v in data.items():
            assert np.allclose(got[k], np.quantile(v, [*at_.values()]), atol=1e-12)
    whole = order_stats.quantiles(df, [], "x", {"m": 0.5}, 10).collect()
    assert len(whole) == 1 and abs(whole[0]["m"] - np.median(np.concatenate([*data.values()]))) < 1e-12


def test_a_large_group_is_not_in_one_task(spark):
    df = spark.range(200_000).selectExpr("1 as k", "pmod(xxhash64(id), 1000000) / 7.0D as x")
    values = order_stats._values(df, ["k"], "x")
    bounds = order_stats._bounds(values, ["k"], 1000)
    b = bounds.first()["_b"]
    assert len(b) == order_stats.BINS
    sizes = [r["count"] for r in order_stats._binned(values, bounds, ["k"]).groupBy("_bin").count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) < 2000 and len(sizes) > 1000
    x = [r["x"] for r in df.collect()]
    out = stats.describe_per_group(df, ["k"], "x", 1000).first()
    assert out["p50"] == statistics.median(x) and out["count"] == len(x)


def test_statistics_by_threshold(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, float(rng.randint(0, 50))]), rng.choice([None, rng.uniform(0, 40), 10.0])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k long, x double, w double")
    for large in (20, 10**6):
        got = {(r["k"], r["threshold"]): r for r in stats.weighted_stats_by_threshold(df, "x", "w", 5, 35, 3, ["k"], large).collect()}
        quart = {(r["k"], r["threshold"]): r for r in stats.quartiles_by_threshold(df, "x", "w", 5, 35, 3, ["k"], large).collect()}
        want = {}
        for k in (1, 2, None):
            for t in range(5, 36, 3):
                some = [(x, w) for q, x, w in rows if q == k and None not in (x, w) and w >= t]
                if some:
                    want[k, t] = some
        assert got.keys() == want.keys() == quart.keys()
        for key, some in want.items():
            x, w = (np.array(c) for c in zip(*some))
            mean = (x * w).sum() / w.sum()
            assert np.allclose([got[key]["median"], got[key]["mean"], got[key]["std"]], [np.median(x), mean, math.sqrt((w * (x - mean) ** 2).sum() / w.sum())])
            assert np.allclose([quart[key][c] for c in ("q1", "median", "q3")], np.quantile(x, [0.25, 0.5, 0.75]))


def haversine(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1.0)))


def test_nearest_against_all_pairs(spark):
    rng = random.Random(10)
    spot = lambda: rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (52 + rng.random(), 5 + rng.random()), (rng.uniform(60, 62), rng.choice([-1, 1]) * rng.uniform(179, 180)), (90.0, rng.uniform(-180, 180)), (50.0, 4.0)])
    cells = [(i, *spot()) for i in range(150)] + [(900, None, 1.0), (901, 10.0, 180.0), (902, 10.0, -180.0)]
    points = [(i, *spot()) for i in range(400)] + [(900, 1.0, None)]
    c = spark.createDataFrame(cells, "cell long, lat double, lon double")
    p = spark.createDataFrame(points, "point long, lat double, lon double")
    for leaf in (4, 64):
        got = {}
        for r in spatial.nearest_k(c, p, 3, leaf=leaf).collect():
            got.setdefault(r["cell"], []).append((r["rank"], r["point"], r["distance__km"]))
        assert got.keys() == {i for i, la, _ in cells if la is not None}
        for i, la, lo in cells:
            if la is not None:
                d = {q: haversine((la, lo), (pla, plo)) for q, pla, plo in points if plo is not None}
                want = sorted(d.values())[:3]
                mine = sorted(got[i])
                assert [r for r, _, _ in mine] == [1, 2, 3] and all(abs(x - w) < 1e-6 and abs(d[q] - x) < 1e-6 for (_, q, x), w in zip(mine, want))
    assert spatial.nearest_k(c, p.limit(0), 3).count() == 0 and spatial.nearest_k(c, p.limit(2), 3).where("cell = 1").count() == 2


def test_leaves_out_of_reach_are_not_paired():
    rng = np.random.default_rng(11)
    lat, lon = 52 + rng.random(20_000), 5 + rng.random(20_000)
    tree = spatial.Quadtree(lat, lon)
    leaf = tree.leaf(lat, lon)
    ids, n = np.unique(leaf, return_counts=True)
    assert n.max() <= spatial.LEAF and len(ids) > 300
    ends = [np.array([f(v[leaf == i]) for i in ids]) for v in (lat, lon) for f in (np.min, np.max)]
    la, lo = np.radians((ends[0] + ends[1]) / 2), np.radians((ends[2] + ends[3]) / 2)
    box = {"leaf": ids, "n": n, "lat": la, "lon": lo, "r": spatial._angle(la, lo, np.radians(ends[0]), np.radians(ends[2]))}
    reached = [len(spatial._reached(box, i, box, 3)) for i in range(len(ids))]
    assert np.mean(reached) < 40


def test_bounded_fits():
    """Against coordinate descent, which ends at the same point; many solutions lie on a bound."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 40, 4))
    y = np.einsum("nij,j->ni", x, [1.0, -2.0, 0.1, 0.0]) + rng.normal(size=(60, 40)) * 2
    a, r = np.einsum("nij,nik->njk", x, x), np.einsum("nij,ni->nj", x, y)
    want = np.zeros((60, 4))
    for _ in range(3000):
        for j in range(4):
            want[:, j] = np.maximum(0, want[:, j] + (r[:, j] - np.einsum("nk,nk->n", a[:, j], want)) / a[:, j, j])
    got = fit._nonnegative(a, r)
    assert np.allclose(got, want, atol=1e-8) and (got == 0).any(1).mean() > 0.5 and (got[:, 0] > 0).all()


def test_negative_terms_leave_the_others_best(spark):
    rows = [(1, float(i % 7 + 1), float((i * i) % 5 + 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("y", 2 * F.col("a") - 0.5 * F.col("b"))
    r = fit.least_squares(df, F.col("y"), {"p": F.col("a"), "q": F.col("b")}, ["id"], bounded=True).first()
    assert r["q"] == 0 and r["p"] == pytest.approx(sum(a * (2 * a - b / 2) for _, a, b in rows) / sum(a * a for _, a, _ in rows))


def test_the_hour_that_comes_twice(spark):
    """Local clocks over the end of summer time: 00:00 and 01:00 UTC both read 02:00."""
    def utc(h, m):
        return dt.datetime(2024, 10, 27, h, m)

    true = [utc(h, m) for h in (0, 1) for m in (5, 20, 35, 50)]
    told = [dt.datetime(2024, 10, 26, 23, 50), *true, utc(2, 5)]
    local = [t + dt.timedelta(hours=2 if t < utc(1, 0) else 1) for t in told]
    rows = [(1, t, f"{x:%y%m%d%H%M%S}") for t, x in zip(told, local)]
    # a second series with only one pass, a third with signs, a fourth in spring
    rows += [(2, utc(0, 5), "241027020500"), (2, utc(0, 10), "241027021000"), (3, utc(1, 5), "241027020500W"), (3, utc(0, 5), "241027020500S"), (4, dt.datetime(2024, 3, 31, 1, 30), "240331033000")]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, telegram string")
    got = {}
    for r in meters.meter_timestamp_parse(df, "telegram").collect():
        got.setdefault(r["id"], []).append(r["timestamp"])
    assert sorted(got[1]) == told and sorted(got[2]) == [utc(0, 5), utc(0, 10)] and sorted(got[3]) == [utc(0, 5), utc(1, 5)] and got[4] == [dt.datetime(2024, 3, 31, 1, 30)]
    from hearthline.sources import io

    cell = "[" + ", ".join(f'{{"rate": 1, "date": "{x:%Y-%m-%d %H:%M:%S}", "quantity": {i}}}' for i, x in enumerate(local)) + "]"
    cells = spark.createDataFrame([("p", cell, "bad")], "pseudonym string, a string, b string")
    out = io.import_meter_json(cells, ["a", "b"], {1: "x"}).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).orderBy("value").collect()
    assert [r["timestamp"] for r in out] == told


def test_blocks_of_homes_and_times(spark):
    rng = random.Random(13)
    stations = [(i, 50 + rng.random() * 3, 4 + rng.random() * 3) for i in range(6)]
    homes = [(i, 50 + rng.random() * 3, 4 + rng.random() * 3) for i in range(40)] + [(90, None, 4.0)]
    weather = [(s, at(3600 * h), p, None if rng.random() < 0.2 else rng.uniform(0, 20)) for s in range(6) for h in range(30) for p in ("t", "w")]
    w, h, s = spark.createDataFrame(weather, "station long, timestamp timestamp_ntz, property string, value double"), spark.createDataFrame(homes, "id long, lat double, lon double"), spark.createDataFrame(stations, "station long, lat double, lon double")
    out = spatial.spatial_interpolate(w, h, s, homes_a_block=16, times_a_block=20)
    assert out.rdd.getNumPartitions() == 3 * 3  # 41 homes and 60 times
    small = {tuple(r)[:3]: r["value"] for r in out.collect()}
    large = {tuple(r)[:3]: r["value"] for r in spatial.spatial_interpolate(w, h, s).collect()}
    assert small.keys() == large.keys() and len(small) == 41 * 60
    at_station = spark.createDataFrame([(1, stations[0][1], stations[0][2])], "id long, lat double, lon double")
    known = {(t, p): v for i, t, p, v in weather if i == 0 and v is not None}
    got = {(r["timestamp"], r["property"]): r["value"] for r in spatial.spatial_interpolate(w, at_station, s).collect()}
    assert all(abs(got[k] - v) < 1e-6 for k, v in known.items())
    for k, v in large.items():
        assert (v is None) == (k[0] == 90) == (small[k] is None) and (v is None or abs(v - small[k]) < 1e-9)
    assert spatial.spatial_interpolate(w.limit(0), h, s).count() == 0 == spatial.spatial_interpolate(w, h.limit(0), s).count()


def test_buckets_save_shuffles(spark, tmp_path):
    from pyspark.sql import Window

    from hearthline.sources import io

    rows = [r for r in series(14) if r[1] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    names = [f"buckets_{tmp_path.name}_{i}" for i in (0, 1)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = (io.write_bucketed(df, n, buckets=3, path=f"{tmp_path}/{n}") for n in names)
        after = a.withColumn("before", F.lag("value").over(Window.partitionBy("id").orderBy("timestamp", "n"))).join(b.groupBy("id").agg(F.count("*").alias("all")), "id")
        assert "Exchange" not in after._jdf.queryExecution().executedPlan().toString()
        assert after.count() == len(rows) and after.agg(F.count("before")).first()[0] > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")
    assert len([*(tmp_path / names[0]).glob("*.parquet")]) <= 3


def test_a_large_home_has_several_files(spark, tmp_path):
    from hearthline.sources import io

    df = spark.range(1000).selectExpr("id as n", "if(id < 900, 1L, id) as id")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for partitions that are worth a task
    spark.conf.set("spark.sql.shuffle.partitions", "101")
    try:
        io.write_per_home(df, f"{tmp_path}/homes", rows_a_file=300)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len([*(tmp_path / "homes" / "id=1").glob("*.parquet")]) == 3 and len([*(tmp_path / "homes" / "id=950").glob("*.parquet")]) == 1
    assert spark.read.parquet(f"{tmp_path}/homes").count() == 1000


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_homes_are_written_without_more_files(spark, tmp_path, monkeypatch, kind):
    """A folder and a file a home and nothing beside; odd names and values as by Spark's own writer, which serves file systems that aren't mounted."""
    from hearthline.sources import io

    write = {"parquet": io.write_per_home, "csv": io.write_csv_per_home}[kind]
    ids = [None, "", "a b", "ü", *(f"x{chr(c)}y" for c in range(1, 128) if chr(c) not in "\n\r")]
    texts = [None, "", " ", "a,b", 'say "so"', "a\nb", "\\", "ü", "#", "-"]
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, n % 60, 7), texts[n % 10], None if n % 7 == 0 else n * 1e6 / 3, n, dt.date(1500, 1, 1), Decimal(n), b"\x00") for n, i in enumerate(ids * 11)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, text string, value double, n long, day date, amount decimal(12,3), raw binary")
    df = df.drop("raw") if kind == "csv" else df
    write(df, f"{tmp_path}/new")
    with monkeypatch.context() as m:
        m.setattr(io, "_mounted", lambda *_: None)
        write(df, f"{tmp_path}/spark")
    folders = {f.name for f in (tmp_path / "spark").glob("id=*")}
    files = [f.relative_to(tmp_path / "new") for f in (tmp_path / "new").rglob("*") if f.is_file()]
    assert {f.name for f in (tmp_path / "new").iterdir()} == folders | {"_SUCCESS"} and len(files) == len(folders) + 1
    if kind == "csv":
        content = lambda f: sorted(gzip.decompress(f.read_bytes()).decode().replace("a\nb", "a b").split("\n"))
        assert all(content(tmp_path / "new" / f) == content(next((tmp_path / "spark" / f.parent).glob("*.gz"))) for f in files if f.name != "_SUCCESS")
    else:
        new, old = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("new", "spark"))
        assert new.dtypes == old.dtypes and new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty() and new.count() == len(rows)
    with pytest.raises(FileExistsError):
        write(df, f"{tmp_path}/new")


@pytest.mark.parametrize("more", ["", ", value double", ', `a "b", c` string'])
def test_csv_homes_of_nulls(spark, tmp_path, monkeypatch, more):
    from hearthline.sources import io

    df = spark.createDataFrame([(i, t, None) if more else (i, t) for i in (1, 2) for t in (None, T0)], "id long, timestamp timestamp" + more)
    io.write_csv_per_home(df, f"{tmp_path}/new")
    monkeypatch.setattr(io, "_mounted", lambda *_: None)
    io.write_csv_per_home(df, f"{tmp_path}/spark")
    content = lambda n, i: [sorted(gzip.decompress(f.read_bytes()).decode().split("\n")) for f in (tmp_path / n / f"id={i}").glob("*.gz")]
    assert all(content("new", i) == content("spark", i) for i in (1, 2))


def test_no_homes_at_all(spark, tmp_path):
    from hearthline.sources import io

    io.write_per_home(spark.range(0).withColumn("value", F.lit(1.0)), f"{tmp_path}/none")
    assert [f.name for f in (tmp_path / "none").iterdir()] == ["_SUCCESS"]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_slopes_are_exact_on_cubics(n):
    at_ = np.cumsum([0.5, 1, 2, 0.7, 1.3, 1, 3, 0.2, 1][:n])
    power = min(n - 1, 3)
    assert np.allclose(spatial.slope_matrix(at_) @ (at_**power), power * at_ ** (power - 1))


def test_spline_surface(spark):
    rng = random.Random(15)
    cubic = lambda x, y: 0.5 + 0.1 * x - 0.02 * x * y + 0.001 * x**3 - 0.0005 * x * y**3 + 0.0001 * x**3 * y**2
    xs, ys = [0.0, 1.0, 2.5, 3.0, 5.0], [0.0, 2.0, 3.0, 4.5]
    rough = {(x, y): rng.random() for x in xs for y in ys}
    surface = [(m, x, y, cubic(x, y) if m == 1 else rough[x, y]) for m in (1, 2) for x in xs for y in ys] + [(3, 0.0, 0.0, 1.0), (3, 1.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0), (4, 1.0, 1.0, 0.7)]
    asked = [(i, m, rng.choice([None, rng.uniform(-1, 6), rng.choice(xs)]), rng.uniform(-1, 5)) for i, m in enumerate([1, 2, 3, 4, 5, None] * 40)]
    s = spark.createDataFrame(surface, "model long, x double, y double, eta double")
    got = {r["n"]: r["e"] for r in spatial.spline_lookup(spark.createDataFrame(asked, "n long, model long, x double, y double"), s, "model", "x", "y", "eta", "e").collect()}
    assert len(got) == len(asked)
    for i, m, x, y in asked:
        if m not in (1, 2, 4) or x is None:
            assert got[i] is None
        elif m == 4:
            assert got[i] == pytest.approx(0.7)
        elif m == 1:
            assert got[i] == pytest.approx(cubic(min(max(x, 0), 5), min(max(y, 0), 4.5)), abs=1e-9)
    # through the nodes, and with slopes that go on over the edges of cells
    near = [(k, 2, x + e, y) for k, (x, y, e) in enumerate((x, y, e) for x in xs[1:-1] for y in (1.1, 3.0) for e in (-1e-4, 0.0, 1e-4))]
    at_ = {r["n"]: r["e"] for r in spatial.spline_lookup(spark.createDataFrame(near, "n long, model long, x double, y double"), s, "model", "x", "y", "eta", "e").collect()}
    for k in range(0, len(near), 3):
        assert abs((at_[k + 2] - at_[k + 1]) - (at_[k + 1] - at_[k])) < 1e-6
        if near[k][3] == 3.0:
            assert at_[k + 1] == pytest.approx(rough[near[k + 1][2], 3.0])


def test_steps_are_counted_in_the_pass_itself(spark):
    from hearthline.operators import audit, mask

    df = spark.createDataFrame(series(16), SCHEMA)
    columns, log = ["value"], []
    step = audit.observed(columns, log)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("audit", "")
    out = step(mask.filter_between)(step(mask.filter_min_max)(df, "value", 2, 7), "value", 3, 5)
    rows = out.collect()
    jobs = len(tracker.getJobIdsForGroup("audit"))
    spark.sparkContext.setJobGroup("plain", "")
    assert len(mask.filter_between(mask.filter_min_max(df, "value", 2, 7), "value", 3, 5).collect()) == len(rows)
    assert jobs == len(tracker.getJobIdsForGroup("plain"))
    got = [r.asDict() for r in audit.observed_log(spark, log, columns).collect()]
    middle = mask.filter_min_max(df, "value", 2, 7)
    want = [audit.audit_step("filter_min_max", df, middle, columns), audit.audit_step("filter_between", middle, mask.filter_between(middle, "value", 3, 5), columns)]
    assert got == [w.first().asDict() for w in want]


def test_one_place_is_many_tasks(spark):
    """Homes of a place are dealt to tasks by the size of the result; every pair comes once."""
    weather = spark.createDataFrame([(p, float(i)) for p in (1, 2, None) for i in range(30)] + [(3, 1.0)], "place long, temp double")
    homes = spark.createDataFrame([(i, 1) for i in range(60)] + [(60, 2), (61, None), (62, 4)], "id long, place long")
    out = pivot.locations_expand(weather, homes, ["place"], rows_a_task=100)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 61 * 30 and max(sizes) < 61 * 30 / 3
    got = sorted((r["id"], r["temp"]) for r in out.collect())
    assert got == sorted((i, float(t)) for i in range(61) for t in range(30))
    assert pivot.locations_expand(weather, homes.where("id > 61"), ["place"]).count() == 0


@pytest.mark.parametrize(("step", "target", "limit"), [(2, 6, None), (2, 6, 1), (3, 7, 2), (4, 2, None), (2, 20, 0)])
def test_filled_means_are_those_of_the_laid_out_grid(spark, step, target, limit):
    """Also with nulls at either end, steps that don't divide each other, null keys, and gaps over the limit; with few rows for long gaps."""
    rng = random.Random(step * target)
    rows = [(k, T0 + dt.timedelta(seconds=at), rng.choice([None, 1.0, 2.5, 7.0])) for k in (1, 2, 3, None) for at in sorted(rng.sample(range(1, 90), 14))]
    rows += [(4, T0, None), (4, T0 + dt.timedelta(seconds=31), None), (5, T0, 1.0), (6, T0, 1.0), (6, T0 + dt.timedelta(days=200), 9.0)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, value double")
    some = df.where("id is null or id != 6")
    shape = lambda d: sorted((r["id"] or -1, r["timestamp"], None if r["value"] is None else round(r["value"], 9)) for r in d.collect())
    laid = grid.resample_agg(grid.fill_limited(grid.resample_first(some, step, keys=("id",)), step, limit, keys=("id",)), target, "mean", keys=("id",), every=False)
    for chunk_s in (10, grid.CHUNK_S):
        assert shape(grid.filled_means(some, step, target, limit, keys=("id",), chunk_s=chunk_s)) == shape(laid)
    long = grid.filled_means(df.where("id = 6"), 1, 86_400, None, keys=("id",))
    assert long.count() == 201 and long.agg(F.avg("value")).first()[0] == pytest.approx(5, abs=0.03)
