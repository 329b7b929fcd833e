"""Runs, islands and periods: sequences of rows of a key, ordered by time.

Functions take rows with key columns, a timestamp and a value, and order ties of time by the columns in ``tie``. Those that
number runs or merge periods cut each series into chunks of ``chunk_s`` seconds (see ``scan``), so that one long series is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hearthline.functions.time import from_micros, micros, seconds_between, shifted
from hearthline.operators.intervals import times_in
from hearthline.operators.mask import all_present, compare
from hearthline.operators.scan import CHUNK_S, before, behind, running_sum, segmented, turns, up_to

Keys = tuple[str, ...]


def _w(keys: Keys, *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def with_run(df: DataFrame, changed: Column, keys: Keys, order: Keys, name: str = "run", chunk_s: float = CHUNK_S) -> DataFrame:
    """A running number that goes up at every row where changed holds. order begins with the time."""
    return running_sum(df.withColumn("_c", F.coalesce(changed.cast("long"), F.lit(0).cast("long"))), "_c", keys, order, name, chunk_s).drop("_c")


def streak_ids(df: DataFrame, flag: str, keys: Keys = ("id",), ts: str = "timestamp", tie: Keys = (), name: str = "streak_id", chunk_s: float = CHUNK_S) -> DataFrame:
    """Numbers the runs of equal flags."""
    return turns(df, flag, keys, (ts, *tie), name, chunk_s)


def filtered_islands(df: DataFrame, valid: str, keys: Keys = ("id",), ts: str = "timestamp", tie: Keys = (), chunk_s: float = CHUNK_S) -> DataFrame:
    """Valid rows with the number of the island they are in; rows that aren't valid part the islands."""
    return with_run(df, ~F.coalesce(F.col(valid), F.lit(False)), keys, (ts, *tie), "island", chunk_s).where(F.coalesce(F.col(valid), F.lit(False)))


def _periods(df: DataFrame, hit: Column, keys: Keys, ts: str, tie: Keys, start: str, chunk_s: float) -> DataFrame:
    """Runs of rows where hit holds; start names the column to take the first time from."""
    df = with_run(df.withColumn("_hit", F.coalesce(hit, F.lit(False))), ~F.col("_hit"), keys, (ts, *tie), "_run", chunk_s).where("_hit")
    return df.groupBy(*keys, "_run").agg(F.min(start).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n_samples")).drop("_run")


def periods_by_value(df: DataFrame, op: str, value: float, column: str = "value", keys: Keys = ("id", "property"), ts: str = "timestamp", tie: Keys = (), singles: bool = False, chunk_s: float = CHUNK_S) -> DataFrame:
    """Longest runs of samples that satisfy the comparison, from the first to the last of them; single samples only if asked."""
    out = _periods(df, compare(column, op, value), keys, ts, tie, ts, chunk_s)
    return out if singles else out.where("n_samples > 1")


def periods_custom(df: DataFrame, step: Callable[..., Column], column: str = "value", keys: Keys = ("id", "property"), ts: str = "timestamp", tie: Keys = (), chunk_s: float = CHUNK_S) -> DataFrame:
    """Longest runs of steps for which step(before, after, t_before, t_after) holds, from the sample before the first step to the last."""
    order, row = (ts, *tie), F.struct(F.col(ts).alias("t"), F.col(column).alias("v"))
    holds = lambda a, b: F.coalesce(step(a["v"], b["v"], a["t"], b["t"]), F.lit(False))

    def local(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns({"_now": row, "_was": F.lag(row).over(w)})
        # a chunk's first step comes from the chunk before and is counted among the summaries
        d = d.withColumn("_off", F.when(F.col("_was").isNotNull(), ~holds(F.col("_was"), F.col("_now"))).otherwise(F.lit(False)).cast("long"))
        return d.withColumn("_own", F.sum("_off").over(up_to(w)))

    def carried(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_edge", F.lag("_tail").over(w)).withColumn("_cut", (~holds(F.col("_edge"), F.col("_head"))).cast("long"))
        return d.withColumn("_base", F.sum("_cut").over(up_to(w)) + F.coalesce(F.sum("_many").over(before(w)), F.lit(0))).drop("_head", "_tail", "_many", "_cut")

    df = segmented(df, keys, order, chunk_s, local, {"_many": F.sum("_off"), "_head": F.min_by(row, behind(order)), "_tail": F.max_by(row, behind(order))}, carried)
    df = df.withColumn("_was", F.coalesce("_was", "_edge")).where(holds(F.col("_was"), F.col("_now"))).withColumn("_run", F.col("_own") + F.coalesce("_base", F.lit(0)))
    return df.groupBy(*keys, "_run").agg(F.min("_was.t").alias("start"), F.max(ts).alias("end"), F.count("*").alias("n_steps")).drop("_run")


def periods_relative(df: DataFrame, op: str, column: str = "value", **where) -> DataFrame:
    """Longest runs in which each sample compares so with the one before."""
    return periods_custom(df, lambda before, after, *_: compare(after, op, before), column, **where)


def close_period_gaps(periods: DataFrame, delta_s: float = 0.0, keys: Keys = ("id",), chunk_s: float = CHUNK_S) -> DataFrame:
    """Periods that overlap or lie at most delta_s apart become one; an open end swallows what follows.

    A merged period is named by the period that begins it. Within a chunk of starts these are marked as if nothing came before; a mark stands
    if it also lies apart from the greatest end of all chunks before, and periods without a mark go to the last one before.
    """
    last, delta = F.lit(1 << 62), F.lit(int(delta_s * 1e6))
    df = periods.withColumns({"_s": F.coalesce(micros(periods, "start"), -last), "_e": F.coalesce(micros(periods, "end"), last)})
    apart = lambda s, reach: reach.isNull() | ((reach < last) & (s - reach > delta))

    def local(d: DataFrame, w: WindowSpec) -> DataFrame:
        mark = F.when(apart(F.col("_s"), F.max("_e").over(before(w))), F.struct("_s", "_e"))
        return d.withColumn("_mark", mark).withColumn("_own", F.max("_mark").over(up_to(w)))

    def carried(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_reach", F.max("_most").over(before(w)))
        return d.withColumn("_open", F.last(F.when(apart(F.col("_final._s"), F.col("_reach")), F.col("_final")), ignorenulls=True).over(before(w))).drop("_most", "_final")

    df = segmented(df, keys, ("_s", "_e"), chunk_s, local, {"_most": F.max("_e"), "_final": F.max("_mark")}, carried)
    run = F.when(apart(F.col("_own._s"), F.col("_reach")), F.col("_own")).otherwise(F.col("_open"))
    out = df.groupBy(*keys, run.alias("_run")).agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    at = lambda c, none: F.when(F.col(c) != none, from_micros(periods, "start", F.col(c)))
    return out.select(*keys, at("_s", -last).alias("start"), at("_e", last).alias("end"))


def periods_union(a: DataFrame, b: DataFrame, keys: Keys = ("id",)) -> DataFrame:
    """Both lists with overlapping and touching periods merged."""
    columns = [*keys, "start", "end"]
    return close_period_gaps(a.select(*columns).unionByName(b.select(*columns)), 0.0, keys)


def periods_intersect(a: DataFrame, b: DataFrame, keys: Keys = ("id",)) -> DataFrame:
    """All overlaps of a period of a with one of b; touching ends overlap for no time. Null ends are open.

    Of two periods that overlap the later start lies in the other one, so starts of each side meet the periods of the other (see
    ``intervals``) and each overlap comes from one of both. Open ends lie at the least and greatest time that there is.
    """
    both = a.select("start", "end").unionByName(b.select("start", "end"))
    s, e = micros(both, "start"), micros(both, "end")
    span = F.broadcast(both.agg(F.least(F.min(s), F.min(e)).alias("_lo"), F.greatest(F.max(s), F.max(e)).alias("_hi")))  # one row

    def side(df: DataFrame, n: str) -> DataFrame:
        df = df.crossJoin(span)
        at = lambda c, none: F.coalesce(micros(df, c), F.col(none), F.lit(0).cast("long")).alias(f"_{n}{c[0]}")
        return df.select(*(F.col(k).alias(f"_{n}_{k}") for k in keys), F.col("start").alias(f"_{n}_start"), F.col("end").alias(f"_{n}_end"), at("start", "_lo"), at("end", "_hi"))

    x, y = side(a, "a"), side(b, "b")
    pairs = [(f"_a_{k}", f"_b_{k}") for k in keys]
    # equal starts are found from the side of b alone
    later_b = times_in(y, "_bs", x, "_as", "_ae", [(q, p) for p, q in pairs])
    later_a = times_in(x, "_as", y.withColumn("_past", F.col("_bs") + 1), "_past", "_be", pairs).drop("_past")
    met = later_b.unionByName(later_a).where("_as <= _be and _bs <= _ae")
    return met.select(*(F.col(p).alias(k) for k, (p, _) in zip(keys, pairs)), F.greatest("_a_start", "_b_start").alias("start"), F.least("_a_end", "_b_end").alias("end"))


def period_extend(periods: DataFrame, delta_s: float) -> DataFrame:
    """Both ends moved outward; open ends stay open."""
    return periods.withColumns({"start": shifted("start", -delta_s), "end": shifted("end", delta_s)})


def period_shrink(periods: DataFrame, delta_s: float) -> DataFrame:
    """Both ends moved inward; a short period may end before it starts."""
    return period_extend(periods, -delta_s)


def period_delta(periods: DataFrame, name: str = "duration_s") -> DataFrame:
    """Seconds from start to end, 0 for open periods."""
    return periods.withColumn(name, F.coalesce(seconds_between("start", "end"), F.lit(0.0)))


def period_order(periods: DataFrame) -> list[Column]:
    """Sort keys: open starts first, open ends last."""
    return [F.asc_nulls_first("start"), F.asc_nulls_last("end")]


def interval_seconds(df: DataFrame, keys: Keys = ("id",), ts: str = "timestamp", tie: Keys = (), name: str = "interval__s") -> DataFrame:
    """Seconds to the next row, 0 in the last."""
    return df.withColumn(name, F.coalesce(seconds_between(F.col(ts), F.lead(ts).over(_w(keys, ts, *tie))), F.lit(0.0)))


def longest_sane_streak(df: DataFrame, sane: str, keys: Keys = ("id",), ts: str = "timestamp", threshold_s: float = 0.0, tie: Keys = ()) -> DataFrame:
    """For each key its streak of sane rows of the greatest duration (the first of equals), if it lasts long enough.

    A row lasts until the next row of the key, the last row not at all. Keys with under two rows or under two sane rows, or
    whose streak is shorter from first to last row than the threshold, have none.
    """
    df = streak_ids(interval_seconds(df, keys, ts, tie, "_len").withColumn("_sane", F.coalesce(F.col(sane), F.lit(False))), "_sane", keys, ts, tie, "_streak")
    out = df.where("_sane").groupBy(*keys, "_streak").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.sum("_len").alias("_len"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    out = out.withColumns({"_all": F.sum("_n").over(w), "_rank": F.row_number().over(w.orderBy(F.desc("_len"), "start"))})
    out = out.where("_rank = 1 and _all >= 2").withColumn("duration_s", seconds_between("start", "end"))
    return out.where(F.col("duration_s") >= threshold_s).select(*keys, "start", "end", "duration_s")


def periodic_learn_list(df: DataFrame, sane: str, days: int, threshold_s: float, id_col: str = "id", ts: str = "timestamp", max_len: int | None = None, seed: int = 42) -> DataFrame:
    """The longest sane streak of each id in each window of some days, counted from the first timestamp of all ids."""
    first = F.broadcast(df.agg(F.min(ts).alias("_first")))  # one row
    at = F.floor(seconds_between(F.col("_first"), F.col(ts)) / (days * 86_400)).cast("long")
    jobs = longest_sane_streak(df.crossJoin(first).withColumn("window", at), sane, (id_col, "window"), ts, threshold_s)
    return jobs if max_len is None else seeded_sample(jobs, max_len, [id_col, "start"], seed)


def seeded_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows, the same for the same keys and seed: those whose keys have the least digests."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))), *keys).limit(n)


def valid_learn_list(df: DataFrame, required: list[str], max_gap_s: float = 60.0, threshold_s: float = 0.0, id_col: str = "id", ts: str = "timestamp") -> DataFrame:
    """Runs of rows with all required columns and no gap over max_gap_s, if they last long enough."""
    df = df.where(all_present(required)).withColumn("_gap", seconds_between(F.lag(ts).over(_w((id_col,), ts)), F.col(ts)) > max_gap_s)
    out = with_run(df, F.col("_gap"), (id_col,), (ts,), "_run").groupBy(id_col, "_run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"))
    out = out.withColumn("duration_s", seconds_between("start", "end"))
    return out.where(F.col("duration_s") >= threshold_s).select(id_col, "start", "end", "duration_s")


def job_rows(df: DataFrame, jobs: DataFrame, id_col: str = "id", ts: str = "timestamp") -> DataFrame:
    """The rows of each job, start included and end not, with the job's start and end; jobs of an id may overlap (see ``intervals``)."""
    first, last = micros(jobs, "start"), micros(jobs, "end") - 1
    j = jobs.select(F.col(id_col).alias("_id"), "start", "end", first.alias("_first"), last.alias("_last"))
    return times_in(df.withColumn("_us", micros(df, ts)), "_us", j, "_first", "_last", [(id_col, "_id")]).drop("_id", "_us", "_first", "_last")


def time_info(df: DataFrame, keys: Keys = ("id",), ts: str = "timestamp") -> DataFrame:
    """Start, end, step and duration (step times rows) of each key; regular says whether there is one step only."""
    df = df.withColumn("_step", seconds_between(F.lag(ts).over(_w(keys, ts)), F.col(ts)))
    out = df.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.min("_step").alias("step__s"), (F.min("_step") == F.max("_step")).alias("regular"), F.count("*").alias("n_rows"))
    return out.withColumn("duration_s", F.col("step__s") * F.col("n_rows"))


def consistent_interval(df: DataFrame, keys: Keys = ("id",), ts: str = "timestamp") -> DataFrame:
    """One row: the step of all keys in seconds, if each is regular and all agree; else null."""
    per = time_info(df, keys, ts).where("step__s is not null")
    return per.agg(F.when(F.bool_and("regular") & (F.min("step__s") == F.max("step__s")), F.min("step__s")).alias("step__s"))


#: Upper ends in seconds of the bins of streak durations; each bin is open below and closed above.
DURATION_BINS = {"1min_5min": 300, "5min_10min": 600, "10min_15min": 900, "15min_30min": 1800, "30min_1h": 3600, "1h_1d": 86_400, "1d_1w": 604_800, "1w_30d": 2_592_000, "over_30d": None}


def duration_bin(seconds: Column, bins: dict[str, float | None] = DURATION_BINS, least: float = 60.0) -> Column:
    out = F.when(seconds <= least, F.lit(None).cast("string"))
    for name, upper in bins.items():
        out = out.otherwise(F.lit(name)) if upper is None else out.when(seconds <= upper, F.lit(name))
    return out


def streak_durations(df: DataFrame, column: str, keys: Keys = ("id",), ts: str = "timestamp") -> DataFrame:
    """For each key the total duration of the streaks with a value, by bin of the streak's duration; a row lasts until the next."""
    df = interval_seconds(df, keys, ts, name="_len").withColumn("_has", F.col(column).isNotNull())
    runs = streak_ids(df, "_has", keys, ts, name="_run").where("_has").groupBy(*keys, "_run").agg(F.sum("_len").alias("_len"))
    runs = runs.withColumn("_bin", duration_bin(F.col("_len"))).where("_bin is not null")
    return runs.groupBy(*keys).pivot("_bin", [*DURATION_BINS]).agg(F.sum("_len"))


def state_transitions(df: DataFrame, state: str, error: str, keys: Keys = ("id",), ts: str = "timestamp") -> DataFrame:
    """Mean and median of the error in the rows before and after the state turns on and off; an unknown state is no turn."""
    w = _w(keys, ts)
    before, after, now = F.coalesce(F.lag(state).over(w), F.lit(False)), F.coalesce(F.lead(state).over(w), F.lit(False)), F.col(state)
    df = df.withColumns({"before_on": ~now & after, "after_on": now & ~before, "before_off": now & ~after, "after_off": ~now & before})
    names = ["before_on", "after_on", "before_off", "after_off"]
    aggs = [f(F.when(F.col(n), F.col(error))).alias(f"{k}_{n}") for n in names for k, f in (("mean", F.avg), ("median", F.median))]
    return df.agg(*aggs)


def weekly_slices(df: DataFrame, id_col: str = "id", ts: str = "timestamp", threshold_s: float = 86_400.0) -> DataFrame:
    """Slices of seven days from the first day of each id on, kept if the last sample is threshold_s or more after the slice's start."""
    day = F.date_trunc("DAY", F.min(ts).over(Window.partitionBy(id_col)))
    df = df.withColumn("_day", day.cast(df.schema[ts].dataType)).withColumn("slice", F.floor(seconds_between(F.col("_day"), F.col(ts)) / 604_800).cast("long"))
    out = df.groupBy(id_col, "slice").agg(F.min("_day").alias("_day"), F.max(ts).alias("last"))
    out = out.withColumn("start", shifted("_day", F.col("slice") * 604_800.0))
    return out.where(seconds_between("start", "last") >= threshold_s).select(id_col, "slice", "start", "last")


def hysteresis_state(df: DataFrame, measured: str, target: str, under: float, over: float, keys: Keys = ("id",), ts: str = "timestamp", name: str = "on") -> DataFrame:
    """On below target - under, off above target + over, else as before; null before the first such row."""
    event = F.when(F.col(measured) < F.col(target) - under, True).when(F.col(measured) > F.col(target) + over, False)
    w = _w(keys, ts).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_ev", event).withColumn(name, F.last("_ev", ignorenulls=True).over(w)).drop("_ev")


def ch_temperature_mask(df: DataFrame, flow: str, ret: str, ch: str, dhw: str, speed: str, max_rise: float = 5.0, keys: Keys = ("id",), order: Keys = ("source_category", "source_type", "timestamp")) -> DataFrame:
    """Flow and return temperature where they tell of space heating, as ch_<flow> and ch_<return>.

    Burning for heating opens the state; burning for hot water, full pump speed without heating, or a rise of flow or
    return over max_rise closes it, and a row with both leaves it. Rows in the open state count while the pump runs.
    """
    w = _w(keys, *order)
    rise = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w) > max_rise, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    opens = yes(F.col(ch))
    closes = yes(F.col(dhw)) | (yes(F.col(speed) == 100) & ~opens) | rise(flow) | rise(ret)
    df = df.withColumn("_ev", F.when(opens & ~closes, 1).when(closes & ~opens, -1))
    df = df.withColumn("_st", F.last("_ev", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    valid = yes((F.col("_st") == 1) & (F.col(speed) != 0))
    return df.withColumns({f"ch_{c}": F.when(valid, F.col(c)) for c in (flow, ret)}).drop("_ev", "_st")


def clip_streak_edges(df: DataFrame, columns: list[str], head: int, tail: int, least: int, keys: Keys = ("id",), ts: str = "timestamp") -> DataFrame:
    """Hides the first head and last tail rows of each run of complete rows, and all of runs of under least rows."""
    df = streak_ids(df.withColumn("_ok", all_present(columns)), "_ok", keys, ts, name="_run")
    w = Window.partitionBy(*keys, "_run")
    df = df.withColumns({"_i": F.row_number().over(w.orderBy(ts)), "_n": F.count("*").over(w)})
    keep = F.col("_ok") & (F.col("_n") >= least) & (F.col("_i") > head) & (F.col("_i") <= F.col("_n") - tail)
    return df.withColumn("_keep", keep).withColumns({c: F.when(F.col("_keep"), F.col(c)) for c in columns}).drop("_ok", "_run", "_i", "_n", "_keep")


def setpoint_proxy(df: DataFrame, flow: str, indoor: str, target: str, keys: Keys = ("id",), ts: str = "timestamp", name: str = "flow_set_proxy") -> DataFrame:
    """The next row's flow temperature (the last row's own), 0 where it is warmer than set."""
    ahead = F.coalesce(F.lead(flow).over(_w(keys, ts)), F.col(flow))
    return df.withColumn("_next", ahead).withColumn(name, F.when(F.col(indoor) > F.col(target), F.lit(0.0)).otherwise(F.col("_next"))).drop("_next")
