"""Weather at the homes' places from stations, and nearest points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.sources.io import kept


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.sin((c - a) / 2) ** 2 + F.cos(a) * F.cos(c) * F.sin((d - b) / 2) ** 2
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


#: Most places that shape a quadtree, and about the most places of a sample in one leaf.
SAMPLE, LEAF = 200_000, 64
#: Halvings of each axis at most.
DEPTH = 24


class Quadtree:
    """Leaves of a globe in degrees, split while more than leaf of some sampled places are inside; leaves cover everything, so any place has one."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, leaf: int = LEAF):
        code = self.code(lat, lon)
        code.sort()
        starts, todo = [], [(0, 0, 0, len(code))]
        while todo:
            depth, start, a, b = todo.pop()
            if b - a <= leaf or depth == DEPTH:
                starts.append(start)
                continue
            size = 1 << 2 * (DEPTH - depth - 1)
            edges = [a, *(int(np.searchsorted(code, start + i * size)) for i in (1, 2, 3)), b]
            todo += [(depth + 1, start + i * size, edges[i], edges[i + 1]) for i in range(4)]
        self.starts = np.sort(np.array(starts, dtype=np.int64))

    @staticmethod
    def code(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """The places' cells at full depth, bits of both axes interleaved."""
        out = np.zeros(len(lat), dtype=np.int64)
        last = (1 << DEPTH) - 1
        y = np.clip((lat + 90) / 180 * (last + 1), 0, last).astype(np.int64)
        x = np.clip(np.mod(lon + 180, 360) / 360 * (last + 1), 0, last).astype(np.int64)
        for i in range(DEPTH):
            out |= ((y >> i & 1) << (2 * i + 1)) | ((x >> i & 1) << (2 * i))
        return out

    def leaf(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.code(lat, lon), side="right") - 1


def _sampled(places: DataFrame, n: int) -> np.ndarray:
    """About SAMPLE of n places at most, chosen by hash."""
    some = places if n <= SAMPLE else places.where(F.pmod(F.xxhash64("_la", "_lo"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    return some.select("_la", "_lo").toPandas().to_numpy(np.float64)


def _leaved(places: DataFrame, tree: Quadtree, name: str) -> DataFrame:
    def run(batches):
        for b in batches:
            b[name] = tree.leaf(b["_la"].to_numpy(), b["_lo"].to_numpy())
            yield b

    return places.mapInPandas(run, T.StructType([*places.schema.fields, T.StructField(name, T.LongType())]))


def _boxes(places: DataFrame, leaf: str) -> dict[str, np.ndarray]:
    """By leaf the number of its places, and a circle that holds them all: centre and angle in radians."""
    b = places.groupBy(leaf).agg(F.count("*").alias("n"), *(f(c).alias(f"{k}{c}") for c in ("_la", "_lo") for k, f in (("a", F.min), ("b", F.max)))).toPandas()
    lat, lon = np.radians((b["a_la"] + b["b_la"]) / 2).to_numpy(), np.radians((b["a_lo"] + b["b_lo"]) / 2).to_numpy()
    wide = np.radians((b["b_lo"] - b["a_lo"]) / 2).to_numpy()
    # the farthest place of a box from its centre is a corner, unless the box is wider than half the globe
    r = np.maximum(*(_angle(lat, lon, np.radians(b[c]).to_numpy(), lon + wide) for c in ("a_la", "b_la"))) if len(b) else np.empty(0)
    return {"leaf": b[leaf].to_numpy(np.int64), "n": b["n"].to_numpy(np.int64), "lat": lat, "lon": lon, "r": np.where(wide > np.pi / 2, np.pi, r * (1 + 1e-9) + 1e-12)}


def _angle(lat1, lon1, lat2, lon2):
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def _reached(box: dict[str, np.ndarray], i: int, to: dict[str, np.ndarray], k: int) -> np.ndarray:
    """Places in to of the leaves that may hold one of the k nearest points of any place of leaf i of box."""
    d = _angle(box["lat"][i], box["lon"][i], to["lat"], to["lon"])
    most = d + box["r"][i] + to["r"]
    order = np.argsort(most, kind="stable")
    enough = order[min(int(np.searchsorted(np.cumsum(to["n"][order]), k)), len(order) - 1)]
    return np.flatnonzero(d - box["r"][i] - to["r"] <= most[enough])


def nearest_k(cells: DataFrame, points: DataFrame, k: int, cell_id: str = "cell", point_id: str = "point", lat: str = "lat", lon: str = "lon", leaf: int = LEAF) -> DataFrame:
    """The k nearest points of each cell, ties by the point's id. Cells and points without a place have no rows.

    Distinct places of cells, and of points (with the k least ids of each place), are dealt by two quadtrees, whose leaves split by the number of places
    in a bounded sample of each side; samples shape the trees alone. Exact counts and extents by leaf bound how far the k-th
    point of any place in a leaf can be, across the date line and the poles too, and so give the leaves of points to compare; a task compares
    the places of a leaf with the points of the leaves in reach, and keeps k for each. The number of leaves, which is what the
    driver holds, is bounded by the samples.
    """
    side = lambda df, i, n: df.select(F.col(i).alias(n), F.col(lat).cast("double").alias("_la"), F.col(lon).cast("double").alias("_lo")).where("_la is not null and _lo is not null and not isnan(_la) and not isnan(_lo)")
    c, p = side(cells, cell_id, "_c"), side(points, point_id, "_p")
    places = c.select("_la", "_lo").distinct()
    first = F.row_number().over(Window.partitionBy("_la", "_lo").orderBy("_p"))
    p = p.withColumn("_i", first).where(F.col("_i") <= k).drop("_i")
    schema = T.StructType([*places.schema.fields, *p.select("_p").schema.fields, T.StructField("rank", T.IntegerType()), T.StructField("distance__km", T.DoubleType())])
    n_places, n_points = places.count(), p.count()
    if not n_places or not n_points:
        found = cells.sparkSession.createDataFrame([], schema)
    else:
        places = kept(_leaved(places, Quadtree(*_sampled(places, n_places).T, leaf), "_from"), "cell-places")
        p = kept(_leaved(p, Quadtree(*_sampled(p, n_points).T, leaf), "_to"), "point-places")
        box, to = _boxes(places, "_from"), _boxes(p, "_to")

        def pairs(batches):
            for b in batches:
                for i in b["i"]:
                    near = _reached(box, i, to, k)
                    yield pd.DataFrame({"_from": np.full(len(near), box["leaf"][i]), "_to": to["leaf"][near]})

        near = cells.sparkSession.range(len(box["leaf"])).toDF("i").mapInPandas(pairs, "_from long, _to long")
        dealt = near.join(p, "_to").select("_from", "_la", "_lo", "_p")

        def chosen(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
            there = there.sort_values("_p", kind="stable")
            ids, tlat, tlon = there["_p"].to_numpy(), np.radians(there["_la"].to_numpy()), np.radians(there["_lo"].to_numpy())
            m, out, step = min(k, len(ids)), [], max(1, (1 << 20) // max(1, len(ids)))
            for i in range(0, len(here), step):
                la, lo = here["_la"].to_numpy()[i : i + step], here["_lo"].to_numpy()[i : i + step]
                d = 6371.0 * _angle(np.radians(la)[:, None], np.radians(lo)[:, None], tlat[None], tlon[None])
                best = np.argsort(d, axis=1, kind="stable")[:, :m]  # equal distances stay in order of ids
                out.append(pd.DataFrame({"_la": la.repeat(m), "_lo": lo.repeat(m), "_p": ids[best.ravel()], "rank": np.tile(np.arange(1, m + 1, dtype=np.int32), len(la)), "distance__km": np.take_along_axis(d, best, axis=1).ravel()}))
            return pd.concat(out) if out else pd.DataFrame(columns=schema.names)

        found = places.groupBy("_from").cogroup(dealt.groupBy("_from")).applyInPandas(chosen, schema)
    return c.join(found, ["_la", "_lo"]).select(F.col("_c").alias(cell_id), F.col("_p").alias(point_id), "rank", "distance__km")


def spline_coefficients(stations: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of the thin-plate spline with a linear trend through the stations' values: one for each station, then constant, latitude and longitude.

    With under three stations, or stations on a line, the least-norm solution is taken.
    """
    r2 = ((stations[:, None, :] - stations[None, :, :]) ** 2).sum(2)
    kernel = np.where(r2 > 0, 0.5 * r2 * np.log(np.maximum(r2, 1e-300)), 0.0)
    trend = np.column_stack([np.ones(len(stations)), stations])
    system = np.block([[kernel, trend], [trend.T, np.zeros((3, 3))]])
    return np.linalg.pinv(system)[:, : len(stations)] @ values


def station_weights(stations: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(places x stations): what each station's value counts for in the spline's value at each place."""
    r2 = ((places[:, None, :] - stations[None, :, :]) ** 2).sum(2)
    kernel = np.where(r2 > 0, 0.5 * r2 * np.log(np.maximum(r2, 1e-300)), 0.0)
    solved = spline_coefficients(stations, np.eye(len(stations)))
    return np.column_stack([kernel, np.ones(len(places)), places]) @ solved


#: Homes, and times of a property, of one block of the product.
HOMES, TIMES = 512, 512


def spatial_interpolate(weather: DataFrame, homes: DataFrame, stations: DataFrame, station_id: str = "station", id_col: str = "id", ts: str = "timestamp", lat: str = "lat", lon: str = "lon", homes_a_block: int = HOMES, times_a_block: int = TIMES) -> DataFrame:
    """(id, timestamp, property, value) at the homes from (station, timestamp, property, value).

    The value at a home is a sum of the stations' values by weights that hang only on the places, so all times with the same stations
    share them. The values of a time and property make one row; these rows and the homes are dealt into blocks, and each task multiplies
    the weights of a block of homes by the values of a block of times. There are as many tasks as blocks, so their number follows homes x times.
    """
    known = weather.where("value is not null").join(stations.select(F.col(station_id).alias("_s"), F.col(lat).alias("_sla"), F.col(lon).alias("_slo")), F.col(station_id) == F.col("_s"))
    sets = known.groupBy(ts, "property").agg(F.sort_array(F.collect_list(F.struct("_s", "_sla", "_slo", "value"))).alias("_m"))
    sets = kept(sets.select(ts, "property", *(F.col(f"_m.{c}").alias(c) for c in ("_sla", "_slo", "value"))), "station-values")
    places = kept(homes.select(F.col(id_col).alias("_h"), F.col(lat).cast("double").alias("_la"), F.col(lon).cast("double").alias("_lo")), "places")
    schema = T.StructType([places.schema["_h"], sets.schema[ts], sets.schema["property"], T.StructField("value", T.DoubleType())])
    n_times, n_homes = max(1, -(-sets.count() // times_a_block)), max(1, -(-places.count() // homes_a_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sets = sets.withColumns({"_t": F.pmod(F.xxhash64(ts, "property"), F.lit(n_times)).cast("int"), "_b": every(n_homes)})
    places = places.withColumns({"_b": F.pmod(F.xxhash64("_h"), F.lit(n_homes)).cast("int"), "_t": every(n_times)})

    def product(values: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out, at = [], block[["_la", "_lo"]].to_numpy()
        same: dict[bytes, list[int]] = {}
        for i, (x, y) in enumerate(zip(values["_sla"], values["_slo"])):
            same.setdefault(np.column_stack([x, y]).tobytes(), []).append(i)
        for key, rows in same.items():
            found = station_weights(np.frombuffer(key).reshape(-1, 2), at) @ np.column_stack([values["value"].iloc[i] for i in rows])
            out.append(pd.DataFrame({"_h": block["_h"].to_numpy().repeat(len(rows)), ts: np.tile(values[ts].to_numpy()[rows], len(block)), "property": np.tile(values["property"].to_numpy()[rows], len(block)), "value": found.ravel()}))
        out = pd.concat(out) if out else pd.DataFrame(columns=schema.names)
        return out.astype({"value": "float64"}).replace({"value": {np.nan: None}})

    n = n_times * n_homes
    dealt = sets.repartition(n, "_t", "_b").groupBy("_t", "_b").cogroup(places.repartition(n, "_t", "_b").groupBy("_t", "_b"))
    return dealt.applyInPandas(product, schema).withColumnRenamed("_h", id_col)


def weather_metric_scale(df: DataFrame, metrics: dict[str, tuple[str, float]], keys: list[str]) -> DataFrame:
    """Metrics by their new name and factor, in place of the old ones, without duplicate keys."""
    return df.select(*keys, *((F.col(old) * F.lit(f)).alias(new) for old, (new, f) in metrics.items())).dropDuplicates(keys)


def weather_window(df: DataFrame, without: str, source: str = "source_type", ts: str = "timestamp") -> DataFrame:
    """One row: first and last time of all sources but one."""
    return df.where(F.col(source) != without).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


def bilinear_lookup(df: DataFrame, surface: DataFrame, model: str, x: str, y: str, value: str, step_x: float, step_y: float, name: str) -> DataFrame:
    """The surface's value between its grid points, with x and y held within each model's grid; null where one is missing.

    surface has (model, x, y, value) on a regular grid of the given steps.
    """
    span = surface.groupBy(model).agg(*(f(c).alias(f"_{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))))
    df = df.join(span, model, "left")
    held = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_lo{c}")), F.col(f"_hi{c}"))) for c in (x, y)}
    steps = {x: step_x, y: step_y}
    df = df.withColumns({f"_h{c}": h for c, h in held.items()})
    df = df.withColumns({f"_i{c}": F.floor((F.col(f"_h{c}") - F.col(f"_lo{c}")) / steps[c]).cast("long") for c in (x, y)})
    df = df.withColumns({f"_f{c}": (F.col(f"_h{c}") - F.col(f"_lo{c}")) / steps[c] - F.col(f"_i{c}") for c in (x, y)})
    grid = surface.join(span, model).select(model, F.round((F.col(x) - F.col(f"_lo{x}")) / step_x).cast("long").alias("_gx"), F.round((F.col(y) - F.col(f"_lo{y}")) / step_y).cast("long").alias("_gy"), F.col(value).alias("_v"))
    for a in (0, 1):
        for b in (0, 1):
            part = grid.select(F.col(model).alias("_m"), F.col("_gx").alias("_px"), F.col("_gy").alias("_py"), F.col("_v").alias(f"_v{a}{b}"))
            df = df.join(part, (F.col(model) == F.col("_m")) & (F.col(f"_i{x}") + a == F.col("_px")) & (F.col(f"_i{y}") + b == F.col("_py")), "left").drop("_m", "_px", "_py")
    fx, fy = F.col(f"_f{x}"), F.col(f"_f{y}")
    # at the upper edges the far neighbour doesn't exist and has no weight
    term = lambda v, w: F.when(w == 0, F.lit(0.0)).otherwise(F.col(v) * w)
    out = term("_v00", (1 - fx) * (1 - fy)) + term("_v10", fx * (1 - fy)) + term("_v01", (1 - fx) * fy) + term("_v11", fx * fy)
    helpers = [f"_{n}{c}" for c in (x, y) for n in ("lo", "hi", "h", "i", "f")] + [f"_v{a}{b}" for a in (0, 1) for b in (0, 1)]
    return df.withColumn(name, out).drop(*helpers)


def slope_matrix(at: np.ndarray) -> np.ndarray:
    """Slopes at the nodes of the cubic spline through values there, as a matrix that multiplies the values.

    The third derivative goes on over the second and the last but one node, so values of a cubic give it back; three nodes give a parabola, two a line.
    """
    n, h = len(at), np.diff(at)
    if n == 1:
        return np.zeros((1, 1))
    step = np.zeros((n - 1, n))  # differences of neighbours over their distance
    step[np.arange(n - 1), np.arange(n - 1)], step[np.arange(n - 1), np.arange(1, n)] = -1 / h, 1 / h
    if n == 2:
        return np.repeat(step, 2, axis=0)
    if n == 3:
        bend = (step[1] - step[0]) / (h[0] + h[1])
        return np.array([step[0] - bend * h[0], step[0] + bend * h[0], step[1] + bend * h[1]])
    a, b = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1], a[i, i], a[i, i + 1] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        b[i] = 3 * (h[i] * step[i - 1] + h[i - 1] * step[i])
    for row, i in ((0, 0), (n - 1, n - 3)):
        u, v = 1 / h[i] ** 2, 1 / h[i + 1] ** 2
        a[row, i], a[row, i + 1], a[row, i + 2] = u, u - v, -v
        b[row] = 2 * (u * step[i] - v * step[i + 1])
    return np.linalg.solve(a, b)


def spline_lookup(df: DataFrame, surface: DataFrame, model: str, x: str, y: str, value: str, name: str) -> DataFrame:
    """The surface's value on a bicubic spline through its grid points, with x and y held within each model's grid.

    surface has (model, x, y, value) on a grid of any steps, small enough a model for one task. The spline of a model is solved once, as values, slopes
    and twists at the corners of each cell; rows meet their cell in one join and are evaluated in expressions. Null where x or y is missing,
    and for models that have no grid or one with holes.
    """
    kind = surface.schema[model]
    corners = [f"_{c}{i}{j}" for c in ("f", "x", "y", "t") for i in (0, 1) for j in (0, 1)]

    def cells(g: pd.DataFrame) -> pd.DataFrame:
        g = g[[x, y, value]].astype(float).dropna().drop_duplicates([x, y])
        grid = g.pivot(index=x, columns=y, values=value)
        at, f = (grid.index.to_numpy(), grid.columns.to_numpy()), grid.to_numpy()
        if not f.size or np.isnan(f).any():
            return pd.DataFrame(columns=[f.name for f in schema])
        dx, dy = slope_matrix(at[0]), slope_matrix(at[1])
        nodes = {"f": f, "x": dx @ f, "y": f @ dy.T, "t": dx @ f @ dy.T}
        i, j = (m.ravel() for m in np.meshgrid(np.arange(max(1, len(at[0]) - 1)), np.arange(max(1, len(at[1]) - 1)), indexing="ij"))
        far = lambda k, axis, d: np.minimum(k + d, len(at[axis]) - 1)
        out = {"_ix": i, "_iy": j, "_x0": at[0][i], "_x1": at[0][far(i, 0, 1)], "_y0": at[1][j], "_y1": at[1][far(j, 1, 1)]}
        out |= {f"_{c}{a}{b}": v[far(i, 0, a), far(j, 1, b)] for c, v in nodes.items() for a in (0, 1) for b in (0, 1)}
        return pd.DataFrame(out)

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("_ix", "_iy")] + [T.StructField(c, T.DoubleType()) for c in ("_x0", "_x1", "_y0", "_y1", *corners)])
    named = T.StructType([T.StructField("_m", kind.dataType), *schema.fields])
    solved = kept(surface.where(F.col(model).isNotNull()).groupBy(model).applyInPandas(lambda key, g: cells(g).assign(_m=key[0])[named.names], named), "spline-cells")
    # a cell goes from its lower edge on to its upper one, the outermost also beyond
    axes = solved.groupBy(F.col("_m").alias("_am")).agg(F.array_sort(F.collect_set("_x0")).alias("_xs"), F.array_sort(F.collect_set("_y0")).alias("_ys"))
    place = lambda c, edges: F.greatest(F.size(F.filter(edges, lambda e: e <= F.col(c))) - 1, F.lit(0)).cast("long")
    out = df.join(axes, F.col(model) == F.col("_am"), "left").withColumns({"_px": F.when(F.col(x).isNotNull(), place(x, F.col("_xs"))), "_py": F.when(F.col(y).isNotNull(), place(y, F.col("_ys")))})
    out = out.join(solved, (F.col("_am") == F.col("_m")) & (F.col("_px") == F.col("_ix")) & (F.col("_py") == F.col("_iy")), "left")

    def basis(c: str, low: str, high: str) -> tuple[Column, list[tuple[Column, Column]]]:
        wide = F.col(high) - F.col(low)
        u = F.when(wide > 0, (F.least(F.greatest(F.col(c), F.col(low)), F.col(high)) - F.col(low)) / wide).otherwise(F.lit(0.0))
        rest = 1 - u
        return wide, [((1 + 2 * u) * rest * rest, u * rest * rest * wide), (u * u * (3 - 2 * u), -u * u * rest * wide)]

    (_, bx), (_, by) = basis(x, "_x0", "_x1"), basis(y, "_y0", "_y1")
    terms = [F.col(f"_{c}{a}{b}") * bx[a][c in "xt"] * by[b][c in "yt"] for c in ("f", "x", "y", "t") for a in (0, 1) for b in (0, 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), total).alias(name))
