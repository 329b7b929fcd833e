import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, d=9, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.4 + rng.normal(size=d)
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x.astype(np.float32))]
    rows += [(n, None, 1), (n + 1, [None] + [0.5] * (d - 1), 1), (n + 2, [float("nan")] * d, 1), (n + 3, [float("inf")] + [0.0] * (d - 1), 1), (n + 4, [1.0], 1), (n + 5, [], 1)]
    rows += [(n + 6, rows[0][1], 1), rows[1], (None, rows[2][1], 1), (n + 7, [-0.0] * d, 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _id", "2 as _x", "3 as component", "4 as n", "5 as deviation", "6 as whitened", "7 as _v", "8 as k")


def test_against_numpy(spark):
    rows = vectors()
    out = whitening.whitened_vectors(frame(spark, rows)).collect()
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, _ in rows if v is not None and len(v) == 9 and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, dtype=np.float64)
    a -= a.mean(axis=0)
    cov = a.T @ a / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(out) == 4 * len(good) and n < len(good)
    by = {}
    for r in out:
        by.setdefault(r["component"], []).append(r)
    x = {i: v for i, v in good}
    for k in range(1, 5):
        sign = None
        for r in by[k]:
            v = x[r["vec_id"]]
            assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(v, sums))
            want = (np.array(v) - np.array(sums) / n) @ basis[:, k - 1] / math.sqrt(values[k - 1])
            sign = sign or math.copysign(1, want * r["whitened"])
            assert abs(r["whitened"] * sign - want) < 1e-8
            assert abs(r["explained"] / (values[k - 1] / np.trace(cov)) - 1) < 1e-9 and r["identity_error"] < 1e-9
    assert sum(r["vec_id"] is None for r in by[1]) == 1


@pytest.mark.parametrize("low,high,rows", [(-5, 5, 3), (0, 0, 70), (-(2**31), 2**31, 100), (-(2**61), 2**61, 130), (10**6, 10**6 + 3, 5000), (-(2**63), 2**63 - 1, 65)])
def test_scatter_is_exact(spark, low, high, rows):
    rng = np.random.default_rng(2)
    x = [[int(v) for v in rng.integers(low, high, 3, dtype=np.int64, endpoint=True)] for _ in range(rows)]
    df = spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(3)
    n, sums, cross = whitening.exact_scatter(df)
    assert n == rows and sums == [sum(v[i] for v in x) for i in range(3)]
    assert cross == [[sum(v[i] * v[j] for v in x) for j in range(3)] for i in range(3)]


def test_carries():
    s = whitening.Scatter(2, 40)
    rng = np.random.default_rng(5)
    total = np.zeros((3, 3), dtype=object)
    for i in range(5):
        y = rng.integers(0, 2**40, (100, 2), dtype=np.uint64)
        s.add(y)
        s.carry()
        z = np.column_stack((y, np.ones(100, dtype=np.uint64))).astype(object)
        total = total + z.T @ z
    got = sum(s.digits[k].astype(object) << (whitening.DIGIT * k) for k in range(len(s.digits)))
    assert (got == total).all() and all((s.digits[k] < 1 << whitening.DIGIT).all() for k in range(len(s.digits) - 1))


def test_edges(spark):
    assert whitening.whitened_vectors(frame(spark, [])).count() == 0
    one = whitening.whitened_vectors(frame(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 1 and r["identity_error"] is None for r in one)
    # a direction without spread
    flat = whitening.whitened_vectors(frame(spark, [(i, [i / 4, 1.0, 2.0], 1) for i in range(10)])).collect()
    assert {r["component"] for r in flat if r["whitened"] is not None} == {1} and len(flat) == 30
    kinds = dict(whitening.whitened_vectors(frame(spark, vectors(20))).dtypes)
    assert kinds == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert frame(spark, vectors(5)).where(F.col("embedding").isNull()).count() == 1


def test_wide_deviations_are_exact_or_raise(spark):
    model = whitening.Whitening(10**9, [0, 0], np.ones(1), np.array([[1.0], [0.0]]), 1.0, 0.0)
    fits = spark.createDataFrame([(1, [2, 1])], "_id long, _x array<long>")
    assert whitening.whiten(fits, model).first()["deviation"] == 5 * 10**18
    with pytest.raises(Exception):
        whitening.whiten(spark.createDataFrame([(1, [4, 1])], "_id long, _x array<long>"), model).collect()
