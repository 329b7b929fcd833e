"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Entries become whole numbers, ``floor(256 * entry)``. The fit list holds each distinct vector once. Every dimension is
shifted by its least value, so what is left are non-negative numbers of a few bits; bit p of one dimension over 64 rows is one
word, and the cross-product of two dimensions is the sum over pairs of bit planes of 2**(p + q) times the number of
bits that both words have. A last dimension of ones gives the sums and the number of rows along with it. Tasks add
popcounts up in digits of base 2**40, Spark sums the digits, and the driver, which gets as many numbers as the matrix
has entries, puts them together as Python integers: the scatter is exact for any number of rows and any spread, and is
centred as integers, n * G - S * S', before it is divided once. ``eigh`` gives the components.

Defined results: rows with a null vector, or with null or non-finite entries, are left out, and so are rows whose vector
hasn't the commonest length (of equally common ones the longest); rows with a null id are whitened like others; repeated
rows come back as often as they are there, but count once in the fit; with fewer dimensions than components there are fewer rows a
vector; a component along which the fit list has no spread has a null ``whitened``, and ``explained`` is null where nothing spreads;
entries beyond 2**55 are held at the ends of a 64-bit integer; ``deviation`` raises where it does not fit into 64 bits;
an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import saved, slices

SCALE, COMPONENTS = 256, 4
#: Rows of one block of bit planes; bits of one digit of a sum; words that one step of the popcount may hold.
BLOCK, DIGIT, WORDS = 4_096, 40, 1 << 20
#: A component whose eigenvalue is a smaller part of the trace has no spread.
FLAT = 1e-13


@dataclass
class Whitening:
    """What the fit knows: vectors in the fit list, their sums, and the components with their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(_id, _x array<long>) of the usable rows."""
    v = F.col("_v")
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v")).where(
        v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    )
    common = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long"))
    return rows.where(F.size("_v") == F.lit(common["d"] if common else 0)).select("_id", x.alias("_x"))


def matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of least and greatest values."""
    low = high = None
    for b in batches:
        if b.num_rows:
            x = matrix(b.column(0))
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
    if low is not None:
        yield pa.RecordBatch.from_arrays([pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))], names=["low", "high"])


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of non-negative numbers (rows x dimensions): words (bits x dimensions x rows / 64)."""
    rows = -(-len(y) // 64) * 64
    out = np.zeros((bits, y.shape[1], rows // 8), dtype=np.uint8)
    for p in range(bits):
        packed = np.packbits(((y >> np.uint64(p)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        out[p, :, : packed.shape[1]] = packed
    return out.view(np.uint64)


def popcounts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that each row of words of a shares with each row of b."""
    step = max(1, WORDS // max(1, b.size))
    return np.concatenate([np.bitwise_count(a[i : i + step, None] & b[None]).sum(axis=2, dtype=np.int64) for i in range(0, len(a), step)])


class Scatter:
    """Cross-products of shifted rows and of a one behind them, as digits of base 2**DIGIT."""

    def __init__(self, dims: int, bits: int):
        self.bits, self.blocks = bits, 0
        self.digits = np.zeros((2 * bits // DIGIT + 3, dims + 1, dims + 1), dtype=np.int64)

    def add(self, y: np.ndarray) -> None:
        words = planes(np.column_stack((y, np.ones(len(y), dtype=np.uint64))), self.bits)
        used = [p for p in range(self.bits) if words[p].any()]
        for p in used:
            for q in used:
                if q < p:
                    continue
                both = popcounts(words[p], words[q])
                k, shift = divmod(p + q, DIGIT)
                self.digits[k] += (both if p == q else both + both.T) << shift
        self.blocks += 1
        if self.blocks % 256 == 0:
            self.carry()

    def carry(self) -> None:
        for k in range(len(self.digits) - 1):
            self.digits[k + 1] += self.digits[k] >> DIGIT
            self.digits[k] &= (1 << DIGIT) - 1


def _scatter(batches: Iterator[pa.RecordBatch], low: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(k, i, values): digit k of row i of the scatter, from the diagonal on."""
    found, waiting, held = Scatter(len(low), bits), [], 0

    def done() -> None:
        y = np.concatenate(waiting)
        found.add((y.view(np.uint64) - low.view(np.uint64)[None]))  # modulo 2**64, as the difference may be wider than a long
        waiting.clear()

    for b in slices(batches, rows=BLOCK):
        x = matrix(b.column(0))
        if held + len(x) > BLOCK:
            done()
            held = 0
        waiting.append(x)
        held += len(x)
    if held:
        done()
        found.carry()
        for k, rows in enumerate(found.digits):
            if rows.any():
                d = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([k] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([r[i:].tolist() for i, r in enumerate(rows)], pa.list_(pa.int64()))], names=["k", "i", "values"])


def exact_scatter(fit_list: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, their sums and their cross-products, exact. fit_list: one column of whole-number arrays of one length."""
    fit_list = fit_list.toDF("_x")
    ends = fit_list.mapInArrow(_ends, "low array<long>, high array<long>")
    ends = ends.select(F.posexplode(F.arrays_zip("low", "high")).alias("i", "e")).groupBy("i").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high")).orderBy("i").collect()
    if not ends:
        return 0, [], []
    low, d = [r["low"] for r in ends], len(ends)
    bits = max(1, *((r["high"] - r["low"]).bit_length() for r in ends))
    shift = np.array(low, dtype=np.int64)
    parts = fit_list.mapInArrow(lambda batches: _scatter(batches, shift, bits), "k int, i int, values array<long>")
    sums = parts.select("k", "i", F.posexplode("values").alias("j", "v")).groupBy("k", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    g = [[0] * (d + 1) for _ in range(d + 1)]
    for k, i, j, v in zip(*(sums.column(c).to_pylist() for c in ("k", "i", "j", "v"))):
        g[i][i + j] += v << (DIGIT * k)
    n, shifted = g[d][d], [g[i][d] for i in range(d)]
    # undo the shift: x = y + low
    cross = [[g[min(i, j)][max(i, j)] + low[i] * shifted[j] + low[j] * shifted[i] + n * low[i] * low[j] for j in range(d)] for i in range(d)]
    return n, [s + n * a for s, a in zip(shifted, low)], cross


def _whitened(x: np.ndarray, model: Whitening, basis: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Rows projected on the components' unit-variance axes, and their deviations."""
    n, sums = model.n, np.array(model.sums, dtype=object)
    width = max(1, max(map(abs, model.sums)), n * int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 1) * 2
    if width < 1 << 62:
        off = n * x - sums.astype(np.int64)[None]
        wide = off.astype(np.float64)
        if (wide * wide).sum(axis=1).max(initial=0) < 2.0**62:
            return wide / n @ basis, (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - sums[None]
    return off.astype(np.float64) / n @ basis, [int(s) for s in (off * off).sum(axis=1)]


def _basis(model: Whitening) -> np.ndarray:
    """Dimensions x components; nan where there is no spread."""
    spread = model.values > FLAT * model.trace
    return np.where(spread, model.vectors / np.sqrt(np.where(spread, model.values, 1.0)), np.nan)


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """rows: from quantised, written."""
    fit_list = saved(rows.select("_x").distinct(), "fit-list")
    n, sums, cross = exact_scatter(fit_list)
    d = len(sums)
    if not d:
        return Whitening(n, sums, np.empty(0), np.empty((0, 0)), 0.0)
    cov = np.array([[(n * cross[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])  # integers, divided once
    values, vectors = np.linalg.eigh(cov)
    model = Whitening(n, sums, values[::-1][:components].copy(), vectors[:, ::-1][:, :components].copy(), sum(n * cross[i][i] - sums[i] ** 2 for i in range(d)) / (n * n))
    model.identity_error = _identity_error(fit_list, model)
    return model


def _identity_error(fit_list: DataFrame, model: Whitening) -> float | None:
    """Measured over the whitened fit list."""
    basis = _basis(model)
    basis = basis[:, ~np.isnan(basis[0])]
    c = basis.shape[1]
    if not c:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=BLOCK):
            w, _ = _whitened(matrix(b.column(0)), model, basis)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k].copy()) for k in range(c)], names=[f"c{k}" for k in range(c)])

    axes = fit_list.mapInArrow(run, ", ".join(f"c{k} double" for k in range(c)))
    pairs = [(a, b) for a in range(c) for b in range(a, c)]
    found = axes.agg(*(F.covar_pop(f"c{a}", f"c{b}").alias(f"v{a}_{b}") for a, b in pairs)).first()
    return max(abs(v - (a == b)) for (a, b), v in zip(pairs, found))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(_id, component, n, deviation, whitened, explained, identity_error): a row for each row of quantised and each component."""
    kind = rows.schema["_id"].dataType
    basis, trace = _basis(model), model.trace
    c = len(model.values)
    explained = pa.array([v / trace if trace > 0 else None for v in model.values.tolist()], pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=BLOCK):
            w, off = _whitened(matrix(b.column(1)), model, basis)
            m, at = b.num_rows, np.arange(b.num_rows).repeat(c)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, model.n, dtype=np.int64)), pa.array(off, pa.int64()).take(pa.array(at)),
                 pa.array(w.reshape(-1), from_pandas=True), explained.take(pa.array(np.tile(np.arange(c), m))), pa.array([model.identity_error] * (m * c), pa.float64())],
                names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = T.StructType([T.StructField("_id", kind)] + T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields)
    return rows.select("_id", "_x").mapInArrow(run, schema) if c else rows.sparkSession.createDataFrame([], schema)


def whitened_vectors(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of every usable row."""
    rows = saved(quantised(vectors, id_col, vec_col), "whole-vectors")
    return whiten(rows, fit_whitening(rows, components)).withColumnRenamed("_id", id_col)
