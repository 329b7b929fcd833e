"""Document quality by random Fourier features over document statistics.

Each text becomes a row of statistics (shape of characters, words, lines and repetition). Random Fourier features
approximate a Gaussian kernel over the standardised statistics. Every partition of the training rows sums its part of
the normal equations, Spark adds the parts row by row, and one small solve gives the ridge weights. Isotonic
calibration on a held-back fold turns ridge values into scores of 0 to 1.

Ties: equal statistics have equal scores, also where their labels differ. Defined results: null text counts as an empty one, and empty texts are scored like any other; texts of any length are
scored whole; without both classes among the labels every score is the share of label 1 (0 without labels); an id labelled
more than once takes its largest label; repeated rows and equal texts score alike; an empty table gives no rows; other
columns pass through, but for one named score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import saved, slices
from hearthline.llm.labelled import CLASS_BOUND, labelled_sample

FEATURES, RIDGE, SEED = 256, 1e-3, 7
STATISTICS = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digit", "stop", "shout", "symbol", "bar", "space", "non_ascii",
    "log_line_length", "repeated_lines", "distinct_words", "distinct_pairs", "doubled_words", "top_word", "capital_words",
)

#: Class of each byte: 0 other, 1 upper, 2 lower, 3 digit, 4 stop and comma, 5 exclamation and question, 6 symbol, 7 bar, 8 space, 9 beyond ASCII.
_CLASS = np.array([9 if c > 127 else 1 if chr(c).isupper() else 2 if chr(c).islower() else 3 if chr(c).isdigit() else 4 if chr(c) in ".,;:'\"-" else 5 if chr(c) in "!?" else 7 if chr(c) == "|" else 8 if chr(c).isspace() else 6 for c in range(256)], dtype=np.uint8)


def statistics(text: str | None) -> list[float]:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = np.bincount(_CLASS[raw], minlength=10) / max(1, len(raw))
    letters = max(n[1] + n[2] + n[9], 1e-9)
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x]
    w = max(1, len(words))
    pairs = list(zip(words, words[1:]))
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    return [
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / w, sum(len(x) > 14 for x in words) / w, n[1] / letters, n[3], n[4], n[5], n[6], n[7], n[8], n[9],
        np.log1p(len(raw) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), len(counts) / w, len(set(pairs)) / max(1, len(pairs)), sum(a == b for a, b in pairs) / w, max(counts.values(), default=0) / w, sum(x[0].isupper() for x in words) / w,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    constant: float | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of the statistics, and a one."""
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(len(STATISTICS), FEATURES)) / np.sqrt(len(STATISTICS))
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.features(x) @ self.weights, *self.steps), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit by pooling neighbours; the mean x and the value of each pool. Equal x are one from the start, in whatever order they come."""
    x, of = np.unique(x, return_inverse=True)
    total = np.bincount(of, weight)
    pools: list[list[float]] = []  # value, weight, sum of weighted x
    for xi, yi, wi in zip(x, np.bincount(of, y * weight) / total, total):
        pools.append([yi, wi, xi * wi])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, s = pools.pop()
            p = pools[-1]
            pools[-1] = [(p[0] * p[1] + v * w) / (p[1] + w), p[1] + w, p[2] + s]
    return np.array([s / w for _, w, s in pools]), np.array([v for v, _, _ in pools])


def _with_statistics(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics(t) for t in b.column(0).to_pylist()], dtype=float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(x[:, i].copy()) for i in range(x.shape[1]))], names=[*keep, *STATISTICS])

    schema = df.select(*keep).schema
    for s in STATISTICS:
        schema = schema.add(s, "double")
    return df.select(text_col, *keep).mapInArrow(run, schema)


def _normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of the products of their features, and of features and labels."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            z, w = model.features(b[list(STATISTICS)].to_numpy()), b["weight"].to_numpy()
            total += (z * w[:, None]).T @ np.column_stack([z, b["label"].to_numpy(float)])
        yield pd.DataFrame({"i": np.arange(FEATURES + 1, dtype=np.int32), "part": [r.tobytes() for r in total]})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": b["i"].iloc[:1], "part": [sum(np.frombuffer(x) for x in b["part"]).tobytes()]})

    sums = rows.mapInPandas(part, "i int, part binary").groupBy("i").applyInPandas(add, "i int, part binary").toPandas().sort_values("i")
    total = np.array([np.frombuffer(x) for x in sums["part"]])
    return total[:, :-1], total[:, -1]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = CLASS_BOUND, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fitted on about bound documents of each class at most: ridge weights from four folds, calibration from the fifth."""
    sample = labelled_sample(docs, labels, label, bound, id_col, text_col)
    rows = saved(_with_statistics(sample, ["label", "weight", "fold"]), "statistics")
    about = rows.agg(*(F.avg(s).alias(f"m_{s}") for s in STATISTICS), *(F.stddev_pop(s).alias(f"s_{s}") for s in STATISTICS), (F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("p"), F.count_distinct("label").alias("n")).first()
    if about["n"] < 2:
        return QualityModel(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), constant=float(about["p"] or 0.0))
    model = QualityModel(np.array([about[f"m_{s}"] for s in STATISTICS]), np.array([max(about[f"s_{s}"], 1e-6) for s in STATISTICS]))
    a, b = _normal_equations(rows.where("fold <> 0").repartition(16), model)
    model.weights = np.linalg.solve(a + RIDGE * np.trace(a) / len(a) * np.eye(len(a)), b)
    rest = rows.where("fold = 0").toPandas()
    if rest["label"].nunique() < 2:
        rest = rows.toPandas()
    model.steps = isotonic(model.features(rest[list(STATISTICS)].to_numpy()) @ model.weights, rest["label"].to_numpy(float), rest["weight"].to_numpy())
    return model


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs without the text but with score, in place of a column of that name."""
    keep = [c for c in docs.columns if c not in (text_col, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics(t) for t in b.column(0).to_pylist()], dtype=float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.score(x))], names=[*keep, "score"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])
    return docs.select(text_col, *keep).mapInArrow(run, schema)
