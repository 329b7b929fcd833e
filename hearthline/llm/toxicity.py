"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Spark counts the character n-grams of a bounded sample of labelled documents, by class. Orders ``SHARED + 1`` to
``ORDER`` have counts of their own for toxic and ordinary text, with absolute discounts; below them both classes back
off to one interpolated Kneser-Ney model of the shared continuation counts, so rare and unseen expressions weigh alike
in both unless their parts are known. A word's weight is the difference of its two log-likelihoods. A document is
compared by its mean weight a word over the whole text and over its most toxic window of ``WINDOW`` words, both
normalised by length; a text of fewer words counts as one of ``WINDOW`` words, as little text is little evidence, and a
word that repeats the one before it is left out. A logistic curve fitted on a held-back fold, whose slopes can't be
negative, turns the two into a score of 0 to 1 that never falls as they rise.

The tables hold n-grams of at most ``2 * CLASS_BOUND`` sampled documents, so their broadcast is bounded.

Models are of characters within words: no n-gram crosses a space.

Defined results: null and empty texts get the score of no evidence; texts of any length are scored whole; without both
classes among the labels every score is the share of label 1 (0 without labels); an id labelled more than once takes its
largest label; repeated rows and equal texts score alike; an empty table gives no rows; other columns pass through, but
for those named like the results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import Memo, slices
from hearthline.llm.labelled import CLASS_BOUND, labelled_sample

#: Longest n-gram; longest n-gram of the shared backoff; least count of n-grams above SHARED + 1; words in a window.
ORDER, SHARED, LEAST, DISCOUNT, WINDOW = 6, 3, 2, 0.75, 8
CACHE = 300_000
#: Characters that are hashed at a time.
PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def pieces(words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Padded words, and which word each is, about PIECE characters at a time; a longer word is cut, with the ORDER - 1 characters before a cut in front of what follows."""
    pad, held, owners, size = "\x02" * (ORDER - 1), [], [], 0
    for i, w in enumerate(words):
        w = pad + w + "\x03"
        for a in range(ORDER - 1, len(w), PIECE):
            held.append(w[a - ORDER + 1 : a + PIECE])
            owners.append(i)
            size += len(held[-1])
            if size >= PIECE:
                yield held, np.array(owners)
                held, owners, size = [], [], 0
    if held:
        yield held, np.array(owners)


def gram_hashes(padded: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """At each position of padded words but for the first ORDER - 1 characters of each: for k from 0 to ORDER the hash of the k characters that end there, and of the k before it; and the position's word."""
    text = "".join(padded)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(w) for w in padded], dtype=np.int64)
    word = np.repeat(np.arange(len(padded)), lengths)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= ORDER - 1
    mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h, power = np.zeros(len(codes) + 1, dtype=np.uint64), np.uint64(1)
    grams, before = ([np.zeros(int(inside.sum()), dtype=np.uint64)] for _ in range(2))
    for k in range(1, ORDER + 1):
        h[k:] += mixed[: len(mixed) - k + 1] * power
        power = np.uint64(int(power) * int(_BASE) % (1 << 64))
        grams.append(h[1:][inside] ^ np.uint64(k))
        before.append(h[:-1][inside] ^ np.uint64(k))
    return grams, before, word[inside]


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def gram_counts(sample: DataFrame) -> DataFrame:
    """(k, gram, ctx, suffix, n1, n0) over the sample's texts: occurrences in label 1 and in label 0."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = {0: Counter(), 1: Counter()}
            for text, label in zip(b.column(0), b.column(1)):
                n[label.as_py()].update(words_of(text.as_py()))
            words = list(n[0] | n[1])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[1][w] for w in words], pa.int64()), pa.array([n[0][w] for w in words], pa.int64())], names=["word", "n1", "n0"])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            for padded, owner in pieces(words):
                grams, ctx, word = gram_hashes(padded)
                n1, n0 = (b.column(c).to_numpy()[owner[word]] for c in (1, 2))
                for k in range(1, ORDER + 1):
                    g, at, back = np.unique(grams[k], return_index=True, return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(g), k, np.int32))] + [pa.array(x.view(np.int64)) for x in (g, ctx[k - 1][at], grams[k - 1][at])] + [pa.array(np.bincount(back, x, len(g)).astype(np.int64)) for x in (n1, n0)],
                        names=["k", "gram", "ctx", "suffix", "n1", "n0"],
                    )

    words = sample.select("text", "label").mapInArrow(count_words, "word string, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    grams = words.mapInArrow(count_grams, "k int, gram long, ctx long, suffix long, n1 long, n0 long")
    grams = grams.groupBy("k", "gram").agg(F.min("ctx").alias("ctx"), F.min("suffix").alias("suffix"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    return grams.where((F.col("k") <= SHARED + 1) | (F.col("n1") + F.col("n0") >= LEAST))


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in the sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


@dataclass
class ToxicModel:
    """For each class order: sorted n-grams with the difference of their log-probabilities, and sorted contexts with that of their backoff weights."""

    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    constant: float | None = None

    memo: Memo | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}

    def weigh(self, words: list[str]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary)."""
        total = np.zeros(len(words))
        for padded, owner in pieces(words):
            grams, ctx, word = gram_hashes(padded)
            out, open_ = np.zeros(len(word)), np.arange(len(word))
            for k in range(ORDER, SHARED, -1):
                keys, value = self.grams[k]
                at, hit = _find(keys, grams[k][open_])
                out[open_[hit]] += value[at[hit]]
                open_ = open_[~hit]
                keys, value = self.contexts[k]
                at, hit = _find(keys, ctx[k - 1][open_])
                out[open_[hit]] += value[at[hit]]
            total += np.bincount(owner[word], out, len(words))
        return total

    def _weigh_all(self, words: list[str]) -> list[float]:
        return self.weigh(words).tolist()

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """(texts, 2): mean weight a word of each text, and of its most toxic window."""
        split = [[w for w, last in zip(words, ["", *words]) if w != last] for words in map(words_of, texts)]
        if self.memo is None:
            self.memo = Memo(self._weigh_all, CACHE)
        get = self.memo.of(set().union(*split)).__getitem__
        out = np.zeros((len(texts), 2))
        for i, words in enumerate(split):
            if words:
                x = np.cumsum([0.0, *map(get, words)])
                n = min(WINDOW, len(words))
                out[i] = x[-1] / max(WINDOW, len(words)), (x[n:] - x[:-n]).max() / WINDOW
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(evidence), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + evidence @ np.array(self.curve[1:]), -40, 40)))


def kneser_ney(t: dict[str, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], dict[int, dict[int, np.ndarray]], dict[int, dict[int, np.ndarray]]]:
    """By order the sorted n-grams and contexts; then by order and class the n-grams' probabilities and the contexts' backoff weights (class orders only)."""
    of = {k: np.flatnonzero(t["k"] == k) for k in range(1, ORDER + 1)}
    of = {k: i[np.argsort(t["gram"][i])] for k, i in of.items()}
    gram = {k: t["gram"][i] for k, i in of.items()}

    def by_context(k: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts, each gram's context, and the contexts' totals and distinct continuations."""
        ctx, back = np.unique(t["ctx"][of[k]], return_inverse=True)
        return ctx, back, np.bincount(back, n, len(ctx)), np.bincount(back, n > 0, len(ctx))

    shared = np.full(len(of[1]), 1.0 / max(1, len(of[1])))  # uniform, refined order by order
    for k in range(1, SHARED + 1):
        longer = np.unique(t["suffix"][of[k + 1]], return_counts=True)
        n = np.zeros(len(of[k]))
        at, hit = _find(longer[0], gram[k])
        n[hit] = longer[1][at[hit]]
        ctx, back, total, kinds = by_context(k, n)
        at, _ = _find(gram[k - 1], t["suffix"][of[k]]) if k > 1 else (np.arange(len(of[1])), None)
        base = shared[at] if k > 1 else shared
        total = np.maximum(total, 1e-9)
        shared = np.where(total[back] > 1e-6, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds[back] * base) / total[back], base)
    contexts, probability, backoff = {}, {SHARED: {1: shared, 0: shared}}, {}
    for k in range(SHARED + 1, ORDER + 1):
        at, _ = _find(gram[k - 1], t["suffix"][of[k]])
        probability[k], backoff[k] = {}, {}
        for c in (1, 0):
            n = t[f"n{c}"][of[k]].astype(float)
            contexts[k], back, total, kinds = by_context(k, n)
            seen = total > 0
            backoff[k][c] = np.where(seen, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            probability[k][c] = np.where(seen[back], np.maximum(n - DISCOUNT, 0) / np.maximum(total[back], 1), 0.0) + backoff[k][c][back] * probability[k - 1][c][at]
    return gram, contexts, probability, backoff


def _class_tables(t: dict[str, np.ndarray]) -> ToxicModel:
    """The differences of the classes' logarithms."""
    gram, contexts, probability, backoff = kneser_ney(t)
    model = ToxicModel({}, {})
    for k in range(SHARED + 1, ORDER + 1):
        model.grams[k] = gram[k], np.log(probability[k][1]) - np.log(probability[k][0])
        model.contexts[k] = contexts[k], np.log(backoff[k][1]) - np.log(backoff[k][0])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for a weighted logistic curve."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (weight * (y - p)) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def rising_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A logistic curve without negative slopes: a measure whose slope would be negative is left out."""
    used = [*range(x.shape[1])]
    while True:
        b = _logistic(x[:, used], y, weight)
        if (b[1:] >= 0).all():
            break
        used.pop(int(np.argmin(b[1:])))
    out = np.zeros(1 + x.shape[1])
    out[[0, *(i + 1 for i in used)]] = b
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = CLASS_BOUND, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Fitted on about bound documents of each class at most; counts from four folds, the curve from the fifth."""
    sample = labelled_sample(docs, labels, label, bound, id_col, text_col)
    grams = gram_counts(sample.where("fold <> 0")).toArrow()
    t = {c: grams[c].to_numpy() for c in grams.column_names}
    for c in ("gram", "ctx", "suffix"):
        t[c] = t[c].view(np.uint64)
    share = sample.agg((F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("p")).first()["p"]
    if not grams.num_rows or t["n1"].sum() == 0 or t["n0"].sum() == 0:
        return ToxicModel({k: (np.empty(0, np.uint64), np.empty(0)) for k in range(1, ORDER + 1)}, {k: (np.empty(0, np.uint64), np.empty(0)) for k in range(1, ORDER + 1)}, constant=float(share or 0.0))
    model = _class_tables(t)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            e = shipped.value.evidence(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), b.column(1), b.column(2)], names=["mean", "peak", "label", "weight"])

    rows = sample.where("fold = 0").select("text", "label", "weight").mapInArrow(weigh, "mean double, peak double, label int, weight double").toPandas()
    if rows["label"].nunique() < 2:
        model.curve = (float(np.log((share + 1e-6) / (1 - share + 1e-6))), 1.0, 1.0)
    else:
        model.curve = tuple(rising_logistic(rows[["mean", "peak"]].to_numpy(), rows["label"].to_numpy(float), rows["weight"].to_numpy()))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """docs without the text but with score and the two measures it is made of, in place of columns of their names."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in (text_col, "score", "mean_weight", "peak_weight")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            e = shipped.value.evidence(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(shipped.value.score(e)), pa.array(e[:, 0]), pa.array(e[:, 1])], names=[*others, "score", "mean_weight", "peak_weight"])

    schema = docs.select(*others).schema.add("score", "double").add("mean_weight", "double").add("peak_weight", "double")
    return docs.select(text_col, *others).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs whose score is below the threshold, with the columns they came with."""
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **options)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            e = shipped.value.evidence(b.column(at).to_pylist())
            yield b.filter(pa.array(shipped.value.score(e) < threshold))

    return docs.mapInArrow(run, docs.schema)
