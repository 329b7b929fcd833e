"""Document probabilities from the lattice of subword segmentations.

Each word is spelled by the pieces of an existing vocabulary, and its probability is the sum over all segmentations, each
weighted by the vocabulary's own scores: a forward recursion, in log space where a double is too small. The scores (ranks, turned into log-weights by
Zipf's law and normalised over all pieces) are taken as they are, or, with ``learn``, are where expectation maximisation over
all distinct words of the training texts begins. Then each training word is also an arc of its own from end to end, weighed by its
count, beside the segmentations into pieces. A text is a sequence of words that ends after each with the probability ``stop``, the training texts' share of
ends among tokens. So a text's probability is the product over its words and its end, marginal over all segmentations.

Beside it goes a word-unigram baseline with added counts, learned from all training texts. Words that make up a
``1 / HEAVY`` part of the training tokens or more are at most ``HEAVY``; only these are broadcast. The others meet
their counts in a shuffle join on a 64-bit hash.

Defined results: null text counts as empty and has the end token only; characters without a piece are spelled by byte pieces;
texts and words of any length are scored whole; repeated rows score alike; rows with a null id belong to no fold and are
scored only; an empty table gives no rows, and without training texts ``stop`` is a half; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log, log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import Memo, id_bucket, saved
from hearthline.llm.sentence_pieces import LONG, SPACE, model, vocabulary_path

FOLDS, HELD_OUT = 10, 0
HEAVY, ADDED = 100_000, 0.1
#: Rounds in which the pieces' weights are learned, and the part of the weight that stays the vocabulary's.
ROUNDS, KEPT = 4, 0.01
#: Words that a process keeps, of late and of before.
CACHE = 300_000
#: Words less probable than this are summed up in log space, as their parts may be too small for a double.
SMALL = 1e-280


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8, with A to Z in lower case; white space is ASCII's."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes(words) -> np.ndarray:
    """XXH64 of each word as a signed long."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, 11) for w in words], dtype=np.uint64).view(np.int64)


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + log(sum(exp(v - top) for v in values))


class Lattice:
    """Forward recursions over words, with the log-weights of the vocabulary's pieces."""

    def __init__(self, path: str, weights: np.ndarray | None = None):
        self.m = model(path)
        score = np.full(len(self.m.pieces), -np.inf)
        score[self.m.ids] = self.m.score
        score[[*self.m.byte_ids.values()]] = self.m.score.min()
        self.own = score - np.logaddexp.reduce(score[np.isfinite(score)])
        self.weights = self.own if weights is None else weights
        self.by_place = self.weights[self.m.ids]
        self.p = np.exp(self.by_place)
        self.memo = Memo(lambda words: self.log10(words).tolist(), CACHE)

    def _spelled(self, character: str) -> float:
        return float(sum(self.weights[self.m.byte_ids[b]] for b in character.encode("utf-8", "surrogatepass")))

    def _arcs(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each size of pieces in equally long words the weights by start and word, where there is a piece (flat), and its place.

        A character without a piece has the weight of its bytes.
        """
        m = self.m
        codes = np.ascontiguousarray(m._codes(words).T)
        h, base, power, out = np.zeros((len(codes) + 1, len(words)), dtype=np.uint64), np.uint64(0x100000001B3), 1, []
        for j in range(len(codes)):
            h[j + 1] = h[j] * base + codes[j] + np.uint64(1)
        for size in range(1, min(len(codes), m.longest) + 1):
            power = power * int(base) % (1 << 64)
            starts, at = m.probe(m._finish(h[size:] - h[:-size] * np.uint64(power)).ravel())
            weight = np.zeros((len(codes) + 1 - size) * len(words))
            if size == 1 and len(starts) < len(weight):
                rest = np.setdiff1d(np.arange(len(weight)), starts)
                kinds, kind = np.unique(codes.ravel()[rest], return_inverse=True)
                weight[rest] = np.exp([self._spelled(chr(c)) for c in kinds.tolist()])[kind]
            weight[starts] = self.p[at]
            out.append((weight.reshape(-1, len(words)), starts, at))
        return out

    def _forward(self, arcs: list) -> np.ndarray:
        """Sums of all ways up to each place of equally long words, by place and word."""
        alpha = np.zeros((len(arcs[0][0]) + 1, arcs[0][0].shape[1]))
        alpha[0] = 1
        for j in range(1, len(alpha)):
            for size, (weight, _, _) in enumerate(arcs[:j], 1):
                alpha[j] += alpha[j - size] * weight[j - size]
        return alpha

    def _uses(self, words: list[str]) -> np.ndarray:
        """How often each piece, by its place, is expected in the segmentations of equally long words: sums over all ways from each place on, by the same arcs."""
        arcs, out = self._arcs(words), np.zeros(len(self.m.ids))
        alpha = self._forward(arcs)
        small = alpha[-1] < SMALL
        for i in np.flatnonzero(small).tolist():
            out += self._uses_long(words[i])
        beta = np.zeros(alpha.shape)
        beta[-1] = np.where(small, 0, 1 / np.where(small, 1, alpha[-1]))
        for j in range(len(beta) - 2, -1, -1):
            for size, (weight, _, _) in enumerate(arcs[: len(beta) - 1 - j], 1):
                beta[j] += weight[j] * beta[j + size]
        for size, (weight, starts, at) in enumerate(arcs, 1):
            if len(at):
                out += np.bincount(at, (alpha[:-size] * weight * beta[size:]).ravel()[starts], len(out))
        return out

    def uses(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of the pieces in some words, each taken once."""
        out = np.zeros(len(self.m.ids))
        for group in self._groups([SPACE + w.decode("utf-8", "surrogatepass") for w in words]):
            texts = [t for _, t in group]
            if len(texts[0]) > LONG:
                for t in texts:
                    out += self._uses_long(t)
            else:
                out += self._uses(texts)
        return out

    def learned(self, uses: np.ndarray) -> np.ndarray:
        """Log-weights of the pieces from their uses, with the ``KEPT`` part of the weight as the vocabulary has it."""
        p = np.exp(self.own)
        if uses.sum() > 0:
            p = KEPT * p
            p[self.m.ids] += (1 - KEPT) * uses / uses.sum()
        with np.errstate(divide="ignore"):
            return np.log(p)

    @staticmethod
    def _groups(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
        """(place, text) of equally long texts, in batches of bounded size."""
        length = np.array([len(t) for t in texts])
        order = np.argsort(length, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            most = max(1, 100_000 // (int(length[group[0]]) + 1)) if len(group) else 1
            for i in range(0, len(group), most):
                yield [(k, texts[k]) for k in group[i : i + most].tolist()]

    def _ways_long(self, word: str) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        """For one word, piece by piece and in log space: sums up to each place, and the (start, piece's place or -1, log-weight) of the arcs that end there."""
        first, sizes, places = self.m.arcs(word)
        weight, alpha, arcs = self.by_place, [0.0], [[]]
        for j in range(1, len(word) + 1):
            here = [(j - sizes[i], places[i], float(weight[places[i]])) for i in range(first[j], first[j + 1])]
            if first[j] == first[j + 1] or sizes[first[j]] > 1:
                here.append((j - 1, -1, self._spelled(word[j - 1])))
            alpha.append(_log_sum([alpha[i] + w for i, _, w in here]))
            arcs.append(here)
        return alpha, arcs

    def _uses_long(self, word: str) -> np.ndarray:
        """As _uses for one word."""
        alpha, arcs = self._ways_long(word)
        after: list[list[float]] = [[] for _ in alpha]
        after[-1].append(0.0)
        at, uses = [], []
        for j in range(len(word), 0, -1):
            if not after[j]:
                continue
            beta, after[j] = _log_sum(after[j]), []
            for i, place, w in arcs[j]:
                after[i].append(w + beta)
                if place >= 0:
                    at.append(place)
                    uses.append(exp(alpha[i] + w + beta - alpha[-1]))
        return np.bincount(np.array(at, dtype=np.int64), np.array(uses), len(self.m.ids))

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word."""
        out = np.zeros(len(words))
        for group in self._groups([SPACE + w.decode("utf-8", "surrogatepass") for w in words]):
            places, texts = [i for i, _ in group], [t for _, t in group]
            found = np.zeros(len(texts)) if len(texts[0]) > LONG else self._forward(self._arcs(texts))[-1]
            small = found < SMALL
            found[~small] = np.log(found[~small])
            found[small] = [self._ways_long(texts[i])[0][-1] for i in np.flatnonzero(small).tolist()]
            out[places] = found
        return out / np.log(10)


@lru_cache(maxsize=1)
def lattice(path: str, weights: bytes | None = None) -> Lattice:
    """The lattice of this process: tasks that follow each other share its words."""
    return Lattice(path, None if weights is None else np.frombuffer(weights))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, h, n) of the texts' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
            n.clear()
            return out

        for b in batches:
            for text in b.column(0):
                n.update(words_of(text.as_py()))
                if len(n) > CACHE:
                    yield flush()
        yield flush()

    out = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes(b.column(0).to_pylist())), b.column(1)], names=["word", "h", "n"])

    return out.mapInArrow(hashed, "word binary, h long, n long")


def learned_weights(counts: DataFrame, path: str) -> bytes:
    """Log-weights of the pieces by expectation maximisation over all distinct training words."""
    own = Lattice(path)
    weights = own.own.tobytes()
    for _ in range(ROUNDS):
        shipped = counts.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            at = Lattice(path, np.frombuffer(shipped.value))
            uses, words, size = np.zeros(len(at.by_place)), [], 0
            for b in batches:  # many words at once, as those of one length are taken together
                words += b.column(0).to_pylist()
                size += b.nbytes
                if size > 1 << 20:
                    uses += at.uses(words)
                    words, size = [], 0
            uses += at.uses(words)
            places = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(uses[places])], names=["place", "uses"])

        found = counts.select("word").mapInArrow(run, "place int, uses double").groupBy("place").agg(F.sum("uses").alias("uses")).toArrow()  # a row a piece at most
        uses = np.zeros(len(own.by_place))
        uses[found["place"].to_numpy()] = found["uses"].to_numpy()
        weights = own.learned(uses).tobytes()
    return weights


def score_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", learn: bool = False) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; counts come from the rows that are not held out.

    learn: the pieces' weights are learned from the training words, and each training word is an arc of its own across the lattice.
    """
    spark, path = docs.sparkSession, path or vocabulary_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    train = rows.where(id_bucket("id", FOLDS) != HELD_OUT)
    counts = saved(word_counts(train), "word-counts")
    ends = train.count()
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = known["n"] + ends, known["v"] + (ends > 0)
    floor = log10(total + ADDED * (distinct + 1))
    stop = (ends + 1) / (total + 2)
    end_base, go_on, end_log10 = log10(ends + ADDED), log10(1 - stop), log10(stop)
    heavy = counts.where(F.col("n") >= max(2.0, total / HEAVY)).select("word", "n").toArrow()  # HEAVY rows at most
    # the whole-word arcs share what is left by the part of the words that were new when they came (Witten and Bell)
    new = known["v"] / (known["n"] + known["v"]) if known["v"] else 1.0
    arc = (1 - new) / max(known["n"], 1)
    learned = spark.sparkContext.broadcast(learned_weights(counts, path) if learn else None)
    shipped = spark.sparkContext.broadcast({w: (log10(n + ADDED), arc * n) for w, n in zip(heavy["word"].to_pylist(), heavy["n"].to_pylist())})
    lists = ["h", "times", *(["spelled"] if learn else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with the hashes and numbers of its words that aren't heavy."""
        common, spellings = shipped.value, lattice(path, learned.value).memo
        for whole in batches:
            for i in range(0, whole.num_rows, 400):
                b = whole.slice(i, 400)
                split = [words_of(t) for t in b.column(1).to_pylist()]
                weight = spellings.of(set().union(*split))
                marks, light, times, spelled, sizes, n_tokens, n_heavy, heavy_base, scores = [], [], [], [], [], [], [], [], []
                for words in split:
                    base, score, known, rest = 0.0, end_log10 + go_on * len(words), 0, []
                    for w, n in Counter(words).items():
                        c = common.get(w)
                        if not learn:
                            score += n * weight[w]
                        elif c is not None:
                            score += n * log10(c[1] + new * 10 ** weight[w])
                        if c is None:
                            rest.append(w)
                            times.append(n)
                            if learn:
                                spelled.append(weight[w])
                        else:
                            base += n * c[0]
                            known += n
                    marks.append(b" ".join(words))
                    light += rest
                    sizes.append(len(rest))
                    n_tokens.append(len(words) + 1)
                    n_heavy.append(known)
                    heavy_base.append(base)
                    scores.append(score)
                at = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(hashes(marks)), pa.array(n_tokens, pa.int64()), pa.array(n_heavy, pa.int64()), pa.array(heavy_base, pa.float64()), pa.array(scores, pa.float64())]
                    + [pa.ListArray.from_arrays(at, pa.array(hashes(light))), pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))]
                    + ([pa.ListArray.from_arrays(at, pa.array(spelled, pa.float64()))] if learn else []),
                    names=["id", "mark", "n_tokens", "n_heavy", "heavy_base", "score", *lists],
                )

    schema = rows.select("id").schema.add("mark", "long").add("n_tokens", "long").add("n_heavy", "long").add("heavy_base", "double").add("score", "double").add("h", T.ArrayType(T.LongType())).add("times", T.ArrayType(T.IntegerType()))
    schema = schema.add("spelled", T.ArrayType(T.DoubleType())) if learn else schema
    texts = rows.mapInArrow(run, schema)
    # each text's own row has no times; the others are its words
    own = F.struct(F.col("mark").alias("h"), F.lit(0).alias("times"), *([F.lit(0.0).alias("spelled")] if learn else []))
    words = texts.select("id", "mark", F.posexplode(F.concat(F.array(own), F.arrays_zip(*lists))).alias("at", "w"), "n_tokens", "n_heavy", "heavy_base", "score")
    first = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    words = words.select("id", "mark", *(F.col(f"w.{c}").alias(c) for c in lists), *map(first, ("n_tokens", "n_heavy", "heavy_base", "score")))
    light = counts.where(F.col("n") < max(2.0, total / HEAVY)).select(F.col("h").alias("_h"), "n")
    met = words.join(light, F.col("h") == F.col("_h"), "left")
    value = F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(ADDED))
    # all ways through a light word: its own arc, if it has one, and its pieces
    ways = F.when(F.col("n").isNull(), F.lit(log10(new)) + F.col("spelled")).otherwise(F.log10(F.lit(arc) * F.col("n") + F.lit(new) * F.pow(F.lit(10.0), F.col("spelled")))) if learn else F.lit(0.0)
    # rows of one id and text are summed together: each of them gets its part
    summed = met.groupBy("id", "mark").agg(
        F.count("n_tokens").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.max("n_heavy").alias("n_heavy"), F.max("heavy_base").alias("heavy_base"), F.max("score").alias("score"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_light"), F.sum(value).alias("light_base"),
        F.sum(F.when(F.col("times") > 0, F.col("times") * ways).otherwise(0.0)).alias("light_score"),
    )
    out = summed.select(
        F.col("id").alias(id_col), F.coalesce(id_bucket("id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("n_heavy") + F.col("n_light") / F.col("copies") + F.lit(1 if ends else 0)).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("heavy_base") + F.col("light_base") / F.col("copies") + F.lit(end_base) - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (F.col("score") + F.col("light_score") / F.col("copies")).alias("score"), "copies",
    )
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).drop("_", "copies")
