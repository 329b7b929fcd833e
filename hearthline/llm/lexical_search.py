"""Ranked lexical search by dense blocked multiplication.

A term's weight and a document's length decide what one occurrence count of the term is worth in the document: its
impact, an integer. A score is the sum of impacts over an item's terms, which is a product of two matrices: how often
each item holds each term, and the impact of each term in each document.

Items are cut into tiles of at most ``TERMS`` distinct terms. For one tile a task lays out ``DOCS`` documents at a time as a
dense matrix of the tile's terms, and BLAS multiplies it in float64. The terms of a tile are summed in parts whose
largest possible sum is below 2**53, so every float is an exact integer; parts are added as 64-bit integers. Each task
keeps the best ``k`` of each item, with all ties of the last place until the smaller ids are known to be in, and a
window over what the tasks kept gives the ranks.

Documents are read as text once for each block of items (about ``BLOCK`` terms, one block in the usual case); what goes on
is each document's counts of the block's terms, so bounded tables go to the tasks whatever the number of items.

Defined results: null texts hold no term; texts of any length count whole; items without terms have no rows; rows that
share an item id are one item with the terms of all of them, but a repeated row counts once; rows of items with a null id are left out; documents with a
null id count in all statistics and are not ranked; each row of documents is ranked, so a repeated id may come twice;
equal scores go by ascending id; empty tables give no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import saved, slices

#: About the most terms, with repeats, of the items that one pass over the documents takes.
BLOCK = 200_000
#: Most distinct terms of one tile of items (an item with more is a tile of its own), and documents of one tile.
TERMS, DOCS = 2_048, 512
#: No impact reaches its term's weight times this.
_MOST = 1_000_000
_EXACT = 1 << 53
#: ASCII letters become lower case, ASCII that is no letter or digit becomes a blank; other bytes stay.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, found: int) -> int:
    """Of a term that so many of the documents with terms hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found + 1)))


def length_factor(n: int, n_docs: int, all_terms: int) -> int:
    return 75 + 25 * n * n_docs // all_terms


@dataclass
class Tile:
    """Some items with their own numbering of terms; the places say which column a term of the block has, -1 for none."""

    items: list
    places: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]  # columns and items' counts of them, float64


def _parts(counts: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cuts counts (items x terms) so that no item's sum over a part can reach 2**53."""
    left, out = counts.copy(), []
    most = np.maximum(1, (_EXACT - 1) // np.maximum(1, weights * _MOST))
    while left.any():
        columns, taken, sums = [], [], np.zeros(len(left), dtype=np.int64)
        for c in np.flatnonzero(left.any(axis=0)):
            now = np.minimum(left[:, c], most[c])
            more = sums + now * weights[c] * _MOST
            if (more >= _EXACT).any():
                continue
            sums = more
            columns.append(c)
            taken.append(now)
            left[:, c] -= now
        out.append((np.array(columns), np.column_stack(taken).astype(np.float64)))
    return out


def _tiles(items: list[tuple[object, Counter]], numbers: dict[bytes, int], weights: np.ndarray) -> list[Tile]:
    groups, held = [], set()
    for key, found in items:
        if not groups or len(held | found.keys()) > TERMS:
            groups.append([])
            held = set()
        groups[-1].append((key, found))
        held |= found.keys()
    out = []
    for group in groups:
        own = np.array(sorted({numbers[t] for _, found in group for t in found}))
        places = np.full(len(numbers), -1)
        places[own] = np.arange(len(own))
        counts = np.zeros((len(group), len(own)), dtype=np.int64)
        for i, (_, found) in enumerate(group):
            for t, n in found.items():
                counts[i, places[numbers[t]]] = n
        out.append(Tile([key for key, _ in group], places, _parts(counts, weights[own])))
    return out


def _postings(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(_doc, _n, _t, _tf) of the documents with terms: the number of all of them, and the block's terms and their counts."""
    for b in slices(batches):
        ids, sizes, held, counts = [], [], [], []
        for i, text in enumerate(b.column(1)):
            found = terms(text.as_py())
            if found:
                ids.append(i)
                sizes.append(len(found))
                known = [(numbers[t], n) for t, n in Counter(found).items() if t in numbers]
                held.append([t for t, _ in known])
                counts.append([n for _, n in known])
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
            names=["_doc", "_n", "_t", "_tf"],
        )


class _Best:
    """The best k of one item so far: scores, falling, and ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.empty(0, np.int64), np.empty(0, np.int64), 1

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        near = np.flatnonzero(scores >= self.least)  # a tie with the last may have the smaller id
        if not len(near):
            return
        scores, ids = np.concatenate((self.scores, scores[near])), np.concatenate((self.ids, ids[near]))
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]
        if len(first) == self.k:
            self.least = int(self.scores[-1])


def _scored(batches: Iterator[pa.RecordBatch], tiles: list[Tile], weights: np.ndarray, n_docs: int, all_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of _postings; (item, _doc, _score) of this task's best k of each item."""
    best = [[_Best(k) for _ in tile.items] for tile in tiles]
    for b in slices(batches, rows=DOCS):
        ids, lists = b.column(0).to_numpy(), b.column(2)
        term, tf = lists.flatten().to_numpy(), b.column(3).flatten().to_numpy()
        doc = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        factors = np.array([length_factor(n, n_docs, all_terms) for n in b.column(1).to_pylist()], dtype=np.int64)
        impact = (weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * factors[doc]))).astype(np.float64)
        for tile, kept in zip(tiles, best):
            place = tile.places[term]
            here = place >= 0
            if not here.any():
                continue
            dense = np.zeros((int(tile.places.max()) + 1, b.num_rows))
            dense[place[here], doc[here]] = impact[here]
            scores = sum((counts @ dense[columns]).astype(np.int64) for columns, counts in tile.parts)
            for i in np.flatnonzero(scores.max(axis=1) >= [x.least for x in kept]).tolist():
                kept[i].take(scores[i], ids)
    found = [(key, x) for tile, kept in zip(tiles, best) for key, x in zip(tile.items, kept) if len(x.ids)]
    if found:
        yield pa.RecordBatch.from_arrays(
            [pa.array([key for key, x in found for _ in x.ids], pa.int64()), pa.array(np.concatenate([x.ids for _, x in found])), pa.array(np.concatenate([x.scores for _, x in found]))],
            names=["_item", "_doc", "_score"],
        )


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): the k documents of highest score above 0 for each item. Ids are whole numbers."""
    spark = docs.sparkSession
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("_item"), F.col(item_text).alias("_text")).distinct()
    # a term takes two bytes at least
    blocks = max(1, -(-(asked.agg(F.sum(F.length("_text"))).first()[0] or 0) // (2 * BLOCK)))
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"))
    found, sums = None, None
    for i in range(blocks):
        block: dict[int, Counter] = {}
        for r in asked.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == i).collect():
            block.setdefault(r["_item"], Counter()).update(terms(r["_text"]))
        numbers = {t: n for n, t in enumerate(sorted(set().union(*block.values())))}
        if not numbers:
            continue
        postings = saved(texts.mapInArrow(lambda batches, numbers=numbers: _postings(batches, numbers), "_doc long, _n long, _t array<int>, _tf array<long>"), "postings")
        if sums is None:
            sums = postings.agg(F.count("*").alias("docs"), F.sum("_n").alias("terms")).first()
        if not sums["docs"]:
            break
        held = {r["t"]: r["n"] for r in postings.select(F.explode("_t").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
        weights = np.array([weight(sums["docs"], held.get(t, 0)) for t in range(len(numbers))], dtype=np.int64)
        tiles = _tiles([(key, c) for key, c in sorted(block.items()) if c], numbers, weights)
        run = lambda batches, tiles=tiles, weights=weights, n=sums["docs"], m=sums["terms"]: _scored(batches, tiles, weights, n, m, k)
        some = postings.where("_doc is not null and size(_t) > 0").select("_doc", "_n", "_t", "_tf").mapInArrow(run, "_item long, _doc long, _score long")
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], "_item long, _doc long, _score long")
    place = F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("_score"), "_doc"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select(F.col("_item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("_doc").alias(id_col), F.col("_score").alias("score"))


def oracle_sql(k: int = 20) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    toks = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {toks} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::bigint AS nd, sum(len(w))::bigint AS nt FROM d WHERE len(w) > 0),
t AS (SELECT row_number() OVER () AS r, doc_id, len(w)::bigint AS n, w FROM d),
u AS (SELECT r, doc_id, n, unnest(w) AS term FROM t),
tf AS (SELECT r, doc_id, n, term, count(*)::bigint AS tf FROM u GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM tf, s GROUP BY term),
b AS (SELECT item_id, unnest({toks}) AS term FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, term, count(*)::bigint AS c FROM b GROUP BY ALL),
sc AS (SELECT item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))))::bigint AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {k}"""
