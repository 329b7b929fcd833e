"""SimHash near-duplicates linked by BK-trees.

A fingerprint has a bit for each of the 64 bits of its shingles' XXH64; fingerprints link at ``RADIUS`` or fewer
differing bits. Distinct fingerprints go to tree shards: the 64 bits are cut into six blocks, and two fingerprints
within two bits agree in four blocks at least, so each fingerprint goes to the 15 shards of its four-block choices
and every link is inside some shard. A shard holds at most 2**22 fingerprints, whatever the input. In a shard a
BK-tree (children keyed by Hamming distance to the parent) is built and searched, following only the edges within the
radius, and one spanning edge per joined fingerprint goes on. Components come from these edges.

Shard trees go to their tasks by a shuffle and not by broadcast: a broadcast of all fingerprints has no size bound.

Defined results: null text is an empty one; texts without words have fingerprint zero and link like any other; texts of any
length are taken whole; repeated rows share a fingerprint, and of rows that share an id all stay or all go; a component is
named by its smallest id; rows with a null doc_id never name one; an empty table gives no rows; ``simhash_components``
leaves other columns out, ``drop_near_duplicates`` passes them through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import saved, without
from hearthline.llm.components import connected_components

RADIUS, BLOCKS = 2, 6
_EDGES = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
#: Masks of the four-block choices, as signed longs.
SHARD_MASKS = [int(np.uint64(sum(((1 << _EDGES[b + 1]) - (1 << _EDGES[b])) for b in kept)).astype(np.int64)) for kept in combinations(range(BLOCKS), BLOCKS - RADIUS)]


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return voted(np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype="<u8"))


def voted(hashes: np.ndarray) -> int:
    """The fingerprint whose bits are set in over half of the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        votes += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, _fp): the fingerprint of every row, as a signed long."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=[id_col, "_fp"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("_fp", T.LongType())]))


class BKTree:
    """A BK-tree over distinct 64-bit fingerprints, held in arrays."""

    def __init__(self, points: np.ndarray):
        """points: distinct uint64 values; each group's first value becomes its node, the others go below it by distance."""
        self.points = points
        parent, edge = np.full(len(points), -1), np.zeros(len(points), dtype=np.int64)
        todo = [np.arange(len(points))] if len(points) else []
        while todo:
            group = todo.pop()
            root, rest = group[0], group[1:]
            far = np.bitwise_count(points[rest] ^ points[root])
            for d in np.unique(far):
                below = rest[far == d]
                parent[below[0]], edge[below[0]] = root, d
                todo.append(below)
        # children of a node stand together, ordered by their distance to it
        self.child = np.lexsort((edge, parent))
        self.child = self.child[parent[self.child] >= 0]
        self.edge = edge[self.child]
        self.first = np.searchsorted(parent[self.child], np.arange(len(points) + 1))

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, point) within the radius."""
        found_q, found_p = [np.empty(0, int)], [np.empty(0, int)]
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=int)
        if not len(self.points):
            return found_q[0], found_p[0]
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_p.append(node[hit])
            n = self.first[node + 1] - self.first[node]
            at = np.repeat(self.first[node], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            q, d = np.repeat(q, n), np.repeat(d, n)
            near = np.abs(self.edge[at] - d) <= radius
            q, node = q[near], self.child[at[near]]
        return np.concatenate(found_q), np.concatenate(found_p)


def _spanning(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that join what the tree search links, one for each joined point."""
    root = list(range(len(points)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    if len(points) <= 24:
        values, kids = points.tolist(), [{} for _ in points]
        for i in range(1, len(values)):
            stack, v = [0], values[i]
            while stack:
                j = stack.pop()
                d = (v ^ values[j]).bit_count()
                if d <= radius and (a := top(i)) != (b := top(j)):
                    root[a] = b
                    out.append((i, j))
                stack += [kid for e, kid in kids[j].items() if abs(e - d) <= radius]
            j = 0
            while (d := (v ^ values[j]).bit_count()) in kids[j]:
                j = kids[j][d]
            kids[j][d] = i
        return out
    tree = BKTree(points)
    for i in range(0, len(points), 1024):
        for q, p in zip(*(x.tolist() for x in tree.search(points[i : i + 1024], radius))):
            if (a := top(q + i)) != (b := top(p)):
                root[a] = b
                out.append((q + i, p))
    return out


def _shard_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp, rep) ordered by mask and key; edges between the reps of each shard."""

    def edges(rows: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        mask, key, fp, rep = rows
        cut = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            for i, j in _spanning(fp[a:b].view(np.uint64), radius):
                yield int(rep[a + i]), int(rep[a + j])

    held: list[np.ndarray] | None = None

    def batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], names=["a", "b"])

    waiting: list[list[np.ndarray]] = []  # of the one shard that may go on
    for b in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(rows[0]):
            continue
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if waiting and (waiting[0][0][0] != rows[0][-1] or waiting[0][1][0] != rows[1][-1] or cut):
            done = [np.concatenate(x) for x in zip(*waiting, [r[:cut] for r in rows])]
            waiting = [[r[cut:] for r in rows]]
        elif cut:
            done, waiting = [r[:cut] for r in rows], [[r[cut:] for r in rows]]
        else:
            waiting.append(rows)
            continue
        yield batch(list(edges(done)))
    if waiting:
        yield batch(list(edges([np.concatenate(x) for x in zip(*waiting)])))


def simhash_components(docs: DataFrame, width: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, _fp, _component) of every row: fingerprint as a signed long, and the smallest id reachable by links, itself included."""
    prints = saved(fingerprints(docs, width, id_col, text_col), "fingerprints")
    reps = prints.groupBy("_fp").agg(F.min(id_col).cast("long").alias("rep"))
    found = connected_components(print_links(reps, radius))
    by_print = saved(reps.join(found, reps["rep"] == found["node"], "left").select(F.col("_fp").alias("_fp2"), F.coalesce("component", "rep").alias("_component")), "components")
    return prints.join(by_print, F.col("_fp") == F.col("_fp2"), "left").select(*prints.columns, "_component")


def print_links(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges that span what the tree shards link, between the reps of distinct fingerprints (_fp, rep)."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"shards hold every link up to {RADIUS} bits")
    shards = F.array(*(F.struct(F.lit(i).cast("int").alias("mask"), F.col("_fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(SHARD_MASKS)))
    rows = reps.where("rep is not null").select(F.explode(shards).alias("s"), "_fp", "rep").select("s.mask", "s.key", "_fp", "rep")
    rows = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return rows.mapInArrow(lambda batches: _shard_edges(batches, radius), "a long, b long")


def drop_near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id. Rows with a null id stay."""
    out = simhash_components(docs, width, radius, id_col, text_col)
    return without(docs, out.where(F.col("_component") < F.col(id_col)).select(id_col).distinct(), id_col)
