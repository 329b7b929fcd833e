"""Near copies by fingerprints and by the Jaccard similarity of word shingles, as the pipeline's near-dedup stage takes them.

Texts of equal shingle sets are one from the start. Candidates come from two sides: the SimHash BK-trees link sets whose
fingerprints differ in two bits or fewer, and MinHash bands propose the rest, as at similarity 0.8 some 10 of 64 bits
differ and 15 often do, a radius at which no choice of blocks keeps tree shards small. Two sets of similarity 0.8 share a
band with probability 1 - (1 - 0.8**5)**20, more than 0.9996. Candidates that hang together form a group, and within it
every pair whose similarity can reach the bound is told exactly (see ``set_links``), so trees and bands only propose. The components of the
exact links are the result.

Defined results: null text is an empty one; texts without words are copies of each other; a text of fewer words than
a shingle is one shingle; texts of any length are compared whole; rows with a null id stay and make no row go; an empty
table gives no rows; a component is named by its smallest id; ``drop_near_copies`` passes other columns through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import saved, slices, without
from hearthline.llm.components import connected_components
from hearthline.llm.set_links import candidate_edges, group_links, with_names
from hearthline.llm.simhash import print_links, voted

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
_FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=np.uint64))


def set_hash(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of the set's MinHashes; none for the empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), 512):
        np.minimum(least, np.multiply.outer(found[i : i + 512], _FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rows], dtype=np.uint64).astype(np.int64).tolist()


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [shingles(t, width) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([set_hash(x) for x in found], pa.int64()), pa.array(np.array([voted(x) for x in found], dtype=np.uint64).view(np.int64)), pa.array([bands(x) for x in found], pa.list_(pa.int64()))],
            names=["_id", "_set", "_fp", "_bands"],
        )


def _rebuilt(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (_set, text); the set's hashes where the text has that set."""
    for b in slices(batches):
        found = [(k, x) for k, t in zip(b.column(0).to_pylist(), b.column(1)) if set_hash(x := shingles(t.as_py(), width)) == k]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x.view(np.int64) for _, x in found], pa.list_(pa.int64()))], names=["_set", "_hashes"])


def full_sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(_set, _hashes): the sets of wanted (_set, _rep), written, each from the text of row _rep. rows: (_id, _text)."""
    # one plan at every size: a broadcast would only work for few sets
    texts = wanted.select("_set", "_rep").hint("merge").join(rows, F.col("_rep") == F.col("_id")).select("_set", "_text")
    # another text, or the same once more, may share the id
    return texts.mapInArrow(lambda batches: _rebuilt(batches, width), "_set long, _hashes array<long>").dropDuplicates(["_set"])


def near_copies(docs: DataFrame, width: int = WIDTH, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _name): every row with an id, and the smallest id of its component."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    signs = saved(rows.mapInArrow(lambda batches: _signatures(batches, width), "_id long, _set long, _fp long, _bands array<long>"), "shingle-sets")
    reps = saved(signs.groupBy("_set").agg(F.min("_id").alias("_rep"), F.first("_fp").alias("_fp"), F.first("_bands").alias("_bands")), "shingle-reps")
    # equal fingerprints are one band more
    proposed = candidate_edges(reps.select("_set", F.explode(F.concat("_bands", F.array("_fp"))).alias("_key")))
    trees = print_links(reps.groupBy("_fp").agg(F.min("_set").alias("rep")))
    groups = with_names(connected_components(proposed.unionByName(trees)))
    wanted = saved(groups.join(reps.select("_set", "_rep"), F.col("node") == F.col("_set")).select(F.col("component").alias("_group"), "_set", "_rep"), "near-groups")
    members = saved(wanted.join(full_sets(rows, wanted, width), "_set").select("_group", "_set", "_hashes"), "near-members")
    found = with_names(connected_components(group_links(members, round(100 * least))))
    inside = saved(found.join(reps.select("_set", "_rep"), F.col("node") == F.col("_set")).select(F.col("_set").alias("_node"), "_rep", "component"), "near-inside")
    names = saved(inside.groupBy("component").agg(F.min("_rep").alias("_name")), "near-names")
    names = inside.select("_node", "component").join(names, "component").select("_node", "_name")
    own = reps.select("_set", "_rep").join(names, F.col("_set") == F.col("_node"), "left").select("_set", F.least("_rep", "_name").alias("_name"))
    return signs.select("_id", "_set").join(saved(own, "near-owners"), "_set").select("_id", "_name")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id. Rows with a null id stay."""
    gone = near_copies(docs, width, least, id_col, text_col).where("_id > _name").select("_id").distinct()
    return without(docs, gone, id_col)
