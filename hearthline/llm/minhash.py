"""MinHash near-duplicates with circulant signatures and exact links.

A document's set holds its distinct five-word shingles, as 64-bit hashes. A first permutation of the 64-bit numbers is
applied to each, and a second one is read at the result, shifted round by k places, for coordinate k of the signature: the
least value over the set. So two permutations give all ``BANDS * ROWS`` coordinates; both are bijective mixings of 64 bits.
Signatures are cut into bands; sets that share a band are candidates, and a link is decided on the full sets (see
``set_links``). Two sets at a similarity of 0.85 share none of the bands with a probability of (1 - 0.85**5)**24, under one
in a million.

Equal sets are one from the start. Only sets that share a band with another are built a second time, from their
document of least id, and shuffled.

Defined results: null text is an empty one; texts without words have an empty set and are linked with nothing, not even each
other; a text of fewer words than a shingle is one shingle; texts of any length are taken whole; repeated rows have equal
sets and so one component; a row's component is that of its text, so an id that comes twice with unlike texts may name two;
a component is named by its smallest id; rows with a null id have no component, name none, link nothing and are kept;
an empty table gives no rows; ``minhash_components`` leaves other columns out, ``drop_minhash_copies`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import saved, slices, without
from hearthline.llm.components import connected_components
from hearthline.llm.near_copies import full_sets, set_hash, shingles
from hearthline.llm.set_links import candidate_edges, group_links, with_names

WIDTH, SHARE = 5, 85
BANDS, ROWS = 24, 5
#: Shifts and factors of two published 64-bit finalisers, each a bijection.
_FIRST = ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1))
_SECOND = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))


def permuted(x: np.ndarray, steps: tuple[tuple[int, int], ...]) -> np.ndarray:
    """A permutation of all 64-bit numbers, applied in place."""
    for shift, factor in steps:
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x


def signature(found: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The circulant MinHashes of a set that isn't empty."""
    placed = permuted(found.copy(), _FIRST)
    turns = np.arange(size, dtype=np.uint64)
    least = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(placed), 256):
        np.minimum(least, permuted(np.subtract.outer(placed[i : i + 256], turns), _SECOND).min(axis=0), out=least)
    return least


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band, none for the empty set; the band's number is part of its key."""
    if not len(found):
        return np.empty(0, dtype=np.int64)
    rows = signature(found).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for c in range(ROWS):
        keys = permuted(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, c], _FIRST)
    return keys.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [shingles(t.as_py(), width) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([set_hash(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([bands(x) for x in found], pa.list_(pa.int64()))],
            names=["_id", "_set", "_n", "_bands"],
        )


def minhash_components(docs: DataFrame, width: int = WIDTH, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _n, _component) of every row: size of its set, and the smallest id reachable by links of share percent or more."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType.fromDDL("_id long, _set long, _n long, _bands array<long>")
    signs = saved(rows.mapInArrow(lambda batches: _signed(batches, width), schema), "circulant-signs")
    reps = saved(signs.where("_id is not null and _n > 0").groupBy("_set").agg(F.min("_id").alias("_rep"), F.first("_bands").alias("_bands")), "minhash-reps")
    groups = with_names(connected_components(candidate_edges(reps.select("_set", F.explode("_bands").alias("_key")))))
    wanted = saved(groups.join(reps.select("_set", "_rep"), F.col("node") == F.col("_set")).select(F.col("component").alias("_group"), "_set", "_rep"), "minhash-groups")
    members = saved(wanted.join(full_sets(rows, wanted, width), "_set").select("_group", "_set", "_hashes"), "minhash-members")
    found = saved(with_names(connected_components(group_links(members, share))), "minhash-components")
    inside = saved(found.join(reps.select("_set", "_rep"), F.col("node") == F.col("_set")).select("_set", "_rep", "component"), "minhash-inside")
    names = saved(inside.select("_set", "component").join(inside.groupBy("component").agg(F.min("_rep").alias("_name")), "component").select(F.col("_set").alias("_node"), "_name"), "minhash-names")
    own = saved(reps.select("_set", "_rep").join(names, F.col("_set") == F.col("_node"), "left").select("_set", F.coalesce("_name", "_rep").alias("_name")), "minhash-owners")
    return signs.join(own, "_set", "left").select("_id", "_n", F.when(F.col("_id").isNotNull(), F.when(F.col("_n") > 0, F.col("_name")).otherwise(F.col("_id"))).alias("_component"))


def drop_minhash_copies(docs: DataFrame, width: int = WIDTH, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id. Rows with a null id stay."""
    gone = minhash_components(docs, width, share, id_col, text_col).where("_component < _id").select("_id").distinct()
    return without(docs, gone, id_col)


def oracle_sql(width: int = WIDTH, share: int = SHARE) -> str:
    """All pairs that share a shingle, and the closure of the links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(len(w) - {width - 1}), lambda i: array_to_string(w[i + 1 : i + {width}], ' ')) END)) AS s FROM w),
k AS (SELECT doc_id, s, len(s)::bigint AS n, md5(array_to_string(s, chr(10))) AS k FROM s),
r AS (SELECT k, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY k),
u AS MATERIALIZED (SELECT rep, n, hash(unnest(s)) AS h FROM r),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.rep < b.rep GROUP BY a.rep, b.rep),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= {share} * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS other FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other),
m AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT doc_id, k.n AS n_shingles, CASE WHEN k.n = 0 THEN doc_id ELSE coalesce(m.component, r.rep) END AS component_id,
  doc_id = CASE WHEN k.n = 0 THEN doc_id ELSE coalesce(m.component, r.rep) END AS kept
FROM k LEFT JOIN r USING (k) LEFT JOIN m ON m.node = r.rep"""
