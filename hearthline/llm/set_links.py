"""Links of sets with an exact Jaccard bound, within groups of candidates.

A group of up to ``GROUP`` sets is linked in one task, which compares only what a prefix of each set lets be alike: with the
rarest elements first, two sets of that similarity share one of the first few.

In a larger group the same prefixes are made by Spark, by how many sets of the group hold an element. A set whose own, rare
elements fill its prefix has no partner, so texts that have only a boilerplate in common drop out without being compared. Sets
that share a prefix element meet the most central set among them (the one whose elements are commonest), which joins
true copies by one comparison a set. Where several clusters are left among the sets that share an element, these are compared
in one task, or in blocks of ``GROUP`` every two of which meet in one task. Pairs within a group are never listed, and
all links between clusters are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import saved, slices
from hearthline.llm.components import connected_components

#: Sets that one task compares, and of one block of more.
GROUP = 250


def _rarest_first(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets as sorted numbers that are smaller the fewer of the sets hold an element."""
    _, of, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(counts), dtype=np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return [np.sort(x) for x in np.split(place[of], np.cumsum([len(x) for x in sets])[:-1])]


def linked(sets: list[np.ndarray], share: int, clusters: list | None = None, sides: list | None = None) -> list[int]:
    """For each distinct set the number of its component under links of a similarity of share percent or more.

    clusters: what is known to be linked from the start. sides: sets of one side have been compared before.
    """
    number = {c: i for i, c in enumerate(dict.fromkeys(clusters or range(len(sets))))}
    of = [number[c] for c in clusters or range(len(sets))]
    members: list[set[int]] = [set() for _ in number]
    for i, c in enumerate(of):
        members[c].add(i)
    sets = _rarest_first(sets) if sets else sets
    held: dict[int, list[int]] = {}
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        x = sets[i]
        first = x[: len(x) - -(-share * len(x) // 100) + 1].tolist()
        near = set().union(*(held.get(h, ()) for h in first)) - members[of[i]]
        if sides:
            near = {j for j in near if sides[j] != sides[i]}
        while near:
            j = near.pop()
            y = sets[j]
            if 100 * len(y) < share * len(x):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both < share * (len(x) + len(y) - both):
                continue
            a, b = sorted((of[i], of[j]), key=lambda c: len(members[c]))
            near -= members[of[j]]
            for k in members[a]:
                of[k] = b
            members[b] |= members[a]
            members[a] = set()
        for h in first:
            held.setdefault(h, []).append(i)
    return of


def _block_links(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, low, high, side, cluster, set, hashes) ordered by the first three; edges (a, b) between sets that join clusters."""

    def done(group: dict[int, tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        keys, clusters = list(group), [c for c, _, _ in group.values()]
        of = linked([x for _, _, x in group.values()], share, clusters, [s for _, s, _ in group.values()])
        first: dict[int, int] = {}
        joined = {c: (k, first.setdefault(n, k)) for k, c, n in zip(keys, clusters, of)}  # one edge a cluster
        out = [(a, b) for a, b in joined.values() if a != b]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    now, held = None, {}
    for b in slices(batches):
        arrays = b.column(6)
        for i, (group, low, high, side, cluster, key) in enumerate(zip(*(c.to_pylist() for c in b.columns[:6]))):
            if (group, low, high) != now:
                if len(held) > 1:
                    yield done(held)
                now, held = (group, low, high), {}
            # where one block is alone all its sets are compared
            held[key] = (cluster, side if low != high else len(held), arrays[i].values.to_numpy().copy())
    if len(held) > 1:
        yield done(held)


def _compared(rows: DataFrame, share: int) -> DataFrame:
    """(a, b): links between clusters. rows: (_group, low, high, side, cluster, _set, _hashes)."""
    rows = rows.repartition("_group", "low", "high").sortWithinPartitions("_group", "low", "high")
    return rows.select("_group", "low", "high", "side", "cluster", "_set", "_hashes").mapInArrow(lambda batches: _block_links(batches, share), "a long, b long")


def _large_links(members: DataFrame, share: int) -> DataFrame:
    """(a, b): links that span the components of large groups. members: (_group, _set, _hashes)."""
    members = saved(members, "large-sets")
    n = F.size("_hashes")
    elements = members.select("_group", "_set", n.alias("_n"), F.explode("_hashes").alias("_h"))
    common = elements.groupBy("_group", "_h").agg(F.count("*").alias("_df")).where("_df > 1")
    ordered = elements.join(common, ["_group", "_h"]).groupBy("_group", "_set", "_n").agg(F.sort_array(F.collect_list(F.struct("_df", "_h"))).alias("_s"), F.sum("_df").alias("_weight"))
    # elements of no other set come first and meet nothing
    left = F.col("_n") - F.ceil(F.col("_n") * share / 100) + 1 - (F.col("_n") - F.size("_s"))
    first = F.explode(F.slice("_s", 1, F.greatest(left, F.lit(0)).cast("int")))
    prefixes = saved(ordered.select("_group", "_set", "_n", (F.col("_weight") / F.col("_n")).alias("_central"), first.alias("_f")).select("_group", "_set", "_n", "_central", F.col("_f._h").alias("_h")), "prefixes")
    hubs = saved(prefixes.groupBy("_group", "_h").agg(F.max(F.struct("_central", "_set", "_n")).alias("_hub"), F.min("_set").alias("_a"), F.max("_set").alias("_b")).where("_a <> _b").select("_group", "_h", "_hub"), "hubs")
    fits = F.least("_n", "_hub._n") * 100 >= F.greatest("_n", "_hub._n") * share
    pairs = saved(prefixes.join(hubs, ["_group", "_h"]).where((F.col("_set") != F.col("_hub._set")) & fits).select(F.col("_set").alias("a"), F.col("_hub._set").alias("b")).distinct(), "hub-pairs")
    sets = members.select("_set", "_hashes")
    both = pairs.join(sets.toDF("a", "_x"), "a").join(sets.toDF("b", "_y"), "b")
    shared = F.size(F.array_intersect("_x", "_y"))
    links = saved(both.where(shared * 100 >= (F.size("_x") + F.size("_y") - shared) * share).select("a", "b"), "hub-links")
    clusters = connected_components(links).toDF("_node", "_cluster")
    placed = prefixes.join(saved(clusters, "hub-clusters"), F.col("_set") == F.col("_node"), "left").select("_group", "_h", "_set", F.coalesce("_cluster", "_set").alias("cluster"))
    sizes = placed.groupBy("_group", "_h").agg(F.count("*").alias("n"), F.min("cluster").alias("_a"), F.max("cluster").alias("_b"), F.sum(F.xxhash64("_set").cast("decimal(38,0)")).alias("_sum")).where("_a <> _b")
    # elements that the same sets share are one
    sizes = saved(sizes.groupBy("_group", "n", "_sum").agg(F.min("_h").alias("_h")).select("_group", "_h", "n"), "open-prefixes")
    if sizes.isEmpty():
        return links
    blocks = F.ceil(F.col("n") / GROUP).cast("int")
    rows = placed.join(sizes, ["_group", "_h"]).withColumns({"side": F.pmod(F.xxhash64("_set"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    rows = rows.select(F.xxhash64("_group", "_h").alias("_group"), F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "cluster", "_set")
    return links.unionByName(saved(_compared(rows.join(sets, "_set"), share), "prefix-links"))


def group_links(members: DataFrame, share: int) -> DataFrame:
    """(a, b): links that span the components of each group's links of share percent or more.

    members: (_group long, _set long, _hashes array<long>), written; a set of distinct hashes is in one group at most.
    """
    sizes = saved(members.groupBy("_group").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("_group"), "large-groups")
    large = not sizes.isEmpty()
    small = members.join(sizes, "_group", "left_anti") if large else members
    small = small.where("_hashes is not null").select("_group", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side"), F.col("_set").alias("cluster"), "_set", "_hashes")
    links = saved(_compared(small, share), "small-links")
    return links.unionByName(_large_links(members.join(sizes, "_group", "left_semi"), share)) if large else links


def candidate_edges(keys: DataFrame) -> DataFrame:
    """(a, b): an edge from each set to the least one that shares a key. keys: (_set long, _key long)."""
    # hubs are written, so that the join with a very common key can be broadcast or split
    hubs = saved(keys.groupBy("_key").agg(F.min("_set").alias("_hub"), F.max("_set").alias("_last")).where("_hub <> _last").drop("_last"), "band-hubs")
    return keys.join(hubs, "_key").where("_set <> _hub").select(F.col("_set").alias("a"), F.col("_hub").alias("b"))


def with_names(found: DataFrame) -> DataFrame:
    """(node, component) of connected_components with a row for the node that names each component."""
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
