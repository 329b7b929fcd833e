import random

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tests.llm.data import corpus, empty, frame

from hearthline.llm import components, simhash


def slow_fingerprint(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_fingerprints(spark):
    for r in corpus():
        assert simhash.fingerprint(r[1]) == slow_fingerprint(r[1])
    df = spark.createDataFrame([("Ab cD e",)], "t string")
    assert xxhash.xxh64_intdigest(b"ab cd e", 42) == df.select(F.xxhash64(F.lower("t"))).first()[0] % 2**64


def test_bk_tree_finds_all():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(rng.integers(63))) ^ np.uint64(1 << int(rng.integers(63))) for _ in range(8)]))
    q, p = simhash.BKTree(points).search(points, 2)
    want = {(i, j) for i in range(len(points)) for j in range(len(points)) if bin(int(points[i]) ^ int(points[j])).count("1") <= 2}
    assert set(zip(q.tolist(), p.tolist())) == want
    for size in (2, 20, len(points)):
        some = points[:size]
        linked = groups(range(size), simhash._spanning(some, 2))
        assert linked == groups(range(size), [(i, j) for i, j in want if i < size and j < size])


def test_shards_hold_every_link():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any((a ^ b) & (m % 2**64) == 0 for m in simhash.SHARD_MASKS)


def test_components_of_planted_links(spark):
    rng = random.Random(6)
    texts, prints = [], {}
    df = frame(spark)
    for r in df.select("doc_id", "text").collect():
        prints.setdefault(r["doc_id"], set()).add(slow_fingerprint(r["text"]))
    rows = [(i, f) for i, fs in prints.items() if i is not None for f in fs]
    linked = [(a, b) for a, x in rows for b, y in rows if bin(x ^ y).count("1") <= 2]
    want = groups({i for i, _ in rows}, linked)
    got = simhash.simhash_components(df)
    assert {(r["doc_id"], r["_component"]) for r in got.collect() if r["doc_id"] is not None} == set(want.items())
    assert got.count() == df.count()
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()]
    assert set(kept) - {None} == set(want.values()) and None in kept
    assert rng and not texts


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 400)]
    df = spark.createDataFrame(chain[::-1] + star + [(7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 400))


def test_shard_edges_over_batches():
    import pyarrow as pa

    fps = np.arange(5, dtype=np.int64)
    table = pa.table({"mask": np.zeros(10, np.int32), "key": np.repeat([1, 2], 5).astype(np.int64), "fp": np.tile(fps, 2), "rep": np.arange(10)})
    for size in (1, 3, 5, 10):
        pairs = [tuple(x) for b in simhash._shard_edges(iter(table.to_batches(max_chunksize=size)), 2) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(groups(range(10), pairs).values()) == [0] * 5 + [5] * 5


def test_empty(spark):
    assert simhash.simhash_components(empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(empty(spark)).columns == empty(spark).columns
