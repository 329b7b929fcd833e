import random

import numpy as np
from tests.llm.data import corpus as mixed
from tests.llm.data import empty, frame, words
from tests.llm.test_near import groups

from hearthline.llm import minhash, set_links


def slow_shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    return bool(x or y) and 100 * len(x & y) >= 85 * len(x | y)


def expected(rows):
    """Components of rows with an id: (id, size, component)."""
    sets = [(i, slow_shingles(t)) for i, t, *_ in rows if i is not None]
    linked = [(p, q) for p, (_, x) in enumerate(sets) for q, (_, y) in enumerate(sets[:p]) if alike(x, y)]
    of, least = groups(range(len(sets)), linked), {}
    for p, (i, _) in enumerate(sets):
        least[of[p]] = min(i, least.get(of[p], i))
    return sorted((i, len(x), least[of[p]]) for p, (i, x) in enumerate(sets))


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = "zz" + str(rng.randrange(10**6))
    return " ".join(w)


def near(n=40):
    """Edited copies at 0.7 to 1.0, chains of edits, and unlike texts of a common first half."""
    rng = random.Random(8)
    rows = [(i, words(rng, 200), "en", "a", 1) for i in range(n)]
    rows += [(1000 + i, edited(rng, rows[i % n][1], rng.randint(1, 5)), "en", "a", 1) for i in range(3 * n)]
    text = rows[0][1]
    for i in range(30):  # each step is a link, the ends are far apart
        text = edited(rng, text, 2)
        rows.append((2000 + i, text, "en", "a", 1))
    shared = words(rng, 150)
    for i in range(40):
        rows.append((3000 + i, shared + " " + words(rng, 60), "en", "a", 1))
        rows.append((3100 + i, edited(rng, rows[-1][1], rng.randint(1, 5)), "en", "a", 1))
    rows += [(4000, "Only Four words here", "en", "a", 1), (4001, "only four  words HERE", "en", "a", 1), (4002, "Änderung only", "en", "a", 1), (4003, "änderung only", "en", "a", 1)]
    return rows


def got(df, **options):
    return sorted(tuple(r) for r in minhash.minhash_components(df, **options).collect() if r["_id"] is not None)


def test_two_permutations_give_all_coordinates():
    rng = np.random.default_rng(1)
    found = np.unique(rng.integers(0, 2**63, 700, dtype=np.uint64))
    mask = 2**64 - 1

    def mixed_by(x, steps):
        for shift, factor in steps:
            x = (x ^ (x >> shift)) * factor & mask
        return x

    want = [min(mixed_by((mixed_by(int(x), minhash._FIRST) - k) & mask, minhash._SECOND) for x in found) for k in range(20)]
    assert minhash.signature(found, 20).tolist() == want
    # shares of equal coordinates are close to the similarity
    a, b = found[:600], found[100:]
    same = np.mean(minhash.signature(a, 2000) == minhash.signature(b, 2000))
    assert abs(same - 500 / 700) < 0.04


def test_against_brute_force(spark):
    rows = near()
    want = expected(rows)
    assert got(frame(spark, rows)) == want and len({c for *_, c in want}) < len(rows) - 60


def test_edges(spark):
    df = frame(spark)
    rows = mixed()
    assert got(df) == expected(rows)
    out = {(r["_id"], r["_n"], r["_component"]) for r in minhash.minhash_components(df).collect()}
    n = len([r for r in rows if r[1] is None])
    assert n and any(i is None and c is None for i, _, c in out)
    # without words: linked with nothing, not even each other
    bare = [r[0] for r in rows if not (r[1] or "").split() and r[0] is not None]
    assert len(bare) >= 3 and all((i, 0, i) in out for i in bare)
    kept = [r["doc_id"] for r in minhash.drop_minhash_copies(df).collect()]
    want = {c for *_, c in expected(rows)}
    assert set(kept) - {None} == want and None in kept and minhash.drop_minhash_copies(df).columns == df.columns
    assert got(empty(spark)) == [] and minhash.drop_minhash_copies(empty(spark)).count() == 0


def test_large_groups(spark, monkeypatch):
    rows = near(12)
    want = expected(rows)
    for group in (3, 20, 1000):
        monkeypatch.setattr(set_links, "GROUP", group)
        assert got(frame(spark, rows)) == want


def test_one_task_links_like_all_pairs():
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(6)]
    texts = base + [edited(rng, t, rng.randint(0, 3)) for t in base for _ in range(6)]
    sets = [minhash.shingles(t) for t in dict.fromkeys(texts)]
    real = [set(x.tolist()) for x in sets]
    want = groups(range(len(sets)), [(i, j) for i in range(len(sets)) for j in range(i) if alike(real[i], real[j])])
    of = set_links.linked(sets, 85)
    assert all((of[i] == of[j]) == (want[i] == want[j]) for i in range(len(sets)) for j in range(i))
