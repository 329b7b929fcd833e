import random

import corpus_pipeline
from tests.llm.data import empty, frame, words
from tests.llm.test_near import groups

from hearthline.llm import near_copies, set_links


def slow_shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = "zz" + str(rng.randrange(10**6))
    return " ".join(w)


def corpus():
    rng = random.Random(8)
    rows = [(i, words(rng, 200), "en", "a", 1) for i in range(40)]
    for i in range(120):  # most near 0.8, on both sides
        rows.append((100 + i, edited(rng, rows[i % 40][1], rng.randint(1, 6)), "en", "a", 1))
    return rows + [(300, None, "en", "a", 1), (301, " \n", "en", "a", 1), (302, "Two words", "en", "a", 1), (303, "two  WORDS", "en", "a", 1), (None, rows[0][1], "en", "a", 1), (5, rows[6][1], "en", "a", 1)]


def expected(rows):
    sets = [(i, slow_shingles(t)) for i, t, *_ in rows if i is not None]
    alike = [(p, q) for p, (_, x) in enumerate(sets) for q, (_, y) in enumerate(sets[:p]) if x == y or (x | y and len(x & y) / len(x | y) >= 0.8)]
    of, least = groups(range(len(sets)), alike), {}
    for p, (i, _) in enumerate(sets):
        least[of[p]] = min(i, least.get(of[p], i))
    return sorted((i, least[of[p]]) for p, (i, _) in enumerate(sets)), alike


def test_edited_copies_against_brute_force(spark):
    rows = corpus()
    want, alike = expected(rows)
    assert len(alike) > 50 and any(i == name and i >= 100 for i, name in want)
    assert sorted(map(tuple, near_copies.near_copies(frame(spark, rows)).collect())) == want


def test_large_groups_are_cut_alike(spark, monkeypatch):
    """Blocks of a few sets, with groups of one cluster and of several."""
    rng = random.Random(9)
    rows = corpus()
    shared = words(rng, 150)
    for i in range(60):  # half of each text is the same: candidates without being copies
        rows.append((400 + i, shared + " " + words(rng, 60), "en", "a", 1))
        rows.append((500 + i, edited(rng, rows[-1][1], rng.randint(1, 6)), "en", "a", 1))
    rows += [(600 + i, edited(rng, rows[0][1], 1), "en", "a", 1) for i in range(40)]
    want, _ = expected(rows)
    for group in (7, 30):
        monkeypatch.setattr(set_links, "GROUP", group)
        assert sorted(map(tuple, near_copies.near_copies(frame(spark, rows)).collect())) == want


def test_stage_takes_edited_copies(spark):
    rows = corpus()
    gone = {i for i, name in expected(rows)[0] if i > name}
    out = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert out.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted(i for i, *_ in rows if i is not None and i not in gone)
    assert out.where("doc_id is null").count() == 1 and corpus_pipeline.near_dedup(spark, empty(spark), "").count() == 0


def test_a_band_alone_links_nothing():
    rng = random.Random(3)
    a = words(rng, 100)
    sets = [near_copies.shingles(t) for t in (a, edited(rng, a, 1), edited(rng, a, 12), words(rng, 100))]
    of = set_links.linked(sets, 80)
    assert of[0] == of[1] and len(set(of)) == 3
