import random

import pytest
from tests.llm.data import empty, frame, words

from hearthline.llm import decontaminate as k

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"


def pairs(spark, texts, items=(ITEM,), **options):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["matched"] for r in k.contaminated_pairs(docs, bench, **options).collect()}


def brute(text, item, window=13, share=0.8):
    import math
    import re

    a, b = ([x for x in re.split(r"[\W_]+", s.lower()) if x] for s in (text, item))
    w = min(window, len(b))
    best = 0
    for i in range(len(a) - w + 1):
        for j in range(len(b) - w + 1):
            best = max(best, sum(x == y for x, y in zip(a[i : i + w], b[j : j + w])))
    return best if best >= math.ceil(w * share) else 0


def test_exact_and_substituted(spark):
    w = ITEM.split()
    two = " ".join(["x" if i in (3, 9) else t for i, t in enumerate(w[2:15])])
    three = " ".join(["x" if i in (1, 6, 11) else t for i, t in enumerate(w[2:15])])
    got = pairs(spark, ["before " + ITEM + " after", "Alpha, " + ITEM.upper().replace(" ", ", "), two, three, "nothing like it", None, ""])
    assert got == {(0, 0): 13, (1, 0): 13, (2, 0): 11}


def test_against_brute_force(spark):
    rng = random.Random(4)
    items = [words(rng, rng.randint(13, 30)) for _ in range(6)]
    texts = []
    for i in range(40):
        item = rng.choice(items).split()
        part = item[rng.randint(0, 5) : rng.randint(12, 30)]
        for _ in range(rng.randint(0, 2)):
            part[rng.randrange(len(part))] = "zz"
        texts.append(words(rng, 30) + " " + " ".join(part) + " " + words(rng, 30))
    got = pairs(spark, texts, items)
    want = {(i, j): b for i, t in enumerate(texts) for j, x in enumerate(items) if (b := brute(t, x))}
    assert got == want


def test_repetitive_text(spark, monkeypatch):
    """Runs along diagonals, also past several steps: repeated words, cycles of two and three, and long items with breaks."""
    rng = random.Random(6)
    cycle = lambda n, k: " ".join(f"c{i % k}" for i in range(n))
    long = words(rng, 120).split()
    broken = [t if i % 17 else "zz" for i, t in enumerate(long)]
    items = ["ho " * 30, cycle(25, 2), cycle(40, 3), " ".join(long), "ho ho ho ho hi " * 6]
    texts = ["ho " * 70, "a " + "ho " * 12 + "b", "ho ho ho ho ho he " * 9, cycle(33, 2), "x " + cycle(60, 3), " ".join(broken), " ".join(long[40:90]), " ".join(broken[:30] + long[70:]), "hi ho ho ho ho " * 7]
    want = {(i, j): b for i, t in enumerate(texts) for j, x in enumerate(items) if (b := brute(t, x))}
    assert pairs(spark, texts, items) == want and len(want) > 10
    monkeypatch.setattr(k, "STEP", 5)
    assert pairs(spark, texts, items) == want


def test_a_run_has_few_hits(spark):
    docs = spark.createDataFrame([(0, "ho " * 2000), (1, "ho " * 2000)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "ho " * 50)], "item_id long, text string")
    hashed = lambda df, key: df.selectExpr(f"{key} as _{'doc' if key == 'doc_id' else 'item'}", "transform(filter(split(text, ' '), t -> t <> ''), t -> xxhash64(t)) as _h")
    hits = k._mask_hits(hashed(bench, "item_id"), hashed(docs, "doc_id"), k.MASKS)
    assert hits.count() < 2 * 3 * (2000 + 50)


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    items = [words(rng, 20) for _ in range(5)]
    texts = [words(rng, 10) + " " + items[i % 5] for i in range(10)]
    whole = pairs(spark, texts, items)
    monkeypatch.setattr(k, "BLOCK", 20)
    assert pairs(spark, texts, items) == whole and len(whole) >= 10


def test_short_items_match_nothing(spark):
    assert pairs(spark, ["one two three four five six"], ["one two three"]) == {}
    assert pairs(spark, ["x one two three four five six seven eight y"], ["one two three four five six seven eight"]) == {(0, 0): 8}


def test_drop_and_edges(spark):
    bench = spark.createDataFrame([(0, ITEM), (1, None), (None, ITEM)], "item_id long, text string")
    df = frame(spark, [(1, ITEM, "en", "a", 1), (2, "clean", "en", "a", 1), (2, "clean", "en", "a", 1), (None, ITEM, None, None, 1), (4, None, None, None, None), (5, "same " * 20000, "en", "a", 1)])
    out = k.drop_contaminated(df, bench)
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [2, 2, 4, 5, None]
    assert out.columns == df.columns
    assert k.drop_contaminated(empty(spark), bench).count() == 0
    assert k.drop_contaminated(df, bench.limit(0)).count() == 6


@pytest.mark.parametrize("gone", [(), (0,), (12,), (0, 12), (5, 6), (3, 9), (4, 8), (2, 10)])
def test_masks_bridge_two_substitutions(gone):
    assert any(all(o + m not in gone for m in mask) for mask in k.MASKS for o in range(13 - mask[-1]))
