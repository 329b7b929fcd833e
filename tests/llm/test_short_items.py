import math
import random
from itertools import combinations

import corpus_pipeline
from tests.llm.data import words
from tests.llm.test_benchmark import brute, pairs

from hearthline.llm import decontaminate as k


def test_some_seed_is_left_for_every_substitution():
    for n in range(1, 14):
        for s in range((n - math.ceil(n * 0.8) if n >= 6 else 0) + 1):
            for gone in combinations(range(n), s):
                seeds = [range(a, a + m) for a, m in k.runs(n, 0.8)] if n < 13 else [[a + o for o in mask] for mask in k.MASKS for a in range(13 - mask[-1])]
                assert any(not set(seed) & set(gone) for seed in seeds), (n, gone)


def test_short_items_with_every_substitution(spark):
    items = [" ".join(f"w{n}x{i}" for i in range(n)) for n in range(6, 13)]
    texts = []
    for item in items:
        w = item.split()
        for s in range(len(w) - math.ceil(len(w) * 0.8) + 2):  # one more than is allowed as well
            texts += ["before " * 3 + " ".join("zz" if i in gone else t for i, t in enumerate(w)) + " after" for gone in combinations(range(len(w)), s)]
    got = pairs(spark, texts, items)
    assert got == {(i, j): b for i, t in enumerate(texts) for j, x in enumerate(items) if x.split()[0][:-1] in t and (b := brute(t, x))}


def test_mixed_lengths_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    items = [words(rng, n) for n in (6, 7, 9, 10, 12, 15, 20)]
    texts = []
    for i in range(40):
        part = rng.choice(items).split()
        for _ in range(rng.randint(0, 2)):
            part[rng.randrange(len(part))] = "zz"
        texts.append(words(rng, rng.randint(0, 12)) + " " + " ".join(part) + " " + words(rng, rng.randint(0, 12)))
    want = {(i, j): b for i, t in enumerate(texts) for j, x in enumerate(items) if (b := brute(t, x))}
    assert len(want) > 20 and pairs(spark, texts, items) == want
    monkeypatch.setattr(k, "BLOCK", 5)
    assert pairs(spark, texts, items) == want


def test_tiny_items_match_word_for_word(spark, tmp_path):
    items = ["one", "one two three", "one two three four five"]
    texts = ["x One, two three y", "one two x three", "a one two three four five", "one two three four six", "none"]
    assert pairs(spark, texts, items) == {}
    assert pairs(spark, texts, items, shortest=2) == {(0, 1): 3, (2, 1): 3, (2, 2): 5, (3, 1): 3}
    spark.createDataFrame([(0, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()} == {1, 4}
