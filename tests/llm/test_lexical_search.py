import math
import random
import re
from collections import Counter

import numpy as np
from tests.llm.data import corpus, empty, frame, words

from hearthline.llm import lexical_search


def slow_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def expected(docs, items, k=20):
    held = [(i, Counter(slow_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        if i is not None:
            asked.setdefault(i, []).extend(slow_terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in wanted if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def data():
    rng = random.Random(3)
    docs = [(r[0], r[1]) for r in corpus()] + [(1000 + i, f"same words here {i % 3}") for i in range(60)] + [(2000, "Straße café 中文 x1"), (2001, "A1-b2_C3 cafÉ"), (2002, "?!")]
    rng.shuffle(docs)
    items = [(i, words(rng, 12)) for i in range(8)] + [(20, "same words here"), (21, "Café, 中文; STRAßE x1 x1 a1 b2"), (22, None), (23, ""), (None, "same"), (24, "same same same"), (24, "words here"), (24, "words here"), (25, docs[0][1])]
    return docs, items


def ranked(spark, docs, items, **options):
    d = frame(spark, [(i, t, "en", "a", 1) for i, t in docs])
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as _item", "2 as rank", "3 as doc_id", "4 as _text")
    return sorted(tuple(r) for r in lexical_search.rank_documents(d, q, **options).collect())


def test_against_brute_force(spark):
    docs, items = data()
    want = expected(docs, items)
    assert ranked(spark, docs, items) == want
    # 60 documents of three texts: the last place is a tie
    ties = [r for r in want if r[0] == 20]
    assert len(ties) == 20 and len({r[3] for r in ties}) == 1 and [r[2] for r in ties] == sorted(r[2] for r in ties)


def test_tiles_and_blocks(spark, monkeypatch):
    docs, items = data()
    want = expected(docs, items, 3)
    for terms, rows, block in ((5, 7, 40), (1, 1, 10**6), (10**6, 10**6, 25)):
        monkeypatch.setattr(lexical_search, "TERMS", terms)
        monkeypatch.setattr(lexical_search, "DOCS", rows)
        monkeypatch.setattr(lexical_search, "BLOCK", block)
        assert ranked(spark, docs, items, k=3) == want


def test_parts_stay_exact():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 400_000, (4, 9))
    weights = rng.integers(0, 30_000, 9)
    parts = lexical_search._parts(counts, weights)
    whole = np.zeros_like(counts)
    for columns, part in parts:
        whole[:, columns] += part.astype(np.int64)
        assert ((part.astype(np.int64) * weights[columns] * 1_000_000).sum(axis=1) < 1 << 53).all()
    assert (whole == counts).all() and len(parts) > 1


def test_edges(spark):
    docs, items = data()
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == [] and ranked(spark, [(1, None), (2, "")], items) == []
    assert lexical_search.rank_documents(empty(spark), empty(spark).selectExpr("doc_id as item_id", "text")).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.terms("A_b,CÉd 9") == [b"a", b"b", "cÉd".encode(), b"9"]
