import random

import numpy as np
from tests.llm.data import corpus, empty, frame

from hearthline.llm import sentence_pieces as k

PATH = k.vocabulary_path()


def slow(m, word):
    """Plain Viterbi with the longer last piece first among equals."""
    at = {m.pieces[i]: (i, s) for i, s in zip(m.ids, m.score)}
    best, back = [0.0] + [float("-inf")] * len(word), [None] * (len(word) + 1)
    for j in range(1, len(word) + 1):
        best[j], back[j] = best[j - 1] + m.lost, (j - 1, None)
        for size in range(1, min(j, m.longest) + 1):
            hit = at.get(word[j - size : j])
            if hit and best[j - size] + hit[1] >= best[j]:
                best[j], back[j] = best[j - size] + hit[1], (j - size, hit[0])
    out, j = [], len(word)
    while j:
        i, p = back[j]
        out.append([p] if p is not None else [m.byte_ids[b] for b in word[j - 1].encode()][::1])
        j = i
    return [x for part in out[::-1] for x in part]


def test_viterbi_against_plain_one():
    m = k.PieceModel(PATH)
    rng = random.Random(1)
    words = [" " + "".join(rng.choice("theoraniédß漢z'") for _ in range(rng.randint(1, 14))) for _ in range(400)] + [" " * 5, "\n"]
    for w, ids in zip(words, m._encoded(words)):
        assert np.frombuffer(ids, dtype=np.int32).tolist() == slow(m, w.replace(" ", k.SPACE)), w


def test_long_words_are_cut_alike(monkeypatch):
    m = k.PieceModel(PATH)
    rng = random.Random(2)
    words = ["".join(rng.choice("theoraniédß漢z'") for _ in range(n)) for n in (1, 3, 40, 40, 250)]
    want = [slow(m, w) for w in words]
    monkeypatch.setattr(k, "LONG", 0)
    assert [m.viterbi([w])[0].tolist() for w in words] == want


def test_round_trips():
    m = k.PieceModel(PATH)
    texts = ["", "a", " a", "a  b ", "\n\n x\t y", "▁ literal ▁▁", "漢字 😀", "", "é" * 3000, None] + [r[1] for r in corpus()]
    for t, ids in zip(texts, m.encode(texts)):
        assert m.decode(ids.tolist()) == (t or "")
        assert ids.dtype.kind == "i" and (len(ids) == 0) == (not t)


def test_known_words_are_single_pieces():
    m = k.PieceModel(PATH)
    (ids,) = m.encode(["the house"])
    assert [m.pieces[i] for i in ids] == ["▁the", "▁house"]


def test_cache_may_overflow(monkeypatch):
    texts = [r[1] for r in corpus()]
    want = [x.tolist() for x in k.PieceModel(PATH).encode(texts)]
    monkeypatch.setattr(k, "CACHE", 5)
    m = k.PieceModel(PATH)
    assert [m.encode([t])[0].tolist() for t in texts] == want


def test_frames(spark):
    df = frame(spark)
    out = k.encode_pieces(df)
    rows = out.collect()
    assert len(rows) == df.count() and all(r["round_trip"] for r in rows)
    assert out.columns == [c for c in df.columns if c != "text"] + ["piece_ids", "n_pieces", "round_trip"]
    back = k.decode_pieces(out.select("doc_id", "piece_ids"))
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back.collect()) == sorted((r["doc_id"] or -1, r["text"] or "") for r in df.collect())
    assert k.encode_pieces(empty(spark)).count() == 0
    assert np.mean([r["n_pieces"] for r in rows]) > 1
