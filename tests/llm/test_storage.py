import hashlib
import zlib

import numpy as np
import pytest
from tests.llm.data import corpus, empty, frame

from hearthline.llm import media, token_store as ts


def test_encoder_equals_the_library():
    e = ts.TextEncoder(ts.tokenizer_path())
    texts = ["", None, "a  b", "x\n\ny", " lead", "trail ", "tab\tx", "a b", "<|endoftext|> hi<|endoftext|>", "don't we'll 'tis", "\n", "a\nb", "é\x85y", "-- x 's 's", "a   b\t c", "x \n\n  y \n", "u\u2003v w\u00a0 x", "a\x1c b\x1dc", " \n", "\r\nx\r\n", "Straße, naïve ĳſ ª º µ. Ωmega ǅ; x?! \nété, (a) a1, 1, , .", "漢字, 😀"] + [r[1] for r in corpus()]
    want = [[*x.ids, 0] for x in e.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in e.encode(texts)] == want


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(2**62, n, replace=False).astype(np.int64) - 2**61
    h = ts.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == [*range(n)]


def test_shard_lookup():
    keys = [None, None, -5, 3, 3, 7, 9]
    ids = [np.array([i, i + 1, 0], dtype="<u4").tobytes() for i in range(len(keys))]
    s = ts.Shard(ts.pack_shard(keys, ids))
    assert s.find(np.array([-5, 3, 7, 9])).tolist() == [2, 3, 5, 6]
    assert s.document(5).tolist() == [5, 6, 0]
    absent = s.find(np.arange(100, 10_000))
    assert (absent >= 0).mean() < 0.01
    with pytest.raises(ValueError):
        ts.PerfectHash.build(np.array([1, 1]))


def check_store(spark, df, got):
    e = ts.TextEncoder(ts.tokenizer_path())
    rows = sorted(df.selectExpr("doc_id", "text", "xxhash64(text)").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    at, want = 0, []
    for (i, *_), ids in zip(rows, e.encode([r[1] for r in rows])):
        want.append((i or 0, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted((r["key"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("size", [1 << 20, 500])
def test_store_round_trip(spark, monkeypatch, tmp_path, size):
    monkeypatch.setattr(ts, "SHARD_IDS", size)
    df = frame(spark)
    shards = ts.write_shards(df, partitions=3)
    check_store(spark, df, ts.read_documents(shards))
    assert ts.export_shards(shards, str(tmp_path / "bin")) == shards.count() == len([*(tmp_path / "bin").iterdir()])


@pytest.mark.parametrize("size", [1 << 20, 500, 1])
def test_look_up(spark, monkeypatch, size):
    monkeypatch.setattr(ts, "SHARD_IDS", size)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(["same key, other text"] * 9 + ["x y z"])] + corpus()
    df = frame(spark, rows)
    shards = ts.write_shards(df, partitions=3)
    e = ts.TextEncoder(ts.tokenizer_path())
    want = {}
    for i, t in sorted(((r[0], r[1]) for r in df.selectExpr("doc_id", "text", "xxhash64(text) as h").orderBy("doc_id", "h").collect() if r[0] is not None), key=lambda r: r[0]):
        want.setdefault(i, np.frombuffer(e.encode([t])[0], dtype="<u4").tolist())
    keys = spark.createDataFrame([(i,) for i in [*range(-3, 200), 5, 5, None]], "doc_id long")
    assert {r["key"]: r["ids"] for r in ts.look_up(shards, keys).collect()} == want


def test_a_wrong_index_is_noticed(spark):
    keys = [None, 3, 3, 7, 9]
    s = ts.Shard(ts.pack_shard(keys, [np.array([i, 0], dtype="<u4").tobytes() for i in range(5)]))
    assert s.places_by_key().tolist() == [0, 1, 2, 3, 4]
    s.places = s.places[::-1]
    with pytest.raises(ValueError):
        s.places_by_key()


def test_store_empty(spark):
    assert ts.read_documents(ts.write_shards(empty(spark))).count() == 0


def test_cuts_move_little():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 123, 60_000).astype(np.uint8))
    assert b"".join(media.chunks(data)) == data
    assert all(len(c) <= media.GREATEST for c in media.chunks(data)) and all(len(c) >= media.LEAST for c in media.chunks(data)[:-1])
    other = data[:30_000] + b"inserted" + data[30_000:]
    assert len({*media.chunks(other)} - {*media.chunks(data)}) <= 3
    # against the rolling hash of the last 32 bytes, taken byte by byte
    for n in (0, 100, 511, 512, 20_000):
        h, ends, start = 0, [], 0
        for i in range(n):
            h = ((h << 1) + int(media.GEAR[data[i]])) % 2**32
            if i + 1 - start == media.GREATEST or (i + 1 - start >= media.LEAST and h >> (32 - media.CUT_BITS) == 0):
                ends.append(i + 1)
                start = i + 1
        assert media.cuts(data[:n]) == ends + ([n] if n > start else [])
    assert len(ends) > 5


def check_media(df, got):
    want = []
    for i, t in df.select("doc_id", "text").collect():
        p = media.payload(t)
        w = media.to_wave(p)
        want.append((i or -1, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(w), hashlib.sha256(w).hexdigest(), media.feature(p)))
        assert len(p) % 192 == 0 and p and media.from_wave(w) == p
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert sorted((r["id"] or -1, *(r[n] for n in names)) for r in got.collect()) == sorted(want)


def test_media_round_trip(spark):
    rows = corpus()
    long = "\n".join(r[1] or "" for r in rows[:60])
    rows += [(200, long, "en", "a", 1), (201, "start " + long, "en", "a", 1), (202, long + " end", "en", "a", 1), (203, long, "en", "a", 1), (203, "same key", "en", "a", 1)]
    df = frame(spark, rows)
    listing, store = media.store_media(df)
    got = media.read_media(listing, store)
    check_media(df, got)
    by = {r["id"]: r for r in got.collect()}
    assert by[201]["n_chunks_elsewhere"] + by[202]["n_chunks_elsewhere"] + by[200]["n_chunks_elsewhere"] > 0
    assert store.select("file").distinct().count() == len({r[1] or "" for r in rows}) == store.count()


def test_media_empty(spark):
    assert media.read_media(*media.store_media(empty(spark))).count() == 0
