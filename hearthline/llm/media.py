"""Media columns with content-defined chunks that are stored once.

Text bytes, padded to a multiple of 192, are the 8-bit samples of a WAVE file. A rolling gear hash over the last 32 bytes
cuts the file where its top bits are zero, with a least and a greatest chunk size, so an insertion moves few cuts.
Spark groups the files by digest (equal files are stored once, under their smallest key) and joins the digests of the
remaining files' chunks: each chunk belongs to the smallest key that has it. The store holds, for each distinct file, its
ordered chunk list and the bytes of the chunks that belong to it. Reading back joins the chunks that belong elsewhere,
puts every file together in order, and verifies length and digest before the samples are used.

Texts travel compressed (bz2 packs short texts a seventh tighter than zstd does), so that the joins shuffle about as many
bytes as the store holds.

Defined results: null text counts as empty and is padded to 192 bytes; texts of any length are stored whole; equal texts share
one stored file; rows with the same key each get their result; null keys are stored under the key of an equal file, or
alone; an empty table gives empty tables; other columns don't matter.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import saved, slices

PAD, RATE = 192, 8000
LEAST, GREATEST, CUT_BITS = 512, 16384, 11


def _gear() -> np.ndarray:
    """One 32-bit number a byte value, by a fixed mix."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def to_wave(samples: bytes) -> bytes:
    """A mono WAVE file of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def from_wave(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 40)[0] != len(media) - 44:
        raise ValueError("not a WAVE file of this store")
    return media[44:]


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for j in range(5):  # windows of 2, 4, ... 32 bytes
        n = 1 << j
        if len(h) > n:
            h[n:] = h[n:] + (h[:-n] << np.uint32(n))
    marks = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, start, i = [], 0, 0
    while start < len(data):
        while i < len(marks) and marks[i] < start + LEAST:
            i += 1
        end = min(marks[i] if i < len(marks) else len(data), start + GREATEST, len(data))
        out.append(end)
        start = end
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def feature(samples: bytes) -> str:
    """A short description of the samples: mean, spread, zero crossings around the mean, and the four commonest values."""
    x = np.frombuffer(samples, dtype=np.uint8)
    n = np.bincount(x, minlength=256)
    mean = x.mean()
    top = np.argsort(-n, kind="stable")[:4]
    return f"mean={mean:.4f};std={x.std():.4f};cross={int(np.count_nonzero(np.diff(x > mean)))};top={','.join(map(str, top.tolist()))}"


def _listing(docs: DataFrame) -> DataFrame:
    """(key, file, n_bytes, digests, id): digest of each row's file, and of its chunks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            files, sizes, lists = [], [], []
            for t in b.column(1).to_pylist():
                media = to_wave(payload(t))
                files.append(digest(media))
                sizes.append(len((t or "").encode("utf-8", "surrogatepass")))
                lists.append([digest(c) for c in chunks(media)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.binary())), b.column(2)], names=["key", "file", "n_bytes", "digests", "id"])

    return docs.select("key", "text", "id").mapInArrow(run, "key long, file binary, n_bytes long, digests array<binary>, id long")


def _packed(docs: DataFrame) -> DataFrame:
    """(key, file, packed): the digest of the row's file, and its text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            packed = [bz2.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(to_wave(payload(t))) for t in texts], pa.binary()), pa.array(packed, pa.binary())], names=["key", "file", "packed"])

    return docs.select("key", "text").mapInArrow(run, "key long, file binary, packed binary")


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The written listing (file, n_bytes, id) of all rows, and the written store of distinct files.

    Store rows: file, digests (ordered chunk list), sizes, kinds (0 belongs to another file, 1 is used by this one
    alone, 2 also by others), body (the compressed bytes of the chunks of kinds 1 and 2, in order).
    """
    # rows without a key go by a negative key of their own text
    key = F.coalesce(F.col(id_col).cast("long"), -F.abs(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))) - F.lit(1))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    listing = saved(_listing(rows), "media-listing")
    firsts = listing.groupBy("file").agg(F.min("key").alias("key"), F.min_by("digests", "key").alias("digests"))
    used = firsts.select("file", "key", F.posexplode("digests").alias("seq", "digest"))
    # written, so that the join with all users of a very common chunk can be broadcast or split
    shared = saved(used.groupBy("digest").agg(F.min("key").alias("owner"), F.max("key").alias("last")).where("owner <> last").drop("last"), "media-shared")
    marks = used.join(shared, "digest").groupBy("file").agg(F.collect_set(F.struct("seq", (F.col("key") == F.col("owner")).alias("own"))).alias("marks"))
    plan = firsts.select("file", "key").join(marks, "file", "left")
    # rows that repeat both key and file are one before they meet the plan, which has each file once
    packed = _packed(rows).groupBy("key", "file").agg(F.first("packed").alias("packed")).join(plan, ["key", "file"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                out: dict[str, list] = {c: [] for c in ("file", "digests", "sizes", "kinds", "body")}
                for raw, file, marks in zip(*(whole.column(c).slice(i, 500).to_pylist() for c in ("packed", "file", "marks"))):
                    media = to_wave(payload(bz2.decompress(raw).decode("utf-8", "surrogatepass")))
                    parts = chunks(media)
                    kinds = [1] * len(parts)
                    for m in marks or ():
                        kinds[m["seq"]] = 2 if m["own"] else 0
                    for c, v in zip(out, (file, [digest(x) for x in parts], [len(x) for x in parts], kinds, bz2.compress(b"".join(x for x, k in zip(parts, kinds) if k)))):
                        out[c].append(v)
                kinds_of = {"file": pa.binary(), "digests": pa.list_(pa.binary()), "sizes": pa.list_(pa.int32()), "kinds": pa.list_(pa.int32()), "body": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds_of[c]) for c in out], names=list(out))

    store = packed.select("packed", "file", "marks").mapInArrow(cut_up, "file binary, digests array<binary>, sizes array<int>, kinds array<int>, body binary")
    return listing.drop("digests", "key"), saved(store, "media-store", codec="none")


def _shared_chunks(store: DataFrame) -> DataFrame:
    """(digest, chunk) of the chunks that other files use too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, out = [], []
            for digests, sizes, kinds, body in zip(*(b.column(c).to_pylist() for c in ("digests", "sizes", "kinds", "body"))):
                raw, at = bz2.decompress(body), 0
                for d, n, k in zip(digests, sizes, kinds):
                    if k == 2:
                        names.append(d)
                        out.append(bz2.compress(raw[at : at + n]))
                    at += n if k else 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.binary())], names=["digest", "chunk"])

    return store.where(F.array_contains("kinds", 2)).select("digests", "sizes", "kinds", "body").mapInArrow(run, "digest binary, chunk binary")


def _rebuilt(store: DataFrame) -> DataFrame:
    """Each distinct file put together again, verified, and measured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b, out = whole.slice(i, 500), []
                for file, sizes, kinds, body, others in zip(*(b.column(c).to_pylist() for c in ("file", "sizes", "kinds", "body", "others"))):
                    raw, at, parts = bz2.decompress(body), 0, []
                    found = {o["seq"]: o["chunk"] for o in others or ()}
                    for seq, (n, k) in enumerate(zip(sizes, kinds)):
                        parts.append(raw[at : at + n] if k else bz2.decompress(found[seq]))
                        at += n if k else 0
                    media = b"".join(parts)
                    if digest(media) != file:
                        raise ValueError("a stored file does not match its digest")
                    samples = from_wave(media)
                    out.append((file, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), len(sizes), sum(1 for k in kinds if not k), feature(samples)))
                columns = list(zip(*out)) or [[]] * 9
                types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                names = ["file", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_chunks", "n_chunks_elsewhere", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    columns = ["file", "sizes", "kinds", "body", "others"]
    schema = "file binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_chunks long, n_chunks_elsewhere long, feature string"
    lacking = F.array_contains("kinds", 0)
    refs = store.where(lacking).select("file", F.posexplode(F.arrays_zip("digests", "kinds")).alias("seq", "c")).where("c.kinds = 0").select("file", "seq", F.col("c.digests").alias("digest"))
    fetched = refs.join(_shared_chunks(store), "digest").groupBy("file").agg(F.collect_list(F.struct("seq", "chunk")).alias("others"))
    partial = store.where(lacking).join(fetched, "file").select(*columns).mapInArrow(run, schema)
    complete = store.where(~lacking).withColumn("others", F.lit(None).cast("array<struct<seq:int,chunk:binary>>")).select(*columns).mapInArrow(run, schema)
    return complete.unionByName(partial)


def read_media(listing: DataFrame, store: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes, ... feature) of every row, from the stored bytes."""
    # each file is stored once: a join without a grouping, which Spark can split where copies abound
    return listing.join(_rebuilt(store), "file").drop("file")
