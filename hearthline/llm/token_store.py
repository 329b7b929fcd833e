"""Token ids in shards of raw payload, with a minimal perfect hash index for constant-time access by document key.

Texts are range-partitioned and sorted by key, encoded with a public tokenizer, and packed into shards of at most about
``SHARD_IDS`` ids. A shard is one binary image:

    "HLTS" | version u32 | documents u64 | ids u64 | levels u32 | distinct keys u32 | null keys u32
    keys i64[n] | offsets u64[n + 1] | for each level: bits u64 count, words u64[...] | fingerprints u32[n] | slots u32[n] | ids u32[...]

Everything is little-endian. Keys and offsets are in document order. The index is a cascade of bit arrays: a level sets
the bit of every key that has its hash to itself, the others go on to the next level, and the rank of a key's bit is its
slot. A slot holds a fingerprint of its key, which tells absent keys, and the key's place in document order.

Images travel in a binary column of a Parquet table, so every store that Spark can reach can hold them;
``export_shards`` writes them as plain files where the folder is mounted.

``look_up`` gives the documents of wanted keys: it finds a key's shard by the shards' key ranges, and the document by the
shard's index. ``read_documents`` goes through the index for every key too, so a wrong index can't go unnoticed.

Defined results: null text counts as empty and has the end id only; rows with the same key are all stored one after another,
ordered by a hash of their texts, and the index leads to the first of them; null keys come first and are not indexed; an
empty table gives no shards; a text of any length is one document of one shard; other columns don't matter.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import Memo, parts_of, saved, slices, strung

SHARD_IDS, END, GAMMA, LEVELS = 1 << 20, 0, 2.0, 48
#: Words whose ids a process keeps, of late and of before.
CACHE = 350_000
_HEAD = struct.Struct("<4sIQQIII")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A word with the white space before it, or white space at the end. The pre-tokenizer cuts before white space that follows a word.
_PIECE = re.compile(r"\s*\S+|\s+")


#: Letters of every Unicode version, after a line break or not, and a sign that is a pre-token of its own after them.
_LETTERS = re.compile("(\n?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]?)")


class TextEncoder:
    """Encodes whole texts; the library encodes each distinct word once.

    The pre-tokenizer always cuts before white space that follows a word, so a text's ids are those of its words, each
    with the white space before it. Words are told apart by splitting at spaces, with a space put before every line
    break. Where that meets other white space the text's words are found by a pattern instead.
    """

    def __init__(self, path: str):
        self.library = _encoder(path)
        # which ids begin with a space
        self.begins = np.zeros(self.library.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.begins[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t[0] == "Ġ"]] = True
        self.tails = dict(zip(".,;:!?", self._ids([*".,;:!?"])))
        self.memo = Memo(self._learn, CACHE)
        self.line = self._ids(["\n"])[0]
        self.line_id = int(np.frombuffer(self.line, dtype="<u4")[0])
        self.end = np.array([END], dtype="<u4").tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_line(self, words: list[str]) -> list[bytes]:
        """Ids of words without line breaks: as one text, where line breaks part them."""
        if not words:
            return []
        ids = np.array(self.library.encode_batch_fast(["\n".join([*words, ""])], add_special_tokens=False)[0].ids, dtype="<u4")
        raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.line_id) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *(x + 4 for x in ends)], ends)]

    def _spaced(self, letters: list[str]) -> list[bytes]:
        """Ids of words of letters alone, each with a space before it: as one text, where spaces begin them."""
        ids = np.array(self.library.encode_batch_fast([" ".join(["", *letters])], add_special_tokens=False)[0].ids, dtype="<u4")
        raw, starts = ids.tobytes(), (np.flatnonzero(self.begins[ids]) * 4).tolist()
        return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]

    def _learn(self, words: list[str]) -> list[bytes | None]:
        """Ids of words: one with a line break before it as it stands, others without their space; None where there is other white space."""
        out: dict[str, bytes | None] = dict.fromkeys(words)
        known, tailed, letters, lines, rest = self.memo.now, [], {}, {}, {}
        for w in words:
            m = _LETTERS.fullmatch(w)
            if m:
                body, tail = m[1], m[2]
                if tail:
                    tailed.append((w, body, tail))
                    if body in known or body in out:
                        continue
                if body[0] == "\n":
                    lines[body] = body[1:]
                else:
                    letters[body] = body
            elif w and not w[-1].isspace() and not any(map(str.isspace, w[1:])):
                if w[0] == "\n":
                    lines[w] = w[1:]
                else:
                    rest[w] = " " + w
        new: dict[str, bytes] = {}
        for some, ids_of, before in ((letters, self._spaced, b""), (lines, self._by_line, self.line), (rest, self._by_line, b"")):
            keys, values = [*some], [*some.values()]
            for i in range(0, len(keys), 5000):
                new.update(zip(keys[i : i + 5000], (before + x for x in ids_of(values[i : i + 5000]))))
        for w, body, tail in tailed:
            new[w] = (new[body] if body in new else known[body]) + self.tails[tail]
        return [new.get(w) for w in out]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian ids of each text, with the end id."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        # every text gets a line break in front, whose id is taken off again
        parts, places, bounds = parts_of(texts, "\n")
        get = self.memo.of({*parts}).__getitem__
        known = [*map(get, parts)]
        odd = np.concatenate(([0], np.cumsum(np.array([x is None for x in known], dtype=bool)[places])))
        ids, ends = strung([x or b"" for x in known], places)
        raw, ends, odd = ids.tobytes(), (4 * ends[bounds]).tolist(), (odd[bounds[1:]] > odd[bounds[:-1]]).tolist()
        skip, out = len(self.line), []
        for i, (a, b, other) in enumerate(zip(ends, ends[1:], odd)):
            # a lone line break is odd, so only empty texts come out of the pattern without words
            out.append((b"".join(self._ids(_PIECE.findall(texts[i].as_py() or ""))) if other else raw[a + skip : b]) + self.end)
        return out


@lru_cache(maxsize=1)
def text_encoder(path: str) -> TextEncoder:
    """The encoder of this process: tasks that follow each other share its words."""
    return TextEncoder(path)


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit mix of integer keys."""
    h = keys.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct integer keys, as bit arrays by level with ranks."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(words).astype(np.int64) for words in levels]
        ends = np.cumsum([0, *(int(c.sum()) for c in counts)])
        self.before = [start + np.cumsum(c) - c for start, c in zip(ends, counts)]
        self.n = int(ends[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)))
            at = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
            bits[:size] = alone
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys must be distinct")
        # sizes follow from the numbers of keys, which follow from the levels' bits
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has it. Absent keys may get the slot of another key."""
        out, open_, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), self.n
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            size = max(64, int(GAMMA * left))
            at = (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            rank = before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
            left -= int(np.bitwise_count(words).sum())
        return out


def pack_shard(keys: list[int | None], ids: list[bytes]) -> bytes:
    """The image of documents in key order."""
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype("<u8")
    values = np.array([0 if k is None else k for k in keys], dtype="<i8")
    first = np.flatnonzero(np.array([k is not None and (i == 0 or keys[i - 1] != k) for i, k in enumerate(keys)], dtype=bool))
    index = PerfectHash.build(values[first])
    slot = index.slots(values[first])
    prints, places = np.zeros(len(first), dtype="<u4"), np.zeros(len(first), dtype="<u4")
    prints[slot], places[slot] = (_mix(values[first], 1 << 20) >> np.uint64(32)).astype("<u4"), first
    parts = [_HEAD.pack(b"HLTS", 2, len(keys), int(offsets[-1]), len(index.levels), len(first), sum(k is None for k in keys)), values.tobytes(), offsets.tobytes()]
    for words in index.levels:
        parts += [struct.pack("<Q", len(words)), words.tobytes()]
    return b"".join([*parts, prints.tobytes(), places.tobytes(), *ids])


class Shard:
    """Reads an image."""

    def __init__(self, image: bytes):
        magic, version, self.n, n_ids, levels, n_keys, self.nulls = _HEAD.unpack_from(image)
        if (magic, version) != (b"HLTS", 2):
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.keys, self.offsets = take("<i8", self.n), take("<u8", self.n + 1).astype(np.int64)
        self.index = PerfectHash([take("<u8", int(take("<u8", 1)[0])) for _ in range(levels)])
        self.prints, self.places, self.ids = take("<u4", n_keys), take("<u4", n_keys), take("<u4", n_ids)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in document order; -1 where the fingerprint says that it isn't here."""
        slot = self.index.slots(np.asarray(keys))
        out = np.full(len(slot), -1, dtype=np.int64)
        known = slot >= 0
        same = self.prints[slot[known]] == (_mix(np.asarray(keys)[known], 1 << 20) >> np.uint64(32)).astype("<u4")
        out[np.flatnonzero(known)[same]] = self.places[slot[known][same]]
        return out

    def places_by_key(self) -> np.ndarray:
        """Where each document is, in key order: the index says where a key's first document is, repeats follow it; null keys come first."""
        keys = self.keys[self.nulls :]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(first)
        found = self.find(keys[starts])
        if (found < 0).any() or not np.array_equal(self.keys[found], keys[starts]):
            raise ValueError("the index of a shard does not lead to its keys")
        run = np.cumsum(first) - 1
        return np.concatenate([np.arange(self.nulls), found[run] + np.arange(len(keys)) - starts[run]]) if len(keys) else np.arange(self.nulls)

    def document(self, place: int) -> np.ndarray:
        return self.ids[self.offsets[place] : self.offsets[place + 1]]


def write_shards(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """The written shard table: (part, seq, first_key, last_key, n_docs, n_ids, image), in key order by (part, seq)."""
    path = path or tokenizer_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = text_encoder(path)
        part, seq, keys, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([keys[0]], pa.int64()), pa.array([keys[-1]], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_shard(keys, ids)], pa.binary())],
                names=["part", "seq", "first_key", "last_key", "n_docs", "n_ids", "image"],
            )

        for b in slices(batches, 500, 1 << 21):
            for k, x in zip(b.column(0).to_pylist(), encoder.encode(b.column(1))):
                keys.append(k)
                ids.append(x)
                size += len(x) // 4
                if size >= SHARD_IDS:
                    yield shard()
                    seq, keys, ids, size = seq + 1, [], [], 0
        if keys:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    # rows of one key are parted by their texts, so that no key is one task's
    order = [F.asc_nulls_first("key"), F.col("mark")]
    rows = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    rows = rows.sortWithinPartitions(*order).select("key", "text")
    return saved(rows.mapInArrow(pack, "part int, seq int, first_key long, last_key long, n_docs long, n_ids long, image binary"), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, shard_part, shard_seq) of every stored document, read where the index of its image leads.

    start is the number of ids of all documents before it.
    """
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # one row for each range partition: their number is set, whatever the data
    before = sizes.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("_before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = shards.select("part", "seq", "n_ids").withColumn("_within", within).join(F.broadcast(before), "part").select(F.col("part").alias("_p"), F.col("seq").alias("_s"), (F.col("_before") + F.col("_within")).alias("_start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, image in zip(*(c.to_pylist() for c in b.columns)):
                s = Shard(image)
                at = s.places_by_key()
                crc = np.array([zlib.crc32(s.document(i)) for i in at.tolist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(s.n, part, np.int32)), pa.array(np.full(s.n, seq, np.int32)), pa.array(s.keys, mask=np.arange(s.n) < s.nulls), pa.array(s.offsets[at]), pa.array(s.offsets[at + 1] - s.offsets[at]), pa.array(crc)],
                    names=["part", "seq", "key", "offset", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "seq", "image").mapInArrow(read, "part int, seq int, key long, offset long, n_tokens long, ids_crc32 long")
    joined = rows.join(starts, (rows["part"] == starts["_p"]) & (rows["seq"] == starts["_s"]))
    return joined.select("key", (F.col("_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", F.col("part").alias("shard_part"), F.col("seq").alias("shard_seq"))


def look_up(shards: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(key, ids): the ids, end id included, of the first document of each of the wanted keys that is stored.

    A key goes to its partition by the partitions' key ranges (their number is set, whatever the data), then to its
    shard by one sorted pass over the partition's shards and wanted keys, and the shard's index leads to the document.
    """
    stored = shards.where("last_key is not null")
    parts = stored.groupBy("part").agg(F.min(F.coalesce("first_key", F.lit(-(1 << 63)))).alias("_low"), F.max("last_key").alias("_high"))
    wanted = keys.where(F.col(key_col).isNotNull()).select(F.col(key_col).cast("long").alias("key")).distinct()
    # a key that runs over several partitions is wanted from the first of them
    routed = wanted.join(F.broadcast(parts), F.col("key").between(F.col("_low"), F.col("_high"))).groupBy("key").agg(F.min("part").alias("part"))
    marks = stored.groupBy("part", F.coalesce("first_key", F.lit(-(1 << 63))).alias("key")).agg(F.min("seq").alias("seq"), F.lit(1).alias("kind"))
    both = marks.unionByName(routed.select("part", "key", F.lit(None).cast("int").alias("seq"), F.lit(0).alias("kind")))
    # shards are in key order: the last one that begins below the key may have it, or the first that begins with it
    below = F.last("seq", ignorenulls=True).over(Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.min("seq").over(Window.partitionBy("part", "key"))
    placed = both.select("part", "key", "kind", F.array_compact(F.array(below, at)).alias("seqs")).where("kind = 0")
    asked = placed.select("part", "key", F.explode("seqs").alias("seq")).groupBy("part", "seq").agg(F.collect_list("key").alias("keys"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, image, some in zip(*(c.to_pylist() for c in b.columns)):
                s, some = Shard(image), np.array(some, dtype=np.int64)
                place = s.find(some)
                hit = place >= 0
                hit[hit] = s.keys[place[hit]] == some[hit]  # a fingerprint may be another key's
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some[hit]), pa.array(np.full(int(hit.sum()), part, np.int32)), pa.array(np.full(int(hit.sum()), seq, np.int32)), pa.array([s.document(i).astype(np.int64) for i in place[hit].tolist()], pa.list_(pa.int64()))],
                    names=["key", "part", "seq", "ids"],
                )

    found = stored.select("part", "seq", "image").join(asked, ["part", "seq"]).mapInArrow(find, "key long, part int, seq int, ids array<long>")
    return found.groupBy("key").agg(F.min_by("ids", F.struct("part", "seq")).alias("ids"))


def export_shards(shards: DataFrame, folder: str) -> int:
    """Writes each image as a file part-seq.bin of a folder that all executors mount; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for part, seq, image in zip(*(c.to_pylist() for c in b.columns)):
                with open(f"{folder}/{part:06d}-{seq:06d}.bin", "wb") as f:
                    f.write(image)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return shards.select("part", "seq", "image").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
