"""SentencePiece encoding and decoding by batched numpy Viterbi over an existing piece vocabulary.

A text gets ``▁`` in front and for its spaces, and is cut into words: ``▁`` runs with what follows, and line breaks (no
piece crosses either). Words that a task has not met yet are grouped by length and advance together: at each end
position the hashes of the substrings that may be a piece probe the sorted piece keys, and a vectorised maximum over
the lengths stores score and backpointer. Characters that no piece covers become byte pieces, so decoding gives back
every text exactly.

The vocabulary file holds merge ranks r as scores -r, so a piece weighs -log(r + 2), Zipf's law over the ranks; byte
pieces stand for unknown characters only. ``raw_scores`` takes the scores as they are, for vocabularies that hold
log-probabilities. Ties go to the longer last piece.

Words of more than ``LONG`` characters are taken one at a time: all their pieces are found by sliding hashes, then one
pass over the ends stores score and backpointer, so a text without spaces takes time in proportion to its length.

Defined results: null text encodes as an empty one, to no ids; texts of any length are encoded whole; an empty table
gives no rows; repeated rows encode alike; other columns pass through, but for those named like the results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hearthline.llm.common import Memo, parts_of, strung

SPACE = "▁"
#: Encoded words that a process keeps, of late and of before.
CACHE = 300_000
#: Words of more characters are taken one at a time, all their pieces found at once.
LONG = 256
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Spaces with what follows, line breaks, and a ▁ of the text itself.
_WORD = re.compile(f" *[^ \n{SPACE}]+| +|\n|{SPACE}")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Pieces, their weights and a sorted key table, from a SentencePiece model file."""

    def __init__(self, path: str, raw_scores: bool = False):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = np.array([sp.get_score(i) for i in usable])
        if not raw_scores:
            rank = np.maximum(np.where(score > -1e8, -score, 0), 0)
            # runs of spaces have no rank: the longest one is taken
            score = np.where(score > -1e8, -np.log(rank + 2), -np.log(2.0))
        self.longest = max(len(self.pieces[i]) for i in usable)
        keys = np.array([self.key(self.pieces[i]) for i in usable], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.score = keys[order], np.array(usable)[order], score[order]
        assert len(np.unique(self.keys)) == len(keys), "two pieces share a hash"
        self.lost = float(score.min()) - 10.0
        # where in the sorted keys those with the same leading 20 bits begin (-1: there are none), and how many share them at most
        lead, starts, sizes = np.unique((self.keys >> np.uint64(44)).astype(np.int64), return_index=True, return_counts=True)
        self.begin = np.full(1 << 20, -1, dtype=np.int32)
        self.begin[lead] = starts
        self.deep = int(sizes.max())
        self.keys_end = np.concatenate([self.keys, np.zeros(self.deep, dtype=np.uint64)])
        self.texts = [x.replace(SPACE, " ") for x in self.pieces]
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[[*self.byte_ids.values()]] = True
        self.words, self.chunks = Memo(self._encoded, CACHE), Memo(self._encoded_chunks, CACHE)

    @staticmethod
    def key(piece: str) -> int:
        return int(PieceModel._finish(PieceModel._prefixes(PieceModel._codes([piece]))[:, -1])[0])

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        """Characters of equally long words, one row for each."""
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        """Hash of every prefix, the empty one first."""
        h = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        for j in range(codes.shape[1]):
            h[:, j + 1] = h[:, j] * _BASE + codes[:, j] + np.uint64(1)
        return h

    @staticmethod
    def _finish(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32))

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose hash is a piece's, and the piece's place."""
        at = self.begin[(h >> np.uint64(44)).astype(np.int64)]
        rows = np.flatnonzero(at >= 0)
        at, wanted = at[rows], h[rows]
        hit = self.keys_end[at] == wanted
        for i in range(1, self.deep):
            more = np.flatnonzero(~hit)
            if not len(more):
                break
            here = self.keys_end[at[more] + i] == wanted[more]
            at[more[here]] += i
            hit[more[here]] = True
        return rows[hit], at[hit]

    def arcs(self, word: str) -> tuple[list[int], list[int], list[int]]:
        """For each end in the word where its pieces begin in the lists of their sizes (shortest first) and places."""
        codes = self._codes([word])[0] + np.uint64(1)
        h, ends, sizes, places = np.zeros(len(codes) + 1, dtype=np.uint64), [], [], []
        for size in range(1, min(self.longest, len(codes)) + 1):
            h = h[:-1] * _BASE + codes[size - 1 :]
            starts, at = self.probe(self._finish(h))
            ends.append(starts + size)
            sizes.append(np.full(len(starts), size))
            places.append(at)
        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        first = np.searchsorted(end[order], np.arange(len(codes) + 2))
        return first.tolist(), np.concatenate(sizes)[order].tolist(), np.concatenate(places)[order].tolist()

    def _viterbi_long(self, word: str) -> np.ndarray:
        """The same for one word."""
        first, sizes, places = self.arcs(word)
        score, best, back = self.score.tolist(), [0.0], [(1, -1)]
        for j in range(1, len(word) + 1):
            top, how = best[j - 1] + self.lost, (1, -1)
            for i in range(first[j], first[j + 1]):
                x = best[j - sizes[i]] + score[places[i]]
                if x >= top:
                    top, how = x, (sizes[i], places[i])
            best.append(top)
            back.append(how)
        out, j = [], len(word)
        while j:
            size, at = back[j]
            out += [int(self.ids[at])] if at >= 0 else [self.byte_ids[b] for b in reversed(word[j - 1].encode("utf-8", "surrogatepass"))]
            j -= size
        return np.array(out[::-1], dtype=np.int32)

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """Ids of the best segmentation of each of some equally long words."""
        if len(words[0]) > LONG:
            return [*map(self._viterbi_long, words)]
        codes = self._codes(words)
        n, length = codes.shape
        h = self._prefixes(codes)
        power = np.ones(self.longest + 1, dtype=np.uint64)
        for i in range(self.longest):
            power[i + 1] = int(power[i]) * int(_BASE) % (1 << 64)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.ones((n, length + 1), dtype=np.int32)
        piece = np.full((n, length + 1), -1, dtype=np.int32)
        for j in range(1, length + 1):
            top = best[:, j - 1] + self.lost
            step, what = np.ones(n, dtype=np.int32), np.full(n, -1, dtype=np.int32)
            for size in range(1, min(j, self.longest) + 1):
                rows, at = self.probe(self._finish(h[:, j] - h[:, j - size] * power[size]))
                score = best[rows, j - size] + self.score[at]
                better = score >= top[rows]
                rows = rows[better]
                top[rows], step[rows], what[rows] = score[better], size, self.ids[at[better]]
            best[:, j], back[:, j], piece[:, j] = top, step, what
        ends, where, found = np.full(n, length), np.arange(n), []
        while len(where):
            found.append((where, ends[where], piece[where, ends[where]]))
            ends[where] -= back[where, ends[where]]
            where = where[ends[where] > 0]
        word = np.concatenate([w for w, _, _ in found])[::-1]
        end = np.concatenate([e for _, e, _ in found])[::-1]
        ids = np.concatenate([p for _, _, p in found])[::-1]
        order = np.argsort(word, kind="stable")
        word, end, ids = word[order], end[order], ids[order]
        out = np.split(ids, np.flatnonzero(np.diff(word)) + 1)
        if (ids < 0).any():
            ends = np.split(end, np.flatnonzero(np.diff(word)) + 1)
            for i in np.unique(word[ids < 0]):
                out[i] = np.array([x for p, e in zip(out[i], ends[i]) for x in ([p] if p >= 0 else [self.byte_ids[b] for b in words[i][e - 1].encode("utf-8", "surrogatepass")])], dtype=np.int32)
        return out

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of words. A ▁ of the text becomes its bytes, as the piece ▁ stands for a space."""
        out = {SPACE: np.array([self.byte_ids[b] for b in SPACE.encode()], dtype=np.int32).tobytes()}
        by_length: dict[int, list[str]] = {}
        for w in words:
            if w != SPACE:
                by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            most = max(1, 400_000 // (length + 1))
            for i in range(0, len(group), most):
                part = group[i : i + most]
                out.update(zip(part, (x.astype(np.int32).tobytes() for x in self.viterbi([w.replace(" ", SPACE) for w in part]))))
        return [out[w] for w in words]

    def _encoded_chunks(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of the parts between single spaces, each with its space, or with the line break before it; None where only the pattern tells words apart."""
        plain = [c for c in chunks if c and SPACE not in c]
        words = {c[1:] if c[0] == "\n" else " " + c for c in plain} - {""} | {"\n"}
        get = self.words.of(words)
        ids = {c: (get["\n"] + (get[c[1:]] if len(c) > 1 else b"")) if c[0] == "\n" else get[" " + c] for c in plain}
        return [ids.get(c) for c in chunks]

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        parts, places, bounds = parts_of(texts)
        known = [*map(self.chunks.of({*parts}).__getitem__, parts)]
        odd = np.concatenate(([0], np.cumsum(np.array([x is None for x in known], dtype=bool)[places])))
        ids, ends = strung([x or b"" for x in known], places)
        out, ids, ends = [], ids.view(np.int32), ends[bounds]
        for i, other in enumerate((odd[bounds[1:]] > odd[bounds[:-1]]).tolist()):
            if other:
                words = _WORD.findall(" " + t) if (t := texts[i].as_py()) else []
                out.append(np.frombuffer(b"".join([*map(self.words.of({*words}).__getitem__, words)]), dtype=np.int32))
            else:
                out.append(ids[ends[i] : ends[i + 1]])
        return out

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        if not self.is_byte[ids].any():
            return "".join([*map(self.texts.__getitem__, ids.tolist())])[1:]
        out, raw, byte_of = [], bytearray(), self.byte_of
        for i in ids.tolist():
            if i in byte_of:
                raw.append(byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "surrogatepass"))
                raw = bytearray()
            out.append(self.texts[i])
        if raw:
            out.append(raw.decode("utf-8", "surrogatepass"))
        return "".join(out)[1:]


@lru_cache(maxsize=2)
def model(path: str, raw_scores: bool = False) -> PieceModel:
    """The model of this process, read once."""
    return PieceModel(path, raw_scores)


def encode_pieces(docs: DataFrame, path: str | None = None, raw_scores: bool = False, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with piece_ids (array of int), n_pieces and round_trip: whether decoding the ids gives the text back; these replace columns of their names."""
    path = path or vocabulary_path()
    others = [c for c in docs.columns if (c != text_col or keep_text) and c not in ("piece_ids", "n_pieces", "round_trip")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, raw_scores)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                texts = b.column(0).to_pylist()
                ids = m.encode(b.column(0))
                n = np.array([len(x) for x in ids], dtype=np.int64)
                same = [m.decode(x) == (t or "") for x, t in zip(ids, texts)]
                values = pa.array(np.concatenate(ids)) if len(ids) else pa.array([], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], lists, pa.array(n), pa.array(same)], names=[*names, "piece_ids", "n_pieces", "round_trip"])

    names = [f"_{i}" for i in range(len(others))]
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, others)]).add("piece_ids", T.ArrayType(T.IntegerType())).add("n_pieces", "long").add("round_trip", "boolean")
    return docs.select(text_col, *others).mapInArrow(run, schema).toDF(*others, "piece_ids", "n_pieces", "round_trip")


def decode_pieces(df: DataFrame, path: str | None = None, ids_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """df with the text that its ids stand for, in place of a column of that name; null ids give null."""
    path = path or vocabulary_path()
    df = df.drop(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType())])
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
