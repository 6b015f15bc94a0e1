"""SentencePiece encoding and decoding in numpy batches: Viterbi or merges, as the model's type asks.

Pieces, scores and normalisation come from a SentencePiece model file. A normalised
text falls apart before every run of the space mark (no piece has a mark after another
character) and around line feeds, and each distinct word is segmented once per worker. Words of equal length
advance together: at each position the hashes of all substrings that end there probe
the sorted piece keys, and the maximum over them is stored as a back pointer. A
character without a piece costs the least score less 10 and becomes its UTF-8 bytes.
Of equally good segmentations, the one whose last piece is longest stays.

``how="merges"`` joins, also in lockstep, the neighbours whose union has the highest
score until none is a piece: what a file of type BPE prescribes, whose scores are ranks
of merges and don't add up. Encoding takes the way of the model's type unless told.

Nulls: null and empty texts have no ids and decode to the empty text. A space mark in
a text decodes to a space, as SentencePiece has it. Repeated rows give equal rows; no
rows, no rows out. Very long texts are encoded whole, a few at a time; a word without
spaces of more than LONG characters merges in time that its length times its logarithm
bounds. encode() keeps all columns and never overwrites one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import slices, vocabulary_path

MARK = "▁"
PENALTY = 10.0
#: Words that a worker keeps.
CACHE_WORDS = 600_000
_MAX_KEPT = 48
#: Longer words are merged one at a time.
LONG = 512
#: Ways by the type in a model file.
WAYS = {1: "viterbi", 2: "merges"}
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_FILTER_BITS = 20


def model_path() -> str:
    return vocabulary_path("piece_bpe_32k.model")


def way_of(path: str) -> str:
    """Way that a model file's type prescribes: Viterbi for unigram, merges for BPE."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.trainer_spec.model_type not in WAYS:
        raise ValueError("neither a unigram nor a BPE model")
    return WAYS[model.trainer_spec.model_type]


class Pieces:
    """A model file as sorted keys, scores and bytes of its pieces."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        self.way = way_of(path)
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        ids, texts = [], []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.encode())
                ids.append(i)
                texts.append(piece)
        if any(MARK in t.lstrip(MARK) for t in texts):
            raise ValueError("a piece has a space mark inside")
        self.unknown = sp.unk_id()
        self.id_of = dict(zip(texts, ids))
        #: A line feed that no piece holds is a word of its own.
        alone = "" if any("\n" in t for t in texts) else "\n"
        self.word = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|\n")
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.longest = max(map(len, texts))
        keys = np.array([self._hash(np.array([[*map(ord, t)]], dtype=np.uint32))[0, -1] for t in texts], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, dtype=np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.scores = np.array([sp.get_score(int(i)) for i in self.ids], dtype=np.float64)
        self.score_of = {t: float(sp.get_score(i)) for t, i in self.id_of.items()}
        self.unknown_score = self.scores.min() - PENALTY
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        self._cache: dict[tuple[str, str], bytes] = {}
        self._most = cache_words
        self.code_of: dict[str, bytes] = {}

    @staticmethod
    def _hash(chars: np.ndarray) -> np.ndarray:
        """Prefix hashes (rows, length + 1) of rows of characters; substrings follow by difference and inverse powers."""
        with np.errstate(over="ignore"):
            x = (chars.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(chars.shape[1] - 1, _P, np.uint64)]))
            out = np.zeros((len(chars), chars.shape[1] + 1), dtype=np.uint64)
            np.cumsum(x * power, axis=1, out=out[:, 1:])
        return out

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the sorted piece keys, -1 where it is no piece."""
        out = np.full(keys.shape, -1, dtype=np.int64)
        maybe = self.filter[keys >> np.uint64(64 - _FILTER_BITS)]
        some = keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == some, at, -1)
        return out

    def viterbi(self, chars: np.ndarray) -> np.ndarray:
        """Length of the last piece of the best segmentation up to each position; rows are words of one length."""
        n, length = chars.shape
        prefix = self._hash(chars)
        with np.errstate(over="ignore"):
            inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, _PINV, np.uint64)]))
            best = np.zeros((n, length + 1))
            back = np.zeros((n, length + 1), dtype=np.int32)
            rows = np.arange(n)
            for j in range(1, length + 1):
                i = np.arange(max(0, j - self.longest), j)
                at = self.probe((prefix[:, j, None] - prefix[:, i]) * inverse[i])
                gain = np.where(at >= 0, self.scores[at], -np.inf)
                gain[:, -1] = np.where(at[:, -1] >= 0, gain[:, -1], self.unknown_score)
                total = best[:, i] + gain
                pick = np.argmax(total, axis=1)
                best[:, j] = total[rows, pick]
                back[:, j] = j - i[pick]
        return back

    def _spans(self, chars: np.ndarray) -> list[list[int]]:
        """Piece lengths of each word from its back pointers."""
        out = []
        for back in self.viterbi(chars).tolist():
            at, own = len(back) - 1, []
            while at:
                own.append(back[at])
                at -= back[at]
            out.append(own[::-1])
        return out

    def _summed(self, chars: np.ndarray, words: list[str]) -> list[bytes]:
        """The ids of the words' best segmentations, all back pointers followed together; a word with a character that has no piece goes alone."""
        (n, length), back, prefix = chars.shape, self.viterbi(chars), self._hash(chars)
        ids, to, live, column = np.full((n, length), -1, dtype=np.int64), np.full(n, length), np.arange(n), length
        with np.errstate(over="ignore"):
            inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, _PINV, np.uint64)]))
            while len(live):
                column, end = column - 1, to[live]
                start = end - back[live, end]
                at = self.probe((prefix[live, end] - prefix[live, start]) * inverse[start])
                ids[live, column] = np.where(at >= 0, self.ids[at], -2)
                to[live] = start
                live = live[start > 0]
        raw = ids[ids != -1].astype(self.kind).tobytes()
        edge = np.concatenate([[0], np.cumsum((ids != -1).sum(axis=1))]) * np.dtype(self.kind).itemsize
        out = [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        for r in np.flatnonzero((ids == -2).any(axis=1)).tolist():
            out[r] = self._joined(words[r], self._spans(chars[r : r + 1])[0])
        return out

    def _joined(self, word: str, spans: list[int]) -> bytes:
        start, coded = 0, []
        for s in spans:
            piece = word[start : start + s]
            coded.append(self.code_of.get(piece) or self._code(piece))
            start += s
        return b"".join(coded)

    def _merged(self, chars: np.ndarray) -> list[list[int]]:
        """Piece lengths of each word after joining the best neighbours again and again, of equals the leftmost."""
        n, length = chars.shape
        if length > LONG:
            return [self._merged_alone(row) for row in chars.tolist()]
        prefix = self._hash(chars)
        out: list[list[int]] = [[]] * n
        with np.errstate(over="ignore"):
            inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, _PINV, np.uint64)]))

            def gain_of(rows, begin, to):
                at = self.probe((prefix[rows, to] - prefix[rows, begin]) * inverse[begin])
                return np.where((at >= 0) & (to - begin <= self.longest), self.scores[at], -np.inf)

            # Every open row has joined once a round, so all have as many cuts.
            rows, cuts = np.arange(n), np.tile(np.arange(length + 1), (n, 1))
            gain = gain_of(rows[:, None], cuts[:, :-2], cuts[:, 2:])
            while True:
                pick = np.argmax(gain, axis=1) if gain.shape[1] else np.zeros(len(rows), dtype=np.int64)
                live = np.isfinite(gain[np.arange(len(rows)), pick]) if gain.shape[1] else np.zeros(len(rows), dtype=bool)
                for r, spans in zip(rows[~live].tolist(), np.diff(cuts[~live], axis=1).tolist()):
                    out[r] = spans
                rows, pick = rows[live], pick[live]
                if not len(rows):
                    return out
                places = np.arange(cuts.shape[1] - 1)
                cuts = np.where(places > pick[:, None], cuts[live, 1:], cuts[live, :-1])
                gain = np.where(places[:-2] >= pick[:, None], gain[live, 1:], gain[live, :-1])
                for at, some in ((pick - 1, pick > 0), (pick, pick < gain.shape[1])):
                    r, k = np.flatnonzero(some), at[some]
                    gain[r, k] = gain_of(rows[r], cuts[r, k], cuts[r, k + 2])

    def _merged_alone(self, row: list[int]) -> list[int]:
        """The same for one long word, with a heap of neighbours."""
        word, n = "".join(map(chr, row)), len(row)
        end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(left):
            right = end[left]
            if right < n and end[right] - left <= self.longest and (score := self.score_of.get(word[left : end[right]])) is not None:
                heapq.heappush(heap, (-score, left, right, end[right]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, right, to = heapq.heappop(heap)
            if end[left] != right or end[right] != to:
                continue
            end[left], end[right] = to, 0
            if to < n:
                before[to] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        out, at = [], 0
        while at < n:
            out.append(end[at] - at)
            at = end[at]
        return out

    def segment(self, words: list[str], how: str = "viterbi", rows: int = 4096) -> dict[str, bytes]:
        """Ids of words, each a run of space marks and what follows up to the next mark."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        out = {}
        for length, same in by.items():
            most = max(1, min(rows, (1 << 20) // length))
            for at in range(0, len(same), most):
                part = same[at : at + most]
                chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(part), length)
                out.update(zip(part, self._summed(chars, part) if how == "viterbi" else map(self._joined, part, self._merged(chars))))
        return out

    def _ids(self, piece: str) -> list[int]:
        i = self.id_of.get(piece)
        if i is not None:
            return [i]
        fallback = self.byte_ids[list(piece.encode("utf-8", "surrogatepass"))]
        return [self.unknown] if (fallback < 0).any() else fallback.tolist()

    def _code(self, piece: str) -> bytes:
        """The bytes of a piece's ids; those of pieces of the model are kept."""
        raw = np.array(self._ids(piece), dtype=self.kind).tobytes()
        if piece in self.id_of:
            self.code_of[piece] = raw
        return raw

    def words(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, normalised, that are segmented one by one."""
        return [self.word.findall(self.sp.normalize(t)) if t else [] for t in texts]

    def encode(self, texts: list[str], how: str | None = None) -> list[bytes]:
        return self.encode_words(self.words(texts), how)

    def encode_words(self, split: list[list[str]], how: str | None = None) -> list[bytes]:
        new, known = set(), self._cache
        for words in split:
            new.update(set(words).difference(known))
        fresh = self.segment(list(new), how or self.way)
        before = len(known)
        known.update(fresh)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        room = self._most - before
        for w in fresh:
            if room > 0 and len(w) <= _MAX_KEPT:
                room -= 1
            else:
                del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype=self.kind).tolist()))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[tuple[str, str | None], Pieces] = {}


def pieces(path: str, how: str | None = None) -> Pieces:
    """One table per model file, way and Python worker."""
    if (path, how) not in _LOADED:
        _LOADED[path, how] = Pieces(path)
    return _LOADED[path, how]


def encode(docs: DataFrame, path: str | None = None, how: str | None = None) -> DataFrame:
    """``docs`` with a column ids (little-endian, 16 bits where the model has at most 65,536 pieces).

    Where ``docs`` has a column of that name, it stays and the new one is ids_2, or the first free of ids_3, ..."""
    path = path or model_path()

    @F.pandas_udf("binary")
    def of(texts):
        import pandas as pd

        table = pieces(path, how)
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size > 4_000_000:
                out += table.encode(held, how)
                held, size = [], 0
        return pd.Series(out + table.encode(held, how), dtype=object)

    return docs.withColumn(common.free_name(docs, "ids"), of(common.text_or_empty()))


def check(docs: DataFrame, path: str | None = None, how: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_byte_ids, decoded_chars, decoded_sha256, lossless of every text, encoded and decoded again; viterbi_n_ids and viterbi_crc32 are those of the best sum of scores, whatever the model's type."""
    path = path or model_path()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        table, best = pieces(path, how), pieces(path, "viterbi")
        is_byte = np.zeros(len(table.bytes_of), dtype=bool)
        is_byte[table.byte_ids[table.byte_ids >= 0]] = True
        for whole in batches:
            for b in slices(whole, 4_000_000):
                texts, rows = b.column("text").to_pylist(), []
                split = table.words(texts)
                coded = table.encode_words(split, how)
                summed = coded if (how or table.way) == "viterbi" else best.encode_words(split, "viterbi")
                for t, raw, other in zip(texts, coded, summed):
                    ids, back = np.frombuffer(raw, dtype=table.kind), table.decode(raw)
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), int(is_byte[ids].sum()), len(back), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t.replace(MARK, " "), len(other) // np.dtype(table.kind).itemsize, zlib.crc32(np.frombuffer(other, dtype=table.kind).astype("<u4").tobytes())))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_ids", "ids_crc32", "n_byte_ids", "decoded_chars", "decoded_sha256", "lossless", "viterbi_n_ids", "viterbi_crc32"])

    rows = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, decoded_chars long, decoded_sha256 string, lossless boolean, viterbi_n_ids long, viterbi_crc32 long")


def op8_viterbi_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, by document. The model file is of type BPE, so the ids come from merges; what Viterbi gives over its scores stands beside them."""
    return check(common.table(spark, sf_dir, "documents"))
