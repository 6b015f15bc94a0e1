"""Token ids of a public byte-level BPE vocabulary, for the operators on token files.

The tokenizers library does the encoding. The vocabulary's split pattern starts a new
piece at a space or line feed between two other characters, and at a comma or full
stop between letters or digits and white space, so the ids of a text are the ids of
such parts in a row. Each part is encoded once per worker and kept in a bounded table;
the table changes speed, never ids. Texts in which white space or those marks stand
next to others of their kind are cut at single spaces only or encoded whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np

#: Chunks that a worker keeps; about 60 MB.
CACHE_CHUNKS = 600_000
_MAX_KEPT_CHARS = 48
_SPACE = re.compile(r"\s")
#: White space that the cuts don't cover.
_ODD_SPACES = ["  ", "\n\n", "\n ", " \n", *map(chr, [*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
#: A comma or full stop beside anything but letters, digits and what may follow it.
_ODD_MARK = re.compile(r"[^\w][.,]|_[.,]|[.,][^\w\s]|[.,]_")
_MARK_PAIRS = [",,", ",.", "..", ".,"]
_MARK_AFTER_SPACE = [" ,", " .", "\n,", "\n."]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes texts to little-endian uint16 ids; needs a vocabulary of at most 65,536 ids.

    ``plain`` takes the strings of special tokens in a text as ordinary text, else each is its own id, as the library has it."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = plain
        #: Strings that stand for one id each; texts with one of them are encoded whole.
        self._special = [] if plain else [t.content for t in self._tok.get_added_tokens_decoder().values()]
        if self._tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        plan = json.loads(self._tok.to_str())
        #: The same merges for words that are one piece each and already in the vocabulary's byte letters.
        self._words = Tokenizer.from_str(json.dumps(plan | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self._letters = self._byte_letters()
        self._inner = {b: c for b, c in self._letters.items() if b != 32}
        self._line = self._tok.encode("\n", add_special_tokens=False).ids[0]
        self._cache: dict[str, bytes] = {}
        self._most = cache_chunks

    def _byte_letters(self) -> dict[int, str]:
        """The letter that stands for each byte, as the library's byte-level splitter has it."""
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        two = "".join(map(chr, range(128, 2048))) + "".join(chr(c) for c in range(0x10000, 0x110000, 4096)) + "".join(chr(c) for c in range(0x0800, 0xD800, 64))
        found = {}
        for c in [*map(chr, range(128)), *two]:
            found |= dict(zip(c.encode(), level.pre_tokenize_str(c)[0][0]))
        return found

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u2").tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters with a space before each."""
        out: list[bytes] = []
        space, line = self._letters[32], self._letters[10]
        for at in range(0, len(words), 2048):
            run = words[at : at + 2048]
            mapped = (" ".join(run)).encode().decode("latin-1").translate(self._inner).split(" ")
            ids = np.array(self._words.encode_batch_fast([f" {line} ".join([space + w for w in mapped])], add_special_tokens=False)[0].ids, dtype="<u2")
            cut = [-2, *(2 * np.flatnonzero(ids == self._line)).tolist(), 2 * len(ids)]
            raw = ids.tobytes()
            out += [raw[a + 2 : b] for a, b in zip(cut, cut[1:])]
        return out

    def _encode_new(self, parts: list[str]) -> dict[str, bytes]:
        """Ids by part; a part that starts with a letter or digit stands after a space."""
        words = [p for p in parts if p.isalpha()]
        out = dict(zip(words, self._encode_words(words)))
        rest = [p for p in parts if p not in out]
        joined = [p for p in rest if p and not _SPACE.search(p)]
        for at in range(0, len(joined), 2048):
            run = joined[at : at + 2048]
            texts = [p if p[0] in ",." else " " + p for p in run]
            ids = np.array(self._tok.encode_batch_fast(["\n".join(texts) + "\n"], add_special_tokens=False)[0].ids, dtype="<u2")
            ends = np.flatnonzero(ids == self._line)
            if len(ends) != len(run):
                continue
            raw, start = ids.tobytes(), 0
            for p, end in zip(run, (2 * ends).tolist()):
                out[p] = raw[start:end]
                start = end + 2
        rest = [p for p in rest if p not in out]
        return out | dict(zip(rest, self._encode([p if p[:1] in (",", ".", "\n") and p else " " + p for p in rest])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """uint16 ids of each text."""
        known = self._cache
        split: list[tuple[list[str], list[bytes | None]] | None] = []
        new: set[str] = set()
        for t in texts:
            if not t or t[0] in " ,.\n" or t[-1] in " \n" or any(c in t for c in _ODD_SPACES) or any(x in t for x in self._special):
                split.append(None)
                continue
            marked = any(c in t for c in _MARK_AFTER_SPACE)
            bare = t.replace(" ", "").replace("\n", "").replace(",", "").replace(".", "")
            if not marked and (bare.isalnum() and not any(c in t for c in _MARK_PAIRS) or not _ODD_MARK.search(t)):
                t = t.replace(",", " ,").replace(".", " .")
            elif marked:
                split.append(None)
                continue
            parts = t.replace("\n", " \n").split(" ")
            parts[0] = "\n" + parts[0]  # its line feed goes again below
            have = list(map(known.get, parts))
            if None in have:
                new.update([p for p, ids in zip(parts, have) if ids is None])
            split.append((parts, have))
        fresh: dict[str, bytes] = {}
        todo = list(new)
        for at in range(0, len(todo), 32_768):
            fresh |= self._encode_new(todo[at : at + 32_768])
        out = []
        for t, both in zip(texts, split):
            if both is None:
                out.append(self._encode([t])[0] if t else b"")
            elif None in both[1]:
                out.append(b"".join([fresh[p] if ids is None else ids for p, ids in zip(*both)])[2:])
            else:
                out.append(b"".join(both[1])[2:])
        room = self._most - len(known)
        if room > 0:
            known.update(itertools.islice(((c, ids) for c, ids in fresh.items() if len(c) <= _MAX_KEPT_CHARS), room))
        return out


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, plain: bool = False) -> ChunkEncoder:
    """One encoder per vocabulary, way and Python worker."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = ChunkEncoder(path, plain=plain)
    return _ENCODERS[path, plain]


def slices(batch, most_chars: int = 8_000_000):
    """Arrow batches of at most so many characters of text, at least one row each."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    cuts = np.searchsorted(size, np.arange(most_chars, int(size[-1]) + most_chars, most_chars), side="left") + 1
    start = 0
    for end in [*np.unique(np.minimum(cuts, batch.num_rows)), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
            start = int(end)
