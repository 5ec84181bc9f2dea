"""Batch encoding of texts to token ids with a public tokenizer file.

The library's own encoder spends most of its time on text it has seen before, so each worker
keeps what it has encoded.  A text is cut into *units* that the tokenizer can never join:

* white space between words is dropped by the tokenizer and never part of a token;
* inside a word of ASCII characters and Latin-1 letters without an apostrophe, a letter run, a
  single digit and a run of anything else are separate pre-tokens;
* any other word is one unit and left whole to the library.

The ids of a text are the ids of its units in order; ``tests/llm/test_encode.py`` holds this
against the library on whole texts.  A text that holds the string of a special token is given to
the library whole; with ``plain`` such strings are ordinary text, so no text yields a special id.
The cache takes about 28 bytes a unit and is bounded by ``CACHE_UNITS``; it only saves time and is
emptied when full.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from lodestar.llm.wordhash import U64, space_separated, split_words

#: Units a worker remembers.
CACHE_UNITS = 1_200_000
_SLOT_BITS = 19


def byte_classes() -> np.ndarray:
    """0 white space, 1 letters (with all non-ASCII bytes), 2 digits, 3 the rest."""
    c = np.full(256, 3, np.uint8)
    c[[0x20, 9, 10, 11, 12, 13]] = 0
    c[0x41:0x5B] = c[0x61:0x7B] = 1
    c[0x80:] = 1
    c[0x30:0x3A] = 2
    return c


_CLASS = byte_classes()
_SPACE = space_separated()


class Encoder:
    """Encodes slices of texts; one per worker and tokenizer file."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.special = [] if plain else [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.vocab_size = self.library.get_vocab_size()
        self._reset()

    def _reset(self) -> None:
        self.keys = np.empty(0, U64)
        self.entry = np.empty(0, np.int32)
        self.begin = np.empty(0, np.int32)
        self.count = np.empty(0, np.int32)
        self.pool = np.empty(0, np.uint32)
        self.slot_key = np.zeros(1 << _SLOT_BITS, U64)
        self.slot_entry = np.full(1 << _SLOT_BITS, -1, np.int32)

    def _units(self, data: np.ndarray, offsets: np.ndarray):
        """Starts, ends and hashes of units, and the first unit of each text."""
        words = split_words(data, offsets, _SPACE, lower=True)
        if not len(words.starts):
            return words.starts, words.ends, words.hashes, words.first
        odd = (data == 0x27) | (data >= 0xC2) & (data != 0xC3)
        if (data == 0xC3).any():
            after = np.flatnonzero(data[:-1] == 0xC3) + 1
            odd[after] |= (data[after] == 0x97) | (data[after] == 0xB7)
        whole = np.add.reduceat(odd.view(np.uint8), words.starts, dtype=np.int64) > 0
        kind = _CLASS[data]
        inner = np.zeros(len(data), bool)
        inner[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        inner &= kind != 0
        if whole.any():
            span = np.zeros(len(data) + 1, np.int32)
            span[words.starts[whole]] += 1
            np.subtract.at(span, words.ends[whole], 1)
            inner &= np.cumsum(span[:-1]) == 0
        inner[words.starts] = True
        starts = np.flatnonzero(inner)
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:]
        ends[-1] = len(data)
        at = np.searchsorted(starts, words.starts)
        ends[np.append(at[1:], len(starts)) - 1] = words.ends
        marks = split_hashes(data, starts, ends)
        return starts, ends, marks, np.append(at, len(starts))[words.first]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encodes units (distinct hashes, sorted) that the cache lacks."""
        if len(self.keys) + len(hashes) > CACHE_UNITS:
            self._reset()
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
        plain = [t.isascii() and t.isalpha() for t in texts]
        model = self.library.model
        ids: list[list[int]] = [[]] * len(texts)
        rest = [i for i, p in enumerate(plain) if not p]
        for i, p in enumerate(plain):
            if p:
                ids[i] = [t.id for t in model.tokenize(texts[i].lower())]
        if rest:
            done = self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False)
            for i, e in zip(rest, done):
                ids[i] = e.ids
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        begin = (len(self.pool) + np.cumsum(count) - count).astype(np.int32)
        new = np.arange(len(self.begin), len(self.begin) + len(ids), dtype=np.int32)
        self.pool = np.concatenate([self.pool, np.fromiter((x for one in ids for x in one), np.uint32, int(count.sum()))])
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, count])
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.entry = np.insert(self.keys, at, hashes), np.insert(self.entry, at, new)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and the number of ids of each text."""
        ids, per_text = self._encode(data, offsets)
        ids, per_text = self._with_special(data, offsets, ids, per_text)
        if end_id is None:
            return ids, per_text
        out = np.full(len(ids) + len(per_text), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(per_text)), per_text)] = ids
        return out, per_text + 1

    def _with_special(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replaces the ids of texts in which a special token's string occurs."""
        raw, texts = data.tobytes(), set()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, side="right")) - 1
                texts.add(text)
                at = raw.find(s, max(at + 1, int(offsets[text + 1]) - len(s) + 1))
        if not texts:
            return ids, per_text
        parts = np.split(ids, np.cumsum(per_text)[:-1])
        for t in texts:
            parts[t] = np.array(self.library.encode(raw[offsets[t] : offsets[t + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, hashes, first = self._units(data, offsets)
        slot = (hashes >> U64(64 - _SLOT_BITS)).astype(np.int64)
        entry = np.where(self.slot_key[slot] == hashes, self.slot_entry[slot], np.int32(-1))
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            wanted, one, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
            lacks = self.keys[at] != wanted if len(self.keys) else np.ones(len(wanted), bool)
            if lacks.any():
                pick = missing[one[lacks]]
                size = len(self.keys)
                self._learn(data, starts[pick], ends[pick], wanted[lacks])
                if len(self.keys) < size:  # the cache was emptied; entries found before are void
                    return self._encode(data, offsets)
                at = np.searchsorted(self.keys, wanted)
            found = self.entry[at]
            entry[missing] = found[back]
            slot = (wanted >> U64(64 - _SLOT_BITS)).astype(np.int64)
            self.slot_key[slot], self.slot_entry[slot] = wanted, found
        count = self.count[entry].astype(np.int64) if len(entry) else np.empty(0, np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(self.begin[entry] - total[:-1], count) + np.arange(total[-1])] if len(entry) else np.empty(0, np.uint32)
        return ids, np.diff(total[first])


def split_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans with A-Z as a-z; never 0, which marks an empty slot."""
    from lodestar.llm import wordhash as w

    n = len(data)
    up, down = w.powers(w._BYTE_BASE | 1, n)
    prefix = np.empty(n + 1, dtype=U64)
    prefix[0] = 0
    np.cumsum(w._byte_values(True)[data] * up, out=prefix[1:])
    h = w.mix((prefix[ends] - prefix[starts]) * down[starts])
    h[h == 0] = 1
    return h


@lru_cache(maxsize=2)
def encoder(path: str, plain: bool = False) -> Encoder:
    return Encoder(path, plain)
