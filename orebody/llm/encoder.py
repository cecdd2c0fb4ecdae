"""Exact token ids of whole texts with the tokenizers library, with remembered pieces.

The library cuts a text into pre-tokens before it merges. Three places always lie between two pre-tokens of the
byte-level pattern: before a single space that has no white space beside it, around a single line end that has none
beside it, and between a letter and an ASCII sign other than an apostrophe. Texts are cut there, all at once, and each
different piece is given to the library once; any other text inside a piece is the library's own affair. Pieces are
found by a hash and then compared byte by byte: one that meets another's hash is encoded anew.
"""

from __future__ import annotations

import os

import numpy as np

from orebody.llm.common import lane_hash, lanes

#: Pieces a worker remembers before it begins anew, ids of these pieces, and words of 8 bytes that they fill.
PIECES, IDS, WORDS = 3 << 18, 1 << 23, 1 << 22

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True
_SIGN[39] = False


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        kind = type(self.library.pre_tokenizer).__name__
        self.by_piece = kind == "ByteLevel" and self.library.normalizer is None and not self.library.pre_tokenizer.add_prefix_space
        self.special = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        self._reset(1 << 17)

    def _reset(self, slots: int) -> None:
        self.keys, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        #: By entry: the piece's first id and number of ids, its first word and number of bytes.
        self.at, self.size, self.word, self.bytes = (np.zeros(slots, np.int32) for _ in range(4))
        self.pool, self.used = np.zeros(slots, np.uint32), 0
        self.words, self.filled = np.zeros(slots, np.uint64), 0
        self.count = 0

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The first byte of each piece."""
        n = len(data)
        begin = np.zeros(n + 2, bool)  # begin[i + 1]: a piece begins at byte i
        if self.by_piece and n:
            padded = np.full(n + 4, 32, np.uint8)  # what stands outside counts as white space
            padded[2:-2] = data
            white = _WHITE[padded]
            lead = padded[:-1]
            after = padded[1:]
            # Leads of non-ASCII white space; taken widely, which only leaves pieces longer.
            odd = np.zeros(n + 4, bool)
            if data.max() >= 0x80:
                pair = (lead == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (lead == 0xE1) & ((after == 0x9A) | (after == 0xA0)) | (lead == 0xE2) & ((after == 0x80) | (after == 0x81)) | (lead == 0xE3) & (after == 0x80)
                for at in np.flatnonzero(pair):
                    odd[at : at + 3] = True
                white |= odd
            edge = np.zeros(n + 1, bool)
            edge[offsets] = True
            here, before, behind = white[2:-2], white[1:-3].copy(), white[3:-1].copy()
            before[edge[:-1]] = True
            behind[edge[1:]] = True
            alone = here & ~before & ~behind
            begin[1:-1] |= alone & (data == 32)
            line = alone & (data == 10)
            begin[1:-1] |= line
            begin[2:] |= line
            letter = _LETTER[padded]
            if data.max() >= 0x80:  # the accented letters of Latin-1
                letter[1:] |= (lead == 0xC3) & (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
            begin[1:-1] |= letter[1:-3] & _SIGN[data] & ~edge[:-1]
            blob = data.tobytes()
            for token in self.special:
                at = blob.find(token)
                while at >= 0:
                    begin[at + 2 : at + 1 + len(token)] = False
                    at = blob.find(token, at + 1)
        begin = begin[1:-1]
        full = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[full] = True
        return np.flatnonzero(begin)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        """Each key's slot, or the free one that it would get."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (key & mask).astype(np.int64)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != key) & (found != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            found = self.keys[slot[open_]]
            open_ = open_[(found != key[open_]) & (found != 0)]
        return slot

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all texts, one after another, and their numbers."""
        encoded = [x.ids for a in range(0, len(texts), 4096) for x in self.library.encode_batch_fast(texts[a : a + 4096], add_special_tokens=False)]
        size = np.array([len(x) for x in encoded], np.int32)
        return np.fromiter((i for x in encoded for i in x), np.uint32, int(size.sum())), size

    def _learn(self, key: np.ndarray, texts: list[str], words: list[np.ndarray], bytes_: np.ndarray) -> None:
        """Ask the library for pieces with different, unknown keys."""
        flat, size = self._ask(texts)
        filled = np.array([len(x) for x in words], np.int32)
        self.pool, at = _extended(self.pool, self.used, flat), self.used + np.cumsum(size) - size
        self.words, word = _extended(self.words, self.filled, np.concatenate(words)), self.filled + np.cumsum(filled) - filled
        self.used, self.filled = self.used + len(flat), self.filled + int(filled.sum())
        entry = self.count + np.arange(len(key))
        for name, value in (("at", at), ("size", size), ("word", word), ("bytes", bytes_)):
            setattr(self, name, _extended(getattr(self, name), self.count, value.astype(np.int32)))
        self.count += len(key)
        if 2 * self.count > len(self.keys):
            old = np.flatnonzero(self.keys)
            kept = self.keys[old], self.entry[old]
            slots = 1 << (4 * self.count).bit_length()
            self.keys, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
            self._put(*kept)
        self._put(key, entry)

    def _put(self, key: np.ndarray, entry: np.ndarray) -> None:
        while len(key):
            slot = self._slot(key)
            _, first = np.unique(slot, return_index=True)  # of those that want one slot, one gets it
            self.keys[slot[first]], self.entry[slot[first]] = key[first], entry[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, entry = key[rest], entry[rest]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a text buffer, one after another, and the rows' offsets among them."""
        start = self._cuts(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        word, span, first = lanes(data, start, end)
        key = lane_hash(word, span, first, end - start) | np.uint64(1)
        slot = self._slot(key)
        missing = np.flatnonzero(self.keys[slot] != key)
        text = lambda some: [data[a:b].tobytes().decode("utf-8") for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
        if len(missing):
            new, at = np.unique(key[missing], return_index=True)
            where = missing[at]
            if self.count + len(new) > PIECES or self.used > IDS or self.filled > WORDS:
                self._reset(1 << 17)
                new, where = np.unique(key, return_index=True)
            ends = np.append(first[1:], len(word))
            self._learn(new, text(where), [word[a:b] for a, b in zip(first[where].tolist(), ends[where].tolist(), strict=True)], (end - start)[where])
            slot = self._slot(key)
        entry = self.entry[slot]
        other = self.bytes[entry] != end - start
        place = np.where(other[span], 0, self.word[entry][span] + np.arange(len(span)) - first[span])
        other[span[self.words[place] != word]] = True
        size, at, pool = self.size[entry].astype(np.int64), self.at[entry].astype(np.int64), self.pool
        if other.any():
            some = np.flatnonzero(other)
            flat, own = self._ask(text(some))
            size[some], at[some], pool = own, self.used + np.cumsum(own) - own, np.append(pool[: self.used], flat)
        ends = np.cumsum(size)
        ids = pool[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]))]
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(start, offsets)]


def _extended(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """held with `more` from place `used` on, grown if need be."""
    if used + len(more) > len(held):
        held = np.append(held[:used], np.zeros(max(used, 2 * len(more)), held.dtype))
    held[used : used + len(more)] = more
    return held


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of the vocabulary at path, loaded once."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
