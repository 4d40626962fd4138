"""Byte-level BPE over whole texts, each pre-token given to the tokenizers library once.

Pre-tokens are found for a whole block of texts at a time: runs of letters, digits, other
characters and white space, a single space going with what follows it, and the English
contractions. The ids of a pre-token do not depend on its neighbours, so a worker keeps them
by hash. Texts with characters whose class differs between Unicode versions, and texts with
the name of a special token, go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from .arrowtext import Block, prefix_sums, ragged, range_hashes

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 0
# Code points whose class every Unicode version of use agrees on.
SETTLED = [
    (0x09, 0x0D), (0x20, 0x7E), (0xA1, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3CE),
    (0x410, 0x44F), (0x5D0, 0x5EA), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20AC),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
SLOT_BITS, POOL = 22, 1 << 25


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.zeros(0x110000, np.uint8)
    settled = np.zeros(0x110000, bool)
    for low, high in SETTLED:
        settled[low : high + 1] = True
        for c in range(low, high + 1):
            category = unicodedata.category(chr(c))[0]
            kind[c] = {"L": LETTER, "N": DIGIT}.get(category, OTHER)
    kind[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = SPACE
    return kind, settled


class PreTokens:
    """Where the pre-tokens of a block start, in code points; the last entry is the end."""

    kinds: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, block: Block) -> None:
        if PreTokens.kinds is None:
            PreTokens.kinds = _classes()
        kind, settled = PreTokens.kinds
        self.text = block.data.tobytes().decode("utf-8")
        self.points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        if len(self.points) == len(block.data):
            self.parts = block.offsets
        else:
            leads = np.zeros(len(block.data) + 1, np.int64)
            np.cumsum((block.data & 0xC0) != 0x80, out=leads[1:])
            self.parts = leads[block.offsets]
        points, n = self.points, len(self.points)
        self.unsettled = np.flatnonzero(~settled[points])
        if not n:
            self.starts = np.zeros(1, np.int64)
            return
        cls = kind[points]
        # Text starts cut runs; a place behind the last text is no place.
        fresh = np.zeros(n, bool)
        fresh[self.parts[:-1][self.parts[:-1] < n]] = True
        run = fresh.copy()
        run[1:] |= cls[1:] != cls[:-1]
        blank = cls == SPACE
        start = run.copy()
        # A run behind a space starts with that space, which was given its own start below.
        joined = run[1:] & ~fresh[1:] & ~blank[1:] & (points[:-1] == 32)
        start[1:][joined] = False
        last_blank = blank[:-1] & ~blank[1:] & ~fresh[1:]
        start[:-1] |= last_blank
        self._contractions(start, run, fresh, cls)
        self.starts = np.append(np.flatnonzero(start), n)

    def _contractions(
        self, start: np.ndarray, run: np.ndarray, fresh: np.ndarray, cls: np.ndarray
    ) -> None:
        points, n = self.points, len(self.points)
        ends = np.append(self.parts[1:], n)
        for i in np.flatnonzero((points[:-1] == 39) & start[:-1] & run[:-1] & run[1:] & ~fresh[1:]):
            if cls[i + 1] != LETTER:
                continue
            end = ends[np.searchsorted(self.parts, i, "right") - 1]
            ahead = self.text[i : min(i + 3, end)]
            size = next((len(c) for c in CONTRACTIONS if ahead.startswith(c)), 0)
            if size:
                start[i + 1] = False
                if i + size < n:
                    start[i + size] = True

    def words(self, which: np.ndarray) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(self.starts[which], self.starts[which + 1])]


class WordIds:
    """Ids of words, found once and kept by hash while memory allows."""

    vocabulary: int
    slot_bits, most_kept = SLOT_BITS, POOL

    def __init__(self) -> None:
        self.clear()

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        raise NotImplementedError

    def clear(self) -> None:
        size = 1 << self.slot_bits
        self.keys = np.zeros(size, np.uint64)
        self.checks = np.zeros(size, np.uint32)
        self.first = np.zeros(size, np.int32)
        self.length = np.zeros(size, np.int32)
        self.pool = np.zeros(1 << 16, np.uint16 if self.vocabulary <= 1 << 16 else np.uint32)
        self.used = 0

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        return first

    def spans(self, cut) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of the ids of every word of a cut block."""
        if self.used > self.most_kept:
            self.clear()
        starts, ends = cut.starts[:-1], cut.starts[1:]
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = range_hashes(prefix_sums(cut.points), starts, ends)
        check = (
            cut.points[starts] * np.uint32(0x85EBCA6B)
            + cut.points[ends - 1] * np.uint32(0xC2B2AE35)
            + (ends - starts).astype(np.uint32)
        )
        slot = h >> np.uint64(64 - self.slot_bits)
        first, length = self.first[slot].astype(np.int64), self.length[slot].astype(np.int64)
        missing = np.flatnonzero((self.keys[slot] != h) | (self.checks[slot] != check))
        if len(missing):
            _, index, back = np.unique(h[missing], return_index=True, return_inverse=True)
            new = missing[index]
            ids, size = self.find(cut.words(new))
            at = self._keep(ids, size)
            first[missing], length[missing] = at[back], size[back]
            s = slot[new]
            self.keys[s], self.checks[s] = h[new], check[new]
            self.first[s], self.length[s] = at, size
        return first, length


class Encoder(WordIds):
    """Token ids of texts, by a vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        super().__init__()

    def library(self, texts: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [x.ids for x in found]

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.library(words)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.array([i for x in ids for i in x], self.pool.dtype), lengths

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's parts, and how many each part has."""
        cut = PreTokens(block)
        first, length = self.spans(cut)
        part = np.searchsorted(cut.parts, cut.starts[:-1], "right") - 1
        counts = np.bincount(part, length, minlength=len(block.rows)).astype(np.int64)
        ids = self.pool[ragged(first, length)]
        whole = set(np.searchsorted(cut.parts, cut.unsettled, "right") - 1)
        for name in self.special:
            at = cut.text.find(name)
            while at >= 0:
                whole.add(int(np.searchsorted(cut.parts, at, "right")) - 1)
                at = cut.text.find(name, at + 1)
        if not whole:
            return ids, counts
        bounds = np.append(0, np.cumsum(counts))
        pieces = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in sorted(whole):
            text = cut.text[cut.parts[i] : cut.parts[i + 1]]
            pieces[i] = np.array(self.library([text])[0], ids.dtype)
            counts[i] = len(pieces[i])
        return np.concatenate(pieces), counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, with what it has kept."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
