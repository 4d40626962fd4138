"""Texts of an Arrow batch as flat numpy arrays, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
# Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, BLOCK_BYTES + 16), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit hashes over all their bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Sums of symbol * BASE**place before each place, modulo 2**64."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    values = symbols.astype(np.uint64)
    values += np.uint64(1)
    values *= powers(BASE, len(symbols))
    np.cumsum(values, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of symbol ranges that depend on their content only."""
    h = (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]
    return mixed(h + (ends - starts).astype(np.uint64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)
    o = o[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end) of all words ``[^\\x20\\x09-\\x0D]+`` and the offsets of texts in words."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    # A text ends the word before it.
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    low = np.flatnonzero(inside[:-1] & (edge[:-1] | ~np.append(False, inside[:-2])))
    high = np.flatnonzero(inside[:-1] & (edge[1:] | ~inside[1:])) + 1
    return low, high, np.searchsorted(low, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the offsets of texts in words."""
    low, high, bounds = word_bounds(data, offsets)
    out = np.empty(len(low), np.uint64)
    at = 0
    while at < len(low):
        # About ``limit`` bytes at a time, whole words only.
        last = max(at + 1, int(np.searchsorted(high, low[at] + limit, "right")))
        begin = low[at]
        sums = prefix_sums(data[begin : high[last - 1]])
        out[at:last] = range_hashes(sums, low[at:last] - begin, high[at:last] - begin)
        at = last
    return out, bounds


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from flat bytes and offsets."""
    return pa.BinaryArray.from_buffers(
        pa.binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))],
    )


@dataclass
class Block:
    """Consecutive texts, or parts of a long one: part i is data[offsets[i]:offsets[i+1]]."""

    rows: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def _cuts(data: np.ndarray, start: int, end: int, limit: int) -> list[int]:
    """Where a long text may be cut: before single spaces between lower-case ASCII letters.

    A text without such a place stays whole, and needs memory in proportion.
    """
    cuts, at = [], start
    while end - at > limit:
        found = None
        for low in range(at + limit, at, -limit // 4 or -1):
            high = min(low + limit // 4, end - 1)
            piece = data[max(low, at + 1) - 1 : high + 1]
            letter = (piece >= 97) & (piece <= 122)
            good = np.flatnonzero(letter[:-2] & (piece[1:-1] == 32) & letter[2:])
            if len(good):
                found = max(low, at + 1) + int(good[-1])
                break
        if found is None:
            rest = data[at + limit : end]
            letter = (rest >= 97) & (rest <= 122)
            good = np.flatnonzero(letter[:-2] & (rest[1:-1] == 32) & letter[2:])
            if not len(good):
                break
            found = at + limit + 1 + int(good[0])
        cuts.append(found)
        at = found
    return cuts


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, cut: bool = True) -> Iterator[Block]:
    """The texts of a column in order, about ``limit`` bytes at a time."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    at = 0
    while at < n:
        size = offsets[at + 1] - offsets[at]
        if cut and size > limit:
            start, end = int(offsets[at]), int(offsets[at + 1])
            bounds = [start, *_cuts(data, start, end, limit), end]
            for a, b in zip(bounds, bounds[1:]):
                yield Block(np.array([at]), data[a:b], np.array([0, b - a], np.int64))
            at += 1
            continue
        last = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        last = min(max(last, at + 1), n)
        if cut:
            long = np.flatnonzero(np.diff(offsets[at : last + 1]) > limit)
            last = at + int(long[0]) if len(long) else last
        o = offsets[at : last + 1]
        yield Block(np.arange(at, last), data[o[0] : o[-1]], o - o[0])
        at = last


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i]+1, .. of every range, one range after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
