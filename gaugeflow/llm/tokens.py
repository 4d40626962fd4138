"""Hashes of the tokens of whole texts, a block at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrowtext import blocks, mixed, prefix_sums, ragged, range_hashes


# Scripts that are written without spaces: each of their characters is a token.
SPACELESS = "Han Hiragana Katakana Bopomofo Thai Lao Khmer Myanmar".split()


def folded(text: str) -> Column:
    """A text column whose tokens, by ``alphabet``, are its words in any script, case folded.

    Words are runs of letters, marks and digits by their Unicode class. Upper case comes before
    lower, so that a letter and its capitals of several letters meet.
    """
    # Spark would take lower(upper(x)) for lower(x).
    words = F.lower(F.regexp_replace(F.upper(text), r"[^\p{L}\p{M}\p{N}]+", " "))
    one = "".join(rf"\p{{Is{script}}}" for script in SPACELESS)
    apart = F.regexp_replace(words, f"([{one}])", " $1 ")
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.col(text)).otherwise(apart).alias(text)


def alphabet(digits: bool) -> np.ndarray:
    """What each byte stands for in a token, 0 for bytes between tokens.

    Tokens are runs of letters (and digits); A-Z count as a-z, bytes beyond ASCII as letters,
    so texts that are compared by their words go through ``folded`` first.
    """
    out = np.zeros(256, np.uint8)
    out[128:] = np.arange(128, 256)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    if digits:
        out[48:58] = np.arange(48, 58)
    return out


def _words(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of a block start and end."""
    if not len(symbols):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = symbols > 0
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = inside[starts]
    return starts[keep], ends[keep]


def token_hashes(column: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch in order, and how many each text has."""
    counts = np.zeros(len(column), np.int64)
    found = [np.empty(0, np.uint64)]
    for block in blocks(column):
        symbols = letters[block.data]
        starts, ends = _words(symbols, block.offsets)
        found.append(range_hashes(prefix_sums(symbols), starts, ends))
        part = np.searchsorted(block.offsets, starts, "right") - 1
        np.add.at(counts, block.rows, np.bincount(part, minlength=len(block.rows)))
    return np.concatenate(found), counts


def batches_of_hashes(
    batches: Iterator[pa.RecordBatch], letters: np.ndarray, column: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        yield batch, *token_hashes(batch.column(column), letters)


def word_and_gram_hashes(
    column: pa.Array, letters: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, hash, number of words of each text) of all tokens and of the 4-byte pieces in them.

    One block of texts at a time; long texts come in several.
    """
    for block in blocks(column):
        symbols = letters[block.data]
        starts, ends = _words(symbols, block.offsets)
        part = np.searchsorted(block.offsets, starts, "right") - 1
        words = np.bincount(part, minlength=len(block.rows))
        count = np.maximum(ends - starts - 3, 0)
        at = ragged(starts, count)
        wide = np.append(symbols, np.zeros(3, np.uint8)).astype(np.uint64)
        grams = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24)
        hashes = np.concatenate([range_hashes(prefix_sums(symbols), starts, ends), mixed(grams)[at]])
        text = np.concatenate([part, np.repeat(part, count)])
        yield block.rows[text], hashes, np.bincount(block.rows, words, len(column)).astype(np.int64)
