"""Benchmark passages in documents, found by spaced seeds and verified along the alignment.

Tokens are runs of letters, marks and digits by Unicode class, with their case folded; of scripts
without spaces each character is one. A seed is a mask over consecutive tokens:
the hash of those it selects, the others ignored. Seeds of the benchmark and of the documents
are joined; around each hit the benchmark text is laid beside the document as the hit says
(substitutions, no gaps) and token pairs are compared. Every window of ``WINDOW`` pairs (the
whole item if shorter) with at least ``SHARE`` equal is an overlap. ``MASKS`` are such that a
window with as many substitutions as that allows always leaves a seed.

Items are taken in blocks of at most ``BLOCK_TOKENS`` tokens (one item at least); each block
goes to all executors and the documents are read once for it, so neither memory nor a
broadcast grows with the benchmark. An item shorter than a window has seeds of as many
consecutive tokens as its allowed substitutions must leave somewhere.

Items of fewer than ``least`` tokens are left out; a common word would mark every document.

Null texts are empty and match nothing; an empty benchmark matches nothing and keeps every
document. Documents are told apart by their place, so null or repeated doc_ids each give their own
rows; repeated item_ids give one row, the best, and of ties in tokens covered the one with more equal
ones. Ids are of any type. Long texts are searched whole, in chunks; where a text and an item
repeat one token, time grows with the length of the text times that of the item and memory stays
bounded. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrowtext import BASE, binary, mixed, powers, ragged
from .tables import keyed, ready
from .tokens import alphabet, batches_of_hashes, folded

WINDOW, SHARE, BLOCK_TOKENS = 13, 0.8, 400_000
MASKS = ("1101111", "111100001001")
CHUNK = 1 << 19
# Token pairs that are held at a time.
PAIRS = 1 << 21
# Shorter items are not searched for by the query and the pipeline: any text may hold them.
LEAST = 5


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The seed at every place where the mask fits."""
    places = [i for i, c in enumerate(mask) if c == "1"]
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for power, i in zip(powers(BASE, len(places) + 1)[1:], places):
        out += tokens[i : i + n] * power
    return mixed(out + np.uint64(int(mask, 2)))


def bounded(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive parts whose sizes add up to ``most`` at most, or of one."""
    total = np.append(0, np.cumsum(sizes))
    low = 0
    while low < len(sizes):
        high = max(int(np.searchsorted(total, total[low] + most, "right")) - 1, low + 1)
        yield slice(low, high)
        low = high


class Items:
    """A block of benchmark items and its seeds, sorted, with an exact-size filter before."""

    def __init__(self, ids: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        self.ids, self.tokens, self.counts = ids, tokens, counts
        self.starts = np.cumsum(counts) - counts
        wanted = [(mask, counts >= WINDOW) for mask in MASKS]
        for n in np.unique(counts[(counts > 0) & (counts < WINDOW)]).tolist():
            substitutions = n - math.ceil(n * SHARE - 1e-9)
            run = -(-(n - substitutions) // (substitutions + 1))
            wanted.append(("1" * run, counts == n))
        self.seeds = []
        for mask, own in wanted:
            size = np.where(own, counts - len(mask) + 1, 0)
            at = ragged(self.starts, size)
            seeds = seed_hashes(tokens, mask)[at] if len(at) else np.empty(0, np.uint64)
            order = np.argsort(seeds, kind="stable")
            item = np.repeat(np.arange(len(counts)), size)[order]
            maybe = np.zeros(1 << 22, bool)
            maybe[seeds >> np.uint64(42)] = True
            self.seeds.append((mask, seeds[order], item, (at - np.repeat(self.starts, size))[order], maybe))

    def hits(self, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, item, place of the item's first token) that seeds suggest.

        Of a text and an item that repeat a token, all pairs of places suggest few alignments:
        they are made a bounded number at a time and kept as one number per alignment.
        """
        before = int(self.counts.max(initial=0))
        width = len(tokens) + before + 1
        found = []
        for low in range(0, len(tokens), CHUNK):
            for mask, seeds, item, offset, maybe in self.seeds:
                here = seed_hashes(tokens[low : low + CHUNK + len(mask) - 1], mask)
                at = np.flatnonzero(maybe[here >> np.uint64(42)])
                here, at = here[at], at + low
                text = np.minimum(np.searchsorted(ends, at, "right"), len(ends) - 1)
                inside = at + len(mask) <= ends[text]
                here, at, text = here[inside], at[inside], text[inside]
                first = np.searchsorted(seeds, here)
                n = np.searchsorted(seeds, here, "right") - first
                for part in bounded(n, PAIRS):
                    k = ragged(first[part], n[part])
                    line = np.repeat(text[part], n[part]) * len(self.counts) + item[k]
                    place = np.repeat(at[part], n[part]) - offset[k] + before
                    found.append(np.unique(line * width + place))
        every = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        line, place = np.divmod(every, width)
        text, item = np.divmod(line, max(len(self.counts), 1))
        return text, item, place - before

    def overlaps(self, tokens: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, tokens covered by overlaps, equal ones among them), best per pair."""
        ends = np.cumsum(counts)
        starts = ends - counts
        text, item, place = self.hits(tokens, ends)
        # A bounded number of token pairs at a time, one alignment at least.
        for part in bounded(self.counts[item], PAIRS):
            yield self._verified(tokens, starts, ends, text[part], item[part], place[part])

    def _verified(self, tokens, starts, ends, text, item, place):
        size = self.counts[item]
        own = ragged(self.starts[item], size)
        other = ragged(place, size)
        line = np.repeat(np.arange(len(text)), size)
        inside = (other >= starts[text][line]) & (other < ends[text][line])
        equal = np.zeros(len(own), bool)
        equal[inside] = tokens[other[inside]] == self.tokens[own[inside]]
        # Windows of one line never reach into the next.
        window = np.minimum(size, WINDOW)
        need = np.ceil(window * SHARE - 1e-9).astype(np.int64)
        sums = np.append(0, np.cumsum(equal))
        first = ragged(np.cumsum(size) - size, size - window + 1)
        of = np.repeat(np.arange(len(text)), size - window + 1)
        good = sums[first + window[of]] - sums[first] >= need[of]
        change = np.zeros(len(own) + 1, np.int64)
        np.add.at(change, first[good], 1)
        np.add.at(change, first[good] + window[of[good]], -1)
        covered = (np.cumsum(change[:-1]) > 0) & inside
        n = np.bincount(line, covered, len(text)).astype(np.int64)
        same = np.bincount(line, covered & equal, len(text)).astype(np.int64)
        keep = n > 0
        return text[keep], item[keep], n[keep], same[keep]


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_TOKENS, least: int = 1) -> Iterator[Items]:
    """The benchmark's items, so many tokens at a time; the driver holds one block."""
    ready(benchmark.sparkSession)
    letters = alphabet(digits=True)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hashes, counts in batches_of_hashes(batches, letters):
            ends = np.append(0, np.cumsum(counts)) * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), binary(hashes.view(np.uint8), ends)], ["item_id", "tokens"]
            )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.select("item_id", folded("text")).mapInArrow(hashed, f"item_id {kind}, tokens binary")
    ids, tokens, total = [], [], 0

    def block() -> Items:
        return Items(np.array(ids, object), np.concatenate(tokens), np.array([len(t) for t in tokens]))

    for r in rows.toLocalIterator():
        found = np.frombuffer(r.tokens, np.uint64)
        if len(found) < max(least, 1):
            continue
        if ids and total + len(found) > limit:
            yield block()
            ids, tokens, total = [], [], 0
        ids.append(r.item_id)
        tokens.append(found)
        total += len(found)
    if ids:
        yield block()


def overlaps(
    docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_TOKENS, least: int = 1
) -> DataFrame:
    """row, doc_id, item_id, n_overlap (tokens covered), n_equal, item_tokens."""
    spark = docs.sparkSession
    ready(spark)
    letters = alphabet(digits=True)
    rows = keyed(docs, "doc_id", folded("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType
    item_arrow = to_arrow_type(item_kind)
    schema = (
        f"row long, doc_id {kind}, item_id {item_kind.simpleString()}, "
        "n_overlap long, n_equal long, item_tokens long"
    )
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, limit, least):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch, hashes, counts in batches_of_hashes(batches, letters):
                for text, item, n, same in items.overlaps(hashes, counts):
                    ids = [items.ids[i] for i in item]
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("row").take(at), batch.column("doc_id").take(at),
                            pa.array(ids, item_arrow), pa.array(n), pa.array(same),
                            pa.array(items.counts[item]),
                        ],
                        ["row", "doc_id", "item_id", "n_overlap", "n_equal", "item_tokens"],
                    )

        out = out.unionByName(rows.mapInArrow(search, schema))
    best = F.max(F.struct("n_overlap", "n_equal", "item_tokens")).alias("best")
    return out.groupBy("row", "doc_id", "item_id").agg(best).select("row", "doc_id", "item_id", "best.*")


def clean(
    docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_TOKENS, least: int = 1
) -> DataFrame:
    """The documents, with all their columns, that overlap with no item."""
    spark = docs.sparkSession
    ready(spark)
    letters = alphabet(digits=True)
    name = "folded_text"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, folded("text"))
    schema = out.schema
    for block in item_blocks(benchmark, limit, least):
        shared = spark.sparkContext.broadcast(block)

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, hashes, counts in batches_of_hashes(batches, letters, name):
                good = np.ones(len(counts), bool)
                for text, *_ in shared.value.overlaps(hashes, counts):
                    good[text] = False
                yield batch.filter(pa.array(good))

        out = out.mapInArrow(kept, schema)
    return out.drop(name)
