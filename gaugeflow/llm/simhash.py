"""Near-duplicates by SimHash, with fuzzy keys from the Golay code.

A text's fingerprint has a bit set if more than half of its word shingles' hashes have it.
Fingerprints link at ``DISTANCE`` or fewer differing bits. They are cut into five segments:
three errors leave three segments with one error between them at most. A segment, padded to 23
bits, is decoded to the nearest word of the perfect Golay code, which lies within three bits.
One error moves a segment by one bit; so if a segment of even weight takes its nearest
codeword's index, and one of odd weight the indices of all codewords within four bits (one or
six), the two have an index in common. Keys are the indices of three segments, one of them in
all its forms: two linked fingerprints share a key, whatever bits differ.

Equal fingerprints are one node. Fingerprints that share a key meet in one task, sorted, and
are verified there. A key fixes 36 of their bits but for errors, which bounds how many
distinct ones it can have; of a run of many, links that connect it are given, not all its
pairs: each fingerprint found is taken out of the run, so that a dense run costs little more
than its length.

Words are runs of anything but space and the control characters 9 to 13, with A-Z lower-cased.
A text of fewer words than a shingle is one shingle; a text without words, or a null one, has
the fingerprint zero, which links like any other. Rows are told apart by place; the
component of rows whose doc_ids are all null has the id null. An empty table has no rows and
no groups. A text of any length is read once, its shingles some hundred thousand at a time.
Further columns are not read, or kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ragged
from .components import components
from .tables import keyed, ready, written

WORDS, SEED, DISTANCE = 3, 42, 3
SEGMENTS = (13, 13, 13, 13, 12)
# Generator of the binary Golay code of length 23.
GENERATOR = 0xC75
# Runs up to this length are compared pair by pair, many runs at a time.
SHORT_RUN = 12
SHINGLES_AT_ONCE = 1 << 18


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a text's shingles of so many words."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    width = min(words, len(found))
    first, last = starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for low in range(0, len(first), SHINGLES_AT_ONCE):
        spans = zip(first[low : low + SHINGLES_AT_ONCE], last[low : low + SHINGLES_AT_ONCE])
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    high = np.packbits(2 * ones > len(first), bitorder="little")
    return int(high.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """row, doc_id (of any type), fingerprint (as a signed long)."""
    ready(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(found.view(np.int64))],
                ["row", "doc_id", "fingerprint"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs, "doc_id", "text").mapInArrow(
        hashed, f"row long, doc_id {kind}, fingerprint long"
    )


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By the remainder of a 23-bit word: the error to its nearest codeword, and the errors of
    four bits (five of them if the nearest is three bits away, else zeros)."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = [remainder(1 << bit) for bit in range(23)]
    near, far = np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(1, 5):
        for bits in combinations(range(23), weight):
            left, error = 0, 0
            for bit in bits:
                left ^= single[bit]
                error |= 1 << bit
            if weight < 4:
                near[left] = error
            else:
                far[left, filled[left]] = error
                filled[left] += 1
    return near, far


def remainders(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= (words >> bit & 1) * (GENERATOR << (bit - 11))
    return words


class Keys:
    """Fuzzy keys of fingerprints."""

    def __init__(self) -> None:
        self.near, self.far = golay_tables()

    def indices(self, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest codeword's index, and five further ones or -1, for 23-bit words."""
        left = remainders(segment)
        nearest = (segment ^ self.near[left]) >> 11
        errors = self.far[left]
        odd = (np.bitwise_count(segment) & 1).astype(bool)
        further = np.where(odd[:, None] & (errors > 0), (segment[:, None] ^ errors) >> 11, -1)
        return nearest, further

    def of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``found``, key) of all keys."""
        parts, shift = [], 0
        for size in SEGMENTS:
            word = (found >> np.uint64(shift)).astype(np.int64) & ((1 << size) - 1)
            parts.append(self.indices(word))
            shift += size
        everyone = np.arange(len(found))
        places, keys = [], []
        for number, triple in enumerate(combinations(range(len(SEGMENTS)), 3)):
            plain = [parts[i][0] << (12 * k) for k, i in enumerate(triple)]
            head = number << 36
            places.append(everyone)
            keys.append(head | plain[0] | plain[1] | plain[2])
            for k, i in enumerate(triple):
                place, form = np.nonzero(parts[i][1] >= 0)
                rest = head
                for other in range(3):
                    if other != k:
                        rest = rest | plain[other][place]
                places.append(place)
                keys.append(rest | parts[i][1][place, form] << (12 * k))
        return np.concatenate(places), np.concatenate(keys)


def connecting_links(run: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected within a run of distinct fingerprints."""
    left, right = [], []
    while len(run) > 1:
        todo, run = [run[0]], run[1:]
        while todo and len(run):
            one = todo.pop()
            close = np.bitwise_count(run ^ one) <= distance
            if close.any():
                found = run[close]
                left.append(np.full(len(found), one))
                right.append(found)
                todo += list(found)
                run = run[~close]
    none = np.empty(0, np.uint64)
    return (np.concatenate([none, *left]), np.concatenate([none, *right]))


def links_of_runs(keys: np.ndarray, found: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
    sizes = np.diff(np.append(starts, len(keys)))
    left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    short = (sizes > 1) & (sizes <= SHORT_RUN)
    at = ragged(starts[short], sizes[short])
    own_keys, own = keys[at], found[at]
    for lag in range(1, int(sizes[short].max(initial=1))):
        close = (own_keys[lag:] == own_keys[:-lag]) & (np.bitwise_count(own[lag:] ^ own[:-lag]) <= distance)
        left.append(own[:-lag][close])
        right.append(own[lag:][close])
    for i in np.flatnonzero(sizes > SHORT_RUN):
        a, b = connecting_links(found[starts[i] : starts[i] + sizes[i]], distance)
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (node, root) that connect distinct fingerprints at ``distance`` or fewer bits."""
    ready(nodes.sparkSession)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Keys()
        for batch in batches:
            found = batch.column("fingerprint").to_numpy().view(np.uint64)
            place, key = maker.of(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(found[place].view(np.int64))], ["key", "fingerprint"]
            )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(key, found):
            a, b = links_of_runs(key, found, distance)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["node", "root"]
            )

        open_keys, open_found = [], []
        for batch in batches:
            key = batch.column("key").to_numpy()
            found = batch.column("fingerprint").to_numpy().view(np.uint64)
            # The last key may go on in the next batch.
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield result(
                    np.concatenate([*open_keys, key[:last]]), np.concatenate([*open_found, found[:last]])
                )
                open_keys, open_found = [], []
            elif open_keys and len(key) and open_keys[0][0] != key[0]:
                yield result(np.concatenate(open_keys), np.concatenate(open_found))
                open_keys, open_found = [], []
            open_keys.append(key[last:])
            open_found.append(found[last:])
        if open_keys:
            yield result(np.concatenate(open_keys), np.concatenate(open_found))

    return (
        nodes.select("fingerprint")
        .mapInArrow(exploded, "key long, fingerprint long")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(verified, "node long, root long")
    )


def grouped(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """row, doc_id, fingerprint and component_id, the smallest doc_id that links reach."""
    found = written(fingerprints(docs, words), "fingerprints")
    nodes = written(found.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(links(nodes, distance))
    rooted = nodes.join(
        roots.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fingerprint", "root", "component_id")
    return found.join(named, "fingerprint").select(
        "row", "doc_id", "fingerprint", "root", "component_id"
    )


def digest(docs: DataFrame) -> DataFrame:
    return grouped(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One document of every component of linked fingerprints, with all its columns.

    The one of the smallest doc_id stays (nulls last, of equal ones the first row).
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    name = "kept_row"
    while name in docs.columns:
        name += "_"
    stay = (
        grouped(docs, words, distance)
        .groupBy("root")
        .agg(F.min(order).alias("first"))
        .select(F.col("first.row").alias(name))
    )
    numbered = docs.withColumn(name, F.monotonically_increasing_id())
    return numbered.join(stay, name, "left_semi").drop(name)
