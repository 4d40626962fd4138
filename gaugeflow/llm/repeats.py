"""Long strings that occur more than once, by merging shard Burrows-Wheeler transforms.

A byte is repeated if a string of ``length`` bytes that covers it starts anywhere else, in the
same text or another; matches never cross texts.

Every string has an anchor: of the shorter strings in it, the one with the smallest hash. Equal
strings have equal anchors, at the same place. So the starts of a text fall into stretches of
one anchor each, and a stretch with all the bytes its strings cover is a context. Anchors that
occur once end the search there. Equal contexts become one with a count. Contexts of one
anchor meet in one task; each is a shard.

A context is read as strings of blocks (``BLOCK`` bytes), one string per offset. Every shard
has its suffixes sorted and its transform, the block before each suffix. The transforms are
merged by iterative interleave refinement: the interleave says from which shard the next
suffix comes; one pass deals it out anew by the blocks that the transforms give, after which
it is right for one more block. Places where the passes first separate neighbours are the
longest common prefixes; suffixes that no pass of the first ``length`` bytes has separated are
an interval of equal strings. An interval that stands for two starts or more is repeated.
Suffixes are never sorted across shards.

No task merges more than ``MANY`` contexts of one anchor. Contexts of more crowded anchors, as a
line that a large part of all texts have, are split first: strings with the anchor at about the
same place, within ``WIDTHS[0]`` bytes, agree in all the bytes that such strings have in common,
if they are equal. So a context falls into pieces by the place of the anchor, a piece's anchor
is that common core, and equal pieces become one with a count. Pieces of one core are merged as
contexts are; if a core is still crowded, its pieces are split by ever closer places, in the end
into single strings, of which equal ones are one piece. Every string goes through a merge.

Instead of bytes, a text can be read as its words (``words``); each is a symbol, its 64-bit hash,
lengths count words, and white space between words makes no difference. A passage of ``PASSAGE``
words is mostly shorter than ``LENGTH`` bytes, so ``digest`` looks for both.

Blocks and contexts are told apart by 64-bit hashes, contexts within their anchor. Null and
short texts have no strings. Rows are told apart by place, so null and repeated doc_ids and
repeated rows are texts of their own; further columns are not read, or kept by ``cut``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import flat, mixed, prefix_sums, ragged, range_hashes, word_bounds, word_hashes
from .tables import keyed, ready, written

LENGTH, ANCHOR, BLOCK = 400, 100, 100
# Passages of over fifty words.
PASSAGE, PASSAGE_ANCHOR, PASSAGE_BLOCK = 51, 17, 17
BLOCK_BYTES = 1 << 20
# Contexts that a task merges at a time (few, so that the work stays in the processor's cache;
# whole anchors always), and that one anchor may have before it is split.
AT_ONCE, MANY = 120, 2000
# Places of the anchor that the pieces of a crowded context share, from split to split.
WIDTHS = (32, 8, 1)
# Up to so many contexts are sent to the texts they are cut from; for more, texts are shuffled.
SENT_CONTEXTS = 100_000


def symbols(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes or the words of texts, and their offsets."""
    data, offsets = flat(column)
    return word_hashes(data, offsets) if words else (data, offsets)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` values in a row."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces(offsets: np.ndarray, length: int, limit: int) -> Iterator[list[tuple[int, int, int]]]:
    """Blocks of (row, first byte, end) that hold every string of ``length`` bytes of a row once.

    A long row is cut into pieces that overlap by one byte less than a string.
    """
    block, size = [], 0
    for row in range(len(offsets) - 1):
        low, end = int(offsets[row]), int(offsets[row + 1])
        while end - low >= length:
            stop = min(end, low + limit + length - 1)
            if block and size + stop - low > limit:
                yield block
                block, size = [], 0
            block.append((row, low, stop))
            size += stop - low
            low = stop - length + 1
    if block:
        yield block


def contexts(
    data: np.ndarray, block: list[tuple[int, int, int]], length: int, anchor: int
) -> tuple[np.ndarray, ...]:
    """(piece, first start, number of starts, anchor place, anchor hash, context hash)."""
    text = np.concatenate([data[a:b] for _, a, b in block])
    sizes = np.array([b - a for _, a, b in block])
    ends = np.cumsum(sizes)
    sums = prefix_sums(text)
    n = len(text) - anchor + 1
    places = np.arange(n)
    hashes = range_hashes(sums, places, places + anchor)
    low = np.uint64((1 << 24) - 1)
    best = sliding_minimum((hashes & ~low) | places.astype(np.uint64), length - anchor + 1)
    start = np.arange(len(best))
    piece = np.repeat(np.arange(len(block)), sizes)[: len(best)]
    good = start + length <= ends[piece]
    start, piece = start[good], piece[good]
    place = (best[good] & low).astype(np.int64)
    change = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])))
    first, count = start[change], np.diff(np.append(change, len(start)))
    place, piece = place[change], piece[change]
    context = range_hashes(sums, first, first + count + length - 1)
    return piece, first - (ends - sizes)[piece], count, place - first, hashes[place], context


def occurrences(texts: DataFrame, length: int, anchor: int, words: bool = False) -> DataFrame:
    """row, first (start), n (starts), place (of the anchor behind first), anchor, context."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = symbols(batch.column("text"), words)
            rows = batch.column("row").to_numpy()
            for block in pieces(offsets, length, BLOCK_BYTES):
                piece, first, n, place, hashes, context = contexts(data, block, length, anchor)
                row = np.array([r for r, _, _ in block])[piece]
                begin = np.array([a - offsets[r] for r, a, _ in block])[piece]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[row]), pa.array(begin + first), pa.array(n.astype(np.int32)),
                        pa.array(place.astype(np.int32)), pa.array(hashes.view(np.int64)),
                        pa.array(mixed(context + place.astype(np.uint64)).view(np.int64)),
                    ],
                    ["row", "first", "n", "place", "anchor", "context"],
                )

    return texts.select("row", "text").mapInArrow(
        found, "row long, first long, n int, place int, anchor long, context long"
    )


def by_digits(values: np.ndarray) -> np.ndarray:
    """A stable order of non-negative numbers below 2**32, two radix passes."""
    low = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    high = (values >> 16).astype(np.uint16)
    return low[np.argsort(high[low], kind="stable")] if high.any() else low


class Merge:
    """The transforms of contexts, each a shard of its own, and their interleave.

    ``starts`` is how many strings begin in each context; a context has length - 1 bytes more.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int, block: int) -> None:
        self.depth = length // block
        if length % block:
            raise ValueError("a string must be a whole number of blocks")
        sums = prefix_sums(data)
        sizes = starts + length - 1
        n_blocks = sizes - block + 1
        begin = np.cumsum(sizes) - sizes
        at = ragged(begin, n_blocks)
        _, code = np.unique(range_hashes(sums, at, at + block), return_inverse=True)
        code = code.astype(np.int64) + 1  # 0 ends a string
        # A row for every block, and one for the end of each of a context's strings.
        ends = np.minimum(n_blocks, block)
        count = n_blocks + ends
        row0 = np.cumsum(count) - count
        n = int(count.sum())
        self.shard = np.repeat(np.arange(len(starts)), count).astype(np.uint16)
        place = np.arange(n) - row0[self.shard]
        first_block = (np.cumsum(n_blocks) - n_blocks)[self.shard]
        is_end = place >= n_blocks[self.shard]
        self.symbol = np.zeros(n, np.int64)
        self.symbol[~is_end] = code
        before = place - block
        last = place - ends[self.shard]
        previous = np.zeros(n, np.int64)
        inner = ~is_end & (before >= 0)
        previous[inner] = code[(first_block + before)[inner]]
        # Ends follow the last blocks of their strings, in the order of their offsets.
        previous[is_end] = code[(first_block + last)[is_end]]
        self.is_start = ~is_end & (place < starts[self.shard])
        self.place = place
        self.order = self._sorted(n_blocks, row0, block)
        self.transform = previous[self.order]

    def _sorted(self, n_blocks: np.ndarray, row0: np.ndarray, block: int) -> np.ndarray:
        """Rows by shard, in each by their blocks."""
        order = by_digits(self.symbol)
        order = order[np.argsort(self.shard[order], kind="stable")]
        same = np.zeros(len(order) + 1, bool)
        s, h = self.symbol[order], self.shard[order]
        same[1:-1] = (s[1:] == s[:-1]) & (h[1:] == h[:-1]) & (s[1:] > 0)
        tied = np.flatnonzero(same[:-1] | same[1:])
        if len(tied):
            rows = order[tied]
            keys = []
            for k in range(1, self.depth):
                there = self.place[rows] + k * block
                inside = there < n_blocks[self.shard[rows]]
                keys.append(np.where(inside, self.symbol[np.where(inside, rows + k * block, 0)], 0))
            order[tied] = rows[np.lexsort((*keys[::-1], self.symbol[rows], self.shard[rows]))]
        return order

    def classes(self) -> np.ndarray:
        """For every row, the interval of rows that agree with it in ``depth`` blocks."""
        interleave = self.shard[self.order]
        group = np.zeros(len(interleave), np.int64)
        for _ in range(self.depth):
            # Where the interleave takes the first, second, .. suffix of each shard.
            taken = np.argsort(interleave, kind="stable")
            symbol = np.empty(len(interleave), np.int64)
            symbol[taken] = self.transform
            dealt = by_digits(symbol)
            interleave, symbol, group = interleave[dealt], symbol[dealt], group[dealt]
            apart = np.ones(len(group), np.int64)
            apart[1:] = (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])
            group = np.cumsum(apart) - 1
        out = np.empty(len(group), np.int64)
        out[self.order] = group[np.argsort(interleave, kind="stable")]
        return out


def repeated_starts(
    data: np.ndarray, starts: np.ndarray, copies: np.ndarray, length: int, block: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, number) of the stretches of starts whose strings occur twice."""
    merge = Merge(data, starts, length, block)
    own = np.flatnonzero(merge.is_start)
    group, shard = merge.classes()[own], merge.shard[own].astype(np.int64)
    weight = np.bincount(group, copies[shard])
    good = weight[group] >= 2
    # Rows lie by context and place, so stretches are runs.
    edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else low
    # Runs may go on from one context into the next: cut them at the contexts' first rows.
    inner = bounds[np.isin(bounds, low, invert=True)]
    inner = inner[good[inner]] if len(inner) else inner
    low = np.sort(np.concatenate([low, inner]))
    high = np.sort(np.concatenate([high, inner]))
    return shard[low], merge.place[own[low]], high - low


_SLICES = pa.schema(
    [("anchor", pa.int64()), ("context", pa.int64()), ("copies", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())]
)


def _with_text(texts: DataFrame, kinds: DataFrame, sent: bool = False) -> DataFrame:
    """The texts that contexts were first met in, each with the list of its contexts.

    Dealt texts keep their other columns, so that all joins with them share one exchange.
    """
    wanted = kinds.groupBy(F.col("at.row").alias("row")).agg(
        F.collect_list(
            F.struct("anchor", "context", "copies", "at.row", "at.first", "at.n", "at.place")
        ).alias("wanted")
    )
    if sent:
        return texts.join(F.broadcast(wanted), "row").select("text", "wanted")
    return texts.join(wanted, "row")


def split(
    data: np.ndarray, n: np.ndarray, place: np.ndarray, length: int, anchor: int, width: int
) -> tuple[np.ndarray, ...]:
    """The pieces of contexts: (context, skip, starts, place, hash of the core, hash of the piece).

    A string with its anchor at o has the bytes from o before the anchor on. Strings of the
    places a to b share those from a before it to length - b behind its start.
    """
    sizes = n + length - 1
    base = np.cumsum(sizes) - sizes
    sums = prefix_sums(data)
    lowest, highest = (place - n + 1) // width, place // width
    count = highest - lowest + 1
    own = np.repeat(np.arange(len(n)), count)
    step = ragged(lowest, count)
    a, b = step * width, np.minimum(step * width + width - 1, length - anchor)
    high, low = np.minimum(b, place[own]), np.maximum(a, (place - n + 1)[own])
    skip, starts = place[own] - high, high - low + 1
    at = base[own] + place[own]
    core = mixed(range_hashes(sums, at - a, at - b + length) + step.astype(np.uint64))
    first = base[own] + skip
    whole = mixed(range_hashes(sums, first, first + starts + length - 1) + high.astype(np.uint64))
    return own, skip, starts, high, core, whole


def _wishes(batch: pa.RecordBatch, length: int, words: bool) -> Iterator[tuple[list[dict], list[bytes]]]:
    """The contexts asked for and their symbols, some hundred at a time."""
    data, offsets = symbols(batch.column("text"), words)
    one: list[dict] = []
    raw: list[bytes] = []
    for i, wishes in enumerate(batch.column("wanted").to_pylist()):
        for w in wishes:
            low = offsets[i] + w["first"]
            one.append(w)
            raw.append(data[low : low + w["n"] + length - 1].tobytes())
            if len(one) >= 512:
                yield one, raw
                one, raw = [], []
    if one:
        yield one, raw


def kinds_of(contexts: DataFrame) -> DataFrame:
    """The different contexts with copies, where one lies, and how many their anchor has.

    Anchors that occur once are left out.
    """
    kinds = contexts.groupBy("anchor", "context").agg(
        F.sum("copies").alias("copies"),
        F.min(F.struct("row", "first", "n", "place")).alias("at"),
    )
    often = (
        kinds.groupBy("anchor")
        .agg(F.sum("copies").alias("starts"), F.count("*").alias("kinds"))
        .filter("starts > 1")
    )
    return kinds.join(often, "anchor")


def repeated(
    texts: DataFrame,
    dealt: DataFrame,
    length: int = LENGTH,
    anchor: int = ANCHOR,
    block: int = BLOCK,
    words: bool = False,
) -> DataFrame:
    """row and spans (first symbol, end) that repeated strings cover; rows without any are left out.

    ``texts`` has row and text; ``dealt`` is the same, dealt out by row as joins need it.
    """
    ready(texts.sparkSession)
    symbol = np.uint64 if words else np.uint8
    every = written(occurrences(texts, length, anchor, words), "occurrences")
    # Equal contexts are one row from here on, so copies of a text make no anchor large.
    kinds = written(kinds_of(every.withColumn("copies", F.lit(1))), "contexts")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, raw in _wishes(batch, length, words):
                yield pa.RecordBatch.from_pylist(
                    [
                        {"anchor": w["anchor"], "context": w["context"], "copies": w["copies"], "n": w["n"], "bytes": r}
                        for w, r in zip(one, raw)
                    ],
                    _SLICES,
                )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(table: pa.Table) -> pa.RecordBatch:
            data = flat(table.column("bytes"))[0].view(symbol)
            starts, copies = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "copies"))
            context, first, n = repeated_starts(data, starts, copies, length, block)
            at = pa.array(context)
            return pa.RecordBatch.from_arrays(
                [
                    table.column("anchor").take(at).combine_chunks(),
                    table.column("context").take(at).combine_chunks(),
                    pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)),
                ],
                ["anchor", "context", "skip", "n_repeated"],
            )

        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows >= AT_ONCE:
                # Whole groups only.
                key = held.column("anchor").to_numpy()
                cut = int(np.searchsorted(key, key[min(AT_ONCE, len(key) - 1)]))
                cut = cut or int(np.searchsorted(key, key[0], "right"))
                if cut == len(key):
                    break
                yield result(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield result(held)

    def merge(kinds: DataFrame, sent: bool) -> DataFrame:
        return (
            _with_text(texts if sent else dealt, kinds, sent)
            .mapInArrow(sliced, "anchor long, context long, copies long, n int, bytes binary")
            .repartition("anchor")
            .sortWithinPartitions("anchor")
            .mapInArrow(merged, "anchor long, context long, skip int, n_repeated int")
        )

    def resolved(kinds: DataFrame, widths: tuple[int, ...], sent: bool = False) -> DataFrame:
        """anchor, context, skip, n_repeated of all kinds; crowded ones by their pieces."""
        crowded = kinds.filter(F.col("kinds") > MANY)
        n = crowded.count() if widths else 0
        if not n:
            return merge(kinds, sent)
        width = widths[0]

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for one, raw in _wishes(batch, length, words):
                    column = {k: np.array([w[k] for w in one], np.int64) for k in ("anchor", "context", "copies", "row", "first", "n", "place")}
                    data = np.frombuffer(b"".join(raw), symbol)
                    own, skip, starts, place, core, whole = split(data, column["n"], column["place"], length, anchor, width)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(column[k][own]) for k in ("anchor", "context", "copies", "row")),
                            pa.array(column["first"][own] + skip), pa.array(skip.astype(np.int32)),
                            pa.array(starts.astype(np.int32)), pa.array(place.astype(np.int32)),
                            pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)),
                        ],
                        ["anchor", "context", "copies", "row", "first", "before", "n", "place", "core", "piece"],
                    )

        few = n <= SENT_CONTEXTS
        pieces = written(
            _with_text(texts if few else dealt, crowded, few).mapInArrow(
                parts,
                "anchor long, context long, copies long, row long, first long, before int, n int, place int, core long, piece long",
            ),
            "pieces",
        )
        smaller = kinds_of(pieces.select(F.col("core").alias("anchor"), F.col("piece").alias("context"), "copies", "row", "first", "n", "place"))
        found = resolved(written(smaller, "pieces"), widths[1:], few)
        found = found.select(F.col("anchor").alias("core"), F.col("context").alias("piece"), "skip", "n_repeated")
        back = pieces.join(found, ["core", "piece"]).select(
            "anchor", "context", (F.col("before") + F.col("skip")).alias("skip"), "n_repeated"
        )
        return merge(kinds.filter(F.col("kinds") <= MANY), sent).unionByName(back)

    found = resolved(kinds, WIDTHS)
    spans = every.join(found, ["anchor", "context"]).select(
        "row",
        F.struct(
            (F.col("first") + F.col("skip")).alias("low"),
            (F.col("first") + F.col("skip") + F.col("n_repeated") + length - 1).alias("high"),
        ).alias("span"),
    )
    return spans.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def runs(spans: list[dict]) -> list[list[int]]:
    """Sorted spans, joined where they touch."""
    out: list[list[int]] = []
    for span in spans or []:
        if out and span["low"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], span["high"])
        else:
            out.append([span["low"], span["high"]])
    return out


def _dealt(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows, and the same dealt out once for all that follows."""
    texts = keyed(docs, *columns)
    return texts, texts.repartition("row")


def _without(raw: bytes, found: list[list[int]]) -> bytes:
    """What remains between runs."""
    bounds = [0, *(place for span in found for place in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2]))


def digest(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what remains), then
    n_passages, n_passage_words, unique_text.

    The first are of repeated strings of ``length`` bytes. The last are of repeated strings of
    ``PASSAGE`` words: maximal runs of words that such strings cover, the words in them, and what
    remains of the text without runs of either kind. A character that is cut in two shows as a
    replacement character in ``text`` and ``unique_text``; the hash is of the bytes.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            rows = []
            for i, (spans, passages) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("passages").to_pylist())):
                raw, found, said = data[offsets[i] : offsets[i + 1]], runs(spans), runs(passages)
                whole = raw.tobytes()
                kept = _without(whole, found)
                text = unique = kept.decode("utf-8", "replace")
                if said:
                    low, high, _ = word_bounds(raw, np.array([0, len(raw)]))
                    both = [(a, b) for a, b in found] + [(int(low[a]), int(high[b - 1])) for a, b in said]
                    both = runs([{"low": a, "high": b} for a, b in sorted(both)])
                    unique = _without(whole, both).decode("utf-8", "replace")
                rows.append(
                    (len(raw), sum(b - a for a, b in found), len(found), hashlib.sha256(kept).hexdigest(), text,
                     len(said), sum(b - a for a, b in said), unique)
                )
            columns = zip(*rows) if rows else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds.values()))],
                ["doc_id", *kinds],
            )

    kinds = {
        "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(),
        "text": pa.string(), "n_passages": pa.int64(), "n_passage_words": pa.int64(), "unique_text": pa.string(),
    }
    names = {pa.int64(): "long", pa.string(): "string"}
    texts, dealt = _dealt(docs, ["doc_id", "text"])
    passages = repeated(texts, dealt, PASSAGE, PASSAGE_ANCHOR, PASSAGE_BLOCK, words=True)
    return (
        dealt.join(repeated(texts, dealt, length, anchor, block), "row", "left")
        .join(passages.withColumnRenamed("spans", "passages"), "row", "left")
        .select("doc_id", "text", "spans", "passages")
        .mapInArrow(
            counted,
            ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{c} {names[k]}" for c, k in kinds.items())]),
        )
    )


def cut(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """The documents, with all their columns, without repeated bytes; n_chars follows the text.

    A character of which some bytes only are repeated stays whole. A null text stays null.
    """
    others = [c for c in docs.columns if c != "text"]
    # One column holds all others, so that no name of theirs meets one of these.
    texts, dealt = _dealt(docs.select("text", F.struct(*others).alias("others")), ["others", "text"])
    spans = repeated(texts, dealt, length, anchor, block)
    rows = dealt.join(spans, "row", "left").select("others", "text", "spans")

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            kept = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                raw, at, out = data[offsets[i] : offsets[i + 1]], 0, []
                for low, high in runs(spans):
                    while low < len(raw) and raw[low] & 0xC0 == 0x80:
                        low += 1
                    while high < len(raw) and raw[high] & 0xC0 == 0x80:
                        high -= 1
                    if low < high:
                        out.append(raw[at:low].tobytes())
                        at = high
                kept.append(b"".join([*out, raw[at:].tobytes()]).decode("utf-8", "replace"))
            nulls = batch.column("text").is_null().to_pylist()
            text = pa.array([None if n else k for k, n in zip(kept, nulls)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("others"), text], ["others", "text"])

    schema = rows.select("others", "text").schema
    result = rows.mapInArrow(shorter, schema)
    value = {c: F.col("others").getField(c) for c in others}
    value["text"] = F.col("text")
    if "n_chars" in value:
        kind = docs.schema["n_chars"].dataType
        value["n_chars"] = F.when(value["text"].isNotNull(), F.length("text")).otherwise(value["n_chars"]).cast(kind)
    return result.select(*(value[c].alias(c) for c in docs.columns))
