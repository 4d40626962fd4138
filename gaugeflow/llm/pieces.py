"""SentencePiece encoding by unigram Viterbi, and decoding.

The pieces of a model lie in a double-array trie over UTF-8 bytes; a piece's score is its log
score, and the segmentation of the highest sum is taken (of equal ones, that whose last piece
starts first). A character that no piece covers costs the lowest score less ``UNKNOWN`` and
becomes its byte pieces. Spaces become the white-space marker, and a text that is not empty
gets one marker in front, as the models expect; decoding turns markers into spaces and takes
the first away. A text that holds the marker itself comes back with a space for it.

A piece has markers at its front only, so no piece crosses into a new run of spaces, and none
covers a character that it does not hold. Cut there, texts fall into words whose best
segmentations are independent; a worker keeps them by hash. Model files whose pieces hold
inner markers are refused. Null texts are empty and have no pieces; rows are encoded one by
one, so null or repeated doc_ids and further columns change nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import Block, binary, blocks, flat, ragged
from .pretokens import WordIds
from .tables import ready

MARK, UNKNOWN = "▁", 10.0
# Longer words take a loop of their own instead of the one over many words at a time.
LONG = 96


@dataclass(frozen=True)
class Pieces:
    """A model: trie arrays, score and bytes of every piece, id of every byte."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    bytes_at: np.ndarray
    bytes: np.ndarray
    byte_ids: np.ndarray
    unknown: float
    # Code points that some piece holds.
    covered: np.ndarray


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of the trie of ``keys``; node 0 is the root, value -1 is none.

    Child c of node s is base[s] + c, if check there says s.
    """
    nodes: list[dict[int, int]] = [{}]
    values = [-1]
    for key, value in keys.items():
        node = 0
        for byte in key:
            if byte not in nodes[node]:
                nodes[node][byte] = len(nodes)
                nodes.append({})
                values.append(-1)
            node = nodes[node][byte]
        values[node] = value
    used = bytearray(2 * len(nodes) + 1024)
    used[0] = 1
    base, check, value = ([0], [0], [values[0]])
    # Where nodes of so many children last found room; the places before are mostly full.
    room: dict[int, int] = {}
    todo = [(0, 0)]
    for node, place in todo:
        children = sorted(nodes[node])
        if not children:
            continue
        at = room.get(len(children), 1)
        while any(used[at + c] for c in children):
            at += 1
            if at + 512 > len(used):
                used += bytes(len(used))
        room[len(children)] = at
        if at + 257 > len(check):
            more = at + 257 - len(check)
            base += [0] * more
            check += [-1] * more
            value += [-1] * more
        base[place] = at
        for c in children:
            used[at + c] = 1
            check[at + c] = place
            value[at + c] = values[nodes[node][c]]
            todo.append((nodes[node][c], at + c))
    # A node without children has base 0: places below 256 may not be taken for its children.
    return tuple(np.array(x, np.int32) for x in (base, check, value))


def load(path: str) -> Pieces:
    """Read a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    raw = [model.is_byte(i) for i in range(n)]
    normal = {names[i].encode(): i for i in range(n) if not (special[i] or raw[i])}
    if any(MARK in name.decode().lstrip(MARK) for name in normal):
        raise ValueError("the model has pieces with a marker inside")
    byte_ids = np.full(256, model.unk_id(), np.int32)
    content = []
    for i, name in enumerate(names):
        if raw[i]:
            byte_ids[int(name[3:5], 16)] = i
            content.append(bytes([int(name[3:5], 16)]))
        else:
            content.append(b"" if special[i] else name.replace(MARK, " ").encode())
    covered = np.zeros(0x110000, bool)
    covered[[ord(c) for name in normal for c in name.decode()]] = True
    covered[[ord(" "), ord(MARK)]] = covered[ord(MARK)]
    scores = np.array([model.get_score(i) for i in range(n)], np.float64)
    lowest = min((scores[i] for i in normal.values()), default=0.0)
    return Pieces(
        *double_array(normal),
        scores,
        np.append(0, np.cumsum([len(c) for c in content])),
        np.frombuffer(b"".join(content), np.uint8),
        byte_ids,
        lowest - UNKNOWN,
        covered,
    )


def best_pieces(model: Pieces, word: bytes) -> list[int]:
    """The best segmentation of one word, by plain dynamic programming."""
    n = len(word)
    best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    base, check, value = model.base, model.check, model.value
    for s in range(n):
        if word[s] & 0xC0 == 0x80:
            continue
        size = 1 + (word[s] >= 0xC0) + (word[s] >= 0xE0) + (word[s] >= 0xF0)
        node, single = 0, False
        for t in range(s, n):
            child = int(base[node]) + word[t]
            if check[child] != node or child == 0:
                break
            node = child
            if value[node] >= 0:
                single |= t + 1 - s == size
                score = best[s] + model.scores[value[node]]
                if score > best[t + 1]:
                    best[t + 1], back[t + 1] = score, (s, int(value[node]))
        if not single and best[s] + model.unknown > best[s + size]:
            best[s + size], back[s + size] = best[s] + model.unknown, (s, -1)
    out, at = [], n
    while at:
        s, piece = back[at]
        out += [int(model.byte_ids[b]) for b in reversed(word[s:at])] if piece < 0 else [piece]
        at = s
    return out[::-1]


def best_pieces_of_many(model: Pieces, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for many short words at a time: their ids in a row, and how many each has."""
    n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max(initial=0))
    text = np.zeros((n, width + 4), np.uint8)
    text[np.repeat(np.arange(n), sizes), ragged(np.zeros(n, np.int64), sizes)] = np.frombuffer(
        b"".join(words), np.uint8
    )
    best = np.full((n, width + 4), -np.inf)
    best[:, 0] = 0.0
    start = np.zeros((n, width + 4), np.int16)
    piece = np.full((n, width + 4), -1, np.int32)
    for s in range(width):
        rows = np.flatnonzero((sizes > s) & ((text[:, s] & 0xC0) != 0x80))
        if not len(rows):
            continue
        lead = text[rows, s]
        char = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        so_far = best[rows, s]
        single = np.zeros(len(rows), bool)
        alive, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for t in range(s, width):
            child = model.base[node] + text[rows[alive], t].astype(np.int64)
            good = (model.check[child] == node) & (child > 0) & (sizes[rows[alive]] > t)
            alive, node = alive[good], child[good]
            if not len(alive):
                break
            found = model.value[node]
            hit = np.flatnonzero(found >= 0)
            a = alive[hit]
            single[a] |= char[a] == t + 1 - s
            score = so_far[a] + model.scores[found[hit]]
            better = score > best[rows[a], t + 1]
            r = rows[a[better]]
            best[r, t + 1] = score[better]
            start[r, t + 1] = s
            piece[r, t + 1] = found[hit][better]
        lone = np.flatnonzero(~single)
        end = s + char[lone]
        better = so_far[lone] + model.unknown > best[rows[lone], end]
        r, end = rows[lone][better], end[better]
        best[r, end] = so_far[lone][better] + model.unknown
        start[r, end] = s
        piece[r, end] = -1
    out_row, out_at, out_id = [], [], []
    rows, at = np.arange(n), sizes.copy()
    while True:
        rows = rows[at[rows] > 0]
        if not len(rows):
            break
        end, begin, found = at[rows], start[rows, at[rows]].astype(np.int64), piece[rows, at[rows]]
        known = found >= 0
        out_row.append(rows[known])
        out_at.append(begin[known])
        out_id.append(found[known])
        if not known.all():
            r, b, e = rows[~known], begin[~known], end[~known]
            places = ragged(b, e - b)
            r = np.repeat(r, e - b)
            out_row.append(r)
            out_at.append(places)
            out_id.append(model.byte_ids[text[r, places]])
        at[rows] = begin
    if not out_row:
        return np.empty(0, np.int32), np.zeros(n, np.int64)
    row, place, ids = (np.concatenate(x) for x in (out_row, out_at, out_id))
    return ids[np.argsort(row * (width + 4) + place)], np.bincount(row, minlength=n).astype(np.int64)


class Words:
    """A block cut into words: runs of spaces with what follows, and lone characters.

    Every text that is not empty gets a space in front, which is its first word's.
    """

    def __init__(self, block: Block, first: np.ndarray, covered: np.ndarray) -> None:
        text = block.data.tobytes().decode("utf-8").replace(MARK, " ")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        leads = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum((block.data & 0xC0) != 0x80, out=leads[1:])
        parts = leads[block.offsets]
        led = np.flatnonzero(first & (np.diff(parts) > 0))
        self.points = np.insert(points, parts[led], 32)
        self.parts = parts + np.searchsorted(led, np.arange(len(parts)), "left")
        self.text = self.points.tobytes().decode("utf-32-le")
        n = len(self.points)
        if not n:
            self.starts = np.zeros(1, np.int64)
            return
        fresh = np.zeros(n, bool)
        fresh[self.parts[:-1][self.parts[:-1] < n]] = True
        blank, lone = self.points == 32, ~covered[self.points]
        start = fresh | lone
        start[1:] |= (blank[1:] & ~blank[:-1]) | lone[:-1]
        self.starts = np.append(np.flatnonzero(start), n)

    def words(self, which: np.ndarray) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(self.starts[which], self.starts[which + 1])]


class PieceEncoder(WordIds):
    # Finding pieces is cheap, so less is kept.
    slot_bits, most_kept = 20, 1 << 22

    def __init__(self, model: Pieces) -> None:
        self.model, self.vocabulary = model, len(model.scores)
        super().__init__()

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.replace(" ", MARK).encode() for w in words]
        short = np.array([len(r) <= LONG for r in raw])
        if short.all():
            return best_pieces_of_many(self.model, raw)
        ids, sizes = best_pieces_of_many(self.model, [r for r, s in zip(raw, short) if s])
        pieces = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        all_ = [next(pieces) if s else np.array(best_pieces(self.model, r)) for r, s in zip(raw, short)]
        return np.concatenate(all_), np.array([len(x) for x in all_], np.int64)

    def encode(self, block: Block, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's parts, and how many each has."""
        cut = Words(block, first, self.model.covered)
        at, length = self.spans(cut)
        part = np.searchsorted(cut.parts, cut.starts[:-1], "right") - 1
        counts = np.bincount(part, length, minlength=len(block.rows)).astype(np.int64)
        return self.pool[ragged(at, length)].astype(np.int32), counts


def decode(model: Pieces, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of runs of ``counts`` ids, and their offsets."""
    size = np.diff(model.bytes_at)[ids]
    data = model.bytes[ragged(model.bytes_at[ids], size)]
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
    starts = ends[:-1][counts > 0]
    # The space in front is not the text's.
    lead = starts[data[starts] == 32] if len(data) else starts
    keep = np.ones(len(data), bool)
    keep[lead] = False
    return data[keep], ends - np.searchsorted(lead, ends, "left")


_encoders: dict[str, PieceEncoder] = {}


def _encoded(batch: pa.RecordBatch, tool: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(batch.num_rows, np.int64)
    found, last = [np.empty(0, np.int32)], -1
    for block in blocks(batch.column("text")):
        ids, n = tool.encode(block, np.diff(block.rows, prepend=last) > 0)
        last = block.rows[-1]
        found.append(ids)
        np.add.at(counts, block.rows, n)
    return np.concatenate(found), counts


def _task(path: str, model, use):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = PieceEncoder(model.value)
        for batch in batches:
            yield use(_encoders[path].model, batch, *_encoded(batch, _encoders[path]))

    return rows


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces and ids (little-endian, four bytes) of every text."""
    ready(docs.sparkSession)
    # As large as the model file: a few million bytes.
    model = docs.sparkSession.sparkContext.broadcast(load(path))

    def use(_, batch, ids, counts):
        ends = np.append(0, np.cumsum(counts)) * 4
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts), binary(ids.view(np.uint8), ends)],
            ["doc_id", "n_pieces", "ids"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _task(path, model, use), f"doc_id {kind}, n_pieces long, ids binary"
    )


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of what ``encode`` gave."""
    ready(encoded.sparkSession)
    model = encoded.sparkSession.sparkContext.broadcast(load(path))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("ids"))
            out, ends = decode(model.value, data.view(np.int32), np.diff(offsets) // 4)
            text = binary(out, ends).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(texts, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces among them), ids_crc32, and whether decoding the
    ids gives the text again (with spaces for markers)."""
    ready(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(load(path))

    def use(pieces, batch, ids, counts):
        data, ends = decode(pieces, ids, counts)
        raw, at = flat(batch.column("text"))
        raw_ids = ids.astype("<i4").tobytes()
        stops = np.cumsum(counts)
        is_byte = np.zeros(len(pieces.scores), bool)
        is_byte[pieces.byte_ids] = True
        byte_sums = np.append(0, np.cumsum(is_byte[ids]))
        bytes_, text = data.tobytes(), raw.tobytes()
        mark, space = MARK.encode(), b" "
        same = [
            bytes_[a:b] == text[c:d].replace(mark, space)
            for a, b, c, d in zip(ends, ends[1:], at, at[1:])
        ]
        crc = [zlib.crc32(raw_ids[4 * a : 4 * b]) for a, b in zip(stops - counts, stops)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(counts),
                pa.array(byte_sums[stops] - byte_sums[stops - counts]),
                pa.array(crc, pa.int64()), pa.array(same, pa.bool_()),
            ],
            ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "restored"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _task(path, model, use),
        f"doc_id {kind}, n_pieces long, n_bytes long, ids_crc32 long, restored boolean",
    )
