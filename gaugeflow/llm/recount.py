"""Token counts that follow edits: only what an edit touches is encoded again.

Every document keeps a segment tree over its pre-tokens. A leaf holds some consecutive
pre-tokens; every node holds how many code points and how many tokens lie below it. An edit
goes down the tree to the leaves it touches. They are cut into pre-tokens anew, starting
``LEFT`` code points before the edit at least and looking ``RIGHT`` beyond, until a cut falls
on the old end of the last leaf again; from there on nothing has changed. The leaves' numbers
and the sums above them are replaced, the rest of the tree stays.

Edits of a document apply one after the other. An edit beyond the end works at the end, a
negative place is the start. Null texts are empty, null edit lists are no edits; a null
insertion is empty. Rows are handled one by one, so null or repeated doc_ids and further
columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Block, blocks
from .pretokens import Encoder, PreTokens, encoder
from .tables import ready

LEAF = 32
# No rule of the pre-tokens looks three code points ahead; names of special tokens are longer.
LEFT = RIGHT = 24
EDITS = "array<struct<at:long,remove:long,insert:string>>"
TREES = "doc_id {0}, text string, leaf_chars array<int>, leaf_tokens array<int>"


def by_library(tool: Encoder, text: str) -> tuple[list[int], list[int]]:
    """Lengths and token counts of the pre-tokens of one text, all found by the library."""
    names = "|".join(map(re.escape, tool.special)) or "(?!)"
    sizes, counts = [], []
    for piece in re.split(f"({names})", text):
        if piece in tool.special:
            sizes.append(len(piece))
            counts.append(1)
        elif piece:
            found = tool.tokenizer.pre_tokenizer.pre_tokenize_str(piece)
            words = [piece[a:b] for _, (a, b) in found]
            sizes += map(len, words)
            counts += map(len, tool.library(words))
    return sizes, counts


def segments(tool: Encoder, block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lengths and token counts of the pre-tokens of each part of a block."""
    cut = PreTokens(block)
    counts = tool.spans(cut)[1]
    sizes = np.diff(cut.starts)
    first = np.searchsorted(cut.starts, cut.parts)
    out = [(sizes[a:b], counts[a:b]) for a, b in zip(first, first[1:])]
    whole = set((np.searchsorted(cut.parts, cut.unsettled, "right") - 1).tolist())
    for name in tool.special:
        for found in re.finditer(re.escape(name), cut.text):
            whole.add(int(np.searchsorted(cut.parts, found.start(), "right")) - 1)
    for i in whole:
        text = cut.text[cut.parts[i] : cut.parts[i + 1]]
        out[i] = tuple(np.array(x, np.int64) for x in by_library(tool, text))
    return out


def block_of(texts: list[str]) -> Block:
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    return Block(np.arange(len(raw)), np.frombuffer(b"".join(raw), np.uint8), offsets)


class Tree:
    """Sums of code points and tokens over leaves; node i has the children 2i and 2i + 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.n = len(chars)
        self.size = 1 << max(self.n - 1, 0).bit_length()
        self.chars, self.tokens = (self._sums(x) for x in (chars, tokens))

    def _sums(self, leaves: np.ndarray) -> list[int]:
        level = np.zeros(self.size, np.int64)
        level[: self.n] = leaves
        levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            levels.append(level)
        return [0, *(int(x) for y in reversed(levels) for x in y)]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a code point, and where it starts; the last leaf for the end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        leaf = node - self.size
        if leaf >= self.n:
            leaf = self.n - 1
            start = self.chars[1] - self.chars[self.size + leaf]
        return leaf, start

    def put(self, first: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """New numbers for the leaves from ``first`` on, and for the nodes above them."""
        low = self.size + first
        high = low + len(chars) - 1
        self.chars[low : high + 1] = [int(x) for x in chars]
        self.tokens[low : high + 1] = [int(x) for x in tokens]
        while low > 1:
            low, high = low // 2, high // 2
            for node in range(low, high + 1):
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]


def leaves(sizes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over ``n`` runs of pre-tokens as even as can be."""
    bounds = np.arange(n + 1) * len(sizes) // n
    return tuple(np.diff(np.append(0, np.cumsum(x))[bounds]) for x in (sizes, counts))


def build(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and the leaves of each document's tree."""
    ready(docs.sparkSession)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            parts: list[list] = [[] for _ in range(batch.num_rows)]
            for block in blocks(batch.column("text")):
                for row, found in zip(block.rows, segments(tool, block)):
                    parts[row].append(found)
            kept = []
            for found in parts:
                sizes, counts = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                kept.append(leaves(sizes, counts, max(-(-len(sizes) // LEAF), 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text").fill_null(""),
                    *(pa.array([k[i].tolist() for k in kept], pa.list_(pa.int32())) for i in (0, 1)),
                ],
                ["doc_id", "text", "leaf_chars", "leaf_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trees, TREES.format(kind))


class Document:
    """A text with its tree, and how much of it was encoded again."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.text, self.tree, self.again = text, Tree(chars, tokens), 0

    def touch(self, at: int, remove: int, insert: str) -> None:
        """Apply an edit to the text; remember the leaves it touches."""
        size = len(self.text)
        at = min(max(at, 0), size)
        end = min(at + max(remove, 0), size)
        self.first, self.start = self.tree.find(max(at - LEFT, 0))
        self.last, start = self.tree.find(end)
        self.end = start + self.tree.chars[self.tree.size + self.last]
        self.grown = len(insert) - (end - at)
        self.text = self.text[:at] + insert + self.text[end:]

    def region(self) -> str:
        return self.text[self.start : self.end + self.grown + RIGHT]

    def wider(self) -> None:
        self.last += 1
        self.end += self.tree.chars[self.tree.size + self.last]

    def settle(self, sizes: np.ndarray, counts: np.ndarray) -> bool:
        """Take the region's new pre-tokens if a cut falls on its old end."""
        length = self.end + self.grown - self.start
        ends = np.cumsum(sizes)
        if self.last == self.tree.n - 1:
            k = len(sizes)
        else:
            k = int(np.searchsorted(ends, length)) + 1 if length else 0
            if length and (k > len(ends) or ends[k - 1] != length):
                return False
        n = self.last - self.first + 1
        self.tree.put(self.first, *leaves(sizes[:k], counts[:k], n))
        self.again += k
        return True


def recount(trees: DataFrame, path: str) -> DataFrame:
    """Apply the ``edits`` column of kept trees.

    Returns doc_id, the token counts before and after, the pre-tokens encoded again, the new
    text and the new leaves.
    """
    ready(trees.sparkSession)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            docs, before = [], []
            for i, text in enumerate(texts):
                chars, tokens = (
                    batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                    for c in ("leaf_chars", "leaf_tokens")
                )
                docs.append(Document(text, chars, tokens))
                before.append(docs[-1].tree.tokens[1])
            edits = [e or [] for e in batch.column("edits").to_pylist()]
            for step in range(max(map(len, edits), default=0)):
                todo = []
                for doc, own in zip(docs, edits):
                    if step < len(own):
                        e = own[step]
                        doc.touch(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                        todo.append(doc)
                while todo:
                    found = segments(tool, block_of([doc.region() for doc in todo]))
                    open_ = [doc for doc, x in zip(todo, found) if not doc.settle(*x)]
                    for doc in open_:
                        doc.wider()
                    todo = open_
            n = [doc.tree.size for doc in docs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(before, pa.int64()),
                    pa.array([doc.tree.tokens[1] for doc in docs], pa.int64()),
                    pa.array([doc.again for doc in docs], pa.int64()),
                    pa.array([doc.text for doc in docs], pa.string()),
                    pa.array([d.tree.chars[k : k + d.tree.n] for d, k in zip(docs, n)], pa.list_(pa.int32())),
                    pa.array([d.tree.tokens[k : k + d.tree.n] for d, k in zip(docs, n)], pa.list_(pa.int32())),
                ],
                ["doc_id", "n_before", "n_after", "n_again", "text", "leaf_chars", "leaf_tokens"],
            )

    kind = trees.schema["doc_id"].dataType.simpleString()
    return trees.mapInArrow(
        edited,
        f"doc_id {kind}, n_before long, n_after long, n_again long, text string, "
        "leaf_chars array<int>, leaf_tokens array<int>",
    )


def sample_edits(trees: DataFrame) -> DataFrame:
    """Three edits for every document: a cut, an insertion and a replacement, by its length."""
    n = F.length("text").cast("long")
    none, digits = F.lit(""), F.concat(F.lit(" it's "), n.cast("string"), F.lit("\n"))

    def edit(at, remove, insert):
        return F.struct(
            F.floor(at).cast("long").alias("at"),
            F.lit(remove).cast("long").alias("remove"),
            insert.alias("insert"),
        )

    edits = F.array(edit(n / 3, 7, none), edit(n / 2, 0, digits), edit(n * 5 / 6, 2, F.lit("-")))
    return trees.withColumn("edits", edits)
