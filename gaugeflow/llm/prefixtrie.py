"""The trie of the prefixes that conversations share, found by count-min screening.

A node is a distinct sequence of the first d turns (role, text) of a conversation; the root
has none. Every conversation is the chain of 128-bit digests of its prefixes. A count-min sketch
counts all digests; counters stop at two, since the only question is whether a prefix occurs
once. It never counts too little, so a prefix with the estimate one is a singleton, and so
is all that follows it: those tails are nodes of one conversation each and are given where
the conversation lies. Only the prefixes before them, possibly shared ones, are shuffled and
grouped exactly; what the sketch wrongly takes for shared comes out right there. The sketch
has a cell count in proportion to the prefixes, up to ``SKETCH_BYTES``, which is also the bound
of what is broadcast; a fuller sketch proves less and shuffles more, with the same result.

Subtree sums need no walk: of every node the member with the smallest id is its owner, and a
conversation owns a last stretch of its chain. Sums over what a conversation owns, added up
over the members of a node, give the sums of its subtree and of the owner's nodes above it,
which are taken away again.

Turns go by turn (nulls first), then role, then the digest of role and text, so ties and repeated
rows have a defined order. Null roles and texts are empty. Rows without conv_id belong to no
conversation and are left out. An empty table has no nodes. A conversation's digests, not its
texts, are brought together in one task; very long texts are digested where they lie. Further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import ready, written

# Conversations up to the next number of this size start with turns of its first.
FAMILY, HEADS = 100, 6
SKETCH_ROWS, CELLS_PER_PREFIX = 2, 8
SKETCH_BYTES, SLICE_BYTES = 32 << 20, 1 << 20
DIGEST_BYTES = 16
# Ids that one row holds on their way to a node's hash.
IDS_AT_ONCE = 20_000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_digests(rows: DataFrame) -> DataFrame:
    """conv_id and its turns in order: (digest of role and text, code points of the text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return (
        rows.filter(F.col("conv_id").isNotNull())
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.struct(
                F.col("turn").alias("turn"),
                role.alias("role"),
                # The length keeps role and text apart.
                F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text))).alias("digest"),
                F.length(text).alias("chars"),
            ).alias("one"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("one")).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t.digest, t.chars)).alias("turns"))
    )


def rebuilt(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Every conversation with its first turns taken from the first of its family."""
    base = F.col("conv_id") - F.col("conv_id") % family
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    firsts = conversations.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("firsts")
    )
    return (
        conversations.select("conv_id", "turns", base.alias("base"), h.alias("h"))
        .join(firsts, "base", "left")
        .select(
            "conv_id",
            F.concat(
                F.when(F.col("firsts").isNotNull(), F.slice("firsts", F.lit(1), F.col("h"))).otherwise(
                    F.slice("turns", 1, 0)
                ),
                F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))),
            ).alias("turns"),
        )
    )


def chains(conversations: DataFrame) -> DataFrame:
    """conv_id, chain (the digests of its prefixes of 1, 2, .. turns, joined), chars of each turn."""
    ready(conversations.sparkSession)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column("digests").to_pylist():
                last, chain = b"", []
                for one in turns:
                    last = hashlib.md5(last + one).digest()
                    chain.append(last)
                out.append(b"".join(chain))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(out, pa.binary()), batch.column("chars")],
                ["conv_id", "chain", "chars"],
            )

    return conversations.select(
        "conv_id", F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars")
    ).mapInArrow(chained, "conv_id long, chain binary, chars array<int>")


def cells(digests: np.ndarray, width: int) -> list[np.ndarray]:
    """Each digest's cell in every row of the sketch; ``width`` is a power of two."""
    mask = np.uint64(width - 1)
    return [(digests[:, k] & mask).astype(np.int64) for k in range(SKETCH_ROWS)]


def read_chain(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8").reshape(-1, DIGEST_BYTES // 8)


def sketch_width(prefixes: int, most_bytes: int = SKETCH_BYTES) -> int:
    """Cells of a row: about ``CELLS_PER_PREFIX`` for every prefix, within the bound."""
    most = most_bytes * 4 // SKETCH_ROWS
    wanted = 1 << max(12, (CELLS_PER_PREFIX * prefixes - 1).bit_length() if prefixes else 0)
    return min(wanted, most)


def packed_counts(counts: np.ndarray) -> np.ndarray:
    """Counters of two bits, four to a byte."""
    quads = counts.reshape(-1, 4)
    return quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6


def unpacked_counts(raw: np.ndarray) -> np.ndarray:
    return (raw[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(-1)


def sketch(chained: DataFrame, width: int) -> np.ndarray:
    """The sketch of all prefixes, four counters of two bits to a byte, a row after the other.

    Every task counts into a table of its own and gives its slices; those are added up per slice.
    """
    total = SKETCH_ROWS * width
    per_slice = min(SLICE_BYTES * 4, total)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(total, np.uint8)
        for batch in batches:
            raw = b"".join(c for c in batch.column("chain").to_pylist() if c)
            for row, cell in enumerate(cells(read_chain(raw), width)):
                found, n = np.unique(cell + row * width, return_counts=True)
                table[found] = np.minimum(table[found] + np.minimum(n, 2), 2)
        if not table.any():
            return
        for number, low in enumerate(range(0, total, per_slice)):
            if not table[low : low + per_slice].any():
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([packed_counts(table[low : low + per_slice]).tobytes()], pa.binary())],
                ["slice", "counts"],
            )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, table = None, np.zeros(0, np.uint8)
        for batch in batches:
            for n, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                more = unpacked_counts(np.frombuffer(raw, np.uint8))
                if n != number:
                    if number is not None:
                        yield _slice(number, table)
                    number, table = n, more
                else:
                    table = np.minimum(table + more, 2)
        if number is not None:
            yield _slice(number, table)

    def _slice(number: int, table: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([packed_counts(table).tobytes()], pa.binary())], ["slice", "counts"]
        )

    kind = "slice long, counts binary"
    slices = (
        chained.mapInArrow(counted, kind).repartition("slice").sortWithinPartitions("slice").mapInArrow(added, kind)
    )
    out = np.zeros(total // 4, np.uint8)
    # SKETCH_BYTES at most come to the driver.
    for row in slices.collect():
        low = row["slice"] * (per_slice // 4)
        out[low : low + per_slice // 4] = np.frombuffer(row["counts"], np.uint8)
    return out


def screened(chained: DataFrame, width: int, counts: np.ndarray) -> DataFrame:
    """conv_id, n (turns), head (depth from which on its prefixes are proven singletons, or n + 1),
    and the chain and chars before it."""
    known = chained.sparkSession.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            raw = [c or b"" for c in batch.column("chain").to_pylist()]
            n = np.array([len(c) // DIGEST_BYTES for c in raw], np.int64)
            digests = read_chain(b"".join(raw))
            estimate = np.full(len(digests), 2, np.uint8)
            for row, cell in enumerate(cells(digests, width)):
                at = cell + row * width
                estimate = np.minimum(estimate, table[at >> 2] >> ((at & 3) << 1).astype(np.uint8) & 3)
            starts = np.cumsum(n) - n
            head = n + 1
            single = np.flatnonzero(estimate == 1)
            owner = np.repeat(np.arange(len(n)), n)[single]
            np.minimum.at(head, owner, single - starts[owner] + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), pa.array(n), pa.array(head),
                    pa.array([c[: (h - 1) * DIGEST_BYTES] for c, h in zip(raw, head.tolist())], pa.binary()),
                    batch.column("chars"),
                ],
                ["conv_id", "n", "head", "chain", "chars"],
            )

    return chained.mapInArrow(cut, "conv_id long, n long, head long, chain binary, chars array<int>")


def members(cut: DataFrame, *carried: str) -> DataFrame:
    """A row for every conversation and possibly shared prefix of it, the root (no bytes) first."""

    def digest(depth: str) -> Column:
        return F.expr(f"substring(chain, ({depth} - 1) * {DIGEST_BYTES} + 1, {DIGEST_BYTES})")

    depth = F.col("depth")
    return cut.withColumn("depth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("head") - 1))).select(
        "conv_id",
        "depth",
        F.when(depth == 0, F.lit(b"")).otherwise(digest("depth")).alias("node"),
        F.when(depth > 1, digest("(depth - 1)")).when(depth == 1, F.lit(b"")).alias("parent"),
        F.coalesce(F.get("chars", (depth - 1).cast("int")), F.lit(0)).cast("long").alias("chars"),
        (depth == F.col("n")).alias("ends"),
        # The next prefix is a proven singleton.
        ((F.col("head") <= F.col("n")) & (depth == F.col("head") - 1)).alias("tail"),
        *carried,
    )


def end_hashes(rows: DataFrame) -> DataFrame:
    """node, depth and the SHA-256 of the ids of the conversations that end there.

    One hash is one sequence of bytes, so a node's ids pass through one task in the end; they are
    sorted and written as text before that, in parts of the whole range, and only streamed there.
    """
    ready(rows.sparkSession)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(node: bytes, ids: list[int]) -> tuple[bytes, int, str]:
            return node, ids[0], ",".join(map(str, ids))

        node, ids = None, []
        for batch in batches:
            out = []
            for n, i in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if n != node or len(ids) >= IDS_AT_ONCE:
                    if ids:
                        out.append(part(node, ids))
                    node, ids = n, []
                ids.append(i)
            if out:
                yield batch_of(out)
        if ids:
            yield batch_of([part(node, ids)])

    def batch_of(out):
        nodes, lows, texts = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array(lows, pa.int64()), pa.array(texts, pa.string())],
            ["node", "low", "ids"],
        )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for n, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if n != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if out:
                yield result(out)
        if node is not None:
            yield result([(node, state.hexdigest())])

    def result(out):
        nodes, digests = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"]
        )

    spread = rows.filter("ends").select("node", "conv_id").repartitionByRange("node", "conv_id")
    return (
        spread.sortWithinPartitions("node", "conv_id")
        .mapInArrow(listed, "node binary, low long, ids string")
        .repartition("node")
        .sortWithinPartitions("node", "low")
        .mapInArrow(hashed, "node binary, ends_sha256 string")
    )


def shared_nodes(cut: DataFrame) -> DataFrame:
    """The nodes that were not proven singletons, with exact figures.

    node, parent, depth, owner (smallest member), n_convs, n_children, n_leaves, saved_tokens
    """
    rows = members(cut)
    nodes = written(
        rows.groupBy("node").agg(
            F.min("depth").alias("depth"),
            F.min("parent").alias("parent"),
            F.min("conv_id").alias("owner"),
            F.count("*").alias("n_convs"),
            F.min("chars").alias("chars"),
            F.count(F.when(F.col("tail"), 1)).alias("tails"),
        ),
        "trie-nodes",
    )
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("below"))
    above = Window.partitionBy("owner").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    grown = written(
        nodes.join(children, "node", "left")
        .withColumn("n_children", F.coalesce("below", F.lit(0)) + F.col("tails"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
        .withColumn("above", F.coalesce(F.sum("saved").over(above), F.lit(0)))
        .select("node", "parent", "depth", "owner", "n_convs", "n_children", "saved", "above"),
        "trie-nodes",
    )
    owned = grown.groupBy(F.col("owner").alias("conv_id")).agg(
        F.sum("saved").alias("own_saved"), F.count(F.when(F.col("n_children") == 0, 1)).alias("own_leaves")
    )
    tail = (F.col("head") <= F.col("n")).cast("long")
    richer = cut.join(owned, "conv_id", "left").select(
        *cut.columns,
        F.coalesce("own_saved", F.lit(0)).alias("own_saved"),
        (F.coalesce("own_leaves", F.lit(0)) + tail).alias("own_leaves"),
    )
    sums = (
        members(richer, "own_saved", "own_leaves")
        .groupBy("node")
        .agg(F.sum("own_saved").alias("all_saved"), F.sum("own_leaves").alias("n_leaves"))
    )
    return grown.join(sums, "node").select(
        "node", "parent", "depth", "owner", "n_convs", "n_children", "n_leaves",
        (F.col("all_saved") - F.col("above")).alias("saved_tokens"),
    )


def trie(rows: DataFrame, sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    turns = written(rebuilt(turn_digests(rows)), "conversations")
    chained = written(chains(turns), "chains")
    prefixes = chained.agg(F.sum(F.length("chain"))).first()[0]
    width = sketch_width((prefixes or 0) // DIGEST_BYTES, sketch_bytes)
    cut = written(screened(chained, width, sketch(chained, width)), "screened")
    nodes = written(shared_nodes(cut), "trie-nodes")

    singles = cut.filter("head <= n")
    kind = ["depth", "parent", "owner", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    one = F.lit(1).cast("long")
    heads = singles.select(
        F.lit(None).cast("binary").alias("node"),
        F.expr(f"substring(chain, (head - 2) * {DIGEST_BYTES} + 1, {DIGEST_BYTES})").alias("parent"),
        F.col("head").alias("depth"),
        F.col("conv_id").alias("owner"),
        one.alias("n_convs"),
        (F.col("head") < F.col("n")).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("head") == F.col("n"), F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_sha256"),
    )
    exact = nodes.join(end_hashes(members(cut)), "node", "left").select("node", *kind, "ends_sha256")
    children = heads.unionByName(exact).withColumn(
        # Nothing comes before the root; a first turn's parent is the root, without bytes.
        "parent",
        F.when(F.col("depth") == 1, F.lit(b"")).otherwise(F.col("parent")),
    )
    parents = nodes.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"))
    named = children.join(parents, "parent", "left")
    out = ["owner", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tails = singles.filter("head < n").select(
        F.col("conv_id").alias("owner"),
        F.explode(F.sequence(F.col("head") + 1, F.col("n"))).alias("depth"),
        F.col("conv_id").alias("parent_conv_id"),
        one.alias("n_convs"),
        "n",
    )
    local = tails.select(
        "owner", "depth", "parent_conv_id", "n_convs",
        (F.col("depth") < F.col("n")).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("n"), F.sha2(F.col("owner").cast("string"), 256)).alias("ends_sha256"),
    )
    every = named.select(*out).unionByName(local)
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))).withColumnRenamed(
        "owner", "conv_id"
    )


ORACLE = """
WITH bytes AS (
  SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
  FROM range(256) AS r(i)
), crc AS (SELECT list(t ORDER BY i) AS t FROM bytes),
turns AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
  SELECT conv_id, l, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc.t[xor(c, b) % 256 + 1])), 4294967295) % 6 AS h
  FROM turns, crc
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l
  FROM hashed a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 100
), prefixes AS (
  SELECT conv_id, d, len(l) = d AS ends, l[1:d] AS seq,
    CASE WHEN d > 0 THEN l[1:d - 1] END AS parent, CASE WHEN d > 0 THEN length(l[d].x) ELSE 0 END AS chars
  FROM rebuilt, range(len(l) + 1) AS t(d)
), nodes AS (
  SELECT seq, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY seq, d
), children AS (SELECT parent AS seq, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
grown AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.seq = c.seq AND n.d = c.d
), sums AS (
  SELECT u.seq[1:t.d] AS seq, t.d, count(*) FILTER (u.n_children = 0) AS n_leaves,
    CAST(sum((u.n_convs - 1) * u.chars) AS BIGINT) AS saved_tokens
  FROM grown u, range(u.d + 1) AS t(d) GROUP BY 1, 2
)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children,
  s.n_leaves, s.saved_tokens, g.ends_sha256
FROM grown g JOIN sums s ON g.seq = s.seq AND g.d = s.d
LEFT JOIN nodes p ON p.seq = g.parent AND p.d = g.d - 1
"""
