"""Token ids in files of variable-length integers, frequent ids short.

Ids are replaced by their rank in the whole corpus's frequency order (ties by id). A rank takes
one to four bytes; its length minus one goes into two bits of a separate control stream, four
ranks to a byte, each document starting a byte of its own. Files are Parquet parts written by
Spark: one row per block of documents, with the control and data streams of the block. The
rank table is kept beside them.

Documents lie in ascending doc_id order (null first, ties by length and content) through all
files. A null text is an empty text: its ids are the end id alone. Rows that repeat a doc_id
each get their own entry. An empty table makes empty files. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import binary, blocks, flat, ragged
from .pretokens import encoder
from .tables import ready, written

END_ID = 2
BUCKET_TOKENS, MOST_BUCKETS = 16 << 20, 4000

# Lengths of the four values that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, their offsets, data bytes, their offsets, for runs of ``counts`` values."""
    values = values.astype("<u4")
    code = (values > 0xFF).astype(np.uint8)
    code += values > 0xFFFF
    code += values > 0xFFFFFF
    groups = -(-counts // 4)
    control_at = np.append(0, np.cumsum(groups))
    padded = np.zeros(int(control_at[-1]) * 4, np.uint8)
    padded[ragged(control_at[:-1] * 4, counts)] = code
    fours = padded.reshape(-1, 4)
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    if code.max(initial=0) < 2:
        data = values.astype("<u2").view(np.uint8).reshape(-1, 2)
    else:
        data = values.view(np.uint8).reshape(-1, 4)
    data = data[np.arange(data.shape[1]) <= code[:, None]]
    ends = np.append(0, np.cumsum(code, dtype=np.int64) + np.arange(1, len(code) + 1))
    return control, control_at, data, ends[np.append(0, np.cumsum(counts))]


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of all runs, by looking the control bytes up in a table."""
    groups = -(-counts // 4)
    lengths = LENGTHS[control].reshape(-1)[ragged((np.cumsum(groups) - groups) * 4, counts)]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    values = data[at].astype(np.uint32)
    for more in (1, 2, 3):
        longer = np.flatnonzero(lengths > more)
        if not len(longer):
            break
        values[longer] |= data[at[longer] + more].astype(np.uint32) << np.uint32(8 * more)
    return values


@dataclass(frozen=True)
class TokenFiles:
    """``blocks``: the files; ``ranks``: (rank, id); ``before``: ids in the buckets before each."""

    blocks: DataFrame
    ranks: DataFrame
    before: dict[int, int]


def token_ids(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, two bytes where the vocabulary allows, else four)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            found = [np.empty(0, tool.pool.dtype)]
            for block in blocks(batch.column("text")):
                ids, n = tool.encode(block)
                found.append(ids)
                np.add.at(counts, block.rows, n)
            ids = np.insert(np.concatenate(found), np.cumsum(counts), end_id)
            counts += 1
            ends = np.append(0, np.cumsum(counts)) * ids.dtype.itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), binary(ids.view(np.uint8), ends)],
                ["doc_id", "n_tokens", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        encoded, f"doc_id {id_type}, n_tokens long, ids binary"
    )


def _counted(ids: DataFrame, kind: str, vocabulary: int) -> DataFrame:
    """How often each id occurs; every task sums before anything moves."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column("ids"))[0].view(kind), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return ids.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, end_id: int = END_ID) -> TokenFiles:
    """Encode all texts and write the files."""
    spark = docs.sparkSession
    ready(spark)
    tool = encoder(path)
    kind, vocabulary = tool.pool.dtype.str, max(tool.vocabulary, end_id + 1)
    ids = written(token_ids(docs, path, end_id), "token-ids")
    # One row per id of the vocabulary at most.
    frequent = sorted(_counted(ids, kind, vocabulary).collect(), key=lambda r: (-r.n, r.id))
    order = [r.id for r in frequent]
    rank_of = np.zeros(vocabulary, np.uint32)
    rank_of[order] = np.arange(len(order))
    ranks = written(
        spark.createDataFrame(list(enumerate(order)), "rank long, id long").coalesce(1), "token-ranks"
    )
    buckets = int(min(max(sum(r.n for r in frequent) // BUCKET_TOKENS, 1), MOST_BUCKETS))
    shares = [i / buckets for i in range(1, buckets)]
    found = ids.agg(F.percentile_approx("doc_id", shares or [0.5], 20 * buckets)).first()[0] or []
    limits = np.unique(np.array(found, np.int64)) if shares else np.empty(0, np.int64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, _ = flat(batch.column("ids"))
            counts = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            control, control_at, short, short_at = pack(rank_of[data.view(kind)], counts)
            doc_id = batch.column("doc_id")
            known = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(limits, known, "right").astype(np.int32)
            bucket[doc_id.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket), doc_id, pa.array(counts.astype(np.int64)),
                    binary(control, control_at), binary(short, short_at),
                ],
                ["bucket", "doc_id", "n_tokens", "control", "data"],
            )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before = None, 0
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if bucket[a] != current:
                    current, before = bucket[a], 0
                part = batch.slice(a, b - a)
                n = part.column("n_tokens")
                control, data = (flat(part.column(c))[0].tobytes() for c in ("control", "data"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(current)], pa.int32()), pa.array([before], pa.int64()),
                        pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([n.to_pylist()], pa.list_(pa.int64())),
                        pa.array([control], pa.binary()), pa.array([data], pa.binary()),
                    ],
                    ["bucket", "before", "doc_id", "n_tokens", "control", "data"],
                )
                before += int(np.sum(n.to_numpy()))

    rows = ids.mapInArrow(
        packed, "bucket int, doc_id long, n_tokens long, control binary, data binary"
    )
    # Every bucket is a range of doc_ids and lies in one task, in order.
    placed = rows.repartition(2 * buckets, "bucket").sortWithinPartitions(
        "bucket", "doc_id", "n_tokens", "control", "data"
    )
    files = written(
        placed.mapInArrow(
            joined,
            "bucket int, before long, doc_id array<long>, n_tokens array<long>, control binary, data binary",
        ),
        "token-files",
    )
    sums = files.select("bucket", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = {r.bucket: r.n for r in sums.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    before, at = {}, 0
    for bucket in sorted(totals):
        before[bucket] = at
        at += totals[bucket]
    return TokenFiles(files, ranks, before)


def read(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian, four bytes) of every document."""
    return files.blocks.mapInArrow(
        _reader(files, lambda ids: ids), "doc_id long, start long, n_tokens long, ids binary"
    )


def digests(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids, without handing the ids on."""
    return files.blocks.mapInArrow(
        _reader(files, zlib.crc32), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _reader(files: TokenFiles, use):
    id_of = np.zeros(max(files.ranks.count(), 1), "<u4")
    for r in files.ranks.collect():  # one row per id of the vocabulary at most
        id_of[r.rank] = r.id
    first = files.before
    last = pa.binary() if use(b"") == b"" else pa.int64()
    name = "ids" if last == pa.binary() else "ids_crc32"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = batch.column("n_tokens")[i].values.to_numpy(zero_copy_only=False)
                streams = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in ("control", "data"))
                ids = id_of[unpack(*streams, counts)].tobytes()
                ends = np.cumsum(counts)
                starts = ends - counts
                before = first[batch.column("bucket")[i].as_py()] + batch.column("before")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i].values, pa.array(starts + before), pa.array(counts),
                        pa.array([use(ids[4 * a : 4 * b]) for a, b in zip(starts, ends)], last),
                    ],
                    ["doc_id", "start", "n_tokens", name],
                )

    return rows
