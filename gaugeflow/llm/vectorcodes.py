"""Vector codes: product quantisation in integers, by dictionaries of the values of a dimension.

A component x becomes the integer floor(256 x). Vectors are held as blocks of rows: per block
and dimension a dictionary of the distinct integers, and per vector the codes of its values in
them. For a codebook, the squared differences of every dictionary value to that dimension of
all entries are tabulated once a block; the distances of a part are then gathers from its
dimensions' tables by the codes, added up. No difference is computed per vector.

Codebooks start as the parts of the vectors with the smallest ids (``ENTRIES`` of them, in the
order of id, then of the vector; null ids last). In each round every part goes to its nearest
entry, ties to the lower index; sums and counts are added up per task, then over tasks, one
row per entry at most, and an entry becomes floor(sum / count); an unused entry stays.

Rows whose vector is null, empty, or holds a null or non-finite component are dropped, and so
are rows whose length is not that of the vector with the smallest id. A length that is no
multiple of the number of parts is filled up with zeros. Components beyond 2**26 / 256 count
as that, so that errors fit a long. Repeated rows are rows of their own; of fewer vectors than
entries the codebook has as many entries; an empty table gives no rows. Labels may be null and
are one label then. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ready, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 26
# Vectors of a block: two bytes hold a code, and a part's tables stay small.
BLOCK_ROWS = 4096
# A label's rows lie in so many groups when they meet their sum, so that none is a single task's.
SALTS = 16

_BLOCK = pa.schema(
    [
        ("ids", pa.list_(pa.int64())),
        ("labels", pa.list_(pa.int64())),
        ("values", pa.binary()),
        ("sizes", pa.list_(pa.int32())),
        ("codes", pa.binary()),
    ]
)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, vector of the rows that can be coded."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform(x, lambda v: v.cast("double")).alias("vector"),
    )


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors * SCALE), -LARGEST, LARGEST).astype(np.int64)


@dataclass
class Coded:
    """A block of vectors: ``codes[i, d]`` is the place of a value in ``dictionaries[d]``."""

    dictionaries: list[np.ndarray]
    codes: np.ndarray

    @classmethod
    def of(cls, found: np.ndarray) -> Coded:
        both = [np.unique(found[:, d], return_inverse=True) for d in range(found.shape[1])]
        codes = np.stack([inverse.reshape(-1) for _, inverse in both], axis=1).astype(np.uint16)
        return cls([values for values, _ in both], codes)

    def part(self, part: int, width: int) -> np.ndarray:
        """The integers of one part again."""
        dims = range(part * width, (part + 1) * width)
        return np.stack([self.dictionaries[d][self.codes[:, d]] for d in dims], axis=1)

    def nearest(self, part: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance to it, for every vector."""
        width = entries.shape[1]
        total: np.ndarray | None = None
        for k in range(width):
            d = part * width + k
            squares = (self.dictionaries[d][:, None] - entries[None, :, k]) ** 2
            gathered = squares[self.codes[:, d]]
            total = gathered if total is None else np.add(total, gathered, out=total)
        index = total.argmin(axis=1)
        return index, total[np.arange(len(index)), index]


def coded_blocks(rows: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """Blocks of dictionary-coded vectors, as a written table."""
    ready(rows.sparkSession)
    length = width * parts

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            coded = Coded.of(np.concatenate([v for _, _, v in held]))
            row = {
                "ids": [i for ids, _, _ in held for i in ids],
                "labels": [x for _, labels, _ in held for x in labels],
                "values": np.concatenate(coded.dictionaries).astype("<i8").tobytes(),
                "sizes": [len(d) for d in coded.dictionaries],
                "codes": coded.codes.astype("<u2").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], _BLOCK)

        for batch in batches:
            column = batch.column("vector")
            n = len(batch)
            found = np.zeros((n, length), np.int64)
            if n:
                flat = np.asarray(column.flatten(), np.float64).reshape(n, -1)
                found[:, : flat.shape[1]] = integers(flat)
            ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
            for low in range(0, n, BLOCK_ROWS):
                cut = slice(low, low + BLOCK_ROWS)
                if held and sum(len(i) for i, _, _ in held) + len(ids[cut]) > BLOCK_ROWS:
                    yield block()
                    held = []
                held.append((ids[cut], labels[cut], found[cut]))
        if held:
            yield block()

    schema = "ids array<long>, labels array<long>, values binary, sizes array<int>, codes binary"
    return written(rows.select("vec_id", "label", "vector").mapInArrow(packed, schema), "coded-vectors")


def opened(batch: pa.RecordBatch) -> Iterator[tuple[list, list, Coded]]:
    """ids, labels and vectors of the blocks of an Arrow batch."""
    for row in batch.to_pylist():
        values = np.frombuffer(row["values"], "<i8").astype(np.int64)
        dictionaries = np.split(values, np.cumsum(row["sizes"])[:-1])
        codes = np.frombuffer(row["codes"], "<u2").reshape(-1, len(row["sizes"]))
        yield row["ids"], row["labels"], Coded(dictionaries, codes)


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """(part, entry, place) of the vectors with the smallest ids; None without vectors."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return None
    length = len(first[0]["vector"])
    same = rows.filter(F.size("vector") == length)
    seeds = same.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    width = -(-length // parts)
    found = np.zeros((len(seeds), width * parts), np.int64)
    found[:, :length] = integers(np.array([s["vector"] for s in seeds], np.float64))
    return np.ascontiguousarray(found.reshape(len(seeds), parts, width).transpose(1, 0, 2))


def moved(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: a row per used entry comes to the driver, no more."""
    parts, entries, width = codebooks.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, _, coded in opened(batch):
                for part in range(parts):
                    index, _ = coded.nearest(part, codebooks[part])
                    counts[part] += np.bincount(index, minlength=entries)
                    np.add.at(sums[part], index, coded.part(part, width))
        part, entry = np.nonzero(counts)
        place = np.tile(np.arange(width), len(part))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, width)), pa.array(np.repeat(entry, width)), pa.array(place),
                pa.array(np.repeat(counts[part, entry], width)), pa.array(sums[part, entry].reshape(-1)),
            ],
            ["part", "entry", "place", "n", "total"],
        )

    rows = (
        blocks.mapInArrow(summed, "part long, entry long, place long, n long, total long")
        .groupBy("part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        .collect()
    )
    new = codebooks.copy()
    for r in rows:
        new[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return new


def compressed(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector."""
    parts = len(codebooks)
    digits = np.array([f"{i:02x}" for i in range(256)], "S2")

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, coded in opened(batch):
                error = np.zeros(len(ids), np.int64)
                index = np.zeros((len(ids), parts), np.int64)
                for part in range(parts):
                    index[:, part], distance = coded.nearest(part, codebooks[part])
                    error += distance
                code = np.ascontiguousarray(digits[index]).view(f"S{2 * parts}").reshape(-1).astype(str)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(code, pa.string()), pa.array(error)],
                    ["vec_id", "label", "code", "error"],
                )

    return blocks.mapInArrow(assigned, "vec_id long, label long, code string, error long")


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def trained(
    vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray] | None:
    """The coded blocks of all usable vectors and the codebooks; None without any."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    rows = usable(vectors, vector)
    codebooks = first_codebooks(rows, parts, entries)
    if codebooks is None:
        return None
    width = codebooks.shape[2]
    length = len(rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").first()["vector"])
    blocks = coded_blocks(rows.filter(F.size("vector") == length), width, parts)
    for _ in range(rounds):
        codebooks = moved(blocks, codebooks)
    return blocks, codebooks


def decoded(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id and the vector that its code stands for, as integers of 1/256."""
    parts, _, width = codebooks.shape

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.array([list(bytes.fromhex(c)) for c in batch.column("code").to_pylist()], np.int64)
            found = codebooks[np.arange(parts)[None], index.reshape(-1, parts)].reshape(len(index), parts * width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(list(found), pa.list_(pa.int64()))], ["vec_id", "vector"]
            )

    return codes.select("vec_id", "code").mapInArrow(looked_up, "vec_id long, vector array<long>")


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    made = trained(vectors)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if made is None:
        return vectors.sparkSession.createDataFrame([], schema)
    blocks, codebooks = made
    codes = written(compressed(blocks, codebooks), "vector-codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.alias("c").join(
        spread.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")) & (F.col("c.salt") == F.col("s.salt"))
    )
    return joined.select(
        "c.vec_id", "c.code", "c.error", "s.label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256")
    )


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``digest``, by plain differences."""
    steps = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT r, vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS w
  FROM kept, range({parts}) AS t(p)
), book0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, w) - 1 AS e, w FROM cut
  WHERE r IN (SELECT r FROM kept ORDER BY vec_id, v LIMIT {entries})
)"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS (
  SELECT r, p, e, d FROM (
    SELECT c.r, c.p, b.e,
      list_sum(list_transform(list_zip(c.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM cut c JOIN book{k} b ON c.p = b.p)
  QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1
)"""
        )
        if k < rounds:
            steps.append(
                f"""sums{k} AS (
  SELECT p, e, i, CAST(sum(w[i]) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT n.p, n.e, c.w, unnest(range(1, len(c.w) + 1)) AS i FROM near{k} n JOIN cut c ON n.r = c.r AND n.p = c.p)
  GROUP BY p, e, i
), book{k + 1} AS (
  SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM book{k} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM sums{k} GROUP BY p, e) m
  ON b.p = m.p AND b.e = m.e
)"""
            )
    steps.append(
        f"""done AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY r
), named AS (SELECT vec_id, label, code, error FROM done JOIN kept USING (r)),
labelled AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM named GROUP BY label)"""
    )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT n.vec_id, n.code, n.error, l.label_error,
  (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM named n JOIN labelled l ON n.label IS NOT DISTINCT FROM l.label
"""
    )
