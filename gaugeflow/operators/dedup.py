"""First-wins deduplication and the conflict-skipping insert."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READING_KEY = ["sensor_id", "collected_at"]
ARRIVAL = ["topic", "partition", "offset"]

# A batch up to this many distinct keys is sent to every task that scans stored keys.
BROADCAST_KEYS = 200_000
# The Bloom filter of a larger batch: three bits a key in words of 64, two million words at most.
KEYS_PER_WORD, BITS_OF_KEY, BLOOM_WORDS = 4, 3, 1 << 21


def first_arrivals(rows: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The first row of every key in arrival order.

    The row-number-one window is cut per map task before the shuffle, so a key with very
    many copies sends one row per task.
    """
    window = Window.partitionBy(*key).orderBy(*(order or ARRIVAL))
    return (
        rows.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def without_stored(
    rows: DataFrame, stored: DataFrame, keys: int | None = None
) -> DataFrame:
    """Rows whose key the table does not hold yet; ``rows`` has each key once.

    ``stored`` should be cut to the days the rows touch - equal keys share a day - and only
    its key columns are read. When ``keys`` (their number, counted by the caller) is small, the stored
    keys are first cut to those the batch also has by a broadcast of the batch keys, so the
    stored table is not shuffled. Of a larger batch a Bloom filter of its keys is sent instead,
    and only the stored keys that pass it are shuffled to meet the batch.
    """
    held = stored.select(*READING_KEY)
    if keys is not None:
        if keys <= BROADCAST_KEYS:
            held = held.join(F.broadcast(rows.select(*READING_KEY)), READING_KEY, "left_semi")
        else:
            held = candidates(held, rows, keys)
    return rows.join(held, READING_KEY, "left_anti")


def candidates(held: DataFrame, rows: DataFrame, keys: int) -> DataFrame:
    """Stored keys that may be among those of the rows: all that are, and few others.

    First the instants are cut to the batch's, so files of other hours are skipped by their
    statistics. Then the keys are looked up in a blocked Bloom filter: a key sets three bits of
    one 64-bit word. The filter has a word per four keys, at most ``BLOOM_WORDS``, which is the bound
    of what is sent to every task; beyond 8 million keys it passes more, never less.
    """
    low, high = rows.agg(F.min("collected_at"), F.max("collected_at")).first()
    if low is not None:
        held = held.filter(F.col("collected_at").between(F.lit(low), F.lit(high)))
    words = min(max(1, -(-keys // KEYS_PER_WORD)), BLOOM_WORDS)
    word, bits = _place(words)
    sent = rows.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(
        F.bit_or("_bits").alias("_set")
    )
    return (
        held.withColumns({"_word": word, "_bits": bits})
        .join(F.broadcast(sent), "_word")
        .filter(F.col("_bits").bitwiseAND(F.col("_set")) == F.col("_bits"))
        .select(*READING_KEY)
    )


def _place(words: int) -> tuple[Column, Column]:
    """Word and bits of a key in a filter of so many words."""
    hashed = F.xxhash64(*READING_KEY)
    # The word comes from one end of the hash, the bits from another hash.
    bit = F.xxhash64(F.lit("bits"), *READING_KEY)
    bits = F.lit(0).cast("bigint")
    for k in range(BITS_OF_KEY):
        at = F.shiftrightunsigned(bit, 6 * k).bitwiseAND(63).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return F.pmod(hashed, F.lit(words)), bits


def touched_days(days: DataFrame) -> list[date]:
    """The distinct days that rows touch, oldest first: one value per day."""
    return sorted(d[0] for d in days.distinct().collect())
