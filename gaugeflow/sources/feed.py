"""A message feed kept as files: topic partitions, offsets, headers, and batches closed by rule.

Producers append (``Feed.append``), consumers read ranges of offsets (``Feed.rows``) and learn of
them from a stream (``Feed.spans``). Spark writes and reads all messages; an append then gets
one entry in the feed's log, written in one file under a claim. The entry says which
offset each new file starts at, so the offset of a message is that of its file plus its place in
it: nothing is ranked or written twice, and an append without an entry - of a job that
died - has added nothing. One key keeps to one partition, where its order is kept.

The stream's rows are the ranges themselves, one per partition, planned on the driver from the
log. A batch closes at ``max_messages``; else, once a message waits, after ``linger_s`` or as soon
as ``quiet_s`` passed without a new one, whichever comes first. Progress is in the query's checkpoint: a
batch that was planned is replayed with the same messages. A new query starts at the earliest
message or after an entry of the log, such as the newest.

The planner runs in a Python process without Spark and lists the log with ``pyarrow.fs``. It opens
entries it has not planned yet, never the whole log.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from gaugeflow import vocab
from gaugeflow.schemas import HEADERS, MESSAGES
from gaugeflow.session import ship
from gaugeflow.sources import folders

SPANS_FORMAT = "feed_spans"
SPANS = "partition int, first long, until long, low long, high long, closed_by string"
_LINES = "partition int, first long, count long, append string, file string"
_DATA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", HEADERS),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("partition", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class Closing:
    """When a batch ends."""

    max_messages: int = vocab.BATCH_MESSAGES
    linger_s: float = 2.0
    quiet_s: float = 0.1


@dataclass(frozen=True)
class Feed:
    """One topic under one root folder, which all executors share."""

    spark: SparkSession
    root: str
    topic: str = vocab.READINGS_TOPIC
    partitions: int = 3

    def _path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def _entry_path(self, number: int) -> str:
        return self._path("log", f"entry={number:012d}")

    def last_entry(self) -> int:
        """The number of the newest entry, 0 before the first."""
        names = folders.children(self.spark, self._path("log"))
        numbers = [int(name.removeprefix("entry=")) for name in names if name.startswith("entry=")]
        # Entries are written one at a time; only the newest may be that of a job that died.
        for number in sorted(numbers, reverse=True):
            if any(part.startswith("part-") for part in folders.children(self.spark, self._entry_path(number))):
                return number
        return 0

    def heads(self, entry: int) -> dict[int, int]:
        """The next offset of every partition after an entry: a row per partition."""
        if not entry:
            return {}
        return {r["partition"]: r["head"] for r in self._heads(entry).collect()}

    def _heads(self, entry: int) -> DataFrame:
        lines = self.spark.read.schema(_LINES).json(self._entry_path(entry))
        return lines.groupBy("partition").agg(F.max(F.col("first") + F.col("count")).alias("head"))

    def append(self, messages: DataFrame) -> int:
        """Append keyed messages (key, value and, if there are any, headers); how many they were.

        Messages without a key are dealt to partitions by their place.
        """
        name = uuid.uuid4().hex
        place = F.monotonically_increasing_id()
        headers: Column = F.col("headers") if "headers" in messages.columns else F.lit(None)
        key = F.col("key").cast("binary")
        rows = messages.select(
            key.alias("key"),
            F.col("value").cast("binary").alias("value"),
            headers.cast(HEADERS).alias("headers"),
            F.current_timestamp().alias("timestamp"),
            F.pmod(F.when(key.isNull(), place).otherwise(F.xxhash64(key)), F.lit(self.partitions))
            .cast("int")
            .alias("partition"),
            place.alias("_place"),
        )
        path = self._path("data", f"append={name}")
        rows.sortWithinPartitions("partition", "_place").drop("_place").write.partitionBy("partition").parquet(path)
        data = self.spark.read.schema(_DATA).parquet(path)
        files = data.groupBy("partition", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("count"))
        # A row per file; who appends at the same time waits here.
        with folders.exclusive(self.spark, self._path("claim")):
            last = self.last_entry()
            heads = self._heads(last) if last else None
            lines = self._lines(files, name, heads).persist()
            try:
                added = lines.agg(F.sum("count")).first()[0] or 0
                if added:
                    lines.coalesce(1).write.mode("overwrite").json(self._entry_path(last + 1))
            finally:
                lines.unpersist()
        return added

    def _lines(self, files: DataFrame, name: str, heads: DataFrame | None) -> DataFrame:
        """Where each file starts; a partition without new files keeps its end in a line of none."""
        earlier = Window.partitionBy("partition").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        lines = files.select(
            "partition",
            F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"),
            "count",
            F.lit(name).alias("append"),
            "file",
        )
        if heads is None:
            return lines
        joined = lines.join(heads, "partition", "full_outer")
        return joined.select(
            "partition",
            (F.coalesce("first", F.lit(0)) + F.coalesce("head", F.lit(0))).alias("first"),
            F.coalesce("count", F.lit(0)).alias("count"),
            "append",
            "file",
        )

    def spans(self, closing: Closing | None = None, after: int = 0) -> DataFrame:
        """The stream of batches: per partition the offsets ``first`` to ``until`` (excluded).

        A query without progress of its own starts after the entry ``after``.
        """
        closing = closing or Closing()
        ship(self.spark)
        self.spark.dataSource.register(FeedSpans)
        return (
            self.spark.readStream.format(SPANS_FORMAT)
            .option("log", self._path("log"))
            .option("after", str(after))
            .option("max_messages", str(closing.max_messages))
            .option("linger_s", str(closing.linger_s))
            .option("quiet_s", str(closing.quiet_s))
            .load()
        )

    def rows(self, spans: DataFrame) -> DataFrame:
        """The messages of a batch, with the columns of ``schemas.MESSAGES``.

        The spans are a row per partition; how many files they touch is bounded by the batch.
        """
        return self._rows(spans.sparkSession, spans.collect())

    def _rows(self, spark: SparkSession, ranges: list[Row]) -> DataFrame:
        if not ranges:
            return spark.createDataFrame([], MESSAGES)
        low, high = min(r["low"] for r in ranges), max(r["high"] for r in ranges)
        lines = spark.read.schema(_LINES).json([self._entry_path(n) for n in range(low, high + 1)])
        wanted = F.lit(False)
        for r in ranges:
            own = F.col("partition") == r["partition"]
            wanted = wanted | (own & (F.col("first") < r["until"]) & (F.col("first") + F.col("count") > r["first"]))
        lines = lines.filter("count > 0").filter(wanted)
        appends = [r[0] for r in lines.select("append").distinct().collect()]
        data = (
            spark.read.schema(_DATA)
            .option("basePath", self._path("data"))
            .parquet(*[self._path("data", f"append={name}") for name in appends])
        )
        # A name is that of one append's file in each partition.
        data = data.select(
            "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("_index")
        )
        starts = lines.select("partition", "file", F.col("first").alias("_first"))
        numbered = data.join(starts, ["partition", "file"]).withColumn("offset", F.col("_first") + F.col("_index"))
        inside = F.lit(False)
        for r in ranges:
            own = F.col("partition") == r["partition"]
            inside = inside | (own & F.col("offset").between(r["first"], r["until"] - 1))
        return numbered.filter(inside).withColumn("topic", F.lit(self.topic)).select(*MESSAGES.fieldNames())

    def handle(
        self,
        process: Callable[[DataFrame, int], None],
        done: Callable[[list[Row]], None] | None = None,
    ) -> Callable[[DataFrame, int], None]:
        """What ``foreachBatch`` calls with spans, given what takes a batch of messages.

        ``done`` is then called with the spans. A query's first batch may have none.
        """

        def batch(spans: DataFrame, batch_id: int) -> None:
            ranges = spans.collect()
            if not ranges:
                return
            process(self._rows(spans.sparkSession, ranges), batch_id)
            if done:
                done(ranges)

        return batch


class Log:
    """The feed's log as the planner reads it: entries by number, each a list of lines."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        at = uri.replace("s3a://", "s3://", 1)
        if "://" in at or at.startswith("file:"):
            self.system, self.root = fs.FileSystem.from_uri(at)
        else:
            self.system, self.root = fs.LocalFileSystem(), at
        self.known: dict[int, list[dict]] = {}

    def _children(self, path: str) -> list[str]:
        from pyarrow import fs

        return [info.path for info in self.system.get_file_info(fs.FileSelector(path, allow_not_found=True))]

    def entry(self, number: int) -> list[dict] | None:
        """The lines of an entry; None if it is not there yet."""
        if number not in self.known:
            parts = [
                path for path in self._children(f"{self.root}/entry={number:012d}")
                if path.rsplit("/", 1)[-1].startswith("part-")
            ]
            if not parts:
                return None
            with self.system.open_input_stream(parts[0]) as stream:
                lines = stream.read().decode().splitlines()
            self.known[number] = sorted(
                (line for line in map(json.loads, lines) if line["count"]),
                key=lambda line: (line["partition"], line["first"]),
            )
        return self.known[number]

    def forget(self, before: int) -> None:
        self.known = {n: lines for n, lines in self.known.items() if n >= before}


def take(log: Log, start: dict, most: int) -> tuple[dict, int]:
    """Where a batch of at most ``most`` messages from ``start`` ends, and how many it has."""
    number, taken, count = start["entry"], dict(start["taken"]), 0
    while count < most and (lines := log.entry(number)) is not None:
        for line in lines:
            partition, end = str(line["partition"]), line["first"] + line["count"]
            first = max(line["first"], taken.get(partition, 0))
            n = min(max(end - first, 0), most - count)
            if n:
                taken[partition] = first + n
                count += n
        if all(taken.get(str(line["partition"]), 0) >= line["first"] + line["count"] for line in lines):
            number += 1
        else:
            break
    return {"entry": number, "taken": dict(sorted(taken.items())), "closed_by": ""}, count


def close(
    log: Log,
    start: dict,
    closing: Closing,
    clock: Callable[[], float] = time.monotonic,
    sleep: Callable[[float], None] = time.sleep,
) -> dict:
    """The end of the batch that begins at ``start``; ``start`` itself if no message waits."""
    end, count = take(log, start, closing.max_messages)
    if not count:
        return start
    first_seen = clock()
    while count < closing.max_messages:
        left = first_seen + closing.linger_s - clock()
        if left <= 0:
            return end | {"closed_by": "linger"}
        sleep(min(closing.quiet_s, left))
        before = count
        end, count = take(log, start, closing.max_messages)
        if count == before and left > closing.quiet_s:
            return end | {"closed_by": "quiet"}
    return end | {"closed_by": "count"}


def spans_between(log: Log, start: dict, end: dict) -> list[tuple]:
    """A row of ``SPANS`` for every partition that has messages between two offsets."""
    if start["entry"] == end["entry"] and start["taken"] == end["taken"]:
        return []
    begins: dict[str, int] = {}
    touched: list[int] = []
    for number in range(start["entry"], end["entry"] + 1):
        for line in log.entry(number) or []:
            partition = str(line["partition"])
            first = max(line["first"], start["taken"].get(partition, 0))
            if first < min(line["first"] + line["count"], end["taken"].get(partition, 0)):
                begins.setdefault(partition, first)
                touched.append(number)
    return [
        (int(partition), first, end["taken"][partition], min(touched), max(touched), end["closed_by"])
        for partition, first in sorted(begins.items())
    ]


class FeedSpans(DataSource):
    """The stream behind ``Feed.spans``."""

    @classmethod
    def name(cls) -> str:
        return SPANS_FORMAT

    def schema(self) -> str:
        return SPANS

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return SpanReader(self.options)


class SpanReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.log = Log(options["log"])
        self.after = int(options["after"])
        self.closing = Closing(
            int(options["max_messages"]), float(options["linger_s"]), float(options["quiet_s"])
        )

    def initialOffset(self) -> dict:
        return {"entry": self.after + 1, "taken": {}, "closed_by": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = close(self.log, start, self.closing)
        return iter(spans_between(self.log, start, end)), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(spans_between(self.log, start, end))

    def commit(self, end: dict) -> None:
        self.log.forget(end["entry"] - 1)
