"""Ingest: decode, quarantine, store once, announce - one micro-batch at a time.

Delivery is at least once; every step of a batch is idempotent, in this order: dead letters,
sensors, readings, change event, metrics. A replayed batch overwrites its own dead letters,
finds its sensors and readings stored, and announces the same event again. Nothing is held
only in memory between steps: what a step needs from an earlier one is read back from the
written table, so a lost executor costs a recomputation and never a result.

The checkpoint keeps the feed's progress. Several queries may write the same tables if their
feeds share no reading; sensors and ids are given out under a claim.
"""

from __future__ import annotations

import logging
import socket
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import (
    AnalysisException,
    IllegalArgumentException,
    PySparkException,
    PythonException,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeflow import vocab
from gaugeflow.operators import announce, catalogue, dedup
from gaugeflow.operators.announce import number_spans
from gaugeflow.operators.decode import decode_messages
from gaugeflow.operators.metrics import metric_rows
from gaugeflow.plans.newest import KeptLatest
from gaugeflow.session import tune
from gaugeflow.sources import folders
from gaugeflow.sources.feed import Closing, Feed
from gaugeflow.sources.tables import Tables, day_column
from gaugeflow.streaming.jobs import batch_name, start_batches, start_spans, utc_now

log = logging.getLogger(__name__)

_TRANSIENT_JAVA = ("SocketException", "SocketTimeoutException", "TimeoutException",
                   "ConnectException", "SQLTransient")

# How Spark reports a job that died of lost executors or lost shuffle files.
_LOST_EXECUTOR = ("ExecutorLostFailure", "FetchFailed")
# How object stores report that they are busy for the moment.
_BUSY_STORE = ("503 Slow Down", "SlowDown", "503 Service Unavailable", "Throttling", "429 Too Many")
# How Spark reports a job that somebody stopped.
_STOPPED = ("SPARK_JOB_CANCELLED", "was cancelled", "InterruptedException", "SparkContext was shut down",
            "SparkContext has been shutdown")
# Mistakes in the job itself: no message is to blame, and a retry would fail alike.
_FAULTS = (AnalysisException, IllegalArgumentException, PythonException, TypeError, ValueError,
           LookupError, AttributeError, NameError, AssertionError, ImportError)


@dataclass(frozen=True)
class RetryPolicy:
    """Capped exponential backoff for transient failures of the write."""

    attempts: int = vocab.MAX_ATTEMPTS
    base_ms: int = vocab.BACKOFF_BASE_MS
    max_ms: int = vocab.BACKOFF_MAX_MS
    sleep: Callable[[float], None] = time.sleep

    def delay_s(self, attempt: int) -> float:
        return min(self.base_ms * 2 ** (attempt - 1), self.max_ms) / 1000.0


@dataclass
class BatchReport:
    """What became of one batch."""

    batch: str
    consumed: int = 0
    decoded: int = 0
    inserted: int = 0
    dead_letters: int = 0
    retries: int = 0
    stored: bool = True
    announced: int = 0
    # Earlier batches whose events this one has published.
    sent_later: int = 0

    @property
    def duplicates_skipped(self) -> int:
        return self.decoded - self.inserted if self.stored else 0


@dataclass
class Ingest:
    """The ingest job over one set of tables.

    ``publish`` also sends the change events of a batch elsewhere, and ``reject`` its dead
    letters, for example to Kafka:
    ``lambda m: messages.write_kafka(m, servers, vocab.DEAD_LETTER_TOPIC)``. Failing to
    publish is let pass; failing to reject stops the query, since a letter must not be lost.
    """

    tables: Tables
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    clock: Callable[[], datetime] = utc_now
    publish: Callable[[DataFrame], None] | None = None
    reject: Callable[[DataFrame], None] | None = None
    # Called with every batch's report; the metrics table holds the same numbers.
    report: Callable[[BatchReport], None] | None = None

    def start(
        self,
        messages: DataFrame,
        checkpoint: str,
        drain: bool = False,
        linger: str = vocab.BATCH_LINGER,
    ) -> StreamingQuery:
        """Run on a message stream; ``drain`` stops after what is there now."""
        return start_batches(messages, self.process, checkpoint, drain, linger)

    def start_feed(
        self, feed: Feed, checkpoint: str, closing: Closing | None = None, drain: bool = False
    ) -> StreamingQuery:
        """Run on a feed, in batches that close by count, linger or quiet.

        ``drain`` returns when what is there now is stored.
        """
        return start_spans(feed.spans(closing), feed.handle(self.process), checkpoint, drain)

    def process(self, messages: DataFrame, batch_id: int) -> None:
        """Handle one micro-batch."""
        done = self.run_batch(messages, batch_name(messages, batch_id))
        if self.report:
            self.report(done)

    def run_batch(self, messages: DataFrame, batch: str) -> BatchReport:
        """Handle a bounded set of messages under a batch name of the caller's choice.

        Running a name again means replaying that batch.
        """
        tune(messages.sparkSession)
        tables = Tables(messages.sparkSession, self.tables.root, may_be_new=True)
        started, clock_started = self.clock(), time.monotonic()
        report = BatchReport(batch)

        # Decoding depends on the bytes alone, so lost cached rows are computed again.
        decoded = decode_messages(messages).persist()
        try:
            bad = F.col("error_detail").isNotNull() | (F.length("name") > vocab.NAME_LENGTH)
            report.consumed, report.dead_letters, newest = decoded.agg(
                F.count("*"), F.count_if(bad), F.max(F.when(~bad, F.unix_micros("collected_at")))
            ).first()
            report.decoded = report.consumed - report.dead_letters
            if report.consumed == 0:
                return report
            report.sent_later = self._empty_outbox(tables, batch)
            if report.dead_letters:
                self._quarantine(tables, decoded.filter(bad), batch, started)
            metrics = [
                (vocab.MESSAGES_CONSUMED, {}, report.consumed),
                (vocab.DEAD_LETTERED, {"reason": vocab.DECODE_FAILED}, report.dead_letters),
            ]
            if report.decoded:
                spans = number_spans(decoded)
                good = announce.with_announcement(decoded.filter(~bad).drop("error_detail"), spans)
                write_started = time.monotonic()
                days = dedup.touched_days(good.select(day_column(F.col("collected_at"))))
                cause = self._store_with_retries(tables, good, spans, days, batch, report)
                report.stored = cause is None
                if report.stored:
                    counts = self._stored_counts(tables, days, batch)
                    report.inserted = counts.agg(F.sum("reading_count")).first()[0] or 0
                    if report.inserted:
                        self._announce(tables, good, counts, batch, report)
                    lag = (self._now_micros() - newest) / 1e6
                    metrics += [
                        (vocab.READINGS_INSERTED, {}, report.inserted),
                        (vocab.DUPLICATES_SKIPPED, {}, report.duplicates_skipped),
                        (vocab.WRITE_DURATION, {}, time.monotonic() - write_started),
                        (vocab.EVENTS_PUBLISHED, {}, report.announced),
                        *([(vocab.CONSUMER_LAG, {}, lag)] if lag >= 0 else []),
                    ]
                else:
                    self._abandon(tables, decoded, batch, started)
                    labels = {"reason": vocab.PERSIST_FAILED, "cause": cause}
                    metrics.append((vocab.DEAD_LETTERED, labels, report.consumed))
            metrics += [
                (vocab.BATCH_RETRIES, {}, report.retries),
                (vocab.BATCHES_PROCESSED, {}, 1),
                (vocab.BATCH_DURATION, {}, time.monotonic() - clock_started),
            ]
            rows = metric_rows(tables.spark, [m for m in metrics if m[2]], started)
            tables.put_batch("metrics", batch, rows.coalesce(1))
            return report
        finally:
            decoded.unpersist()

    # --- steps --------------------------------------------------------------------------

    def _quarantine(
        self, tables: Tables, rejected: DataFrame, batch: str, at: datetime
    ) -> None:
        """Dead letters of messages that carry no reading, or one the table cannot hold.

        A name beyond the column's length is set aside alone, not with its whole batch.
        """
        too_long = F.lit(f"value too long for type character varying({vocab.NAME_LENGTH})")
        reason = F.when(F.col("error_detail").isNull(), vocab.PERSIST_FAILED).otherwise(
            vocab.DECODE_FAILED
        )
        rejected = rejected.withColumns(
            {"_reason": reason, "_detail": F.coalesce("error_detail", too_long)}
        )
        letters = announce.dead_letters(rejected, F.col("_reason"), at, "_detail")
        self._set_aside(tables, f"{batch}-{vocab.DECODE_FAILED}", letters)

    def _abandon(self, tables: Tables, decoded: DataFrame, batch: str, at: datetime) -> None:
        """Dead letters of a batch that could not be stored: every message of it."""
        rows = decoded.withColumn("error_detail", F.lit(vocab.BATCH_NOT_STORED))
        letters = announce.dead_letters(rows, vocab.PERSIST_FAILED, at)
        self._set_aside(tables, f"{batch}-{vocab.PERSIST_FAILED}", letters)

    def _set_aside(self, tables: Tables, name: str, letters: DataFrame) -> None:
        tables.put_batch("dead_letters", name, letters)
        if self.reject:
            self.reject(tables.batch_rows("dead_letters", name).drop("batch"))

    def _store_with_retries(
        self,
        tables: Tables,
        good: DataFrame,
        spans: DataFrame,
        days: list[date],
        batch: str,
        report: BatchReport,
    ) -> str | None:
        """Store the batch; the kind of error when it cannot be stored at all.

        A stopped job and a mistake in the job are no failed writes: they end the query, and
        the batch is replayed when it starts again.
        """
        attempt = 1
        while True:
            try:
                self.store(tables, good, spans, days, batch, report.decoded)
                return None
            except Exception as error:  # noqa: BLE001 - the rule decides, not the type
                if is_stopped(error) or is_fault(error):
                    raise
                if not is_transient(error) or attempt == self.retry.attempts:
                    log.exception("Batch %s cannot be stored; it is set aside.", batch)
                    return type(error).__name__
                log.warning("Batch %s: attempt %s failed, trying again.", batch, attempt, exc_info=True)
                report.retries += 1
                self.retry.sleep(self.retry.delay_s(attempt))
                attempt += 1

    def store(
        self,
        tables: Tables,
        good: DataFrame,
        spans: DataFrame,
        days: list[date],
        batch: str,
        rows: int,
    ) -> None:
        """Append the sensors and readings the tables do not hold yet."""
        self._create_sensors(tables, good)
        keyed = catalogue.with_sensor_id(good, tables.sensors()).withColumn(
            "collected_date", day_column(F.col("collected_at"))
        )
        distinct = dedup.first_arrivals(keyed, dedup.READING_KEY)
        fresh = dedup.without_stored(distinct, tables.readings_of(days), keys=rows)
        first = self._reserve(tables, spans, batch)
        numbered = (
            fresh.join(spans, ["topic", "partition"])
            .withColumn("id", F.lit(first) + F.col("before") + F.col("offset") - F.col("low"))
            .withColumn("ingest_batch", F.concat_ws("/", F.lit(batch), "announcement"))
        )
        with KeptLatest(tables).writing(days, batch):
            tables.append_readings(numbered)

    def _create_sensors(self, tables: Tables, good: DataFrame) -> None:
        """Add the sensors that the catalogue lacks, one id per pair however many writers there are.

        Only a batch with new sensors claims the catalogue. What it lacks is asked again under
        the claim: another writer may have added the same ones meanwhile.
        """
        if catalogue.unknown_sensors(good, tables.sensors()).isEmpty():
            return
        with folders.exclusive(tables.spark, tables.claim_path("sensors")):
            known = tables.sensors()
            unknown = catalogue.unknown_sensors(good, known)
            expected = unknown.count()
            if expected:
                last = known.agg(F.max("id")).first()[0] or 0
                tables.append_sensors(catalogue.number_sensors(unknown, last, expected))

    def _reserve(self, tables: Tables, spans: DataFrame, batch: str) -> int:
        """Reserve ids for the batch before using them; an abandoned range stays unused."""
        width = spans.agg(F.sum("width")).first()[0]
        with folders.exclusive(tables.spark, tables.claim_path("id_ranges")):
            first = tables.id_ranges().agg(F.max("next_id")).first()[0] or 1
            row = tables.spark.range(1).select(
                F.lit(first).cast("bigint").alias("first_id"),
                F.lit(first + width).cast("bigint").alias("next_id"),
            )
            row.write.mode("append").parquet(f"{tables.path('id_ranges')}/batch={batch}")
        return first

    def _stored_counts(self, tables: Tables, days: list[date], batch: str) -> DataFrame:
        """Readings this batch stored, per announcement, read back from the table."""
        return (
            tables.readings_of(days)
            .filter(F.col("ingest_batch").startswith(f"{batch}/"))
            .groupBy(F.substring("ingest_batch", len(batch) + 2, 1 << 20).alias("announcement"))
            .agg(F.count("*").alias("reading_count"))
        )

    def _announce(
        self,
        tables: Tables,
        good: DataFrame,
        counts: DataFrame,
        batch: str,
        report: BatchReport,
    ) -> None:
        """Publish the change events; a failure here never fails the batch.

        A batch is in the outbox from before its events are written until they are published;
        what a failure leaves there is sent by the next batch.
        """
        folders.mark(tables.spark, tables.outbox_path(batch))
        events = announce.event_value(
            announce.change_events(good, counts, self.clock())
        ).select("value")
        try:
            tables.put_batch("change_events", batch, events)
            self._publish(tables, batch)
            report.announced = counts.filter(F.col("reading_count") > 0).count()
        except Exception as error:  # noqa: BLE001 - the rows are stored; only the signal is lost
            if is_stopped(error):
                raise
            log.exception("Batch %s is stored, but its change events are not published.", batch)
            report.announced = 0

    def _publish(self, tables: Tables, batch: str) -> None:
        if self.publish:
            self.publish(tables.batch_rows("change_events", batch).select("value"))
        folders.delete(tables.spark, tables.outbox_path(batch))

    def _empty_outbox(self, tables: Tables, batch: str) -> int:
        """Send what earlier batches could not, oldest first; how many batches that were.

        Events that could not even be written are made again from the stored readings. It stops
        at the first that fails again, so that the order is kept.
        """
        sent = 0
        for pending in folders.children(tables.spark, tables.outbox_path()):
            if pending == batch:
                continue
            try:
                if not folders.exists(tables.spark, f"{tables.path('change_events')}/batch={pending}"):
                    stored = tables.readings().filter(F.col("ingest_batch").startswith(f"{pending}/"))
                    events = announce.stored_events(stored, tables.sensors(), self.clock())
                    tables.put_batch("change_events", pending, announce.event_value(events).select("value"))
                self._publish(tables, pending)
            except Exception as error:  # noqa: BLE001 - as in _announce
                if is_stopped(error):
                    raise
                log.exception("Batch %s stays in the outbox.", pending)
                break
            sent += 1
        return sent

    def _now_micros(self) -> int:
        return int(self.clock().timestamp() * 1_000_000)


def _chain(error: BaseException | None):
    """An error and what caused it."""
    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        yield error
        error = error.__cause__ or error.__context__


def is_stopped(error: BaseException) -> bool:
    """Whether somebody stopped the job: the batch has not failed, it has not ended."""
    return any(
        isinstance(e, InterruptedError)
        or (
            isinstance(e, (PySparkException, Py4JJavaError))
            and any(sign in str(e) for sign in _STOPPED)
        )
        for e in _chain(error)
    )


def is_fault(error: BaseException) -> bool:
    """Whether the job is wrong, not the write: unless it hides a fault that may pass."""
    return isinstance(error, _FAULTS) and not is_transient(error)


def is_transient(error: BaseException | None) -> bool:
    """Whether a failed write is worth another try.

    Walks the chain of causes, Python's and the JVM's, for a database state on the list, a
    connection fault, a timeout, a busy object store, or a job that lost its executors.
    Anything not recognised is permanent.
    """
    for error in _chain(error):
        state = getattr(error, "sqlstate", None) or getattr(error, "pgcode", None)
        if isinstance(error, PySparkException):
            state = error.getSqlState()
        if state in vocab.TRANSIENT_SQLSTATES:
            return True
        if isinstance(error, (ConnectionError, TimeoutError, socket.gaierror, socket.herror)):
            return True
        if isinstance(error, (PySparkException, Py4JJavaError)) and any(
            sign in str(error) for sign in (*_LOST_EXECUTOR, *_BUSY_STORE)
        ):
            return True
        if isinstance(error, Py4JJavaError) and _java_transient(error.java_exception):
            return True
    return False


def _java_transient(error: object) -> bool:
    for _ in range(50):
        if error is None:
            return False
        name = error.getClass().getName()
        if any(part in name for part in _TRANSIENT_JAVA):
            return True
        if "SQLException" in name and error.getSQLState() in vocab.TRANSIENT_SQLSTATES:
            return True
        error = error.getCause()
    return False

__all__ = [
    "BatchReport",
    "Ingest",
    "RetryPolicy",
    "is_fault",
    "is_stopped",
    "is_transient",
    "number_spans",
]
