"""Every operator as a query over the given tables, with fixed arguments.

Each takes the session and the folder of the tables. Instants come out as zone-less UTC
values and nested results as rows, so that they compare with plain SQL.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow import bridge, vocab
from gaugeflow.functions import instants, jsontext, labels, thresholds
from gaugeflow.operators import (
    announce,
    buckets,
    catalogue,
    dedup,
    metrics,
    paging,
    readings,
    status,
)
from gaugeflow.operators.decode import decode_messages, split_decoded
from gaugeflow.operators.readings import ReadingFilter
from gaugeflow.plans.console import Console, ConsoleFilter
from gaugeflow.plans.newest import KeptLatest
from gaugeflow.plans.store import ReadingStore
from gaugeflow.schemas import VALUE_COLUMNS
from gaugeflow.session import scratch_dir, tune
from gaugeflow.sources import messages, polls
from gaugeflow.sources.feed import Closing, Feed
from gaugeflow.sources.tables import Tables, day_column, rows_from_arrays
from gaugeflow.streaming import bursts, changes
from gaugeflow.streaming.ingest import Ingest
from gaugeflow.streaming.relay import Relay
from gaugeflow.streaming.upkeep import Upkeep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START = "2024-01-03T10:30:00+00:00"
END = "2024-01-24T17:45:00+00:00"
MIDDLE = instants.normalize("2024-01-16T00:00:00+00:00")
STATUS_NOW = instants.normalize("2024-01-29T12:00:00+00:00")
BEFORE = "2024-01-10T00:00:00+00:00"
PLACE = "loc-7"


def query(f: Query) -> Query:
    """Register a query under its function name."""

    def tuned(spark: SparkSession, folder: str) -> DataFrame:
        return _comparable(f(tune(spark), folder))

    QUERIES[f.__name__] = tuned
    return f


def _comparable(df: DataFrame) -> DataFrame:
    walls = {
        field.name: instants.utc_wall(F.col(field.name))
        for field in df.schema
        if field.dataType.typeName() == "timestamp"
    }
    return df.withColumns(walls) if walls else df


def _store(spark: SparkSession, folder: str, start=None, end=None) -> ReadingStore:
    rows = bridge.readings(spark, folder, instants.normalize(start), instants.normalize(end))
    return ReadingStore(rows, bridge.sensors(spark, folder))


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    return decode_messages(bridge.messages(spark, folder))


def _console(spark: SparkSession, folder: str, **where) -> Console:
    where = {"start": BEFORE, **where}
    return Console(_store(spark, folder), ConsoleFilter(now=STATUS_NOW, **where))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- landed polls and messages ----------------------------------------------------------


@query
def poll_outcomes(spark, folder):
    return polls.classify_polls(bridge.polls(spark, folder)).select(
        "poll_id", "outcome", "next_delay_s"
    )


@query
def poll_readings(spark, folder):
    rows = polls.explode_readings(bridge.polls(spark, folder))
    return rows.select("poll_id", "position", "type", "name", "payload.*", "collected_at").drop(
        "rawJson"
    )


@query
def poll_unknown_payloads(spark, folder):
    rows = polls.explode_readings(bridge.polls(spark, folder)).filter("payload.rawJson IS NOT NULL")
    raw = F.col("payload.rawJson")
    return rows.select(
        "poll_id",
        "position",
        "type",
        F.get_json_object(raw, "$.co2").cast("int").alias("raw_co2"),
        F.get_json_object(raw, "$.motionDetected").alias("raw_motion"),
    )


@query
def reading_messages(spark, folder):
    rows = polls.to_messages(polls.explode_readings(bridge.polls(spark, folder)))
    text = F.col("value").cast("string")
    return rows.select(
        "poll_id",
        "position",
        F.col("key").cast("string").alias("key"),
        F.array_join(F.json_object_keys(text), ",").alias("members"),
        F.array_join(F.json_object_keys(F.get_json_object(text, "$.payload")), ",").alias("fields"),
        F.get_json_object(text, "$.collectedAt").alias("collected_text"),
        F.array_join(
            F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))),
            ";",
        ).alias("headers"),
    )


@query
def decoded_readings(spark, folder):
    good, _ = split_decoded(_decoded(spark, folder))
    return good.select(
        "partition", "offset", "name", "sensor_type", "collected_at", *VALUE_COLUMNS
    )


@query
def decode_failures(spark, folder):
    _, rejected = split_decoded(_decoded(spark, folder))
    return rejected.select("partition", "offset", "error_detail")


@query
def dead_letter_headers(spark, folder):
    _, rejected = split_decoded(_decoded(spark, folder))
    letters = announce.dead_letters(rejected, vocab.DECODE_FAILED, bridge.NOW)
    source = F.map_from_entries("headers")[vocab.DLQ_OFFSET].cast("string").cast("bigint")
    return letters.select(
        source.alias("source_offset"), F.posexplode("headers").alias("position", "header")
    ).select(
        "source_offset",
        "position",
        F.col("header.key").alias("header"),
        F.col("header.value").cast("string").alias("value"),
    )


@query
def sensor_type_spellings(spark, folder):
    rows = bridge.with_reading(bridge.events(spark, folder))
    spelt = (
        F.when(F.col("event_type") == "click", F.upper("sensor_type"))
        .when(F.col("event_type") == "error", F.lit("2"))
        .otherwise(F.col("sensor_type"))
    )
    return rows.select(
        "event_id", spelt.alias("spelling"), labels.is_sensor_type(spelt).alias("known")
    )


@query
def normalized_instants(spark, folder):
    rows = bridge.events(spark, folder)
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("9+02:00"))
    return rows.select("event_id", instants.parse_wire_instant(text).alias("collected_at"))


@query
def next_offsets(spark, folder):
    return announce.next_offsets(bridge.messages(spark, folder))


@query
def upstream_traces(spark, folder):
    return announce.upstream_traces(bridge.messages(spark, folder))


@query
def batch_lag(spark, folder):
    good, _ = split_decoded(_decoded(spark, folder))
    return announce.newest_lag(good, bridge.NOW)


@query
def rows_from_parallel_arrays(spark, folder):
    rows = bridge.with_reading(bridge.events(spark, folder))
    packed = (
        rows.groupBy(instants.floor_div(F.col("event_id"), bridge.POLL_SIZE).alias("pack"))
        .agg(F.array_sort(F.collect_list(F.struct("id", "sensor_id", "collected_at", "co2"))).alias("r"))
        .select(*[F.col(f"r.{c}").alias(c) for c in ("id", "sensor_id", "collected_at", "co2")])
    )
    return rows_from_arrays(packed, {c: c for c in packed.columns})


# --- listings ---------------------------------------------------------------------------


@query
def flat_readings(spark, folder):
    store = _store(spark, folder)
    return readings.with_sensor(store.readings, store.sensors)


@query
def nested_readings(spark, folder):
    store = _store(spark, folder)
    nested = readings.with_nested_sensor(store.readings, store.sensors)
    return nested.select(
        "id",
        F.col("sensor.id").alias("sensor_id"),
        F.col("sensor.name").alias("sensor_name"),
        F.col("sensor.type").alias("sensor_type"),
        "collected_at",
        *VALUE_COLUMNS,
    )


@query
def motion_readings(spark, folder):
    return readings.of_type(bridge.readings(spark, folder), vocab.MOTION)


@query
def filtered_readings(spark, folder):
    store = _store(spark, folder, START, END)
    where = ReadingFilter.of(f" {PLACE} ", vocab.AIR_QUALITY, START, END)
    return readings.filter_readings(store.readings, store.sensors, where)


@query
def readings_in_range(spark, folder):
    store = _store(spark, folder, START, END)
    return readings.filter_readings(
        store.readings, store.sensors, ReadingFilter.of(start=START, end=END)
    )


@query
def readings_page(spark, folder):
    return _store(spark, folder).list_page(page=3, size=50).items


@query
def readings_page_filtered(spark, folder):
    return _store(spark, folder, START).list_page(1, 25, sensor_type=vocab.ENERGY, start=START).items


@query
def readings_page_deep(spark, folder):
    kept = bridge.readings(spark, folder)
    return paging.offset_page(kept, page=15, size=500, range_rows=1000)


@query
def readings_page_summary(spark, folder):
    return _store(spark, folder, START).list_page(2, 50, start=START).summary


@query
def reading_count(spark, folder):
    return _store(spark, folder, START, END).count(PLACE, start=START, end=END)


_CURSOR_AT = instants.micros_of(MIDDLE)


def _cursor() -> str:
    return base64.b64encode(f"{_CURSOR_AT}:0".encode()).decode()


def _edges(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        F.col("sensor.name").alias("sensor_name"),
        F.col("sensor.type").alias("sensor_type"),
        "collected_at",
        *VALUE_COLUMNS,
        "cursor",
    )


@query
def connection_forward(spark, folder):
    return _edges(_store(spark, folder).connection(first=40, after=_cursor()).edges)


@query
def connection_forward_info(spark, folder):
    return _store(spark, folder).connection(first=40, after=_cursor()).page_info


@query
def connection_backward(spark, folder):
    return _edges(_store(spark, folder).connection(last=40, before=_cursor()).edges)


@query
def connection_backward_info(spark, folder):
    return _store(spark, folder).connection(last=40, before=_cursor()).page_info


@query
def connection_default(spark, folder):
    return _edges(_store(spark, folder).connection(sensor_type=vocab.MOTION).edges)


@query
def connection_total(spark, folder):
    return _store(spark, folder).connection(first=5, sensor_type=vocab.ENERGY).total_count


@query
def reading_json(spark, folder):
    store = _store(spark, folder)
    flat = readings.with_sensor(store.readings, store.sensors)
    text = jsontext.compact(F.struct("id", "sensor_name", "sensor_type", *VALUE_COLUMNS))
    return flat.select(
        "id",
        F.array_join(F.json_object_keys(text), ",").alias("members"),
        *[
            F.get_json_object(text, f"$.{c}").cast(flat.schema[c].dataType).alias(c)
            for c in VALUE_COLUMNS
        ],
    )


@query
def location_search(spark, folder):
    store = _store(spark, folder)
    return store.locations().filter(labels.matches_search(F.col("location"), " LOC-1 "))


@query
def sensor_catalogue(spark, folder):
    return _store(spark, folder).catalogue()


@query
def locations(spark, folder):
    return _store(spark, folder).locations()


@query
def sensor_lookup(spark, folder):
    return catalogue.find_sensor_id(bridge.sensors(spark, folder), PLACE, vocab.MOTION)


@query
def readings_per_type(spark, folder):
    return readings.count_by_type(bridge.readings(spark, folder))


@query
def latest_per_sensor(spark, folder):
    return _store(spark, folder).latest()


@query
def latest_in_range(spark, folder):
    rows = _store(spark, folder, START, END).latest_where(
        sensor_type=vocab.AIR_QUALITY, start=START, end=END
    )
    return _nested(rows)


def _nested(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        F.col("sensor.name").alias("sensor_name"),
        F.col("sensor.type").alias("sensor_type"),
        "collected_at",
        *VALUE_COLUMNS,
    )


# --- the same questions over a stored, day-partitioned table ------------------------------


def _stored(spark: SparkSession, folder: str) -> ReadingStore:
    """Write the readings in the layout of the stored table and open a store on it."""
    tables = Tables(spark, scratch_dir(spark, "stored"))
    tables.append_sensors(bridge.sensors(spark, folder))
    tables.append_readings(
        bridge.readings(spark, folder).withColumns(
            {
                "collected_date": day_column(F.col("collected_at")),
                "ingest_batch": F.lit("stored"),
            }
        )
    )
    return ReadingStore(tables.readings(), tables.sensors())


@query
def stored_after_upkeep(spark, folder):
    """All readings, appended in six batches, after their files were merged and swept."""
    tables = Tables(spark, scratch_dir(spark, "upkeep"))
    tables.append_sensors(bridge.sensors(spark, folder))
    rows = bridge.readings(spark, folder).withColumns(
        {"collected_date": day_column(F.col("collected_at")), "ingest_batch": F.lit("stored")}
    )
    batch = F.pmod(F.xxhash64("id"), F.lit(6))
    for n in range(6):
        tables.append_readings(rows.filter(batch == n))
    upkeep = Upkeep(tables)
    upkeep.run(date(9999, 1, 1), ["meter_readings"])
    upkeep.sweep(["meter_readings"], timedelta(0))
    return readings.with_sensor(tables.readings(), tables.sensors())


@query
def stored_latest(spark, folder):
    return _stored(spark, folder).latest()


@query
def stored_latest_until(spark, folder):
    return _nested(_stored(spark, folder).latest_where(sensor_type=vocab.AIR_QUALITY, end=END))


@query
def kept_latest(spark, folder):
    """From the kept table, merged twice, with days not merged and readings that came late."""
    tables = Tables(spark, scratch_dir(spark, "kept"))
    kept = KeptLatest(tables)
    tables.append_sensors(bridge.sensors(spark, folder))
    rows = bridge.readings(spark, folder).withColumns(
        {"collected_date": day_column(F.col("collected_at")), "ingest_batch": F.lit("stored")}
    )
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    for n, bound in enumerate((date(2024, 1, 10), date(2024, 1, 25), None)):
        late = rows.filter(part == n).persist()
        with kept.writing(dedup.touched_days(late.select("collected_date")), f"part-{n}"):
            tables.append_readings(late)
        late.unpersist()
        if bound:
            kept.merge(bound)
    return kept.latest()


@query
def stored_page(spark, folder):
    return _stored(spark, folder).list_page(page=3, size=50).items


@query
def stored_page_deep(spark, folder):
    return _stored(spark, folder).list_page(page=19, size=200, sensor_type=vocab.AIR_QUALITY).items


@query
def stored_connection(spark, folder):
    return _edges(_stored(spark, folder).connection(first=40, after=_cursor()).edges)


@query
def stored_hourly_energy(spark, folder):
    rows = _stored(spark, folder).aggregates("energy_kwh", "hour", START, END, now=bridge.NOW)
    return _rounded(rows, "average")


# --- aggregates -------------------------------------------------------------------------


def _aggregates(spark, folder, metric, interval, **where) -> DataFrame:
    store = _store(spark, folder, START, END)
    rows = store.aggregates(metric, interval, START, END, now=bridge.NOW, **where)
    return _rounded(rows, "average")


@query
def hourly_energy(spark, folder):
    return _aggregates(spark, folder, "energy_kwh", "hour")


@query
def daily_co2(spark, folder):
    return _aggregates(spark, folder, "co2", "day")


@query
def weekly_motion(spark, folder):
    return _aggregates(spark, folder, "motion_detected", "week")


@query
def monthly_humidity(spark, folder):
    return _aggregates(spark, folder, "humidity", "month")


@query
def daily_pm25_of_location(spark, folder):
    return _aggregates(spark, folder, "pm25", "day", location=PLACE)


@query
def hourly_default_range(spark, folder):
    rows = _store(spark, folder).aggregates("energy_kwh", "hour", now=bridge.NOW)
    return _rounded(rows, "average")


@query
def metric_samples(spark, folder):
    return buckets.all_samples(bridge.readings(spark, folder))


@query
def period_starts(spark, folder):
    at = F.col("collected_at")
    rows = bridge.readings(spark, folder)
    return rows.select("id", *[instants.period_start(at, i).alias(i) for i in vocab.INTERVAL_HOURS])


def _series(spark, folder, metric="co2", interval="week") -> DataFrame:
    return _store(spark, folder).series(metric, interval, START, END, now=bridge.NOW)


@query
def weekly_series(spark, folder):
    return _rounded(buckets.explode_series(_series(spark, folder)), "average")


@query
def aligned_series(spark, folder):
    aligned = _store(spark, folder).aligned_series(
        "humidity", "day", START, END, now=bridge.NOW
    )
    return _rounded(buckets.explode_aligned(aligned, "humidity"), "average")


@query
def series_gaps(spark, folder):
    aligned = _store(spark, folder).aligned_series("pm25", "day", START, END, now=bridge.NOW)
    return buckets.first_gaps(aligned)


@query
def period_axis(spark, folder):
    return buckets.period_axis(_series(spark, folder, "energy_kwh", "day"))


@query
def period_count(spark, folder):
    return buckets.period_count(_series(spark, folder, "energy_kwh", "hour"))


# --- ingest -----------------------------------------------------------------------------


@query
def first_arrivals(spark, folder):
    good, _ = split_decoded(_decoded(spark, folder))
    kept = dedup.first_arrivals(good, ["name", "sensor_type", "collected_at"])
    return kept.select("partition", "offset", "name", "sensor_type", "collected_at")


@query
def insert_skipping_stored(spark, folder):
    stored = readings.between(bridge.readings(spark, folder), end=MIDDLE)
    batch = readings.between(bridge.readings(spark, folder), start=instants.normalize(BEFORE))
    return dedup.without_stored(batch, stored)


@query
def insert_summary(spark, folder):
    good, _ = split_decoded(_decoded(spark, folder))
    keyed = catalogue.with_sensor_id(good, bridge.sensors(spark, folder))
    stored = readings.between(bridge.readings(spark, folder), end=MIDDLE)
    # One row per key with its number of arrivals: the messages are decoded once.
    arrived = keyed.groupBy(*dedup.READING_KEY).agg(F.count("*").alias("copies"))
    held = stored.select(*dedup.READING_KEY, F.lit(True).alias("held"))
    counted = arrived.join(held, dedup.READING_KEY, "left")
    return counted.agg(*announce.batch_summary(F.sum("copies"), F.count_if(F.col("held").isNull())))


@query
def new_sensors(spark, folder):
    early = instants.normalize("2024-01-02T00:00:00+00:00")
    known = bridge.with_reading(bridge.events(spark, folder, end=early)).select(
        F.col("sensor_id").alias("id"), "name", "sensor_type"
    )
    rows = bridge.with_reading(bridge.events(spark, folder, start=early))
    unknown = catalogue.unknown_sensors(rows, known)
    return catalogue.number_sensors(unknown, last_id=1000, expected=unknown.count())


@query
def change_events(spark, folder):
    good, _ = split_decoded(_decoded(spark, folder))
    tagged = announce.with_announcement(good, announce.number_spans(bridge.messages(spark, folder)))
    kept = dedup.first_arrivals(tagged, ["name", "sensor_type", "collected_at"])
    inserted = kept.groupBy("announcement").agg(F.count("*").alias("reading_count"))
    events = announce.change_events(tagged, inserted, bridge.NOW)
    return events.select(
        "announcement",
        "published_at",
        "reading_count",
        "newest_collected_at",
        F.posexplode("sensors").alias("position", "sensor"),
    ).select("*", "sensor.location", F.col("sensor.sensorType").alias("sensor_type")).drop("sensor")


def _ingested(spark, folder) -> Tables:
    """Run the ingest job over the events as a stream, into a fresh set of tables."""
    base = scratch_dir(spark, "ingest")
    tables = Tables(spark, f"{base}/tables")
    feed = bridge.with_message(bridge.event_stream(spark, folder)).drop("event_id")
    Ingest(tables).start(feed, f"{base}/checkpoint", drain=True).awaitTermination()
    return tables


@query
def ingest_stored(spark, folder):
    tables = _ingested(spark, folder)
    rows = readings.with_sensor(tables.readings(), tables.sensors())
    # Ids leave gaps; their order is the order of arrival.
    return rows.join(_arrivals(rows), "id").drop("id")


def _arrivals(rows: DataFrame) -> DataFrame:
    """Place of every id in the order of ids: inside its million ids, after a running total."""
    grouped = rows.select("id", F.shiftright("id", 20).alias("million"))
    # One row per million ids.
    sizes = grouped.groupBy("million").agg(F.count("*").alias("size"))
    before = sizes.select(
        "million", (F.sum("size").over(Window.orderBy("million")) - F.col("size")).alias("before")
    )
    place = F.row_number().over(Window.partitionBy("million").orderBy("id"))
    return (
        grouped.withColumn("place", place)
        .join(before, "million")
        .select("id", (F.col("before") + F.col("place")).cast("bigint").alias("arrival"))
    )


@query
def fed_stored(spark, folder):
    """Readings of a feed with three partitions; its first half is sent twice, the job stopped between."""
    base = scratch_dir(spark, "fed")
    tables, feed = Tables(spark, f"{base}/tables"), Feed(spark, f"{base}/feed")
    closing = Closing(messages.MAX_MESSAGES, linger_s=0.0, quiet_s=0.0)
    sent = bridge.messages(spark, folder)
    # One key is in one half, so its order is kept.
    early = F.xxhash64("key") >= 0
    for part in (sent.filter(early), sent):
        feed.append(part.select("key", "value", "headers"))
        Ingest(tables).start_feed(feed, f"{base}/checkpoint", closing, drain=True)
    return readings.with_sensor(tables.readings(), tables.sensors()).drop("id")


@query
def ingest_dead_letters(spark, folder):
    letters = _ingested(spark, folder).dead_letters()
    named = F.map_from_entries(
        F.filter("headers", lambda h: h["key"].startswith("dlq-"))
    )
    return letters.select(
        F.col("key").cast("string").alias("key"),
        *[
            named[header].cast("string").alias(alias)
            for header, alias in (
                (vocab.DLQ_OFFSET, "source_offset"),
                (vocab.DLQ_REASON, "reason"),
                (vocab.DLQ_DETAIL, "detail"),
            )
        ],
    )


@query
def ingest_announced(spark, folder):
    events = messages.decode_changes(_ingested(spark, folder).changes())
    named = F.transform("sensors", lambda s: F.concat_ws(" ", s["location"], s["sensorType"]))
    return events.select(
        "reading_count",
        "newest_collected_at",
        F.array_join(F.array_sort(named), ",").alias("sensors"),
    )


# --- change signals ---------------------------------------------------------------------


def _changes(spark, folder) -> DataFrame:
    return messages.decode_changes(bridge.changes(spark, folder))


@query
def decoded_changes(spark, folder):
    return _changes(spark, folder).select(
        "event_id",
        "published_at",
        "reading_count",
        "newest_collected_at",
        F.size("sensors").alias("sensor_count"),
    )


@query
def changes_since(spark, folder):
    since = instants.normalize("2024-01-30T23:40:00+00:00")
    return messages.only_new(_changes(spark, folder), since).select("event_id", "published_at")


@query
def relayed_changes(spark, folder):
    """What a relay pushes that starts at the end of a feed and reads on from there by offsets."""
    base = scratch_dir(spark, "relayed")
    feed = Feed(spark, f"{base}/feed", vocab.PERSISTED_TOPIC)
    since = instants.normalize("2024-01-30T23:40:00+00:00")
    late = messages.only_new(_changes(spark, folder), since).select("event_id")
    sent = bridge.changes(spark, folder).withColumn("key", F.col("event_id").cast("string"))
    feed.append(sent.join(late, "event_id", "left_anti"))
    kept = "key binary, published_at timestamp"

    def push(events: DataFrame) -> None:
        events.select("key", "published_at").write.mode("append").parquet(f"{base}/pushed")

    spark.createDataFrame([], kept).write.parquet(f"{base}/pushed")
    closing = Closing(messages.MAX_MESSAGES, linger_s=0.0, quiet_s=0.0)
    job = Relay(Tables(spark, f"{base}/tables"), push).start_feed(feed, closing)
    try:
        feed.append(sent.join(late, "event_id", "left_semi"))
        job.processAllAvailable()
    finally:
        job.stop()
    pushed = spark.read.schema(kept).parquet(f"{base}/pushed")
    return pushed.select(F.col("key").cast("string").cast("bigint").alias("event_id"), "published_at")


@query
def refresh_signals(spark, folder):
    return changes.refresh_signals(_changes(spark, folder))


@query
def refresh_stream(spark, folder):
    base = scratch_dir(spark, "refresh")
    events = messages.decode_changes(bridge.with_change(bridge.event_stream(spark, folder)))
    changes.land_events(events, f"{base}/events", f"{base}/checkpoint", drain=True).awaitTermination()
    return changes.landed_signals(spark, f"{base}/events")


@query
def live_signals(spark, folder):
    """Every burst written once by a stateful stream; a tick after the last event ends the open one."""
    base = scratch_dir(spark, "live")
    kind = "published_at timestamp, reading_count int"
    messages_in = bridge.with_change(bridge.event_stream(spark, folder))
    events = messages.decode_changes(messages_in).select("published_at", "reading_count")
    job = bursts.LiveSignals(spark, f"{base}/parts", f"{base}/checkpoint")
    last = _changes(spark, folder).agg(F.max("published_at")).first()[0]
    for ticks in ([], [(last + timedelta(hours=1), None)] if last else []):
        spark.createDataFrame(ticks, kind).write.mode("append").parquet(f"{base}/ticks")
        tick_stream = spark.readStream.schema(kind).parquet(f"{base}/ticks")
        job.start(events.unionByName(tick_stream), drain=True).awaitTermination()
    return job.signals()


@query
def live_view(spark, folder):
    """The running view of a stream that is stopped in the middle and started again."""
    base = scratch_dir(spark, "view")
    events = _changes(spark, folder).select(
        "published_at", "reading_count", "newest_collected_at", "sensors", (F.xxhash64("event_id") >= 0).alias("early")
    )
    for early in (True, False):
        half = events.filter(F.col("early") == early).drop("early")
        half.write.mode("append").parquet(f"{base}/events")
        stream = spark.readStream.schema(half.schema).parquet(f"{base}/events")
        bursts.start_view(stream, f"{base}/view", f"{base}/checkpoint", drain=True).awaitTermination()
    return _view_columns(bursts.current_view(spark, f"{base}/view"))


@query
def running_view(spark, folder):
    return _view_columns(changes.running_view(_changes(spark, folder)))


def _view_columns(view: DataFrame) -> DataFrame:
    named = F.transform(
        "last_event.sensors", lambda s: F.concat_ws(" ", s["location"], s["sensorType"])
    )
    return view.select(
        "events_seen",
        "last_event.published_at",
        "last_event.reading_count",
        F.array_join(named, ",").alias("sensors"),
    )


@query
def arrivals(spark, folder):
    return changes.arrivals(changes.running_view(_changes(spark, folder)), bridge.NOW)


# --- dashboard --------------------------------------------------------------------------


@query
def threshold_breaches(spark, folder):
    rows = bridge.readings(spark, folder)
    broken = thresholds.breaches(F.col("co2"), F.col("pm25"), F.col("humidity"))
    return rows.select("id", F.posexplode(broken).alias("position", "breach")).select(
        "id", "position", "breach.*"
    )


@query
def breach_flags(spark, folder):
    return bridge.readings(spark, folder).select(
        "id",
        *[
            thresholds.is_breached(m, F.col(m)).alias(f"{m}_breached")
            for m in ("co2", "pm25", "humidity")
        ],
    )


@query
def band_verdicts(spark, folder):
    rows = bridge.readings(spark, folder)
    broken = thresholds.breaches(F.col("co2"), F.col("pm25"), F.col("humidity"))
    has_air = F.col("sensor_type") == vocab.AIR_QUALITY
    return rows.select("id", thresholds.verdict(has_air, broken).alias("verdict"))


@query
def feed_states(spark, folder):
    at = F.col("collected_at")
    return bridge.readings(spark, folder).select(
        "id",
        instants.feed_state(at, MIDDLE).alias("state"),
        instants.age_label(at, MIDDLE).alias("age"),
    )


@query
def chart_limits(spark, folder):
    samples = buckets.all_samples(bridge.readings(spark, folder))
    limit = F.lit(None).cast("double")
    for name in vocab.METRICS:
        limit = F.when(F.col("metric") == name, thresholds.alert_limit(name)).otherwise(limit)
    return samples.groupBy("metric", "unit", limit.alias("threshold")).agg(
        F.count("*").alias("samples"), F.count_if(F.col("value") > limit).alias("above")
    )


@query
def location_status(spark, folder):
    rows = _console(spark, folder).locations()
    return rows.select(
        "location",
        F.col("air_quality.co2").alias("co2"),
        F.col("air_quality.state").alias("air_state"),
        F.col("motion.detected").alias("detected"),
        F.col("motion.state").alias("motion_state"),
        F.col("energy.kwh").alias("kwh"),
        F.col("energy.collected_at").alias("energy_at"),
        "worst",
        "oldest_collected_at",
        status.types_present(rows).alias("types"),
    )


@query
def latest_values(spark, folder):
    return _console(spark, folder, search="LOC-1").latest_values()


@query
def type_summary(spark, folder):
    return _rounded(
        _console(spark, folder).type_summary(), "avg_co2", "motion_fraction", "avg_kwh"
    )


@query
def lost_locations(spark, folder):
    return _console(spark, folder).lost()


# --- recorded metrics -------------------------------------------------------------------


@query
def counter_rates(spark, folder):
    names = [vocab.MESSAGES_CONSUMED, vocab.READINGS_INSERTED]
    return _rounded(metrics.rate(bridge.metrics(spark, folder), names), "rate")


@query
def dead_letter_rates(spark, folder):
    rows = metrics.rate(bridge.metrics(spark, folder), [vocab.DEAD_LETTERED], ["reason"])
    return _rounded(rows, "rate")


@query
def poll_rates(spark, folder):
    rows = metrics.rate(bridge.metrics(spark, folder), [vocab.POLL_REQUESTS], ["outcome"])
    return _rounded(rows, "rate")


@query
def duration_p95(spark, folder):
    rows = metrics.histogram_quantile(bridge.metrics(spark, folder), [vocab.BATCH_DURATION])
    return _rounded(rows, "quantile")


@query
def duration_p95_sketch(spark, folder):
    """The sketch's rank may be off by one in a hundred of a range's values."""
    rows = bridge.metrics(spark, folder)
    ranks = metrics.quantile_ranks(rows, metrics.sketch_quantile(rows, [vocab.BATCH_DURATION]))
    rank, most = 0.95 * F.col("n"), 0.01 * F.col("n")
    close = (F.col("below") <= rank + most) & (F.col("up_to") >= rank - most)
    return ranks.select("name", "range_end", "n", close.alias("close"))


@query
def instrument_rates(spark, folder):
    rows = bridge.instruments(spark, folder)
    return _rounded(metrics.rate(rows, list(bridge.COUNTERS)), "rate")


@query
def instrument_p95(spark, folder):
    rows = bridge.instruments(spark, folder)
    return _rounded(metrics.histogram_quantile(rows, list(bridge.DURATIONS)), "quantile")
