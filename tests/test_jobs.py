import json
from types import SimpleNamespace

from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.schemas import POLL_RESPONSES
from gaugeflow.sources import messages as feeds
from gaugeflow.sources.tables import Tables
from gaugeflow.streaming import changes
from gaugeflow.streaming.ingest import Ingest
from gaugeflow.streaming.produce import Produce
from gaugeflow.streaming.relay import Relay

from samples import at, utc


def recorded(tables):
    rows = tables.metrics().select("name", "labels", "value").collect()
    return {(r["name"], *r["labels"].values()): r["value"] for r in rows}


def landed_polls(spark, path):
    body = json.dumps(
        [
            {"type": "energy", "name": "Kitchen", "payload": {"energy": 1.5}},
            {"type": "motion", "name": "Hall", "payload": {"motionDetected": True}},
            {"type": "temperature", "name": "Hall", "payload": {"c": 1}},
        ]
    )
    rows = [(200, None, body, at(0)), (500, None, "", at(1)), (200, None, "[]", at(2))]
    spark.createDataFrame(rows, POLL_RESPONSES).write.parquet(path)
    return spark.readStream.schema(POLL_RESPONSES).parquet(path)


def test_polls_to_stored_readings_to_pushed_events(spark, folder):
    tables = Tables(spark, f"{folder}/tables")

    def land(messages):
        messages.select(
            "key",
            "value",
            "headers",
            F.lit(vocab.READINGS_TOPIC).alias("topic"),
            F.lit(0).alias("partition"),
            F.monotonically_increasing_id().alias("offset"),
            F.current_timestamp().alias("timestamp"),
        ).coalesce(1).write.mode("append").parquet(f"{folder}/feed")

    polls = landed_polls(spark, f"{folder}/polls")
    Produce(tables, land).start(polls, f"{folder}/c1", drain=True).awaitTermination()
    found = recorded(tables)
    assert found.pop((vocab.POLL_DURATION,)) > 0
    assert found == {
        (vocab.POLL_REQUESTS, "success"): 1.0,
        (vocab.POLL_REQUESTS, "failure"): 2.0,
        (vocab.READINGS_POLLED,): 3.0,
        (vocab.MESSAGES_PRODUCED,): 3.0,
    }

    done = []
    ingest = Ingest(tables, report=done.append)
    ingest.start(feeds.file_stream(spark, f"{folder}/feed"), f"{folder}/c2", drain=True).awaitTermination()
    report = done[-1]
    # What the producer kept as unknown is quarantined here.
    assert (report.inserted, report.dead_letters, report.announced) == (2, 1, 1)

    pushed = []
    relay = Relay(tables, lambda events: pushed.extend(events.select("reading_count").collect()))
    relay.run_batch(tables.changes(), "x")
    assert [r[0] for r in pushed] == [2]
    found = recorded(tables)
    assert found[(vocab.EVENTS_CONSUMED,)] == found[(vocab.EVENTS_PUSHED,)] == 1.0
    assert found[(vocab.EVENT_LAG,)] >= 0
    assert found[(vocab.DEAD_LETTERED, vocab.DECODE_FAILED)] == 1.0


def test_a_failing_sink_is_counted(spark, folder):
    def broken(_):
        raise ConnectionError

    tables = Tables(spark, f"{folder}/tables")
    polls = landed_polls(spark, f"{folder}/polls")
    Produce(tables, broken).start(polls, f"{folder}/c1", drain=True).awaitTermination()
    found = recorded(tables)
    assert found[(vocab.MESSAGES_FAILED,)] == 3.0 and (vocab.MESSAGES_PRODUCED,) not in found


def test_relay_drops_and_skips(spark, folder, feed):
    def event(when):
        return json.dumps({"publishedAt": when, "readingCount": 1})

    batch = feed("junk", event("2026-05-04T10:00:00Z"), event("2026-05-04T10:05:00Z"), event("2026-05-04T10:20:00Z"))
    tables, pushed = Tables(spark, folder), []
    Relay(
        tables,
        lambda events: pushed.append(events.count()),
        since=utc("2026-05-04T10:05:00"),
        clock=lambda: utc("2026-05-04T10:10:00"),
    ).run_batch(batch, "x")
    assert pushed == [2]
    # The event from the future has no lag.
    assert recorded(tables)[(vocab.EVENT_LAG,)] == 300.0


def test_running_view_of_a_stream(spark, folder):
    schema = (
        "published_at timestamp, reading_count int, newest_collected_at timestamp, "
        "sensors array<struct<location:string,sensorType:string>>"
    )
    rows = [(at(i), i, at(0), [("A", "motion")]) for i in range(3)]
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    query = (
        changes.running_view(stream)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("seen")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    row = spark.table("seen").first()
    assert (row["events_seen"], row["last_event"]["reading_count"]) == (3, 2)


def test_kafka_options_reach_the_reader():
    class Reader:
        def __init__(self):
            self.seen = {}

        def format(self, name):
            self.seen["format"] = name
            return self

        def option(self, key, value):
            self.seen[key] = value
            return self

        def options(self, **more):
            self.seen.update(more)
            return self

        def load(self):
            return SimpleNamespace(select=lambda *columns: self.seen)

    def seen(**arguments):
        return feeds.kafka_stream(SimpleNamespace(readStream=Reader()), "h:1", **arguments)

    first = seen(minPartitions="64")
    assert first["startingOffsets"] == "earliest" and first["maxOffsetsPerTrigger"] == "5000000"
    assert first["includeHeaders"] == "true" and first["minPartitions"] == "64"
    assert first["minOffsetsPerTrigger"] == "500" and first["maxTriggerDelay"] == "2 seconds"
    bare = seen(from_latest=True, max_messages=None, least=None)
    assert bare["startingOffsets"] == "latest" and bare.keys().isdisjoint({"maxTriggerDelay", "minOffsetsPerTrigger"})


def test_stored_instants_have_statistics(spark, folder, feed):
    import glob

    import pyarrow.parquet as pq

    from samples import wire

    tables = Tables(spark, folder)
    Ingest(tables).run_batch(feed(wire("energy", "A", '{"energy":1}')), "b0")
    (path,) = glob.glob(f"{folder}/meter_readings/*/*.parquet")
    meta = pq.ParquetFile(path).metadata.row_group(0)
    stats = {meta.column(i).path_in_schema: meta.column(i).statistics for i in range(meta.num_columns)}
    assert stats["collected_at"].has_min_max
