"""Live bursts and the running view against their batch forms."""

import json
import random

import pytest
from samples import at

from gaugeflow.streaming import bursts, changes

pytest.importorskip("pandas")
EVENTS = "published_at timestamp, reading_count int"
FULL = (
    "published_at timestamp, reading_count int, newest_collected_at timestamp, "
    "sensors array<struct<location: string, sensorType: string>>"
)


def rows_of(df):
    return sorted(map(tuple, df.select("first_event_at", "refresh_at", "events", "readings").collect()))


def land(spark, path, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def live(spark, folder):
    job = bursts.LiveSignals(spark, f"{folder}/parts", f"{folder}/checkpoint")

    def drain():
        stream = spark.readStream.schema(EVENTS).parquet(f"{folder}/events")
        job.start(stream, drain=True).awaitTermination()
        return job

    return job, drain, f"{folder}/events"


def test_every_burst_is_written_once_over_restarts(spark, live):
    job, drain, path = live
    rng = random.Random(2)
    # Around an hour's end, with gaps just below, at and above the quiet time.
    seconds, all_rows = 3570.0, []
    for _ in range(300):
        seconds += rng.choice([0.0, 0.05, 0.2, 0.399, 0.4, 0.401, 1.5])
        all_rows.append((at(seconds=seconds), rng.randint(1, 9)))
    for low in range(0, 300, 100):
        part = all_rows[low : low + 100]
        rng.shuffle(part)
        land(spark, path, part)
        drain()
    land(spark, path, [(at(minutes=180), None)])
    drain()
    expected = changes.refresh_signals(spark.createDataFrame(all_rows, EVENTS))
    assert rows_of(job.signals()) == rows_of(expected)
    assert sum(r.events for r in job.parts().collect()) == 300
    # Nothing is written again.
    before = job.parts().count()
    drain()
    assert job.parts().count() == before


def test_an_open_burst_waits(spark, live):
    job, drain, path = live
    land(spark, path, [(at(), 1), (at(seconds=0.3), 2), (at(seconds=20), 4)])
    drain()
    assert [(r.events, r.readings) for r in job.signals().collect()] == [(2, 3)]
    land(spark, path, [(at(seconds=20.2), 5), (at(seconds=60), None)])
    drain()
    assert rows_of(job.signals())[1][2:] == (2, 9)


def test_a_burst_over_several_hours_is_one(spark):
    hour = bursts.HOUR_US
    parts = [(0, hour - 300_000, hour - 100_000, 2, 2), (1, hour, 2 * hour - 1, 9, 9), (2, 2 * hour, 2 * hour, 1, 1)]
    parts += [(2, 2 * hour + 400_000, 2 * hour + 400_000, 1, 5), (2, 3 * hour - 10, 3 * hour - 10, 1, 7), (4, 4 * hour, 4 * hour, 1, 8)]
    got = bursts.joined_parts(spark.createDataFrame(parts, bursts.PARTS)).collect()
    assert sorted((r.events, r.readings) for r in got) == [(1, 5), (1, 7), (1, 8), (12, 12)]


def test_the_running_view_goes_on_after_a_restart(spark, folder):
    def event(n):
        return at(n), n, at(n - 1), [(f"room {n}", "motion")]

    def drain():
        stream = spark.readStream.schema(FULL).parquet(f"{folder}/events")
        bursts.start_view(stream, f"{folder}/view", f"{folder}/checkpoint", drain=True).awaitTermination()
        return [json.loads(r) for r in bursts.current_view(spark, f"{folder}/view").toJSON().collect()]

    land(spark, f"{folder}/events", [event(n) for n in (3, 1)], FULL)
    [first] = drain()
    assert first["events_seen"] == 2 and first["last_event"]["reading_count"] == 3
    land(spark, f"{folder}/events", [event(n) for n in (2, 7, 5)], FULL)
    [second] = drain()
    whole = spark.read.schema(FULL).parquet(f"{folder}/events")
    assert [second] == [json.loads(r) for r in changes.running_view(whole).toJSON().collect()]
    assert second["events_seen"] == 5
