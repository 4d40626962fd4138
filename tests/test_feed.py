import json

import pytest
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.schemas import HEADERS, MESSAGES
from gaugeflow.sources.feed import Closing, Feed, Log, close, spans_between, take
from gaugeflow.sources.tables import Tables
from gaugeflow.streaming.ingest import Ingest
from gaugeflow.streaming.relay import Relay

NOW = Closing(quiet_s=0.0, linger_s=0.0)
START = {"entry": 1, "taken": {}, "closed_by": ""}


class Entries(Log):
    """A log in memory; entries are lists of (partition, first, count)."""

    def __init__(self, *entries):
        self.known = {}
        for entry in entries:
            self.add(entry)

    def add(self, entry):
        lines = [{"partition": p, "first": f, "count": n} for p, f, n in entry]
        self.known[len(self.known) + 1] = lines

    def entry(self, number):
        return self.known.get(number)


class Clock:
    """Time that passes by sleeping; ``arrivals`` are what comes in at given moments."""

    def __init__(self, log, arrivals=()):
        self.log, self.arrivals, self.now = log, list(arrivals), 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds
        while self.arrivals and self.arrivals[0][0] <= self.now + 1e-9:
            self.log.add(self.arrivals.pop(0)[1])


def closed(log, arrivals=(), **rule):
    clock = Clock(log, arrivals)
    end = close(log, START, Closing(**rule), clock, clock.sleep)
    return end["closed_by"], end["taken"], round(clock.now, 3)


def test_a_batch_closes_by_count_at_once():
    log = Entries([(0, 0, 300), (1, 0, 300)])
    assert closed(log) == ("count", {"0": 300, "1": 200}, 0.0)


def test_a_batch_closes_when_a_poll_brings_nothing():
    log = Entries([(0, 0, 3)])
    late = [(0.05, [(0, 3, 2)]), (0.15, [(1, 0, 1)]), (0.9, [(0, 5, 9)])]
    assert closed(log, late) == ("quiet", {"0": 5, "1": 1}, 0.3)


def test_a_batch_of_a_trickle_closes_after_its_linger():
    log = Entries([(0, 0, 1)])
    trickle = [(i / 20, [(0, i, 1)]) for i in range(1, 100)]
    reason, taken, seconds = closed(log, trickle)
    assert (reason, seconds) == ("linger", 2.0) and taken["0"] == 41


def test_no_message_is_no_batch():
    log = Entries()
    assert close(log, START, Closing(), Clock(log), None) is START


def test_batches_cut_entries_and_meet_end_to_end():
    log = Entries([(0, 0, 7), (2, 0, 4)], [(0, 7, 1)], [(1, 0, 5), (2, 4, 3)])
    start, seen = START, []
    while True:
        end, n = take(log, start, 6)
        if not n:
            break
        spans = spans_between(log, start, end)
        assert sum(until - first for _, first, until, *_ in spans) == n <= 6
        assert spans == spans_between(log, start, end)
        seen += [(p, i) for p, first, until, *_ in spans for i in range(first, until)]
        start = end
    assert sorted(seen) == sorted([(0, i) for i in range(8)] + [(1, i) for i in range(5)] + [(2, i) for i in range(7)])


@pytest.fixture
def topic(spark, folder):
    return Feed(spark, f"{folder}/feed")


def keyed(spark, low, high):
    return spark.range(low, high, 1, 4).select(
        F.concat(F.lit("k"), F.col("id") % 10).cast("binary").alias("key"),
        F.col("id").cast("string").cast("binary").alias("value"),
        F.array(F.struct(F.lit("n").alias("key"), F.col("id").cast("string").cast("binary").alias("value")))
        .cast(HEADERS)
        .alias("headers"),
    )


def run(feed, folder, handle, name="c", closing=NOW):
    query = (
        feed.spans(closing).writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/{name}").start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_messages_come_once_with_offsets_headers_and_order(spark, folder, topic):
    assert topic.append(keyed(spark, 0, 100)) == 100
    assert topic.append(keyed(spark, 0, 0)) == 0
    topic.append(keyed(spark, 100, 250))
    batches = []

    def handle(spans, batch_id):
        rows = topic.rows(spans)
        assert rows.schema == MESSAGES or rows.columns == MESSAGES.fieldNames()
        batches.append([(r["partition"], r["offset"], r["key"], int(r["value"]), r["headers"][0]["value"]) for r in rows.collect()])

    run(topic, folder, handle, closing=Closing(max_messages=60, linger_s=0.0, quiet_s=0.0))
    assert [len(b) for b in batches] == [60, 60, 60, 60, 10]
    topic.append(keyed(spark, 250, 260))
    run(topic, folder, handle)
    assert len(batches) == 6 and {m[3] for m in batches[-1]} == set(range(250, 260))
    every = [m for b in batches for m in b]
    assert sorted(m[3] for m in every) == list(range(260))
    assert all(int(m[4]) == m[3] for m in every)
    for p in range(3):
        own = sorted(m[1] for m in every if m[0] == p)
        assert own == list(range(len(own)))
    for key in {m[2] for m in every}:
        values = [m[3] for m in sorted((m for m in every if m[2] == key), key=lambda m: m[1])]
        assert values == sorted(values) and len({m[0] for m in every if m[2] == key}) == 1


def test_a_failed_batch_is_replayed_with_the_same_messages(spark, folder, topic):
    topic.append(keyed(spark, 0, 50))
    seen = []

    def failing(spans, batch_id):
        seen.append((batch_id, sorted(int(r["value"]) for r in topic.rows(spans).collect())))
        raise RuntimeError("stopped")

    with pytest.raises(Exception):
        run(topic, folder, failing)
    topic.append(keyed(spark, 50, 60))

    def working(spans, batch_id):
        seen.append((batch_id, sorted(int(r["value"]) for r in topic.rows(spans).collect())))

    run(topic, folder, working)
    assert seen == [(0, list(range(50))), (0, list(range(50))), (1, list(range(50, 60)))]


def reading(name, seconds):
    body = {"type": "energy", "name": name, "payload": {"energy": 1.0}, "collectedAt": f"2026-05-04T08:00:{seconds:02d}Z"}
    return bytearray(f"energy:{name}".encode()), bytearray(json.dumps(body).encode())


def test_produced_messages_are_ingested_once_though_sent_twice(spark, folder, topic):
    rows = [reading(f"room{i % 7}", i) for i in range(30)]
    tables, reports = Tables(spark, f"{folder}/tables"), []
    ingest = Ingest(tables, report=reports.append)
    sent = spark.createDataFrame(rows, "key binary, value binary")
    for _ in range(2):
        topic.append(sent)
        ingest.start_feed(topic, f"{folder}/c", Closing(max_messages=20, linger_s=0.0, quiet_s=0.0), drain=True)
    assert [r.consumed for r in reports] == [20, 10, 20, 10]
    assert sum(r.inserted for r in reports) == 30 and sum(r.duplicates_skipped for r in reports) == 30
    assert tables.readings().count() == 30


def change(minute):
    body = {"publishedAt": f"2026-05-04T08:{minute:02d}:00Z", "readingCount": minute, "sensors": []}
    return bytearray(b"k"), bytearray(json.dumps(body).encode())


def test_a_relay_skips_what_came_while_it_was_away_and_says_so(spark, folder):
    feed = Feed(spark, f"{folder}/feed", topic=vocab.PERSISTED_TOPIC)
    pushed = []
    relay = Relay(Tables(spark, f"{folder}/tables"), lambda e: pushed.append(sorted(r["reading_count"] for r in e.select("reading_count").collect())))

    def send(*minutes):
        feed.append(spark.createDataFrame([change(m) for m in minutes], "key binary, value binary"))

    send(1, 2)
    first = relay.start_feed(feed, NOW)
    try:
        send(3)
        first.processAllAvailable()
    finally:
        first.stop()
    assert pushed == [[3]] and relay.marks(feed) == feed.heads(feed.last_entry())
    send(4, 5)
    second = relay.start_feed(feed, NOW)
    try:
        send(6)
        second.processAllAvailable()
    finally:
        second.stop()
    assert pushed == [[3], [6]]
    skipped = relay.tables.metrics().filter(F.col("name") == vocab.EVENTS_SKIPPED).collect()
    assert sum(r["value"] for r in skipped) == 2
    assert relay.marks(feed) == feed.heads(feed.last_entry())
