import json
import random
import socket

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.operators import announce, catalogue, dedup
from gaugeflow.schemas import MESSAGES
from gaugeflow.sources import folders
from gaugeflow.sources import messages as feeds
from gaugeflow.sources.messages import decode_changes
from gaugeflow.sources.tables import Tables, rows_from_arrays
from gaugeflow.streaming.ingest import Ingest, RetryPolicy, is_stopped, is_transient, number_spans

from samples import at, utc, wire


@pytest.fixture
def job(spark, folder):
    naps = []
    ingest = Ingest(
        Tables(spark, folder, may_be_new=True), retry=RetryPolicy(sleep=naps.append), clock=lambda: utc("2026-09-03T12:00:00")
    )
    ingest.naps = naps
    return ingest


def stored(job):
    rows = job.tables.readings().join(
        job.tables.sensors().select(F.col("id").alias("sensor_id"), "name"), "sensor_id"
    )
    return {
        (r["name"], r["sensor_type"], r["collected_at"], r["energy_kwh"], r["motion_detected"], r["co2"])
        for r in rows.collect()
    }


def energy(name="Kitchen", kwh=9.5, when="2026-09-03T10:00:00+00:00"):
    return wire("energy", name, json.dumps({"energy": kwh}), when)


def motion(name="Kitchen", when="2026-09-03T10:00:00+00:00"):
    return wire("motion", name, '{"motionDetected":true}', when)


def headers(row):
    return {h["key"]: bytes(h["value"]).decode() for h in row["headers"]}


def test_first_of_a_batch_wins(job, feed):
    report = job.run_batch(
        feed(energy(kwh=1.0), energy(kwh=2.0), energy(kwh=3.0, when="2026-09-03T12:00:00+02:00")), "b0"
    )
    assert (report.inserted, report.duplicates_skipped) == (1, 2)
    assert [r[3] for r in stored(job)] == [1.0]


def test_redelivery_stores_and_announces_once(job, feed):
    first = job.run_batch(feed(energy(), motion()), "b0")
    again = job.run_batch(feed(energy(), motion()), "b1")
    assert (first.inserted, first.duplicates_skipped, first.announced) == (2, 0, 1)
    assert (again.inserted, again.duplicates_skipped, again.announced) == (0, 2, 0)
    assert job.tables.readings().count() == 2
    assert decode_changes(job.tables.changes()).count() == 1
    assert job.tables.sensors().count() == 2


def test_partial_overlap(job, feed):
    job.run_batch(feed(energy(when="2026-09-03T10:00:00Z"), energy(when="2026-09-03T11:00:00Z")), "b0")
    report = job.run_batch(feed(energy(when="2026-09-03T11:00:00Z"), energy(when="2026-09-04T00:00:00Z")), "b1")
    assert (report.inserted, report.duplicates_skipped) == (1, 1)
    assert job.tables.readings().select("id").distinct().count() == 3


def test_replay_of_a_batch_changes_nothing(job, feed):
    batch = feed(energy(), "{ not json", motion())
    job.run_batch(batch, "b0")
    before = [stored(job), job.tables.dead_letters().count(), decode_changes(job.tables.changes()).collect()]
    report = job.run_batch(batch, "b0")
    assert [stored(job), job.tables.dead_letters().count(), decode_changes(job.tables.changes()).collect()] == before
    assert report.announced == 1


def test_poison_is_quarantined_byte_for_byte(job, feed):
    bad = b'{"type":"energy"\xff'
    report = job.run_batch(feed(bad, wire("temperature", "A", "{}"), energy(), headers=[("h", "v")]), "b0")
    assert (report.inserted, report.dead_letters) == (1, 2)
    letters = job.tables.dead_letters().collect()
    assert {bytes(r["value"]) for r in letters} == {bad, wire("temperature", "A", "{}").encode()}
    assert all(bytes(r["key"]) == b"k" for r in letters)
    found = {headers(r)["dlq-original-offset"]: headers(r) for r in letters}
    assert found["1"] == {
        "h": "v",
        "dlq-original-topic": "meter-readings",
        "dlq-original-partition": "0",
        "dlq-original-offset": "1",
        "dlq-reason": "decode-failed",
        "dlq-detail": "Unrecognised sensor type 'temperature'.",
        "dlq-timestamp": "2026-09-03T12:00:00.0000000+00:00",
    }


def test_detail_is_cut_and_long_names_are_quarantined(job, feed):
    kind = "x" * 600
    report = job.run_batch(feed(wire(kind, "A", "{}"), energy("n" * 129), energy("n" * 128)), "b0")
    assert (report.inserted, report.dead_letters) == (1, 2)
    letters = [headers(r) for r in job.tables.dead_letters().collect()]
    assert {(h["dlq-reason"], h["dlq-detail"]) for h in letters} == {
        ("decode-failed", f"Unrecognised sensor type '{kind}'."[:512]),
        ("persist-failed", "value too long for type character varying(128)"),
    }


def test_dead_letters_can_be_sent_on(job, feed):
    sent = []
    job.reject = lambda letters: sent.extend(letters.collect())
    job.run_batch(feed(energy(), "x"), "b0")
    job.run_batch(feed("y", first_offset=5), "b1")
    assert [bytes(r["value"]) for r in sent] == [b"x", b"y"] and sent[0].__fields__ == ["key", "value", "headers"]

    def broken(_):
        raise RuntimeError("down")

    job.reject = broken
    with pytest.raises(RuntimeError):
        job.run_batch(feed("z"), "b2")


def test_only_poison_stores_nothing(job, feed):
    report = job.run_batch(feed("x", "y"), "b0")
    assert (report.decoded, report.inserted, report.dead_letters) == (0, 0, 2)
    assert job.tables.readings().count() == 0 and job.tables.changes().count() == 0


def test_one_event_lists_pairs_in_first_seen_order(job, feed):
    job.run_batch(
        feed(
            energy("Kitchen"),
            motion("Kitchen", "2026-09-03T10:00:00Z"),
            motion("Kitchen", "2026-09-03T10:05:00.1234567Z"),
            motion("Garage"),
        ),
        "b0",
    )
    raw = json.loads(bytes(job.tables.changes().first()["value"]))
    assert raw == {
        "publishedAt": "2026-09-03T12:00:00+00:00",
        "readingCount": 4,
        "newestCollectedAt": "2026-09-03T10:05:00.123456+00:00",
        "sensors": [
            {"location": "Kitchen", "sensorType": "energy"},
            {"location": "Kitchen", "sensorType": "motion"},
            {"location": "Garage", "sensorType": "motion"},
        ],
    }


def test_event_covers_skipped_readings_too(job, feed):
    job.run_batch(feed(energy("A")), "b0")
    job.run_batch(feed(energy("A"), energy("B", when="2026-09-03T09:00:00Z"), first_offset=1), "b1")
    last = decode_changes(job.tables.changes().filter("batch = 'b1'")).first()
    assert last["reading_count"] == 1
    assert [s["location"] for s in last["sensors"]] == ["A", "B"]
    assert last["newest_collected_at"] == utc("2026-09-03T10:00:00").replace(tzinfo=None)


def test_large_batches_announce_in_bounded_events(job, spark):
    rows = [
        (b"k", bytearray(energy(f"S{i % 700}", 1.0, f"2026-09-03T10:{i // 700:02d}:00Z").encode()), [], "t", i % 2, i, at())
        for i in range(1500)
    ]
    report = job.run_batch(spark.createDataFrame(rows, MESSAGES), "b0")
    events = decode_changes(job.tables.changes()).collect()
    assert report.inserted == 1500 == sum(e["reading_count"] for e in events)
    assert len(events) == report.announced == 6
    assert max(len(e["sensors"]) for e in events) <= 500


def test_ten_thousand_rows(job, spark):
    body = F.concat(
        F.lit('{"type":"energy","name":"K","payload":{"energy":1.5},"collectedAt":"'),
        F.date_format(F.timestamp_seconds(F.col("id") + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('"}'),
    )
    batch = spark.range(10_000).select(
        F.lit(None).cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        F.array().cast(MESSAGES["headers"].dataType).alias("headers"),
        F.lit("t").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("id").alias("offset"),
        F.current_timestamp().alias("timestamp"),
    )
    assert job.run_batch(batch, "b0").inserted == 10_000
    ordered = job.tables.readings().orderBy("collected_at").select("id").collect()
    assert [r[0] for r in ordered] == list(range(1, 10_001))


def test_permutations_and_repeats_leave_the_same_table(spark, feed, tmp_path_factory):
    # Equal keys carry equal values here, so that any order must give one table.
    bodies = [wire("energy", f"S{i % 4}", f'{{"energy":{i % 4}}}', f"2026-09-0{1 + i % 3}T10:00:00Z") for i in range(24)]
    results = []
    for seed in range(2):
        rng = random.Random(seed)
        job = Ingest(Tables(spark, str(tmp_path_factory.mktemp("run")), may_be_new=True))
        for n in range(3):
            job.run_batch(feed(*rng.choices(bodies, k=15), *rng.sample(bodies, 24)), f"b{n}")
        results.append(stored(job))
    assert results[0] == results[1] and len(results[0]) == 12


def test_stream_from_files(job, spark, feed, folder):
    landed = f"{folder}/landed"
    feed(energy(), "{ not json").write.parquet(landed)
    done = []
    job.report = done.append
    arrivals = [feed(energy(), first_offset=9), feed(energy("New"), first_offset=10), None]
    for expected, following in zip((1, 1, 2), arrivals):
        stream = feeds.file_stream(spark, landed)
        job.start(stream, f"{folder}/checkpoint", drain=True).awaitTermination()
        assert job.tables.readings().count() == expected
        if following is not None:
            following.write.mode("append").parquet(landed)
    assert [r.inserted for r in done] == [1, 0, 1]
    names = {r["batch"] for r in job.tables.metrics().select("batch").distinct().collect()}
    assert len(names) == 3 and len({n.rsplit("-", 1)[0] for n in names}) == 1


def test_a_new_checkpoint_replays_into_the_same_table(job, spark, feed, folder):
    feed(energy(), motion()).write.parquet(f"{folder}/landed")
    done = []
    job.report = done.append
    for checkpoint in ("a", "b"):
        stream = feeds.file_stream(spark, f"{folder}/landed")
        job.start(stream, f"{folder}/{checkpoint}", drain=True).awaitTermination()
    assert [r.inserted for r in done] == [2, 0]
    assert decode_changes(job.tables.changes()).count() == 1


# --- outbox and several writers -----------------------------------------------------------


def test_a_failed_publish_is_sent_later_and_once(job, feed):
    sent, broken = [], [True]

    def publish(df):
        if broken[0]:
            raise ConnectionError("no broker")
        sent.extend(decode_changes(df).select("reading_count", "newest_collected_at").collect())

    job.publish = publish
    first = job.run_batch(feed(energy(), motion()), "b0")
    assert (first.inserted, first.announced, first.sent_later, sent) == (2, 0, 0, [])
    still = job.run_batch(feed(energy(name="Hall")), "b1")
    assert (still.announced, still.sent_later) == (0, 0)
    broken[0] = False
    third = job.run_batch(feed(energy(name="Attic")), "b2")
    assert (third.announced, third.sent_later) == (1, 2)
    assert [r.reading_count for r in sent] == [2, 1, 1]
    fourth = job.run_batch(feed(energy(name="Cellar")), "b3")
    assert fourth.sent_later == 0 and len(sent) == 4
    assert decode_changes(job.tables.changes()).count() == 4


def test_events_that_could_not_be_written_are_made_again(job, feed, monkeypatch):
    put = Tables.put_batch

    def broken(self, name, batch, rows):
        if name == "change_events":
            raise ConnectionError("store is away")
        put(self, name, batch, rows)

    monkeypatch.setattr(Tables, "put_batch", broken)
    assert job.run_batch(feed(motion(), energy(), energy(name="Hall")), "b0").announced == 0
    monkeypatch.undo()
    assert job.run_batch(feed(energy(name="Attic")), "b1").sent_later == 1
    rows = decode_changes(job.tables.changes().filter("batch = 'b0'")).collect()
    assert [r.reading_count for r in rows] == [3]
    assert [(s.location, s.sensorType) for s in rows[0].sensors] == [("Kitchen", "motion"), ("Kitchen", "energy"), ("Hall", "energy")]


def test_two_writers_agree_on_new_sensors(job, feed):
    from concurrent.futures import ThreadPoolExecutor

    names = [f"room {n}" for n in range(6)]
    feeds_of = [feed(*(energy(name=n, when=f"2026-09-0{day}T10:00:00+00:00") for n in names)) for day in (3, 4, 5)]
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda k: job.run_batch(feeds_of[k], f"w{k}"), range(3)))
    assert [r.inserted for r in done] == [6, 6, 6]
    sensors = job.tables.sensors().collect()
    assert len({(s.name, s.sensor_type) for s in sensors}) == len({s.id for s in sensors}) == len(sensors) == 6
    ids = [r.id for r in job.tables.readings().collect()]
    assert len(set(ids)) == 18


def test_a_claim_of_a_dead_holder_ends(spark, folder):
    path = f"{folder}/claims/x"
    with folders.exclusive(spark, path):
        with pytest.raises(TimeoutError):
            with folders.exclusive(spark, path, wait_s=0.3, pause_s=0.1):
                pass
        with folders.exclusive(spark, path, lease_s=0.0, pause_s=0.05):
            pass
    with folders.exclusive(spark, path):
        pass
    assert folders.children(spark, f"{folder}/claims") == []


# --- failures ---------------------------------------------------------------------------


class Flaky(Ingest):
    def store(self, *args):
        self.calls = getattr(self, "calls", 0) + 1
        if self.failures:
            raise self.failures.pop(0)
        super().store(*args)


@pytest.fixture
def flaky(spark, folder):
    def make(*failures):
        naps = []
        job = Flaky(Tables(spark, folder, may_be_new=True), retry=RetryPolicy(sleep=naps.append))
        job.failures, job.naps = list(failures), naps
        return job

    return make


def test_transient_failures_are_retried_with_backoff(flaky, feed):
    job = flaky(ConnectionError(), TimeoutError())
    report = job.run_batch(feed(energy()), "b0")
    assert (report.inserted, report.retries, job.naps) == (1, 2, [0.5, 1.0])


def test_giving_up_quarantines_the_whole_batch(flaky, feed):
    job = flaky(*[ConnectionError()] * 9)
    report = job.run_batch(feed(energy(), "{ not json"), "b0")
    assert (report.stored, report.inserted, report.retries) == (False, 0, 4)
    assert job.naps == [0.5, 1.0, 2.0, 4.0]
    reasons = sorted((headers(r)["dlq-reason"], headers(r)["dlq-original-offset"]) for r in job.tables.dead_letters().collect())
    assert reasons == [("decode-failed", "1"), ("persist-failed", "0"), ("persist-failed", "1")]
    assert job.tables.changes().count() == 0


def test_permanent_failures_are_not_retried(flaky, feed):
    job = flaky(DatabaseError("23505"))
    report = job.run_batch(feed(energy()), "b0")
    assert (report.stored, report.retries, job.calls) == (False, 0, 1)
    [labels] = [r["labels"] for r in job.tables.metrics().filter(F.col("name") == vocab.DEAD_LETTERED).collect()]
    assert labels == {"reason": vocab.PERSIST_FAILED, "cause": "DatabaseError"}


def test_a_busy_store_is_tried_again(flaky, feed):
    job = flaky(PySparkException("Task failed: AmazonS3Exception 503 Slow Down"))
    report = job.run_batch(feed(energy()), "b0")
    assert (report.inserted, report.retries) == (1, 1)


@pytest.mark.parametrize(
    "error",
    [
        PySparkException("[SPARK_JOB_CANCELLED] Job 7 cancelled because of stop"),
        AnalysisException("no such column"),
        ValueError("no"),
    ],
)
def test_stopped_jobs_and_mistakes_end_the_query_and_set_nothing_aside(flaky, feed, error):
    job = flaky(error)
    with pytest.raises(type(error)):
        job.run_batch(feed(energy()), "b0")
    assert job.tables.dead_letters().count() == 0
    assert job.run_batch(feed(energy()), "b0").inserted == 1


def test_a_cancelled_job_is_recognised(spark):
    import threading
    import time

    from pyspark import InheritableThread

    caught = []

    def work():
        spark.sparkContext.setJobGroup("to-cancel", "a long job", True)
        try:
            spark.range(1 << 40).selectExpr("sum(hash(id))").collect()
        except Exception as e:  # noqa: BLE001
            caught.append(e)

    thread = InheritableThread(target=work)
    thread.start()
    while thread.is_alive():
        time.sleep(0.3)
        spark.sparkContext.cancelJobGroup("to-cancel")
    assert isinstance(thread, threading.Thread) and is_stopped(caught[0]) and not is_transient(caught[0])


@pytest.mark.parametrize("size, blocks", [(499, 1), (500, 1), (501, 2), (1001, 3)])
def test_five_hundred_positions_make_an_announcement(spark, feed, size, blocks):
    near = size // 3
    rows = feed(*["x"] * near, first_offset=70).unionByName(feed(*["x"] * (size - near), first_offset=3, partition=1))
    tagged = announce.with_announcement(rows, number_spans(rows))
    counts = {r["announcement"]: r["count"] for r in tagged.groupBy("announcement").count().collect()}
    assert counts == {str(b): min(500, size - 500 * b) for b in range(blocks)}


@pytest.mark.parametrize("n", [10_000, 10_001])
def test_sensors_are_numbered_in_name_order_on_both_sides_of_a_group(spark, n):
    unknown = spark.range(n).select(F.concat(F.lit("s"), F.col("id") * 7919 % n).alias("name"), F.lit("energy").alias("sensor_type"))
    rows = catalogue.number_sensors(unknown, 7, n).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(8, n + 8))
    assert [r["name"] for r in rows] == sorted(r["name"] for r in rows)


def test_a_reader_of_a_missing_table_is_told(spark, folder):
    with pytest.raises(AnalysisException):
        Tables(spark, f"{folder}/mistyped").readings()


def test_failing_to_announce_keeps_the_rows(job, feed):
    def broken(_):
        raise RuntimeError("down")

    job.publish = broken
    report = job.run_batch(feed(energy()), "b0")
    assert (report.inserted, report.stored, report.announced) == (1, True, 0)


def test_backoff_is_capped():
    assert [RetryPolicy().delay_s(n) for n in (1, 2, 3, 7, 20)] == [0.5, 1.0, 2.0, 30.0, 30.0]


class DatabaseError(Exception):
    def __init__(self, state):
        self.sqlstate = state


@pytest.mark.parametrize("state", sorted(vocab.TRANSIENT_SQLSTATES))
def test_listed_states_are_transient(state):
    assert is_transient(DatabaseError(state))


def test_other_failures_are_permanent():
    for error in (DatabaseError("23505"), DatabaseError("42P01"), ValueError(), OSError("disk"), None):
        assert not is_transient(error)


def test_lost_executors_are_transient():
    from pyspark.errors import PySparkException

    lost = "Job aborted due to stage failure: Task 3 failed 4 times: ExecutorLostFailure (executor 7)"
    assert is_transient(PySparkException(lost))
    assert not is_transient(PySparkException("Job aborted due to stage failure: division by zero"))


def test_jvm_causes_are_walked(spark):
    from py4j.protocol import Py4JJavaError

    def thrown(name):
        jvm = spark.sparkContext._jvm
        cause = getattr(jvm.java.net, name)("x") if name != "none" else None
        return Py4JJavaError("failed", jvm.java.lang.RuntimeException("wrapped", cause))

    assert is_transient(thrown("SocketException"))
    assert is_transient(thrown("SocketTimeoutException"))
    assert not is_transient(thrown("none"))


def test_causes_are_walked():
    for cause in (DatabaseError("40001"), TimeoutError(), ConnectionResetError(), socket.gaierror()):
        try:
            try:
                raise cause
            except Exception as inner:
                raise RuntimeError("wrapped") from inner
        except RuntimeError as outer:
            assert is_transient(outer)


# --- single operators -------------------------------------------------------------------


def test_next_offsets(spark, feed):
    rows = feed(*["x"] * 5).unionByName(feed("y", first_offset=41, partition=2))
    assert {tuple(r) for r in announce.next_offsets(rows).collect()} == {
        ("meter-readings", 0, 5),
        ("meter-readings", 2, 42),
    }


def test_traces(spark, feed):
    one, two = "0af7651916cd43dd8448eb211c80319c", "1af7651916cd43dd8448eb211c80319c"
    parent = "00-{}-b7ad6b7169203331-01"
    rows = (
        feed("a", "b", headers=[("traceparent", "junk"), ("traceparent", parent.format(one))])
        .unionByName(feed("c", headers=[("traceparent", parent.format(two))]))
        .unionByName(feed("d", headers=[("traceparent", parent.format("0" * 32))]))
        .unionByName(feed("e"))
    )
    assert {r[0] for r in announce.upstream_traces(rows).collect()} == {one, two}


def test_lag_is_recorded_unless_negative(spark):
    df = spark.createDataFrame([(at(0),), (at(1),)], "collected_at timestamp")
    assert announce.newest_lag(df, at(3)).first()[0] == 120.0
    assert announce.newest_lag(df, at(0)).count() == 0


def test_numbering_spreads_over_groups_and_stays_consecutive(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "_GROUP", 10)
    unknown = spark.range(95).select(F.concat(F.lit("s"), "id").alias("name"), F.lit("energy").alias("sensor_type"))
    numbered = catalogue.number_sensors(unknown, 7, 95)
    rows = numbered.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(8, 103))
    assert [r["name"] for r in rows] == sorted(r["name"] for r in rows)


def test_ids_follow_arrival(spark, feed):
    rows = feed("a", "b", first_offset=100).unionByName(feed("c", first_offset=7, partition=1))
    spans = {r["partition"]: (r["before"], r["low"], r["width"]) for r in number_spans(rows).collect()}
    assert spans == {0: (0, 100, 2), 1: (2, 7, 1)}


def test_stored_keys_are_skipped_with_and_without_broadcast(spark):
    rows = spark.createDataFrame([(1, at(0)), (1, at(1)), (2, at(0))], "sensor_id int, collected_at timestamp")
    held = rows.filter("sensor_id = 1").limit(1)
    for keys in (3, dedup.BROADCAST_KEYS + 1, None):
        assert dedup.without_stored(rows, held, keys).count() == 2


def test_only_candidates_of_a_large_batch_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BROADCAST_KEYS", 10)
    key = "cast(id % 500 as int) AS sensor_id", "timestamp_micros(1777000000000000 + id * 1000000) AS collected_at"
    held = spark.range(20_000).selectExpr(*key)
    rows = spark.range(19_000, 23_000).selectExpr(*key)
    fresh = dedup.without_stored(rows, held, 4000)
    assert fresh.count() == 3000
    assert sorted(fresh.collect()) == sorted(spark.range(20_000, 23_000).selectExpr(*key).collect())
    passed = dedup.candidates(held, rows, 4000)
    # All that are in the batch, and few others.
    assert passed.join(rows, dedup.READING_KEY, "left_semi").count() == 1000
    assert passed.count() < 1100
    spread = held.withColumn("collected_at", F.timestamp_micros(1777019000000000 + F.xxhash64("sensor_id", "collected_at") % 1000))
    assert dedup.candidates(spread, rows, 4000).count() < 1000
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    # The filter's words are sent to where the stored keys lie, before anything of them moves.
    assert "BroadcastHashJoin [_word" in plan


def test_a_filter_that_is_full_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(dedup, "BLOOM_WORDS", 1)
    key = "cast(id as int) AS sensor_id", "timestamp_micros(id) AS collected_at"
    rows, held = spark.range(300).selectExpr(*key), spark.range(100, 400).selectExpr(*key)
    assert dedup.without_stored(rows, held, 300).count() == 100
    assert dedup.without_stored(rows.limit(0), held, 1).count() == 0


def test_first_arrivals_are_cut_before_the_shuffle(spark, feed):
    plan = dedup.first_arrivals(feed("a"), ["key"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_rows_from_arrays(spark):
    df = spark.createDataFrame([([1, 2], ["a", None])], "ids array<int>, names array<string>")
    rows = rows_from_arrays(df, {"ids": "id", "names": "name"})
    assert [tuple(r) for r in rows.collect()] == [(1, "a"), (2, None)]


def test_readings_without_an_instant_are_stored_at_the_earliest_one(job, feed):
    body = '{"type":"energy","name":"A","payload":{"energy":1}}'
    reports = [job.run_batch(feed(body), name) for name in ("b0", "b1")]
    assert [r.inserted for r in reports] == [1, 0]
    kept = job.tables.readings().select(F.col("collected_at").cast("string"), F.col("collected_date").cast("string"))
    assert tuple(kept.first()) == ("0001-01-01 00:00:00", "0001-01-01")
    event = decode_changes(job.tables.changes()).select(F.col("newest_collected_at").cast("string"))
    assert event.first()[0] == "0001-01-01 00:00:00"


def test_a_hot_key_among_many_messages(job, spark):
    """A third of the messages are copies of one reading, another third name one sensor."""
    i = F.col("id")
    name = F.when(i % 3 == 2, F.concat(F.lit("S"), i.cast("string"))).otherwise("Hot")
    second = F.when(i % 3 == 0, F.lit(0)).otherwise(i)
    body = F.format_string(
        '{"type":"energy","name":"%s","payload":{"energy":%d},"collectedAt":"%s"}',
        name,
        i,
        F.date_format(F.timestamp_seconds(second + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )
    batch = spark.range(0, 9000, 1, 6).select(
        F.lit(None).cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        F.array().cast(MESSAGES["headers"].dataType).alias("headers"),
        F.lit("t").alias("topic"),
        (i % 2).cast("int").alias("partition"),
        i.alias("offset"),
        F.current_timestamp().alias("timestamp"),
    )
    report = job.run_batch(batch, "b0")
    assert (report.inserted, report.duplicates_skipped) == (6001, 2999)
    rows = job.tables.readings()
    # The first copy by (partition, offset) is the one kept.
    assert rows.agg(F.min("energy_kwh")).first()[0] == 0.0
    assert rows.select("id").distinct().count() == 6001
    assert job.tables.sensors().count() == 3001
    events = decode_changes(job.tables.changes())
    assert events.agg(F.sum("reading_count"), F.max(F.size("sensors"))).first()[0] == 6001
    assert events.agg(F.max(F.size("sensors"))).first()[0] <= 500


def test_a_batch_lists_the_days_it_touches_only(spark, job, feed):
    for n, day in enumerate(("2026-05-04", "2026-05-05", "2026-05-06")):
        job.run_batch(feed(wire("energy", "A", '{"energy":1}', f"{day}T10:00:00Z"), first_offset=n), f"b{n}")
    from datetime import date

    files = job.tables.readings_of([date(2026, 5, 5), date(1999, 1, 1)]).inputFiles()
    assert len(files) == 1 and "collected_date=2026-05-05" in files[0]
    assert job.tables.readings_of([date(1999, 1, 1)]).count() == 0
    again = job.run_batch(feed(wire("energy", "A", '{"energy":2}', "2026-05-05T10:00:00Z"), first_offset=9), "b9")
    assert (again.inserted, again.duplicates_skipped) == (0, 1)
