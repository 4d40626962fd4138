import json
import random

import pytest
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.operators import metrics
from gaugeflow.schemas import PIPELINE_METRICS
from gaugeflow.sources.messages import decode_changes, only_new
from gaugeflow.streaming import changes

from samples import at, wire

EVENT = {
    "publishedAt": "2026-05-04T10:00:00.5+00:00",
    "readingCount": 18,
    "newestCollectedAt": "2026-05-04T09:59:00.123456+00:00",
    "sensors": [{"location": "Kitchen", "sensorType": "motion"}, {"Location": "Hall"}],
}


def test_event_decoding(spark, feed):
    partial = {k: v for k, v in EVENT.items() if k != "sensors"}
    rows = decode_changes(
        feed(
            json.dumps(EVENT),
            json.dumps(partial),
            json.dumps({**partial, "sensors": None}),
            wire("energy", "A", '{"energy":1}'),
            "",
            "{ not json",
            "null",
            json.dumps({**EVENT, "readingCount": "x"}),
            json.dumps({**EVENT, "sensors": 3}),
            json.dumps({**EVENT, "publishedAt": "noon"}),
        )
    ).orderBy("offset")
    found = rows.select("offset", "reading_count", "sensors").collect()
    assert [r["offset"] for r in found] == [0, 1, 2, 3]
    assert [tuple(s) for s in found[0]["sensors"]] == [("Kitchen", "motion"), ("Hall", None)]
    assert found[1]["sensors"] == [] == found[2]["sensors"]
    assert found[3]["reading_count"] == 0 and found[3]["sensors"] == []
    first = rows.filter("offset = 3").select(F.col("published_at").cast("string")).first()[0]
    assert first == "0001-01-01 00:00:00"


def events(spark, *seconds):
    rows = [(at(0, seconds=s), n + 1, at(0), [("Kitchen", "motion")]) for n, s in enumerate(seconds)]
    return spark.createDataFrame(
        rows,
        "published_at timestamp, reading_count int, newest_collected_at timestamp, "
        "sensors array<struct<location:string,sensorType:string>>",
    )


def test_bursts_refresh_once(spark):
    rows = changes.refresh_signals(events(spark, 0, 0.3, 0.6, 2, 5, 5.399)).orderBy("refresh_at").collect()
    assert [(r["events"], r["readings"]) for r in rows] == [(3, 6), (1, 4), (2, 11)]
    assert rows[0]["refresh_at"] == at(0, seconds=1.0).replace(tzinfo=None)


def test_bursts_that_cross_chained_hours(spark, monkeypatch):
    monkeypatch.setattr(changes, "_CHAINED", 3)
    rng = random.Random(11)
    seconds, now = [], 0.0
    for _ in range(400):
        # A third of the gaps are long, and some bursts run over many chained stretches.
        now += rng.choice([0.05, 0.3, 0.39, 0.45, 3.0]) if len(seconds) > 80 else 0.3
        seconds.append(round(now, 3))
    rng.shuffle(seconds)
    expected, burst = [], []
    for s in sorted(seconds):
        if burst and s - burst[-1] >= 0.4:
            expected.append(len(burst))
            burst = []
        burst.append(s)
    expected.append(len(burst))
    rows = changes.refresh_signals(events(spark, *seconds)).orderBy("first_event_at").collect()
    assert [r["events"] for r in rows] == expected and expected[0] > 80


def test_bursts_on_a_stream(spark, folder):
    def landed(*seconds):
        events(spark, *seconds).write.mode("append").parquet(f"{folder}/in")

    def signals(since=None):
        found = changes.landed_signals(spark, f"{folder}/events", since).orderBy("refresh_at").collect()
        return [r["events"] for r in found]

    landed(0, 0.3, 0.6, 2, 5)
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    run = lambda: changes.land_events(stream, f"{folder}/events", f"{folder}/checkpoint", drain=True).awaitTermination()
    run()
    assert signals() == [3, 1, 1]
    # Hours later comes a late event of the first burst, and one that opens another hour.
    landed(0.9, 7200)
    run()
    assert signals() == [4, 1, 1, 1]
    assert signals(at(60)) == [1]


def test_running_view_and_arrivals(spark):
    view = changes.running_view(events(spark, 0, 9, 4))
    row = view.first()
    assert (row["events_seen"], row["last_event"]["reading_count"]) == (3, 2)
    shown = changes.arrivals(view, at(2)).collect()
    assert [tuple(r) for r in shown] == [(0, "KITCHEN", "MOTION", "1m")]
    empty = changes.running_view(events(spark))
    assert empty.first()["events_seen"] == 0 and changes.arrivals(empty, at(2)).count() == 0


def test_backlog_is_skipped(spark):
    assert only_new(events(spark, 0, 9, 10), at(0, seconds=9)).count() == 2


# --- recorded metrics -------------------------------------------------------------------


def recorded(spark, *rows):
    return spark.createDataFrame([(at(0, seconds=s), n, l, float(v)) for s, n, l, v in rows], PIPELINE_METRICS)


def test_rate_looks_back_five_minutes(spark):
    df = recorded(spark, (1, "c", {}, 300), (16, "c", {}, 600), (1, "other", {}, 5))
    found = {r["range_end"]: r["rate"] for r in metrics.rate(df, ["c"]).collect()}
    start = at(0).replace(tzinfo=None)
    by_offset = {(k - start).total_seconds(): v for k, v in found.items()}
    assert by_offset[15] == 1.0 and by_offset[30] == 3.0 and by_offset[300] == 3.0
    assert by_offset[315] == 2.0 and 330 not in by_offset and 0 not in by_offset


def test_rate_by_label(spark):
    df = recorded(spark, (1, "d", {"reason": "a"}, 30), (1, "d", {"reason": "b"}, 60), (2, "d", {"reason": "a"}, 30))
    found = {r["reason"]: r["rate"] for r in metrics.rate(df, ["d"], ["reason"]).filter(F.col("range_end") == at(0.25)).collect()}
    assert found == {"a": 0.2, "b": 0.2}


def test_rate_equals_a_sliding_window(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(0, 3000), "c", {}, rng.randrange(9)) for _ in range(400)]
    df = recorded(spark, *rows)
    plain = (
        df.groupBy(F.window("ts", "5 minutes", "15 seconds").alias("w"))
        .agg(F.sum("value").alias("v"))
        .select(F.col("w.end").alias("range_end"), (F.col("v") / 300).alias("rate"))
    )
    ours = metrics.rate(df, ["c"]).select("range_end", "rate")
    assert dict(map(tuple, ours.collect())) == pytest.approx(dict(map(tuple, plain.collect())))


@pytest.mark.parametrize(
    "values, expected",
    [([1.0] * 10, 4.75), ([0.0] * 10, 0.0), ([20000.0] * 10, 10000.0), ([1.0] * 9 + [8.0], 5 + 5 * 0.5)],
)
def test_histogram_quantile(spark, values, expected):
    df = recorded(spark, *[(1, vocab.BATCH_DURATION, {}, v) for v in values])
    rows = metrics.histogram_quantile(df, [vocab.BATCH_DURATION]).collect()
    assert len(rows) == 20 and {round(r["quantile"], 9) for r in rows} == {expected}


def test_sketch_quantile_is_exact_for_small_ranges(spark):
    rng = random.Random(1)
    values = [rng.uniform(0, 100) for _ in range(200)]
    df = recorded(spark, *[(i % 15, "h", {}, v) for i, v in enumerate(values)])
    row = metrics.sketch_quantile(df, ["h"]).first()
    assert row["quantile"] == sorted(values)[189]


def test_raw_rows_are_reduced_before_they_fan_out(spark):
    plan = metrics.rate(recorded(spark, (1, "c", {}, 1)), ["c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")
