"""The kept latest readings against the newest rows of the whole table."""

import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import dedup
from gaugeflow.operators.readings import newest_rows
from gaugeflow.plans.newest import KeptLatest
from gaugeflow.schemas import STORED_READINGS
from gaugeflow.sources.tables import Tables, day_column

FIRST = datetime(2026, 5, 1, tzinfo=timezone.utc)


@pytest.fixture
def kept(spark, folder):
    return KeptLatest(Tables(spark, folder, may_be_new=True), buckets=8)


def rows(spark, *triples):
    """(id, sensor, hours after the first of May)"""
    made = [(i, s, FIRST + timedelta(hours=h), "energy", 1.0 * i) for i, s, h in triples]
    df = spark.createDataFrame(made, "id long, sensor_id int, collected_at timestamp, sensor_type string, energy_kwh double")
    df = df.withColumns({"collected_date": day_column(F.col("collected_at")), "ingest_batch": F.lit("b")})
    for field in STORED_READINGS.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.select(*STORED_READINGS.fieldNames())


def append(kept, batch, *triples):
    df = rows(kept.tables.spark, *triples)
    with kept.writing(dedup.touched_days(df.select("collected_date")), batch):
        kept.tables.append_readings(df)


def ids(df):
    return sorted((r["sensor_id"], r["id"]) for r in df.collect())


def same(kept):
    got = ids(kept.rows())
    assert got == ids(newest_rows(kept.tables.readings()))
    return dict(got)


def test_no_tables_no_rows(kept):
    assert kept.merge(date(2026, 5, 2)) == 0
    assert ids(kept.rows()) == []


def test_late_readings_of_merged_days_are_seen_before_and_after_a_merge(kept):
    append(kept, "b1", (1, 1, 1), (2, 2, 2), (3, 3, 30))
    assert kept.merge(date(2026, 5, 2)) == 2
    assert same(kept) == {1: 1, 2: 2, 3: 3}
    append(kept, "b2", (4, 1, 5), (5, 2, 1))
    assert same(kept) == {1: 4, 2: 2, 3: 3}
    # The first day's readers were done, so it needs no reading any more.
    assert kept.merge(date(2026, 5, 2)) == 1
    assert date(2026, 5, 1) not in kept._marked()
    assert same(kept) == {1: 4, 2: 2, 3: 3}


def test_a_writer_that_died_keeps_its_day_read(kept):
    append(kept, "b1", (1, 1, 1))
    kept.merge(date(2026, 5, 3))
    with pytest.raises(RuntimeError):
        with kept.writing([date(2026, 5, 1)], "b2"):
            kept.tables.append_readings(rows(kept.tables.spark, (2, 1, 2)))
            raise RuntimeError("lost")
    assert same(kept) == {1: 2}
    kept.merge(date(2026, 5, 3))
    assert kept._marked() == [date(2026, 5, 1)] and same(kept) == {1: 2}
    kept.forget("b2")
    kept.merge(date(2026, 5, 3))
    assert kept._marked() == [] and same(kept) == {1: 2}


def test_a_replay_marks_its_days_again(kept):
    append(kept, "b1", (1, 1, 1))
    with pytest.raises(RuntimeError):
        with kept.writing([date(2026, 5, 1)], "b1"):
            raise RuntimeError("lost")
    kept.merge(date(2026, 5, 2))
    assert kept._marked() == [date(2026, 5, 1)]


def test_a_merge_that_dies_before_its_state_changes_nothing(kept, monkeypatch):
    append(kept, "b1", (1, 1, 1), (2, 2, 1))
    kept.merge(date(2026, 5, 2))
    append(kept, "b2", (3, 1, 2))
    with monkeypatch.context() as broken:
        broken.setattr(KeptLatest, "_commit", lambda self, state: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.merge(date(2026, 5, 2))
    assert same(kept) == {1: 3, 2: 2}
    assert kept.merge(date(2026, 5, 2)) == 1
    assert same(kept) == {1: 3, 2: 2}


def test_only_touched_buckets_are_written_and_old_ones_swept(kept):
    append(kept, "b1", *[(i, i, 1) for i in range(1, 60)])
    assert kept.merge(date(2026, 5, 2)) == 8
    append(kept, "b2", (100, 7, 26))
    assert kept.merge(date(2026, 5, 3)) == 1
    runs = [run for _, run in kept.state().runs]
    assert sorted(set(runs)) == [1, 2] and runs.count(2) == 1
    assert kept.sweep() == 1
    assert same(kept)[7] == 100


def test_any_order_of_batches_and_merges(kept):
    rng, n = random.Random(3), 0
    for step in range(4):
        batch = []
        for _ in range(30):
            n += 1
            batch.append((n, rng.randint(1, 12), rng.randint(0, 6) * 24 + rng.randint(0, 3)))
        append(kept, f"b{step}", *batch)
        if step % 2 == 0:
            kept.merge(date(2026, 5, 2 + step))
        same(kept)


def test_the_plan_reads_no_merged_day(kept):
    append(kept, "b1", (1, 1, 1), (2, 2, 49))
    kept.merge(date(2026, 5, 3))
    files = [r[0] for r in kept.rows().select("id").withColumn("x", F.lit(1)).select("id").collect()]
    assert sorted(files) == [1, 2]
    plan = kept.rows()._jdf.queryExecution().executedPlan().toString()
    assert "collected_date" in plan and "2026-05-03" in plan and "PartitionFilters" in plan
