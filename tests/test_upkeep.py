"""Upkeep: few files, the same rows, no row twice."""

import os
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from samples import at, energy, motion

from gaugeflow.schemas import STORED_READINGS
from gaugeflow.sources import folders
from gaugeflow.sources.tables import LAYOUTS, Tables
from gaugeflow.streaming import upkeep
from gaugeflow.streaming.upkeep import Upkeep

NONE, LATER = timedelta(0), date(2030, 1, 1)


@pytest.fixture
def tables(spark, folder):
    return Tables(spark, f"{folder}/tables", may_be_new=True)


def append(spark, tables, n, days=2):
    """One small batch: a few readings on each of some days."""
    names = STORED_READINGS.fieldNames()
    rows = []
    for day in range(days):
        for k, one in enumerate((energy, motion)):
            when = at(n, days=day)
            row = one(n * 100 + day * 10 + k, k + 1, when, 1.5 if one is energy else True)
            row |= dict(collected_date=when.date(), ingest_batch=f"q-{n:09d}/0")
            rows.append(tuple(row.get(c) for c in names))
    df = spark.createDataFrame(rows, STORED_READINGS).coalesce(1)
    df.write.mode("append").partitionBy("collected_date").parquet(tables.path("meter_readings"))


def append_file(tables, n):
    """The same as one file, as any writer would leave it."""
    place = f"{tables.path('meter_readings')}/collected_date={at().date()}"
    os.makedirs(place, exist_ok=True)
    columns = {
        "id": pa.array([n * 100, n * 100 + 1], pa.int64()),
        "sensor_id": pa.array([1, 2], pa.int32()),
        "collected_at": pa.array([at(n), at(n)], pa.timestamp("us", "UTC")),
        "sensor_type": pa.array(["energy", "motion"]),
        "energy_kwh": pa.array([1.5, None], pa.float64()),
        "motion_detected": pa.array([None, True], pa.bool_()),
    }
    pq.write_table(pa.table(columns), f"{place}/part-00000-{n:09d}.parquet")


def side(spark, tables, n):
    rows = spark.createDataFrame([(n * 10 + 1, n * 10 + 11)], "first_id long, next_id long").coalesce(1)
    tables.put_batch("id_ranges", f"q-{n:09d}", rows)


def contents(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def listed(tables, name):
    return tables.files(name).count()


def test_two_hundred_batches_leave_few_files(spark, tables):
    job, most = Upkeep(tables), 0
    for n in range(200):
        append_file(tables, n)
        if n % 40 == 39:
            most = max(most, listed(tables, "meter_readings"))
            [done] = job.run(LATER, ["meter_readings"])
            assert done.files_after == 1
            assert job.sweep(["meter_readings"], NONE) == done.files_before
    assert most <= 41
    assert listed(tables, "meter_readings") == 1
    ids = [r.id for r in tables.readings().select("id").collect()]
    assert sorted(ids) == sorted(n * 100 + k for n in range(200) for k in range(2))


def test_rows_are_read_once_at_every_moment(spark, tables):
    for n in range(5):
        append(spark, tables, n)
    before = contents(tables.readings())
    early = tables.readings()
    days = [at().date(), at(days=1).date()]
    [done] = Upkeep(tables).run(LATER, ["meter_readings"])
    assert (done.files_before, done.files_after) == (10, 2)
    # Merged, not yet swept: the old files are there and not read.
    assert contents(tables.readings()) == before == contents(early)
    assert contents(tables.readings_of(days)) == before
    assert len(contents(tables.readings_of(days[:1]))) == len(before) // 2
    append(spark, tables, 7)
    assert tables.readings().count() == len(before) + 4
    assert Upkeep(tables).sweep(["meter_readings"], timedelta(hours=1)) == 0
    assert Upkeep(tables).sweep(["meter_readings"], NONE) == 10
    assert Upkeep(tables).sweep(["meter_readings"], NONE) == 0
    assert tables.readings().count() == len(before) + 4
    # What was merged is merged again with what came later.
    [again] = Upkeep(tables).run(LATER, ["meter_readings"])
    assert (again.files_before, again.files_after) == (4, 2)
    assert tables.readings().count() == len(before) + 4
    assert tables.readings_of([date(1999, 1, 1)]).count() == 0


def test_a_run_that_dies_replaces_nothing(spark, tables, monkeypatch):
    for n in range(3):
        append(spark, tables, n)
    before = contents(tables.readings())

    def dead(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Tables, "replaced_path", dead)
    with pytest.raises(RuntimeError):
        Upkeep(tables).merge(LAYOUTS["meter_readings"], LATER, at())
    monkeypatch.undo()
    assert folders.children(spark, f"{tables.root}/upkeep/meter_readings/merged")
    assert contents(tables.readings()) == before and listed(tables, "meter_readings") == 6


def test_open_days_and_single_files_are_left_alone(spark, tables):
    append(spark, tables, 0)
    assert Upkeep(tables).run(LATER) == []
    append(spark, tables, 1)
    [done] = Upkeep(tables).run(at(days=1).date())
    assert (done.table, done.files_before, done.files_after) == ("meter_readings", 2, 1)
    # The merged file and the two of the open day.
    assert listed(tables, "meter_readings") == 3


def test_order_inside_merged_files(spark, tables):
    for n in range(6):
        append(spark, tables, n, days=1)
    Upkeep(tables).run(LATER, ["meter_readings"])
    [run] = tables.runs("meter_readings")
    path = tables.merged_path("meter_readings", run)
    rows = [(r.sensor_type, r.collected_at) for r in spark.read.parquet(path).coalesce(1).collect()]
    assert rows == sorted(rows) and len(rows) == 12


def test_large_tables_get_files_of_the_target_size(spark, tables):
    names = STORED_READINGS.fieldNames()
    rows = spark.range(40_000).select(
        F.col("id"), F.lit(1).alias("sensor_id"),
        F.timestamp_micros(F.lit(1_777_000_000_000_000) + F.xxhash64("id") % 80_000_000_000).alias("collected_at"),
        F.lit("energy").alias("sensor_type"), F.rand(1).alias("energy_kwh"),
    )
    for c in ("co2", "pm25", "humidity", "motion_detected", "ingest_batch"):
        rows = rows.withColumn(c, F.lit(None).cast(STORED_READINGS[c].dataType))
    rows = rows.withColumn("collected_date", F.lit(date(2026, 4, 24))).select(*names)
    rows.repartition(8).write.partitionBy("collected_date").parquet(tables.path("meter_readings"))
    total = tables.files("meter_readings").agg(F.sum("length")).first()[0]
    [done] = Upkeep(tables, target_bytes=total // 3).run(LATER, ["meter_readings"])
    assert done.files_before == 8 and 3 <= done.files_after <= 5
    assert tables.readings().count() == 40_000


def test_side_tables_keep_the_newest_batch_of_a_query(spark, tables):
    for n in range(5):
        side(spark, tables, n)
    before = contents(tables.id_ranges())
    [done] = Upkeep(tables).run(LATER, ["id_ranges"], settled=NONE)
    assert (done.files_before, done.files_after) == (4, 1)
    assert contents(tables.id_ranges()) == before
    # The newest batch is replayed: its rows are replaced, not doubled.
    side(spark, tables, 4)
    assert contents(tables.id_ranges()) == before
    Upkeep(tables).sweep(["id_ranges"], NONE)
    assert contents(tables.id_ranges()) == before and listed(tables, "id_ranges") == 2


def test_young_files_of_side_tables_wait(spark, tables):
    for n in range(3):
        side(spark, tables, n)
    assert Upkeep(tables).run(LATER, ["id_ranges"], settled=timedelta(hours=1)) == []


def test_unswept_runs_have_a_bound(spark, tables, monkeypatch):
    monkeypatch.setattr(upkeep, "OPEN_RUNS", 1)
    for n in range(2):
        append(spark, tables, n)
    Upkeep(tables).run(LATER, ["meter_readings"])
    with pytest.raises(RuntimeError, match="swept"):
        Upkeep(tables).run(LATER, ["meter_readings"])


def test_nothing_stored_nothing_to_merge(tables):
    assert Upkeep(tables).run(LATER) == []
    assert Upkeep(tables).sweep() == 0
