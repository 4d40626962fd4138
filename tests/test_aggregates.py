from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import buckets
from gaugeflow.plans.arguments import aggregation_range, whole_periods
from gaugeflow.plans.store import ReadingStore

from samples import air, at, energy, motion, utc


@pytest.fixture
def kitchen(sensors, readings):
    def make(*rows):
        known = sensors((1, "Kitchen", "energy"), (2, "Garage", "energy"), (3, "Hall", "motion"), (4, "Hall", "air_quality"))
        return ReadingStore(readings(*rows), known)

    return make


DAY = dict(start=at(0), end=at(24 * 60))


def rows_of(df):
    return [tuple(r) for r in df.select("location", "count", "average", "minimum", "maximum").collect()]


def test_hourly_buckets(kitchen):
    store = kitchen(*[energy(i, 1, at(m), v) for i, (m, v) in enumerate([(0, 10.0), (20, 20.0), (40, 30.0), (70, 100.0)])])
    found = store.aggregates("energy_kwh", "hour", **DAY)
    assert rows_of(found) == [("Kitchen", 3, 20.0, 10.0, 30.0), ("Kitchen", 1, 100.0, 100.0, 100.0)]
    assert [r["period_start"] for r in found.collect()] == [at(0).replace(tzinfo=None), at(60).replace(tzinfo=None)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_days_are_utc_days_in_any_session(spark, kitchen, zone):
    store = kitchen(energy(1, 1, at(120), 1.0), energy(2, 1, at(13 * 60 + 59), 3.0), energy(3, 1, at(14 * 60), 9.0))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = store.aggregates("energy_kwh", "day", **DAY).select(
            F.unix_micros("period_start").alias("at"), "count"
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    first = int(utc("2026-05-04T00:00:00").timestamp() * 1e6)
    assert [tuple(r) for r in found] == [(first, 2), (first + 86_400_000_000, 1)]


def test_motion_average_is_a_rate(kitchen):
    store = kitchen(*[motion(i, 3, at(i), d) for i, d in enumerate([True, True, False, False])])
    assert rows_of(store.aggregates("motion_detected", "day", **DAY)) == [("Hall", 4, 0.5, 0.0, 1.0)]


def test_bounds_location_and_type(kitchen):
    store = kitchen(
        energy(1, 1, at(0), 1.0),
        energy(2, 1, at(60), 2.0),
        energy(3, 2, at(0), 4.0),
        air(4, 4, at(0), 700),
        motion(5, 3, at(0), True),
    )
    assert rows_of(store.aggregates("energy_kwh", "hour", at(0), at(60))) == [
        ("Garage", 1, 4.0, 4.0, 4.0),
        ("Kitchen", 1, 1.0, 1.0, 1.0),
    ]
    assert len(rows_of(store.aggregates("energy_kwh", "hour", **DAY, location=" Kitchen "))) == 2
    assert rows_of(store.aggregates("co2", "hour", **DAY)) == [("Hall", 1, 700.0, 700.0, 700.0)]
    assert rows_of(store.aggregates("energy_kwh", "hour", at(600), at(700))) == []


def test_series_widen_to_whole_periods(kitchen):
    # 12:10 and 12:40, asked from 12:30: the first period is still whole.
    store = kitchen(energy(1, 1, at(130), 1.0), energy(2, 1, at(160), 3.0))
    arguments = ("energy_kwh", "hour", at(150), at(180))
    series = store.series(*arguments).collect()
    assert len(series) == 1 and series[0]["unit"] == "kWh"
    (point,) = series[0]["points"]
    assert (point["count"], point["average"]) == (2, 2.0)
    assert point["period_start"] == at(120).replace(tzinfo=None)
    assert rows_of(store.aggregates(*arguments)) == [("Kitchen", 1, 3.0, 3.0, 3.0)]


def test_series_order_and_emptiness(kitchen):
    store = kitchen(energy(1, 1, at(60), 1.0), energy(2, 1, at(0), 2.0), energy(3, 2, at(0), 3.0))
    series = store.series("energy_kwh", "hour", **DAY).collect()
    assert [s["location"] for s in series] == ["Garage", "Kitchen"]
    assert [p["average"] for p in series[1]["points"]] == [2.0, 1.0]
    assert store.series("co2", "hour", **DAY).count() == 0


def test_late_rows_land_in_their_own_period(kitchen):
    store = kitchen(energy(1, 1, at(600), 1.0), energy(2, 1, at(0), 5.0))
    assert [r[2] for r in rows_of(store.aggregates("energy_kwh", "hour", **DAY))] == [5.0, 1.0]


def test_aligned_series_and_gaps(kitchen):
    store = kitchen(
        energy(1, 1, at(0), 1.0), energy(2, 1, at(60), 2.0), energy(3, 1, at(180), 3.0),
        energy(4, 2, at(60), 4.0), energy(5, 2, at(180), 5.0),
    )
    aligned = buckets.align_series(store.series("energy_kwh", "hour", **DAY))
    values = {r["location"]: [v["average"] for v in r["values"]] for r in aligned.collect()}
    assert values == {"Kitchen": [1.0, 2.0, 3.0], "Garage": [None, 4.0, 5.0]}
    assert "NestedLoop" not in aligned._jdf.queryExecution().toString()
    # A gap at the very start is no lost signal.
    assert {tuple(r) for r in buckets.first_gaps(aligned).collect()} == {
        ("Kitchen", None, None),
        ("Garage", 0, None),
    }


def test_lost_at_is_the_last_period_before_the_gap(kitchen):
    store = kitchen(
        energy(1, 1, at(0), 1.0), energy(2, 1, at(60), 2.0),
        energy(3, 2, at(0), 3.0), energy(4, 2, at(60), 3.0), energy(5, 2, at(120), 3.0),
    )
    series = store.series("energy_kwh", "hour", **DAY)
    gaps = {r["location"]: r for r in buckets.first_gaps(buckets.align_series(series)).collect()}
    assert gaps["Kitchen"]["gap_index"] == 2
    assert gaps["Kitchen"]["lost_at"] == at(60).replace(tzinfo=None)
    assert gaps["Garage"]["gap_index"] is None
    assert buckets.period_axis(series).count() == 3
    assert buckets.period_count(series).first()[0] == 3


def test_all_samples(kitchen):
    store = kitchen(air(1, 4, at(0), 400, 5, 40), motion(2, 3, at(0), False), energy(3, 1, at(0), 2.5))
    found = {(r["metric"], r["unit"], r["value"]) for r in buckets.all_samples(store.readings).collect()}
    assert found == {
        ("co2", "ppm", 400.0),
        ("pm25", "ug/m3", 5.0),
        ("humidity", "%", 40.0),
        ("motion_detected", "fraction", 0.0),
        ("energy_kwh", "kWh", 2.5),
    }


def test_facts_are_reduced_before_the_join(kitchen):
    plan = kitchen(energy(1, 1, at(0), 1.0)).aggregates("energy_kwh", "hour", **DAY)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    join, aggregate = text.index("Join"), text.index("Aggregate")
    assert join < aggregate


# --- the range rule ---------------------------------------------------------------------

NOW = utc("2026-05-04T12:00:00")


@pytest.mark.parametrize("interval, days", [("hour", 1), ("day", 30), ("week", 90), ("month", 90)])
def test_default_ranges(interval, days):
    assert aggregation_range(interval, now=NOW) == (NOW - timedelta(days=days), NOW)


def test_range_limits():
    aggregation_range("hour", NOW - timedelta(days=83), NOW)
    aggregation_range("day", NOW - timedelta(days=90), NOW)
    with pytest.raises(ValueError) as error:
        aggregation_range("hour", NOW - timedelta(days=84), NOW)
    assert str(error.value) == (
        "The requested range would produce about 2016 periods; at most 2000 are allowed. "
        "Widen the interval or narrow the range."
    )
    with pytest.raises(ValueError) as error:
        aggregation_range("day", NOW - timedelta(days=91), NOW)
    assert str(error.value) == "The requested range spans 91 days; at most 90 are allowed."
    for start in (NOW, NOW + timedelta(seconds=1)):
        with pytest.raises(ValueError, match="from must be earlier than to."):
            aggregation_range("hour", start, NOW)
    with pytest.raises(ValueError):
        aggregation_range("minute", now=NOW)


@pytest.mark.parametrize(
    "interval, start, end, low, high",
    [
        ("hour", "2026-05-04T10:37", "2026-05-04T12:05", "2026-05-04T10:00", "2026-05-04T13:00"),
        ("hour", "2026-05-04T10:00", "2026-05-04T12:00", "2026-05-04T10:00", "2026-05-04T12:00"),
        ("day", "2026-05-04T10:37", "2026-05-05T00:00", "2026-05-04T00:00", "2026-05-05T00:00"),
        ("week", "2026-05-03T08:00", "2026-05-06T08:00", "2026-04-27T00:00", "2026-05-11T00:00"),
        ("month", "2026-01-31T08:00", "2026-03-02T08:00", "2026-01-01T00:00", "2026-04-01T00:00"),
        ("month", "2026-11-05T08:00", "2026-12-02T08:00", "2026-11-01T00:00", "2027-01-01T00:00"),
    ],
)
def test_whole_periods(interval, start, end, low, high):
    assert whole_periods(interval, utc(start), utc(end)) == (utc(low), utc(high))


def test_widening_agrees_with_the_buckets(spark, kitchen):
    from gaugeflow.functions import instants

    moments = [utc("2026-01-01T00:00:00") + timedelta(hours=7 * i, minutes=11 * i) for i in range(300)]
    df = spark.createDataFrame([(m,) for m in moments], "at timestamp")
    for interval in ("hour", "day", "week", "month"):
        got = df.select(F.unix_micros(instants.period_start(F.col("at"), interval))).collect()
        want = [instants.micros_of(instants.floor_to_period(m, interval)) for m in moments]
        assert [r[0] for r in got] == want
