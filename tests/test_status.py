import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import instants, labels, thresholds
from gaugeflow.operators import readings as ops
from gaugeflow.operators import status
from gaugeflow.plans.console import Console, ConsoleFilter
from gaugeflow.plans.store import ReadingStore

from samples import air, at, energy, motion

NOW = at(60)


def ago(seconds):
    return at(60, seconds=-seconds)


@pytest.fixture
def rows(sensors, readings):
    def make(known, *facts, now=NOW):
        catalogue = sensors(*known)
        latest = ops.latest_per_sensor(readings(*facts), catalogue)
        return status.location_rows(ops.with_sensor(latest, catalogue), now)

    return make


ONE = [(1, "Kitchen", "air_quality"), (2, "Kitchen", "motion"), (3, "Kitchen", "energy")]


def test_slots_keep_their_own_state(rows):
    df = rows(ONE, air(1, 1, ago(5), 700), motion(2, 2, ago(300), True), energy(3, 3, ago(1000), 2.5))
    row = df.first()
    assert row["location"] == "Kitchen" and df.count() == 1
    assert (row["air_quality"]["state"], row["air_quality"]["co2"]) == ("live", 700)
    assert (row["motion"]["state"], row["motion"]["detected"]) == ("stale", True)
    assert (row["energy"]["state"], row["energy"]["kwh"]) == ("lost", 2.5)
    assert row["worst"] == "lost"
    assert row["oldest_collected_at"] == ago(1000).replace(tzinfo=None)


def test_missing_types_leave_empty_slots(rows):
    df = rows(ONE, motion(2, 2, ago(5), False))
    row = df.select("*", status.types_present(df).alias("types")).first()
    assert row["air_quality"] is None and row["energy"] is None
    assert (row["types"], row["worst"]) == ("MOTION", "live")


def test_types_in_fixed_order(rows):
    df = rows(ONE, energy(3, 3, ago(5), 1.0), air(1, 1, ago(5), 1))
    assert df.select(status.types_present(df)).first()[0] == "AIR_QUALITY + ENERGY"


@pytest.mark.parametrize(
    "seconds, state, label",
    [
        (-30, "live", "0s"),
        (0, "live", "0s"),
        (42, "live", "42s"),
        (119, "live", "1m"),
        (120, "stale", "2m"),
        (420, "stale", "7m"),
        (899, "stale", "14m"),
        (900, "lost", "15m"),
        (3600, "lost", "1h00"),
        (3900, "lost", "1h05"),
        (90_000, "lost", "25h00"),
    ],
)
def test_states_and_labels(spark, seconds, state, label):
    df = spark.createDataFrame([(ago(seconds),)], "at timestamp")
    got = df.select(instants.feed_state(F.col("at"), NOW), instants.age_label(F.col("at"), NOW)).first()
    assert tuple(got) == (state, label)


@pytest.mark.parametrize(
    "values, expected",
    [
        ((1000, 15, 60), []),
        ((1001, 15, 30), ["CO2 HIGH"]),
        ((1001, 16, 61), ["CO2 HIGH", "PM2.5 HIGH", "RH HIGH"]),
        ((0, 0, 29), ["RH LOW"]),
        ((None, None, None), []),
        ((None, 16, None), ["PM2.5 HIGH"]),
    ],
)
def test_breaches(spark, values, expected):
    df = spark.createDataFrame([values], "co2 int, pm25 int, humidity int")
    broken = thresholds.breaches(F.col("co2"), F.col("pm25"), F.col("humidity"))
    assert [b["label"] for b in df.select(broken).first()[0]] == expected


def test_breach_flags(spark):
    df = spark.createDataFrame([(1000, 29), (1001, 30), (None, None)], "co2 int, humidity int")
    flags = df.select(
        thresholds.is_breached("co2", F.col("co2")), thresholds.is_breached("humidity", F.col("humidity"))
    )
    assert [tuple(r) for r in flags.collect()] == [(False, True), (True, False), (False, False)]


def test_chart_limits(spark):
    names = ["co2", "pm25", "humidity", "motion_detected", "energy_kwh"]
    row = spark.range(1).select(*[thresholds.alert_limit(n) for n in names]).first()
    assert tuple(row) == (1000.0, 15.0, 60.0, None, None)


def test_values_of_lost_sensors_are_withheld(rows):
    df = rows(ONE, air(1, 1, ago(1000), 2000, 20), motion(2, 2, ago(300), False), energy(3, 3, ago(5), 2.5))
    row = status.latest_values(df, NOW).first()
    assert row["co2"] is None and row["verdict"] is None and row["co2_breached"] is False
    assert (row["motion"], row["kwh"], row["feed"], row["age"]) == ("NO", 2.5, "lost", "16m")


def test_verdicts(rows):
    for facts, verdict in (
        ((700, 5, 40), "NORMAL"),
        ((1001, 5, 40), "CO2 HIGH >1000"),
        ((1001, 16, 20), "CO2 HIGH >1000 +2"),
    ):
        df = rows(ONE, air(1, 1, ago(5), *facts))
        assert status.latest_values(df, NOW).first()["verdict"] == verdict


def test_type_summary(rows):
    known = [(i, f"R{i}", t) for i, t in enumerate(["air_quality"] * 3 + ["motion"] * 3 + ["energy"], 1)]
    df = rows(
        known,
        air(1, 1, ago(5), 400),
        air(2, 2, ago(5), 600),
        air(3, 3, ago(5000), 5000),
        motion(4, 4, ago(5), True),
        motion(5, 5, ago(5), False),
        motion(6, 6, ago(300), None),
        energy(7, 7, ago(5000), 1.0),
    )
    row = status.type_summary(df).first()
    assert (row["avg_co2"], row["air_reporting"]) == (500.0, 2)
    assert row["motion_fraction"] == pytest.approx(1 / 3) and row["motion_reporting"] == 3
    assert (row["avg_kwh"], row["energy_reporting"], row["lost_locations"]) == (None, 0, 2)


def test_console(spark, sensors, readings):
    known = sensors(*ONE, (4, "Attic", "energy"))
    facts = readings(
        air(1, 1, ago(5), 700), energy(3, 3, ago(300), 1.0), energy(4, 4, ago(2000), 3.0),
        energy(5, 3, at(60, days=-2), 9.0),
    )
    store = ReadingStore(facts, known)
    console = Console(store, ConsoleFilter(now=NOW, metric="energy_kwh"))
    assert [r["location"] for r in console.latest_values().collect()] == ["Attic", "Kitchen"]
    assert [tuple(r) for r in console.lost().collect()] == [("Attic", "33m")]
    assert console.type_summary().first()["avg_kwh"] == 1.0
    assert {r["location"] for r in console.chart().collect()} == {"Attic", "Kitchen"}
    found = Console(store, ConsoleFilter(now=NOW, search=" KIT ")).latest_values().collect()
    assert [r["location"] for r in found] == ["Kitchen"]
    # The look-back of 24 hours hides a sensor that was silent for longer.
    late = Console(store, ConsoleFilter(now=at(60, days=3)))
    assert late.locations().count() == 0


def test_search_and_labels(spark):
    df = spark.createDataFrame([("Kitchen", "air_quality"), ("Hall", "other")], "l string, t string")
    assert [r[0] for r in df.select(labels.matches_search(F.col("l"), " iTCH ")).collect()] == [True, False]
    assert [r[0] for r in df.select(labels.matches_search(F.col("l"), "  ")).collect()] == [True, True]
    assert [r[0] for r in df.select(labels.type_label(F.col("t"))).collect()] == ["AIR QUALITY", "other"]
