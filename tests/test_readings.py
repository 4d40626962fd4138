import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import paging
from gaugeflow.operators import readings as ops
from gaugeflow.operators.catalogue import find_sensor_id
from gaugeflow.operators.readings import (
    ReadingFilter,
    count_by_type,
    latest_per_sensor,
    of_type,
    order_by_type_name,
    order_by_type_rank,
)
from gaugeflow.plans.store import ReadingStore

from samples import air, at, energy, motion


@pytest.fixture
def listing(sensors, readings):
    """Kitchen energy, Office air and Garage motion, three hours each."""
    rows, id_ = [], 0
    for hour in range(3):
        for make in (
            lambda i, w: energy(i, 1, w, 10.0 + hour),
            lambda i, w: air(i, 2, w, 400),
            lambda i, w: motion(i, 3, w, hour % 2 == 0),
        ):
            id_ += 1
            rows.append(make(id_, at(60 * hour)))
    known = sensors((1, "Kitchen", "energy"), (2, "Office", "air_quality"), (3, "Garage", "motion"))
    return ReadingStore(readings(*rows), known)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_newest_first_with_the_id_breaking_ties(listing):
    assert ids(listing.list_page().items) == list(range(9, 0, -1))


def test_flat_rows_leave_inapplicable_columns_null(listing):
    row = listing.list_page(sensor_type="energy", size=1).items.first()
    assert (row["sensor_name"], row["energy_kwh"]) == ("Kitchen", 12.0)
    assert row["co2"] is None and row["motion_detected"] is None


def test_pages_are_disjoint_and_whole(listing):
    pages = [ids(listing.list_page(page=p, size=4).items) for p in (1, 2, 3, 4)]
    assert pages == [[9, 8, 7, 6], [5, 4, 3, 2], [1], []]


@pytest.mark.parametrize(
    "total, size, pages, more",
    [(0, 50, 0, False), (50, 50, 1, False), (51, 50, 2, True), (101, 50, 3, True), (9, 0, 0, False)],
)
def test_page_summary(spark, total, size, pages, more):
    df = spark.createDataFrame([(total,)], "total_count bigint")
    row = paging.summarize_total(df, 1, size).first()
    assert (row["total_pages"], row["has_more"]) == (pages, more)


@pytest.mark.parametrize(
    "arguments, message",
    [
        (dict(page=0), "page must be 1 or greater."),
        (dict(size=0), "pageSize must be between 1 and 500."),
        (dict(size=501), "pageSize must be between 1 and 500."),
        (dict(start=at(1), end=at(1)), "from must be earlier than to."),
        (dict(sensor_type="AirQuality"), "Unrecognised sensor type 'AirQuality'."),
    ],
)
def test_page_arguments(listing, arguments, message):
    with pytest.raises(ValueError) as error:
        listing.list_page(**arguments)
    assert str(error.value) == message


def test_filter_is_half_open_and_trims_the_location(listing):
    page = listing.list_page(location="  Kitchen ", start=at(60), end=at(120))
    assert ids(page.items) == [4]
    assert page.summary.first()["total_count"] == 1
    assert listing.count(location="   ").first()[0] == 9
    assert listing.count(location="Attic").first()[0] == 0
    assert listing.count(location="kitchen").first()[0] == 0


def test_bounds_carry_offsets(listing):
    assert listing.count(start="2026-05-04T13:00:00+02:00").first()[0] == 6


def test_of_type_and_count_by_type(listing):
    only = of_type(listing.readings, "motion")
    assert "co2" not in only.columns and only.count() == 3
    assert {tuple(r) for r in count_by_type(listing.readings).collect()} == {
        ("energy", 3),
        ("air_quality", 3),
        ("motion", 3),
    }


@pytest.fixture
def crowded(readings):
    """900 rows, a third of them at one instant; and their ids, newest first."""
    rng = random.Random(5)
    rows = [
        energy(i, i % 7, at(0) if i % 3 == 0 else at(rng.randrange(-50_000, 50_000)), 1.0)
        for i in rng.sample(range(10_000), 900)
    ]
    ordered = sorted(rows, key=lambda r: (r["collected_at"], r["id"]), reverse=True)
    return readings(*rows), [r["id"] for r in ordered]


@pytest.mark.parametrize("by_day", [False, True])
def test_deep_pages_equal_shallow_ones(crowded, by_day):
    df, expected = crowded
    if by_day:
        df = df.withColumn("collected_date", F.to_date("collected_at"))
    df = df.cache()
    for page in (1, 2, 17, 25, 32, 45, 46, 60):
        for range_rows in (1, 64):
            got = paging.offset_page(df, page, 20, direct_rows=20, range_rows=range_rows)
            assert ids(got) == expected[(page - 1) * 20 : page * 20], (page, range_rows)
    assert ids(paging.offset_page(df.limit(0), 9, 20, direct_rows=20)) == []


def test_located_ranges_are_small(crowded):
    df, expected = crowded
    df = df.cache()
    for rank in (0, 10, 300, 450, 599, 899):
        span = paging._locate(df, rank, 16, None)
        assert span.rows <= 16 and span.ahead <= rank < span.ahead + span.rows
        kept = df.filter(span.not_newer()).filter(span.not_older())
        assert ids(paging.newest_first(kept)) == expected[span.ahead : span.ahead + span.rows]
    assert paging._locate(df, 900, 16, None) is None


# --- cursors ----------------------------------------------------------------------------


def walk(store, size, **where):
    seen, after = [], None
    while True:
        page = store.connection(first=size, after=after, **where)
        info = page.page_info.first()
        seen.append(ids(page.edges))
        assert info["has_previous_page"] == (after is not None)
        if not info["has_next_page"]:
            return seen
        after = info["end_cursor"]


@pytest.fixture
def twelve(sensors, readings):
    rows = [energy(i, 1, at(i), float(i)) for i in range(1, 13)]
    return ReadingStore(readings(*rows), sensors((1, "Kitchen", "energy")))


def test_walk_visits_every_row_once(twelve):
    assert walk(twelve, 5) == [[12, 11, 10, 9, 8], [7, 6, 5, 4, 3], [2, 1]]


def test_appends_between_pages_do_not_shift_them(twelve, readings):
    first = twelve.connection(first=5)
    cursor = first.page_info.first()["end_cursor"]
    head = readings(*[energy(100 + i, 1, at(100 + i), 0.0) for i in range(5)])
    grown = ReadingStore(twelve.readings.unionByName(head), twelve.sensors)
    assert ids(grown.connection(first=5, after=cursor).edges) == [7, 6, 5, 4, 3]


def test_ties_page_by_id(sensors, readings):
    rows = [energy(i, i, at(0), 1.0) for i in range(1, 11)]
    known = sensors(*[(i, f"Room {i}", "energy") for i in range(1, 11)])
    assert walk(ReadingStore(readings(*rows), known), 4) == [[10, 9, 8, 7], [6, 5, 4, 3], [2, 1]]


def test_backward_pages(twelve):
    tail = twelve.connection(last=5)
    info = tail.page_info.first()
    assert ids(tail.edges) == [5, 4, 3, 2, 1]
    assert info["has_previous_page"] and not info["has_next_page"]
    before = twelve.connection(last=5, before=info["start_cursor"])
    assert ids(before.edges) == [10, 9, 8, 7, 6]
    assert before.page_info.first()["has_next_page"]


def test_edges_nest_the_sensor_and_carry_their_cursor(twelve):
    page = twelve.connection(first=2)
    edges = page.edges.collect()
    assert edges[0]["sensor"].asDict() == {"id": 1, "name": "Kitchen", "type": "energy"}
    info = page.page_info.first()
    assert (info["start_cursor"], info["end_cursor"]) == (edges[0]["cursor"], edges[1]["cursor"])


def test_cursor_arguments(twelve):
    with pytest.raises(ValueError, match="maximum allowed items"):
        twelve.connection(first=101)
    with pytest.raises(ValueError, match="together"):
        twelve.connection(first=1, last=1)
    with pytest.raises(ValueError, match="cursor"):
        twelve.connection(after="?")
    assert len(ids(twelve.connection().edges)) == 12


def test_empty_connection(twelve):
    page = twelve.connection(location="Attic")
    info = page.page_info.first()
    assert page.edges.count() == 0
    assert not info["has_next_page"] and info["end_cursor"] is None


@pytest.fixture
def long_table(sensors, readings):
    """One reading a week for three years, stored by day; and another sensor's, long ago."""
    rows = [energy(i, 1, at(0, days=-7 * i), float(i)) for i in range(150)]
    rows += [energy(1000 + i, 2, at(0, days=-1040 - i), 1.0) for i in range(4)]
    df = readings(*rows).withColumn("collected_date", F.to_date("collected_at"))
    known = sensors((1, "Kitchen", "energy"), (2, "Attic", "energy"))
    rows.sort(key=lambda r: (r["collected_at"], r["id"]), reverse=True)
    expected = [r["id"] for r in rows]
    return ReadingStore(df.cache(), known), expected


def test_pages_over_a_long_table(long_table):
    store, expected = long_table
    assert ids(store.list_page(1, 10).items) == expected[:10]
    assert ids(store.list_page(12, 10).items) == expected[110:120]
    assert ids(store.list_page(16, 10).items) == expected[150:]
    assert ids(store.list_page(17, 10).items) == []
    assert ids(store.list_page(1, 3, location="Attic").items) == [1000, 1001, 1002]
    assert ids(store.list_page(1, 3, end=at(0, days=-1041)).items) == [1002, 1003, 149]


def test_tables_of_the_earliest_day(sensors, readings):
    df = readings(energy(1, 1, at(0), 1.0), energy(2, 1, at(1), 2.0))
    first = F.timestamp_seconds(F.unix_seconds("collected_at") - F.unix_seconds(F.lit(at(0))) - 62135596800)
    early = df.withColumn("collected_at", first).withColumn("collected_date", F.to_date("collected_at"))
    store = ReadingStore(early, sensors((1, "K", "energy")))
    assert ids(store.list_page().items.select("id")) == [2, 1]
    assert ids(store.connection(first=1).edges.select("id")) == [2]
    assert ids(store.connection(last=1).edges.select("id")) == [1]
    assert ids(store.latest().select("id")) == [2]


def test_cursors_over_a_long_table(long_table):
    store, expected = long_table
    assert walk(store, 60) == [expected[:60], expected[60:120], expected[120:]]
    back = store.connection(last=100)
    assert ids(back.edges) == expected[-100:]
    again = store.connection(last=100, before=back.page_info.first()["start_cursor"])
    assert ids(again.edges) == expected[:-100]
    assert not again.page_info.first()["has_previous_page"]


# --- latest -----------------------------------------------------------------------------


@pytest.fixture
def two_rooms(sensors, readings):
    rows = [energy(1, 1, at(0), 1.0), energy(2, 1, at(120), 2.0), energy(3, 2, at(60), 9.0)]
    known = sensors((1, "Kitchen", "energy"), (2, "Garage", "energy"), (3, "Attic", "motion"))
    return ReadingStore(readings(*rows), known)


def test_latest_per_sensor(two_rooms):
    rows = [(r["sensor_name"], r["energy_kwh"]) for r in two_rooms.latest().collect()]
    assert rows == [("Garage", 9.0), ("Kitchen", 2.0)]


def test_latest_takes_the_newest_inside_the_range(two_rooms):
    rows = two_rooms.latest_where(end=at(120)).collect()
    assert [(r["sensor"]["name"], r["energy_kwh"]) for r in rows] == [("Garage", 9.0), ("Kitchen", 1.0)]
    assert two_rooms.latest_where(location="Garage").count() == 1
    assert two_rooms.latest_where(sensor_type="motion").count() == 0


def test_latest_breaks_ties_by_id(sensors, readings):
    rows = readings(energy(1, 1, at(0), 1.0), energy(2, 1, at(0), 2.0))
    assert latest_per_sensor(rows, sensors((1, "K", "energy"))).first()["id"] == 2


@pytest.mark.parametrize("silent_days", [None, 1, 10, 100, 300])
def test_latest_of_stored_days_equals_a_full_pass(readings, sensors, silent_days):
    rng = random.Random(2)
    rows = [energy(i, i % 9, at(-i * 7, days=-(i % 3)), float(i)) for i in range(1, 400)]
    if silent_days:
        rows += [energy(900 + i, 50 + i % 2, at(rng.randrange(60), days=-silent_days), 1.0) for i in range(5)]
    known = sensors(*[(i, f"R{i}", "energy") for i in [*range(9), 50, 51][: 11 if silent_days else 9]])
    plain = readings(*rows)
    stored = plain.withColumn("collected_date", F.to_date("collected_at"))
    expected = sorted(r["id"] for r in latest_per_sensor(plain, known).collect())
    assert sorted(r["id"] for r in latest_per_sensor(stored, known).collect()) == expected
    where = ReadingFilter.of(end=at(0, days=-2))
    expected = sorted(r["id"] for r in latest_per_sensor(plain, known, where).collect())
    assert sorted(r["id"] for r in latest_per_sensor(stored, known, where).collect()) == expected


def test_latest_reads_only_recent_days_when_all_report(spark, readings, sensors, folder):
    rows = [energy(i, i % 3, at(0, days=-i), 1.0) for i in range(60)]
    rows += [energy(100 + i, i, at(1), 1.0) for i in range(3)]
    stored = readings(*rows).withColumn("collected_date", F.to_date("collected_at"))
    stored.write.partitionBy("collected_date").parquet(f"{folder}/t")
    known = sensors(*[(i, f"R{i}", "energy") for i in range(3)])
    latest = latest_per_sensor(spark.read.parquet(f"{folder}/t"), known)
    assert sorted(ids(latest)) == [100, 101, 102]
    plan = latest._jdf.queryExecution().toString()
    assert "Union" not in plan and "(collected_date" in plan and ">= 2026-05-03" in plan


def test_latest_is_cut_before_the_shuffle(two_rooms):
    plan = latest_per_sensor(two_rooms.readings, two_rooms.sensors)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_orders(spark, sensors):
    known = sensors((1, "B", "motion"), (2, "A", "motion"), (3, "A", "energy"), (4, "A", "air_quality"))
    assert [r["id"] for r in order_by_type_name(known, "name").collect()] == [4, 3, 2, 1]
    assert [r["id"] for r in order_by_type_rank(known, "name").collect()] == [4, 2, 3, 1]


def test_catalogue(two_rooms):
    assert [r["location"] for r in two_rooms.locations().collect()] == ["Attic", "Garage", "Kitchen"]
    assert find_sensor_id(two_rooms.sensors, "Garage", "energy").first()["id"] == 2
    assert find_sensor_id(two_rooms.sensors, "Garage", "motion").count() == 0


def test_stored_readings_prune_days(spark, two_rooms, folder):
    stored = two_rooms.readings.withColumn("collected_date", F.to_date("collected_at"))
    stored.write.partitionBy("collected_date").parquet(f"{folder}/t")
    store = ReadingStore(spark.read.parquet(f"{folder}/t"), two_rooms.sensors)
    assert ids(store.list_page(page=1, size=2).items) == [2, 3]
    listed = store.list_page(start=at(60), end=at(60) + timedelta(minutes=1)).items
    assert ids(listed) == [3]
    plan = listed._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(collected_date" in plan
    assert "GreaterThanOrEqual(collected_at" in plan
    cursor = store.connection(first=1).page_info.first()["end_cursor"]
    page = store.connection(first=5, after=cursor)
    assert ids(page.edges) == [3, 1]
    assert "LessThanOrEqual(collected_at" in page.edges._jdf.queryExecution().toString()


def test_filter_of_rejects_unknown_types():
    with pytest.raises(ValueError):
        ReadingFilter.of(sensor_type="Motion")


def test_days_come_from_folder_names_and_odd_clocks_cost_one_day(spark, readings, sensors, folder):
    days = [datetime(2026, 5, d, 10, tzinfo=timezone.utc) for d in range(1, 21)]
    odd = [datetime(2124, 1, 1, tzinfo=timezone.utc), datetime(1900, 1, 1, tzinfo=timezone.utc)]
    rows = [energy(n, 1 + n % 2, when, 1.0) for n, when in enumerate([*days, *odd])]
    stored = readings(*rows).withColumn("collected_date", F.to_date("collected_at"))
    stored.write.partitionBy("collected_date").parquet(f"{folder}/t")
    table = spark.read.parquet(f"{folder}/t")

    days_there = ops.stored_days(table)
    assert days_there == sorted({r["collected_at"].date() for r in rows})
    within = ReadingFilter(start=days[3], end=days[5])
    assert ops.stored_days(table, within) == [d.date() for d in days[3:6]]

    known = sensors((1, "A", "energy"), (2, "B", "energy"))
    found = latest_per_sensor(table, known)
    assert sorted(r["id"] for r in found.collect()) == [19, 20]
    # The newest two days that exist: the odd one and the newest real one.
    assert ">= 2026-05-20" in found._jdf.queryExecution().toString()

    newest = [r["id"] for r in paging.offset_page(table, 1, 3, days=days_there).collect()]
    assert newest == [20, 19, 18] == [r["id"] for r in paging.keyset_page(table, first=3, days=days_there).edges.collect()]
    oldest = paging.keyset_page(table, last=2, days=days_there).edges
    assert [r["id"] for r in oldest.collect()] == [0, 21]
    assert oldest.inputFiles() and len(table.inputFiles()) == 22
