"""The questions users ask of the stored readings, with their argument rules applied."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.functions import labels
from gaugeflow.operators import buckets, paging
from gaugeflow.operators import readings as ops
from gaugeflow.operators.paging import Connection
from gaugeflow.operators.readings import ReadingFilter
from gaugeflow.plans.arguments import aggregation_range, whole_periods

Instant = datetime | str | None


@dataclass(frozen=True)
class Page:
    """A numbered page: its rows and one row of totals."""

    items: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class ReadingStore:
    """Listings, latest values and aggregates over a readings table and its catalogue."""

    readings: DataFrame
    sensors: DataFrame

    def list_page(
        self,
        page: int = 1,
        size: int = vocab.DEFAULT_PAGE_SIZE,
        location: str | None = None,
        sensor_type: str | None = None,
        start: Instant = None,
        end: Instant = None,
    ) -> Page:
        """A numbered page of readings, newest first, with sensor name and type inlined."""
        where = ReadingFilter.of(location, sensor_type, start, end)
        paging.check_page(page, size, where.start, where.end)
        kept = ops.filter_readings(self.readings, self.sensors, where)
        days = ops.stored_days(self.readings, where)
        # The page is cut before the catalogue is joined: at most 500 rows meet it.
        cut = paging.offset_page(kept, page, size, days=days)
        rows = ops.with_sensor(cut, self.sensors)
        return Page(paging.newest_first(rows), paging.page_summary(kept, page, size))

    def connection(
        self,
        first: int | None = None,
        after: str | None = None,
        last: int | None = None,
        before: str | None = None,
        location: str | None = None,
        sensor_type: str | None = None,
        start: Instant = None,
        end: Instant = None,
    ) -> Connection:
        """A cursor page of readings, newest first, each with its sensor as a struct."""
        where = ReadingFilter.of(location, sensor_type, start, end)
        kept = ops.filter_readings(self.readings, self.sensors, where)
        days = ops.stored_days(self.readings, where)
        page = paging.keyset_page(kept, first, after, last, before, days)
        nested = ops.with_nested_sensor(page.edges, self.sensors)
        cursor = paging.cursor_of(F.col("collected_at"), F.col("id")).alias("cursor")
        edges = paging.newest_first(nested.select("*", cursor))
        return Connection(edges, page.page_info, page.total_count)

    def count(
        self,
        location: str | None = None,
        sensor_type: str | None = None,
        start: Instant = None,
        end: Instant = None,
    ) -> DataFrame:
        """Number of readings the filter admits, whatever the page."""
        where = ReadingFilter.of(location, sensor_type, start, end)
        kept = ops.filter_readings(self.readings, self.sensors, where)
        return kept.agg(F.count("*").alias("total_count"))

    def latest(self) -> DataFrame:
        """Newest reading per sensor, ordered by name and the type's place in the enum."""
        rows = ops.latest_per_sensor(self.readings, self.sensors)
        return ops.order_by_type_rank(ops.with_sensor(rows, self.sensors))

    def latest_where(
        self,
        location: str | None = None,
        sensor_type: str | None = None,
        start: Instant = None,
        end: Instant = None,
    ) -> DataFrame:
        """Newest reading inside the filter per admitted sensor, by name and stored type."""
        where = ReadingFilter.of(location, sensor_type, start, end)
        rows = ops.latest_per_sensor(self.readings, self.sensors, where)
        nested = ops.with_nested_sensor(rows, self.sensors)
        return nested.orderBy("sensor.name", "sensor.type")

    def aggregates(
        self,
        metric: str,
        interval: str = "hour",
        start: Instant = None,
        end: Instant = None,
        location: str | None = None,
        now: datetime | None = None,
    ) -> DataFrame:
        """Flat aggregate periods over exactly the given range, by period and location."""
        start, end = aggregation_range(interval, start, end, now)
        return buckets.by_period(self._periods(metric, interval, start, end, location))

    def series(
        self,
        metric: str,
        interval: str = "hour",
        start: Instant = None,
        end: Instant = None,
        location: str | None = None,
        now: datetime | None = None,
    ) -> DataFrame:
        """One series per location over the range widened to whole periods."""
        found = self._series(metric, interval, start, end, location, now)
        return found.orderBy("location")

    def aligned_series(
        self,
        metric: str,
        interval: str = "hour",
        start: Instant = None,
        end: Instant = None,
        location: str | None = None,
        now: datetime | None = None,
    ) -> DataFrame:
        """The series of ``series`` laid on one axis: every location has every period."""
        found = self._series(metric, interval, start, end, location, now)
        return buckets.align_series(found).orderBy("location")

    def catalogue(self) -> DataFrame:
        """Every sensor, by name and stored type."""
        return ops.order_by_type_name(self.sensors.select("id", "name", "sensor_type"), "name")

    def locations(self) -> DataFrame:
        """Every location once, ordered."""
        return ops.distinct_locations(self.sensors)

    def _series(
        self,
        metric: str,
        interval: str,
        start: Instant,
        end: Instant,
        location: str | None,
        now: datetime | None,
    ) -> DataFrame:
        bounds = aggregation_range(interval, start, end, now)
        bounds = whole_periods(vocab.interval(interval), *bounds)
        periods = self._periods(metric, interval, *bounds, location)
        return buckets.aggregate_series(periods, metric)

    def _periods(
        self, metric: str, interval: str, start: datetime, end: datetime, location: str | None
    ) -> DataFrame:
        return buckets.aggregate_periods(
            self.readings,
            self.sensors,
            metric,
            interval,
            start,
            end,
            labels.clean_location(location),
        )
