"""The dashboard's panels: status of all locations, their types, and one chart."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.instants import normalize
from gaugeflow.functions.labels import matches_search
from gaugeflow.operators import status
from gaugeflow.plans.store import ReadingStore

DEFAULT_RANGE = timedelta(hours=24)


@dataclass(frozen=True)
class ConsoleFilter:
    """The one filter that feeds every panel."""

    now: datetime
    location: str | None = None
    sensor_type: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    search: str = ""
    metric: str = "co2"
    interval: str = "hour"

    def resolved(self) -> ConsoleFilter:
        """Look back 24 hours unless told otherwise."""
        now = normalize(self.now)
        start = normalize(self.start) or now - DEFAULT_RANGE
        return replace(self, now=now, start=start, end=normalize(self.end))


@dataclass(frozen=True)
class Console:
    """Panels over a store, read through one filter."""

    store: ReadingStore
    where: ConsoleFilter

    def locations(self) -> DataFrame:
        """One row per location that matches the filter and the search term."""
        w = self.where.resolved()
        latest = self.store.latest_where(w.location, w.sensor_type, w.start, w.end).select(
            "*", F.col("sensor.name").alias("sensor_name"), F.col("sensor.type").alias("sensor_type")
        )
        rows = status.location_rows(latest, w.now)
        return rows.filter(matches_search(F.col("location"), w.search)).orderBy("location")

    def latest_values(self) -> DataFrame:
        return status.latest_values(self.locations(), self.where.resolved().now).orderBy("location")

    def type_summary(self) -> DataFrame:
        return status.type_summary(self.locations())

    def lost(self) -> DataFrame:
        return status.lost_locations(self.locations(), self.where.resolved().now)

    def chart(self) -> DataFrame:
        """The metric's series on one axis; the sensor type does not apply here."""
        w = self.where.resolved()
        return self.store.aligned_series(
            w.metric, w.interval, w.start, w.end, w.location, now=w.now
        )
