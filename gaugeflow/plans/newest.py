"""The latest reading of every sensor, kept as a table and merged as days close.

``KeptLatest`` holds one row per sensor, in buckets by a hash of the sensor's id, for all days
before a bound. A merge reads the days that closed since and those that got late readings,
reduces them to a row per sensor, and rewrites only the buckets of sensors whose newest reading
changed; the state, one
file with the bound and the run each bucket was last written by, then appears as a whole. A
reader takes the kept rows and the days that are not merged; taking the newest of both is the same as over the
whole table, since it may see a row twice but never miss one.

Late readings are known by marks: a writer leaves one per day before it writes (``writing``) and
says when it is done. Readers also read every marked day. A merge takes away the marks
whose writer was done before the merge began to read; that of a writer which died stays, and
its day is read until the batch is replayed, or ``forget`` says that it never will be.

Upkeep may merge files meanwhile. One merge of kept rows runs at a time, under a claim.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.operators import readings as ops
from gaugeflow.operators.readings import READING_COLUMNS
from gaugeflow.schemas import METER_READINGS
from gaugeflow.sources import folders
from gaugeflow.sources.tables import Tables

BUCKETS = 64
_ROWS = T.StructType([*METER_READINGS.fields, T.StructField("bucket", T.IntegerType())])
_STATE = "bucket int, run int, closed_before date, buckets int"
_DONE = ".done"


@dataclass(frozen=True)
class State:
    """What the newest merge left: the bound, and the run that holds each bucket."""

    number: int = 0
    closed_before: date | None = None
    buckets: int = BUCKETS
    runs: tuple[tuple[int, int], ...] = ()


@dataclass(frozen=True)
class KeptLatest:
    """The kept rows of one set of tables. ``buckets`` counts for the first merge."""

    tables: Tables
    buckets: int = BUCKETS

    # --- writers ------------------------------------------------------------------------

    @contextmanager
    def writing(self, days: list[date], batch: str) -> Iterator[None]:
        """Mark the days that a batch appends to. A batch that fails leaves its marks."""
        spark = self.tables.spark
        for day in days:
            folders.delete(spark, self._mark(day, batch + _DONE))
            folders.mark(spark, self._mark(day, batch))
        yield
        for day in days:
            folders.mark(spark, self._mark(day, batch + _DONE))

    def forget(self, batch: str) -> None:
        """Take a batch that died for done: what it wrote is there, and no more will come."""
        for day, name in self._marks():
            if name == batch:
                folders.mark(self.tables.spark, self._mark(day, batch + _DONE))

    # --- readers ------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """The newest reading of every sensor, as ``readings.newest_rows`` gives it."""
        # Marks first: one that is gone is covered by a state that is there already.
        marked = self._marked()
        state = self.state()
        stored = self.tables.readings()
        if not state.number:
            return ops.newest_rows(stored)
        day = F.col("collected_date")
        recent = stored.filter(day >= F.lit(state.closed_before))
        late = [d for d in marked if d < state.closed_before]
        if late:
            recent = recent.unionByName(self.tables.readings_of(late))
        both = recent.select(*READING_COLUMNS).unionByName(self._kept(state).select(*READING_COLUMNS))
        return ops.newest_rows(both)

    def latest(self) -> DataFrame:
        """The newest readings by name and the type's place in the enum, as ``ReadingStore.latest``."""
        sensors = self.tables.sensors()
        return ops.order_by_type_rank(ops.with_sensor(self.rows(), sensors))

    # --- the merge ----------------------------------------------------------------------

    def merge(self, closed_before: date) -> int:
        """Merge the days before a bound that are not merged yet; how many buckets were written."""
        spark = self.tables.spark
        with folders.exclusive(spark, self.tables.claim_path("latest")):
            done = self._done_marks()
            state = self.state()
            bound = max(closed_before, state.closed_before or closed_before)
            # By folder names; late days may be among the merged ones.
            days = ops.stored_days(self.tables.readings()) or []
            late = {day for day, _ in done}
            fresh = [d for d in days if d < bound and (d in late or not state.number or d >= state.closed_before)]
            run, buckets = state.number + 1, state.buckets if state.number else self.buckets
            written = self._write(state, fresh, run, buckets) if fresh else []
            runs = dict(state.runs) | {bucket: run for bucket in written}
            self._commit(State(run, bound, buckets, tuple(sorted(runs.items()))))
            for day, batch in done:
                if day < bound:
                    folders.delete(spark, self._mark(day, batch))
                    folders.delete(spark, self._mark(day, batch + _DONE))
            return len(written)

    def sweep(self) -> int:
        """Delete the bucket files and states that the newest state does not name.

        Readers that listed them must be through, so run it some hours after the last merge.
        """
        spark, state, deleted = self.tables.spark, self.state(), 0
        live = dict(state.runs)
        for name in folders.children(spark, self._path("rows")):
            run = int(name.removeprefix("run="))
            for part in folders.children(spark, self._path("rows", name)):
                if part.startswith("bucket=") and run <= state.number:
                    if live.get(int(part.removeprefix("bucket="))) != run:
                        folders.delete(spark, self._path("rows", name, part), recursive=True)
                        deleted += 1
        for number in self._states():
            if number < state.number:
                folders.delete(spark, self._state_path(number), recursive=True)
        return deleted

    def _write(self, state: State, days: list[date], run: int, buckets: int) -> list[int]:
        newest = ops.newest_rows(self.tables.readings_of(days)).withColumn("bucket", _bucket(buckets))
        kept = self._kept(state)
        place = F.struct("collected_at", "id")
        before = kept.select("sensor_id", place.alias("before"))
        newer = F.col("before").isNull() | (place > F.col("before"))
        fresh = newest.join(before, "sensor_id", "left").filter(newer).drop("before").persist()
        path = self._path("rows", f"run={run}")
        try:
            # At most one row per bucket.
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
            if not touched:
                return []
            old = kept.filter(F.col("bucket").isin(touched))
            merged = ops.newest_rows(fresh.unionByName(old)).withColumn("bucket", _bucket(buckets))
            # A bucket is one file, whatever share of the readings a sensor in it has.
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        finally:
            fresh.unpersist()
        return touched

    # --- where it lies ------------------------------------------------------------------

    def _path(self, *parts: str) -> str:
        return "/".join([self.tables.root.rstrip("/"), "latest", *parts])

    def _mark(self, day: date, batch: str) -> str:
        return self._path("late", f"{day.isoformat()}~{batch}")

    def _marks(self) -> list[tuple[date, str]]:
        """Day and batch of every mark, done or not; one listing, however long the table."""
        parted = (name.split("~", 1) for name in folders.children(self.tables.spark, self._path("late")))
        return [(date.fromisoformat(day), batch) for day, batch in parted]

    def _marked(self) -> list[date]:
        return sorted({day for day, _ in self._marks()})

    def _done_marks(self) -> list[tuple[date, str]]:
        return [(day, name.removesuffix(_DONE)) for day, name in self._marks() if name.endswith(_DONE)]

    def _state_path(self, number: int) -> str:
        return self._path("state", f"run={number:08d}")

    def _states(self) -> list[int]:
        names = folders.children(self.tables.spark, self._path("state"))
        return sorted(int(n.removeprefix("run=")) for n in names if n.startswith("run="))

    def state(self) -> State:
        spark = self.tables.spark
        for number in reversed(self._states()):
            parts = folders.children(spark, self._state_path(number))
            if any(part.startswith("part-") for part in parts):
                lines = spark.read.schema(_STATE).json(self._state_path(number)).collect()
                runs = sorted((r["bucket"], r["run"]) for r in lines if r["bucket"] is not None)
                return State(number, lines[0]["closed_before"], lines[0]["buckets"], tuple(runs))
        return State()

    def _commit(self, state: State) -> None:
        lines = [(b, r, state.closed_before, state.buckets) for b, r in state.runs]
        lines = lines or [(None, None, state.closed_before, state.buckets)]
        rows = self.tables.spark.createDataFrame(lines, _STATE).coalesce(1)
        rows.write.mode("overwrite").json(self._state_path(state.number))

    def _kept(self, state: State) -> DataFrame:
        spark = self.tables.spark
        paths = [self._path("rows", f"run={run}", f"bucket={bucket}") for bucket, run in state.runs]
        if not paths:
            return spark.createDataFrame([], _ROWS)
        rows = spark.read.schema(_ROWS).option("basePath", self._path("rows")).parquet(*paths)
        return rows.select(*_ROWS.fieldNames())


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("sensor_id"), F.lit(buckets)).cast("int")
