"""The stored tables: where they lie, how they are read and appended."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions import instants
from gaugeflow.schemas import HEADERS, PIPELINE_METRICS, SENSORS, STORED_READINGS
from gaugeflow.sources import folders

_BATCH = T.StructField("batch", T.StringType())

ID_RANGES = T.StructType(
    [
        T.StructField("batch", T.StringType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("next_id", T.LongType()),
    ]
)
DEAD_LETTERS = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", HEADERS),
        _BATCH,
    ]
)
CHANGE_MESSAGES = T.StructType([T.StructField("value", T.BinaryType()), _BATCH])
STORED_METRICS = T.StructType([*PIPELINE_METRICS.fields, _BATCH])
# The files that an upkeep run has replaced: last folder and name, and the whole path. Files that one
# task writes into the folders of several days have one name.
REPLACED = T.StructType([T.StructField("file", T.StringType()), T.StructField("path", T.StringType())])


@dataclass(frozen=True)
class Layout:
    """How a table lies: by day or not, in what order, and whether each batch has a folder."""

    name: str
    schema: T.StructType
    order: tuple[str, ...]
    day: str | None = None
    batches: bool = False


LAYOUTS = {
    layout.name: layout
    for layout in (
        Layout("meter_readings", STORED_READINGS, ("sensor_type", "collected_at"), day="collected_date"),
        Layout("sensors", SENSORS, ("name", "sensor_type")),
        Layout("dead_letters", DEAD_LETTERS, ("batch",), batches=True),
        Layout("change_events", CHANGE_MESSAGES, ("batch",), batches=True),
        Layout("metrics", STORED_METRICS, ("name", "ts"), batches=True),
        Layout("id_ranges", ID_RANGES, ("first_id",), batches=True),
    )
}


@dataclass(frozen=True)
class Tables:
    """Parquet tables under one root folder.

    ``meter_readings`` is partitioned by the UTC day of collection and sorted inside its
    files by type and instant, so that ranges skip days and types skip row groups.

    Files that upkeep has merged lie under ``upkeep``, by run. A run counts once it has
    written which files it replaces; readers then leave those out until they are deleted.
    """

    spark: SparkSession
    root: str
    # Whether a table that nobody has written yet is an empty one; for a reader it is an error.
    may_be_new: bool = False

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def sensors(self) -> DataFrame:
        return self._read("sensors", SENSORS)

    def readings(self) -> DataFrame:
        return self._read("meter_readings", STORED_READINGS)

    def readings_of(self, days: list[date]) -> DataFrame:
        """The readings of some days. Only their folders are listed, however long the table."""
        layout, names = LAYOUTS["meter_readings"], {f"collected_date={day.isoformat()}" for day in days}
        runs = self.runs(layout.name)
        parts = [self._read_paths(layout, self.path(layout.name), [self._days_glob(names)])]
        merged = [
            f"{self.merged_path(layout.name, run)}/{day}"
            for run in runs
            for day in folders.children(self.spark, self.merged_path(layout.name, run))
            if day in names
        ]
        if merged:
            parts.append(self._read_paths(layout, self._merged_root(layout.name), merged))
        found = [part for part in parts if part is not None]
        if not found:
            # None of the days is stored yet.
            return self.spark.createDataFrame([], STORED_READINGS)
        return self._current(layout, found)

    def _days_glob(self, names: set[str]) -> str:
        days = ",".join(sorted(name.split("=")[1] for name in names))
        return f"{self.path('meter_readings')}/collected_date={{{days}}}"

    def dead_letters(self) -> DataFrame:
        return self._read("dead_letters", DEAD_LETTERS)

    def changes(self) -> DataFrame:
        return self._read("change_events", CHANGE_MESSAGES)

    def metrics(self) -> DataFrame:
        return self._read("metrics", STORED_METRICS)

    def id_ranges(self) -> DataFrame:
        return self._read("id_ranges", ID_RANGES)

    def append_sensors(self, sensors: DataFrame) -> None:
        sensors.select(*SENSORS.fieldNames()).write.mode("append").parquet(self.path("sensors"))

    def append_readings(self, readings: DataFrame) -> None:
        """Append rows that carry ``collected_date``.

        The rebalance keeps the files of a day few and splits a day that got most of the
        rows over several tasks.
        """
        (
            readings.select(*STORED_READINGS.fieldNames())
            .hint("rebalance", "collected_date")
            .sortWithinPartitions("collected_date", "sensor_type", "collected_at")
            .write.mode("append")
            .partitionBy("collected_date")
            .parquet(self.path("meter_readings"))
        )

    def batch_rows(self, name: str, batch: str) -> DataFrame:
        """What a batch wrote, from its own folder alone."""
        reader = self.spark.read.schema(LAYOUTS[name].schema).option("basePath", self.path(name))
        return reader.parquet(f"{self.path(name)}/batch={batch}")

    def put_batch(self, name: str, batch: str, rows: DataFrame) -> None:
        """Write the rows of one batch; writing the batch again replaces them."""
        rows.write.mode("overwrite").parquet(f"{self.path(name)}/batch={batch}")

    def claim_path(self, name: str) -> str:
        """The file that whoever gives out keys of a table holds."""
        return f"{self.root.rstrip('/')}/claims/{name}"

    def outbox_path(self, batch: str = "") -> str:
        """The mark of a batch whose events are not published yet, or the folder of all."""
        return f"{self.root.rstrip('/')}/outbox/{batch}".rstrip("/")

    # --- what upkeep has merged ---------------------------------------------------------

    def _upkeep(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/upkeep/{name}"

    def _merged_root(self, name: str) -> str:
        return f"{self._upkeep(name)}/merged"

    def merged_path(self, name: str, run: str) -> str:
        return f"{self._merged_root(name)}/run={run}"

    def replaced_path(self, name: str, run: str) -> str:
        return f"{self._upkeep(name)}/replaced/run={run}"

    def swept_path(self, name: str, run: str) -> str:
        return f"{self._upkeep(name)}/swept/{run}"

    def runs(self, name: str) -> list[str]:
        """The runs that count: their list of replaced files is there."""
        swept = set(folders.children(self.spark, f"{self._upkeep(name)}/swept"))
        begun = folders.children(self.spark, f"{self._upkeep(name)}/replaced")
        runs = [folder.removeprefix("run=") for folder in begun if folder.startswith("run=")]
        return [run for run in runs if run in swept or self._committed(name, run)]

    def open_runs(self, name: str) -> list[str]:
        """The runs whose replaced files may still be there."""
        swept = set(folders.children(self.spark, f"{self._upkeep(name)}/swept"))
        return [run for run in self.runs(name) if run not in swept]

    def _committed(self, name: str, run: str) -> bool:
        # One file, moved into its place when the job has written it.
        parts = folders.children(self.spark, self.replaced_path(name, run))
        return any(part.startswith("part-") for part in parts)

    def replaced(self, name: str) -> DataFrame | None:
        """The replaced files that may still be there; None if there are none.

        Upkeep holds their number under a bound, so they fit a broadcast.
        """
        paths = [self.replaced_path(name, run) for run in self.open_runs(name)]
        return self.spark.read.schema(REPLACED).parquet(*paths) if paths else None

    def files(self, name: str) -> DataFrame:
        """path, length and modificationTime of the files that readers see; listed by Spark."""
        roots = [self.path(name), *(self.merged_path(name, run) for run in self.runs(name))]
        roots = [root for root in roots if folders.exists(self.spark, root)]
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if not roots:
            return self.spark.createDataFrame([], "path string, length long, modificationTime timestamp")
        listed = reader.option("pathGlobFilter", "*.parquet").load(roots)
        listed = listed.select("path", "length", "modificationTime")
        gone = self.replaced(name)
        if gone is None:
            return listed
        return listed.withColumn("file", placed("path")).join(F.broadcast(gone.select("file")), "file", "left_anti").drop("file")

    def rows_of(self, name: str, paths: list[str]) -> DataFrame:
        """The rows of some files of a table, merged or not."""
        layout, inner = LAYOUTS[name], f"/upkeep/{name}/merged/"
        merged = [path for path in paths if inner in path]
        plain = [path for path in paths if inner not in path]
        parts = [
            self._read_paths(layout, base, chosen).select(*layout.schema.fieldNames())
            for base, chosen in ((self.path(name), plain), (self._merged_root(name), merged))
            if chosen
        ]
        return reduce(DataFrame.unionByName, parts)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            plain = self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException as e:
            if not self.may_be_new or e.getCondition() != "PATH_NOT_FOUND":
                raise
            plain = self.spark.createDataFrame([], schema)
        runs = self.runs(name)
        if not runs:
            return plain
        layout = LAYOUTS[name]
        merged = self._read_paths(layout, self._merged_root(name), [self.merged_path(name, run) for run in runs])
        return self._current(layout, [plain, merged])

    def _read_paths(self, layout: Layout, base: str, paths: list[str]) -> DataFrame | None:
        reader = self.spark.read.schema(layout.schema).option("basePath", base)
        try:
            return reader.parquet(*paths)
        except AnalysisException as e:
            if not self.may_be_new or e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _current(self, layout: Layout, parts: list[DataFrame]) -> DataFrame:
        """The parts without the rows of replaced files."""
        gone = self.replaced(layout.name)
        names = layout.schema.fieldNames()
        if gone is not None:
            file = F.broadcast(gone.select("file"))
            parts = [part.join(file, placed(part["_metadata.file_path"]) == file["file"], "left_anti") for part in parts]
        return reduce(DataFrame.unionByName, [part.select(*names) for part in parts])


def placed(path: Column | str) -> Column:
    """The last folder and the name of a file."""
    return F.regexp_extract(path, "([^/]+/[^/]+)$", 1)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a live database; give partitionColumn and bounds to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def rows_from_arrays(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Parallel array columns to rows: ``columns`` maps array column to result column."""
    return table.select(F.explode(F.arrays_zip(*columns)).alias("_row")).select(
        *[F.col(f"_row.{source}").alias(name) for source, name in columns.items()]
    )


def day_column(at: Column) -> Column:
    """Partition value of a stored reading."""
    return instants.utc_day(at).alias("collected_date")
