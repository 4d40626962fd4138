"""Upkeep of the stored tables: many small files become few, and no reader notices.

A run packs the small files of what is closed - days before ``closed_before`` for readings, batches
that no query can replay any more for the side tables - into files of about ``target_bytes``,
in the table's own order. The merged files lie in a folder of the run; they count once the
run has written which files they replace, in one file that appears as a whole. From then on
readers (``Tables``) leave the replaced files out, so a row is read once, before, during and
after: a run that dies has replaced nothing. ``sweep`` deletes replaced files later, when no query
that listed them can still be reading, and marks the run as swept.

Sizes and names come from a distributed listing; a run takes at most ``MOST_FILES`` files, the
oldest days first, and leaves the others to the next run. One upkeep job works on a table
at a time; ingest may go on meanwhile, since it only adds files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions import instants
from gaugeflow.sources import folders
from gaugeflow.sources.tables import LAYOUTS, REPLACED, Layout, Tables
from gaugeflow.streaming.jobs import utc_now

TARGET_BYTES = 128 << 20
# Files that one run replaces: their names pass through the driver.
MOST_FILES = 10_000
# Replaced files stay so long for the queries that listed them.
GRACE = timedelta(hours=6)
# Runs that may wait to be swept: readers are sent the names of the files they replaced.
OPEN_RUNS = 20


@dataclass(frozen=True)
class Merge:
    """What one run did to one table."""

    table: str
    run: str
    files_before: int
    files_after: int


@dataclass(frozen=True)
class Upkeep:
    """The upkeep job over one set of tables."""

    tables: Tables
    target_bytes: int = TARGET_BYTES
    most_files: int = MOST_FILES

    def run(
        self, closed_before: date | None = None, names: Iterable[str] = LAYOUTS, settled: timedelta = GRACE
    ) -> list[Merge]:
        """Merge every table; ``settled`` is how old the files of side tables must be."""
        now = utc_now()
        closed = closed_before or now.date()
        done = (self.merge(LAYOUTS[name], closed, now - settled) for name in names)
        return [merge for merge in done if merge]

    def merge(self, layout: Layout, closed_before: date, settled_before: datetime) -> Merge | None:
        """Merge the small files of one table; None if it has none to merge."""
        if len(self.tables.open_runs(layout.name)) >= OPEN_RUNS:
            raise RuntimeError(f"{OPEN_RUNS} runs over {layout.name} have not been swept.")
        chosen = self.candidates(layout, closed_before, settled_before).collect()
        if not chosen:
            return None
        run = uuid.uuid4().hex
        total = sum(row["length"] for row in chosen)
        self._write(layout, [row["path"] for row in chosen], run, max(1, -(-total // self.target_bytes)))
        replaced = self.tables.spark.createDataFrame(
            [("/".join(row["path"].split("/")[-2:]), row["path"]) for row in chosen], REPLACED
        )
        replaced.coalesce(1).write.parquet(self.tables.replaced_path(layout.name, run))
        after = self.tables.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        after = after.option("pathGlobFilter", "*.parquet").load(self.tables.merged_path(layout.name, run))
        return Merge(layout.name, run, len(chosen), after.count())

    def candidates(self, layout: Layout, closed_before: date, settled_before: datetime) -> DataFrame:
        """path and length of the files that the next run merges.

        Of a day, or of a table without days, two files at least: a single one is left as it is.
        """
        files = self.tables.files(layout.name).filter(F.col("length") < self.target_bytes // 2)
        if layout.day:
            day = F.regexp_extract("path", f"/{layout.day}=([^/]+)/", 1)
            files = files.withColumn("group", day).filter(F.col("group") < closed_before.isoformat())
        else:
            files = files.withColumn("group", F.lit(""))
            if layout.batches:
                files = self._settled(files)
            files = files.filter(F.col("modificationTime") < instants.instant(settled_before))
        several = files.groupBy("group").count().filter("count > 1").select("group")
        return (
            files.join(several, "group")
            .orderBy("group", "path")
            .limit(self.most_files)
            .select("path", "length")
        )

    def _settled(self, files: DataFrame) -> DataFrame:
        """Files but those of every query's newest batch, which it would replay if restarted."""
        name = F.regexp_extract("path", "/batch=([^/]+)/", 1)
        query = F.regexp_replace(name, r"-\d+(-[a-z-]+)?$", "")
        number = F.regexp_extract(name, r"-(\d+)(?:-[a-z-]+)?$", 1)
        fresh = files.withColumns({"query": query, "number": number})
        newest = fresh.groupBy("query").agg(F.max("number").alias("newest"))
        # Merged files hold settled batches only; their paths name none.
        settled = (F.col("query") == "") | (F.col("number") < F.col("newest"))
        return fresh.join(newest, "query").filter(settled).drop("query", "number", "newest")

    def _write(self, layout: Layout, paths: list[str], run: str, bins: int) -> None:
        rows = self.tables.rows_of(layout.name, paths)
        order = [layout.day, *layout.order] if layout.day else list(layout.order)
        # Ranges of the table's order: each day goes to few files, sorted as appends sort them.
        packed = rows.repartitionByRange(bins, *order).sortWithinPartitions(*order)
        writer = packed.write.option("maxRecordsPerFile", 0)
        if layout.day:
            writer = writer.partitionBy(layout.day)
        writer.parquet(self.tables.merged_path(layout.name, run))

    def sweep(self, names: Iterable[str] = LAYOUTS, grace: timedelta = GRACE) -> int:
        """Delete what runs have replaced longer than ``grace`` ago; how many files that were."""
        spark, deleted = self.tables.spark, 0
        for name in names:
            runs = self.tables.open_runs(name)
            old = [run for run in runs if self._age(name, run) >= grace]
            for run in old:
                rows = spark.read.schema(REPLACED).parquet(self.tables.replaced_path(name, run))
                for row in rows.collect():
                    folders.delete(spark, row["path"])
                    deleted += 1
                folders.mark(spark, self.tables.swept_path(name, run))
        return deleted

    def _age(self, name: str, run: str) -> timedelta:
        path = f"{self.tables.replaced_path(name, run)}/*.parquet"
        listed = self.tables.spark.read.format("binaryFile").load(path)
        micros = listed.agg(F.max(F.unix_micros("modificationTime"))).first()[0]
        return utc_now() - datetime.fromtimestamp(micros / 1e6, timezone.utc)
