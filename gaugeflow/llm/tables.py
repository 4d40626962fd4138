"""Reading the given tables and cutting lineage through the shared folder."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.session import scratch_dir

# Rows and bytes that one Arrow batch may hold, so that a worker's memory does not follow
# the length of the documents.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Give the Python workers this package and small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context, package = spark.sparkContext, Path(__file__).parents[1]
    if not any(name.startswith(f"{package.name}-") for name in context._python_includes or []):
        # The driver hands the archive out to executors; nothing reads it from this folder.
        archive = tempfile.mkdtemp() + f"/{package.name}-{context.applicationId}"
        context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read again: lost executors cannot lose it."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns with ``row``, a number of each row.

    doc_id may be null or repeated, so rows are told apart by their place in the input. The
    input must give the same rows in the same partitions when it is read again, as files do.
    """
    return docs.select(F.monotonically_increasing_id().alias("row"), *columns)
