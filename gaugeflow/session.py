"""Session settings and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

# Settings the jobs rely on; all of them can be set on a running session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # INT96, the default, carries no row-group statistics, so instants could not be pruned.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Bursts of one feed meet in one task; let every task merge its own sessions first.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # A repeated JSON key means its last value, as the producers' serialiser reads it.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the jobs rely on to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "gaugeflow", master: str | None = None, **conf: str
) -> SparkSession:
    """Create (or reuse) a session; leave ``master`` unset on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session."""
    context, package = spark.sparkContext, Path(__file__).parent
    if not any(name.startswith(f"{package.name}-") for name in context._python_includes or []):
        # The driver hands the archive out to executors; nothing reads it from this folder.
        archive = f"{tempfile.mkdtemp()}/{package.name}-{context.applicationId}"
        context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables that cut lineage.

    On a cluster it lies in the shared folder named by ``spark.checkpoint.dir``, so every
    executor sees it and it outlives any of them. Only a local session without that
    setting, as in tests, falls back to a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
        shared = tempfile.mkdtemp(prefix="gaugeflow-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
