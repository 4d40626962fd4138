"""Folders and small marks in whatever file system Spark is given."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, one level deep; none if there is no such folder."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(place))


def mark(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if somebody else has. The file system decides who is first."""
    system, place = _at(spark, path)
    if system.exists(place):
        return False
    system.mkdirs(place.getParent())
    return system.createNewFile(place)


def delete(spark: SparkSession, path: str, recursive: bool = False) -> None:
    """Delete a file or folder; one that is gone already is no fault."""
    system, place = _at(spark, path)
    if system.exists(place):
        system.delete(place, recursive)


def _claim(spark: SparkSession, path: str, token: str) -> bool:
    """Create a file that only one can create; read back, should the file system let two."""
    system, place = _at(spark, path)
    try:
        out = system.create(place, False)
        out.write(token.encode())
        out.close()
    except Py4JJavaError as error:
        if "exist" not in str(error.java_exception):
            raise
        return False
    time.sleep(0.02)
    return _content(spark, path) == token


def _content(spark: SparkSession, path: str) -> str | None:
    system, place = _at(spark, path)
    try:
        stream = system.open(place)
    except Py4JJavaError:
        return None
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@contextmanager
def exclusive(
    spark: SparkSession, path: str, lease_s: float = 600, wait_s: float = 1800, pause_s: float = 0.2
) -> Iterator[None]:
    """Hold a claim on ``path``; others wait. The claim of a holder that died ends with its lease.

    A lease must be longer than what is done under it.
    """
    token, until = uuid.uuid4().hex, time.monotonic() + wait_s
    system, place = _at(spark, path)
    while not _claim(spark, path, token):
        if time.monotonic() > until:
            raise TimeoutError(f"{path} stays claimed.")
        try:
            age_s = time.time() - system.getFileStatus(place).getModificationTime() / 1000
        except Py4JJavaError:
            continue  # just released
        if age_s > lease_s:
            # One of those that wait moves it away; for the others it is gone.
            system.rename(place, place.suffix(f".{token}"))
            delete(spark, f"{path}.{token}")
        time.sleep(pause_s)
    try:
        yield
    finally:
        if _content(spark, path) == token:
            delete(spark, path)
