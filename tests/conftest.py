import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from samples import at  # noqa: E402

from gaugeflow import build_session  # noqa: E402
from gaugeflow.schemas import MESSAGES, METER_READINGS, SENSORS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def sensors(spark):
    """Sensors from (id, name, type) rows."""

    def make(*rows):
        return spark.createDataFrame(list(rows), SENSORS)

    return make


@pytest.fixture
def readings(spark):
    """Readings from dicts; value columns left out are NULL."""

    def make(*rows):
        names = METER_READINGS.fieldNames()
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], METER_READINGS)

    return make


@pytest.fixture
def feed(spark):
    """Messages from bodies, one partition, offsets in order."""

    def make(*bodies, first_offset=0, partition=0, headers=()):
        rows = []
        for n, body in enumerate(bodies):
            raw = body if isinstance(body, (bytes, bytearray)) else body.encode()
            hs = [(k, v.encode()) for k, v in headers]
            rows.append(
                (b"k", bytearray(raw), hs, "meter-readings", partition, first_offset + n, at())
            )
        return spark.createDataFrame(rows, MESSAGES)

    return make
