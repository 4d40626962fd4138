"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as registry
from gaugeflow.oracles import ORACLES
from gaugeflow.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{FOLDER}/events.parquet')")
    return con


def ordered(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in places) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = database.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    expected = ordered(cursor.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    assert ordered([tuple(r) for r in df.collect()], df.columns) == expected


def test_entry(spark):
    assert registry.entry(spark).count() > 0
