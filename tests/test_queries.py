"""Every query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import TESTDATA
from opinionspark.plans.oracles import ORACLES
from opinionspark.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA}/{name}.parquet'")
    return connection


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _sorted(rows, names):
    return sorted((tuple(_value(r[n]) for n in names) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert entry.queries().items() >= QUERIES.items()
    assert entry.oracle_sql().items() >= ORACLES.items()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    frame = entry.queries()[name](spark, TESTDATA)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    kinds = dict(zip(columns, (str(c[1]) for c in result.description)))
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in frame.schema.fields} == kinds
    names = sorted(columns)
    expected = _sorted([dict(zip(columns, row)) for row in result.fetchall()], names)
    assert _sorted(frame.collect(), names) == expected
