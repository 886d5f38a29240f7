"""Every query against its SQL, run by DuckDB on the same files."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__
from tessera.plans.registry import ORACLE, QUERIES


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return str(value) if isinstance(value, datetime.date) else value


def lines(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    session = duckdb.connect()
    for file in os.listdir(sf_dir):
        session.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return session


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    wanted = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    a, b = lines(got.columns, got.collect()), lines(wanted.columns, wanted.fetchall())
    assert len(a) == len(b) and a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
