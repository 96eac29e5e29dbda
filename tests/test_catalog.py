"""Every catalogued query against an independent engine on the smallest tables."""

import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest

from quillmesh.plans import catalog

SQL = catalog.oracle_sql()


def plain(v):
    if v is None or isinstance(v, (bool, str, bytes)):
        return v
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float, Decimal)):
        return float(v) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def sorted_rows(rows, columns, names):
    return sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in rows), key=repr)


@pytest.fixture(scope="module")
def engine(data_dir):
    con = duckdb.connect()
    for f in os.listdir(data_dir):
        path = f"{data_dir}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, data_dir, engine, name):
    df = catalog.queries()[name](spark, data_dir)
    found = sorted_rows(df.collect(), df.columns, sorted(df.columns))
    relation = engine.sql(SQL[name])
    assert sorted(relation.columns) == sorted(df.columns)
    assert found == sorted_rows(relation.fetchall(), relation.columns, sorted(df.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, data_dir, name):
    df = catalog.queries()[name](spark, data_dir)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()
