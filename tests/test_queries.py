"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pytest

from tests.conftest import DATA
from wrenfold import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def canon(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():  # noqa: ANN201
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):  # noqa: ANN001, ANN201
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    theirs = [c[0] for c in found.description]
    assert cols == sorted(theirs)
    key = lambda r: repr(r)
    assert sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=key) == sorted((tuple(canon(r[theirs.index(c)]) for c in cols) for r in found.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, name):  # noqa: ANN001, ANN201
    assert QUERIES[name](spark, DATA).count() > 0
