"""Every registered query of the engine against its SQL in another engine."""

import math
from pathlib import Path

import duckdb
import pytest
from stressframe.plans import registry

ROWS_ONLY = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.fixture(scope="module")
def other(sf):
    connection = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


def shape(frame, names):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    plain = frame[names].astype(object)
    return sorted((tuple(cell(v) for v in row) for row in plain.where(plain.notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, other, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), other.sql(registry.ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert shape(got, names) == shape(want, names)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
