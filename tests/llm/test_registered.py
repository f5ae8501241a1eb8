"""The registered queries of the subpackage: names, and SQL where there is some."""

import re
from pathlib import Path

import duckdb
import pytest
from stressframe.llm import queries


def test_one_query_for_each_operator():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    other = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        other.sql(f"create view {path.stem} as select * from '{path}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), other.sql(queries.ORACLES[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names

    def rows(frame):
        plain = frame[names].astype(object)
        return sorted(str([int(v) if isinstance(v, float) and v.is_integer() else v for v in r]) for r in plain.where(plain.notna(), None).itertuples(index=False))

    assert rows(got) == rows(want)
