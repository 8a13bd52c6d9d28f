"""Every registered query with SQL against DuckDB on small tables."""

import os

import duckdb
import pytest
from trailspark import registry

SF = "/root/testdata/sf0.001"


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    found = df.collect()
    cursor = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    key = sorted(columns)
    own = sorted(repr([rounded(r[c]) for c in key]) for r in found)
    theirs = sorted(repr([rounded(r[columns.index(c)]) for c in key]) for r in cursor.fetchall())
    assert own == theirs
