"""The library's own queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from basketry.plans import lookups, timelines  # noqa: F401
from basketry.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def flat(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 5) + 0.0 if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query(spark, db, name):
    df = Q.QUERIES[name](spark, SF)
    result = db.execute(Q.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert flat(df.collect(), df.columns) == flat(result.fetchall(), columns)
