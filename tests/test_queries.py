"""Every registered query outside the text subpackage against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from seriesforge.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v if isinstance(v, int | type(None)) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(norm, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in registry.ORACLE:
        assert rows
        return
    found = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(norm(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry_names():
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(registry.QUERIES) <= set(found) and set(entry.oracle_sql()) <= set(found)
