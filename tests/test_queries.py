"""Every query of the library against its SQL on DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from varloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)):
        return f"{float(x):.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows, names = df.collect(), sorted(df.columns)
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(registry.ORACLE_SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    at = [have.index(n) for n in names]
    assert sorted(tuple(plain(r[n]) for n in names) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
