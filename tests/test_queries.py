"""Every registered query equals its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lamplight.plans.registry import ORACLE_SQL, QUERIES

DIR = os.environ.get("LAMPLIGHT_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(v, 8) + 0.0) if isinstance(v, float) and not math.isnan(v) else repr(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
