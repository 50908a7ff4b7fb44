"""Every query that SQL can express against DuckDB, and all others for rows, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from strandline import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(x):
    if x is None:
        return ""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 8) + 0.0)
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([plain(y) for y in x])
    return str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    r = con.execute(queries.ORACLES[name])
    columns, want = [c[0] for c in r.description], r.fetchall()
    assert sorted(df.columns) == sorted(columns)
    a, b = ([cs.index(c) for c in sorted(cs)] for cs in (df.columns, columns))
    assert sorted(tuple(plain(x[i]) for i in a) for x in got) == sorted(tuple(plain(x[i]) for i in b) for x in want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0
