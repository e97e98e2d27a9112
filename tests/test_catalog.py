"""Every catalogued query against its SQL twin."""

import math
import os

import duckdb
import pytest

from lithic.catalog import CATALOG

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: float(f"{x:.9g}") if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(CATALOG))
def test_same_rows_as_sql(spark, duck, name):
    f, sql = CATALOG[name]
    df = f(spark, SF)
    want = duck.execute(sql)
    columns = [x[0] for x in want.description]
    rows = want.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows, "an empty answer proves nothing"
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, rows)
