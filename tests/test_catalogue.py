import datetime
import glob
import os
from decimal import Decimal

import duckdb
import pytest
from loomspark import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, (Decimal, datetime.datetime)):
        return str(value)
    return repr(value)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == want
