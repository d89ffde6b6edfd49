"""Every registered query against its SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lexframe.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DIR).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[k]) for k in at) for r in duck.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
