"""Every registered query of the table engine against its SQL, on the same tables."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry
from rowquarry.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(repr(value(r[k])) for k in order) for r in data])


@pytest.mark.parametrize("name", QUERIES)
def test_matches_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(names, want.fetchall())
    if name not in ("key_prefix_drop_first",):
        assert got


def test_entry_points(spark):
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
    df = spark_entry.entry(spark)
    assert df.columns == ["l_quantity", "l_returnflag", "row_id"] and df.count() == 3001
