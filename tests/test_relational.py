"""Every relational operator against DuckDB on the smallest tables."""

import duckdb
import pytest

from formloom.plans.queries import OPERATORS, QUERIES, oracles
from formloom.plans.registry import Folder

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v) if v is not None else None


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.fixture(scope="module")
def folder(spark):
    return Folder(spark, SF, OPERATORS)


def test_registered_query(spark):
    assert QUERIES["match_blank"](spark, SF).count() > 0


@pytest.mark.parametrize("name", list(OPERATORS))
def test_equal(folder, duck, name):
    got = folder.get(name)
    rel = duck.execute(oracles()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, rel.fetchall())
