"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from newsloom.queries import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (str, bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_rows(spark, other, name):
    df = all_queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = other.sql(all_oracles()[name])
    assert sorted(result.columns) == columns
    place = [result.columns.index(c) for c in columns]
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    assert got == sorted([tuple(plain(r[i]) for i in place) for r in result.fetchall()], key=str)


def test_names_agree():
    assert set(all_oracles()) <= set(all_queries())
