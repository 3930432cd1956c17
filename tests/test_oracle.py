"""Every registered query with SQL against DuckDB at the scale of the driver's comparison; the others must run."""

import datetime
import math
import os

import duckdb
import pytest

from eventalpha.plans import registry

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def in_order(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = in_order(df.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(registry.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == in_order([[r[i] for i in at] for r in result.fetchall()])


@pytest.mark.parametrize("name", ["psr_probability", "dsr", "factor_hac", "factor_regression_full", "select_rf", "select_rfe", "class_importance", "classify", "ts_cv"])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
