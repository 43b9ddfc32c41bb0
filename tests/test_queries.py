"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from docmill.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    blank = lambda x: x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x)
    text = lambda x: None if blank(x) else f"{x:.10g}" if isinstance(x, float) else str(x.tolist() if hasattr(x, "tolist") else x)
    number = lambda x: text(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) and not blank(x) else text(x)
    return sorted((tuple(number(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
