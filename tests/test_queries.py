"""Every query with SQL against DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from lodestone.plans import cases, problems, reference

ALL = problems.QUERIES | reference.QUERIES | cases.QUERIES
SQL = problems.SQL | reference.SQL | cases.SQL


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


def canonical(df: pd.DataFrame) -> list:
    def one(x):
        if x is None or x is pd.NaT or (not hasattr(x, "__len__") and pd.isna(x)):
            return "null"
        return repr(round(float(x), 6) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(one(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf, duck, name):
    got = ALL[name](spark, sf).toPandas()
    if name in SQL:
        assert canonical(got) == canonical(duck.execute(SQL[name]).df())
    else:
        assert len(got) > 0
