"""Each registered query of the decision engine against its SQL oracle."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quern.plans import catalog

DATA = Path(os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.001"))

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    text = lambda v: "null" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got, want = catalog.queries()[name](spark, str(DATA)).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
