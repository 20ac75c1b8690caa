"""Every core query with SQL gives DuckDB's rows on the smallest data."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lexspark.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    text = lambda v: "NULL" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    a, b = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_nothing_outside_imports_the_llm_subpackage():
    for f in glob.glob("lexspark/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert "lexspark.llm" not in open(f).read(), f
