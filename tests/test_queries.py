"""Every registered query against its check SQL."""

import sys

import pandas as pd
import pytest
from conftest import ROOT, SF_DIR

sys.path.insert(0, ROOT)
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402


def cells(df):
    """Rows as sorted tuples of texts; whole floats and integers read alike."""
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float) and v == int(v):
            return str(int(v))
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(text(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    want = con.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
