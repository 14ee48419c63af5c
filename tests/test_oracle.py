"""Every registered query with a SQL twin, compared value by value on whole small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from workload.oracle import ORACLE
from workload.queries import QUERIES

# Their columns are the concepts found in the data; the twins list all of them, which the smallest set does not have.
NEED_ALL_CONCEPTS = {"topk_matrix", "topk_page_days_dense", "feature_ranks"}


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def text(x):
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return ""
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10]
    if isinstance(x, (bool, str)):
        return str(x)
    return repr(round(float(x), 9))


def plain(df):
    df = df[sorted(df.columns)].astype(object).map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    def connect(root):
        con = duckdb.connect()
        for path in glob.glob(f"{root}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        return con

    return connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, small_root, mid_root, name):
    root = mid_root if name in NEED_ALL_CONCEPTS else small_root
    ours = plain(QUERIES[name](spark, root).toPandas())
    theirs = plain(duck(root).execute(ORACLE[name]).fetch_df())
    pd.testing.assert_frame_equal(ours, theirs)
