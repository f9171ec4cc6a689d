"""The registered queries against their SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
NAMES = ["degrees", "closure_profile_matrix", "closure_cost", "profile_admission", "candidate_pool_top150", "hint_order", "suffix_resolution", "impact_cone_top30", "cosine_rank_top30", "index_report", "traceback_frames", "p2_found", "p3_found", "p5_found"]


def _cell(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "~"
    if isinstance(v, float) and v != int(v):
        return f"{v:.6g}"
    return str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def _rows(df):
    return Counter(tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_registry_and_smoke(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["trial_seeds_all", "closure_profile_matrix_all"])
def test_all_seeds_equal_sql(spark, db, name):
    assert _rows(entry.queries()[name](spark, DATA).toPandas()) == _rows(db.execute(entry.oracle_sql()[name]).df())
