"""Every query of the catalogue against its SQL twin, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from vicinal.operators import indexes
from vicinal.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)].copy()
    for c in d.columns:
        d[c] = d[c].map(lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else repr(float(v)) if isinstance(v, (float, np.floating)) else str(v))
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, sf, duck, name):
    got = plain(catalog.QUERIES[name](spark, sf).toPandas())
    want = plain(duck.sql(catalog.ORACLE[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["hint_filter", "l2_topk", "candidate_group", "expected_hit", "knn_graph_exact", "default_resolution", "multipart_counting", "multipart_trivial", "range_search"])
@pytest.mark.parametrize("path", [{"QUERY_BLOCK": 9}, {"QUERY_BLOCK": 9, "ENTRY_NUMBERS": 0, "CELL": 200}], ids=["entries broadcast", "grid"])
def test_same_rows_of_many_queries(spark, sf, duck, name, path, monkeypatch):
    """Searches as they run on larger tables; the grid lost the feature's column where both sides stem from one table."""
    for at, value in path.items():
        monkeypatch.setattr(indexes, at, value)
    got = plain(catalog.QUERIES[name](spark, sf).toPandas())
    pd.testing.assert_frame_equal(got, plain(duck.sql(catalog.ORACLE[name]).df()), check_dtype=False)
