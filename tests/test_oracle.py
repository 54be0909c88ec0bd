"""Every query with an oracle equals DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from screenfold.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = list(catalogue.oracle_sql())


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def ordered(d):
    d = d[sorted(d.columns)].copy()
    for c in d.columns:
        if d[c].dtype == object or str(d[c].dtype) == "boolean":
            d[c] = d[c].map(lambda v: "" if v is None or v != v else str(v))
    return d.sort_values(list(d.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = ordered(got), ordered(want)
    for c in a.columns:
        if a[c].dtype.kind in "fi" and b[c].dtype.kind in "fi":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_every_query_is_registered_once():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.queries()) > 150


def test_clusters_and_categories_take_whole_tables(spark, con, tmp_path):
    import pyarrow.parquet as pq

    for name in ("lineitem", "supplier", "part"):
        at = pq.read_table(f"{SF}/{name}.parquet")
        for key in ("l_suppkey", "s_suppkey", "p_partkey"):  # the same rows under large keys
            if key in at.column_names:
                move = 200_000 if key == "p_partkey" else 1000
                at = at.set_column(at.column_names.index(key), key, [[v + move for v in at[key].to_pylist()]])
        pq.write_table(at, tmp_path / f"{name}.parquet")
    genes = con.execute("select count(distinct l_partkey % 200) from lineitem").fetchone()[0]
    for name in ("t34_cluster", "t35_cluster"):
        got = catalogue.queries()[name](spark, str(tmp_path)).toPandas()
        assert len(got) == genes - 1 and got["size"].max() == genes, name
    one = catalogue.queries()["t21_specific_enrichment"](spark, str(tmp_path)).toPandas()
    two = catalogue.queries()["t21_specific_enrichment"](spark, SF).toPandas()
    assert len(one) and ordered(one).equals(ordered(two))
