"""Every catalogue query against its SQL on the smallest tables."""

import os

import pandas as pd
import pytest

from panelspan.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plain(v):
    if v is None or v is pd.NA or v != v:
        return ""
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 5) + 0.0)
    return str(v)


def table_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert table_of(registry.queries()[name](spark, SF).toPandas()) == table_of(con.sql(registry.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    got = registry.entry(spark)
    assert [f.name for f in got.schema] == ["dataset", "horizon", "prediction_count", "mae", "rmse"]
    assert got.count() == 2


def test_all_queries_have_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", ["pairwise_geometry", "nearest_neighbors", "knn_edges", "edge_features", "intervention_features"])
def test_registry_queries_take_every_supplier(spark, name, tmp_path):
    """150 suppliers against the SQL."""
    con = duckdb.connect()
    con.sql(f"copy (select i::bigint as s_suppkey, round(sin(i) * 9999, 2) as s_acctbal, (i % 25)::int as s_nationkey from range(1, 151) t(i)) to '{tmp_path}/supplier.parquet' (format parquet)")
    con.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet'")
    sql = registry.oracle_sql()[name]
    assert table_of(registry.queries()[name](spark, str(tmp_path)).toPandas()) == table_of(con.sql(sql).df())
