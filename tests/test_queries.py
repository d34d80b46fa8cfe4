"""Every query that SQL can express gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tomeforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return "NULL"
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x.tolist()) if getattr(x, "ndim", 0) else str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    rows = registry.QUERIES[name](spark, sf).toPandas()
    assert len(rows) and not rows.isna().all(axis=None)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_prune_and_push(spark, sf):
    """Scans read the columns they need, filters reach them, top-k is cut before the shuffle."""
    plan = registry.QUERIES["type_lookup"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in plan
    from tomeforge.operators import tables
    from tomeforge.plans.binding import table

    plan = tables.find_by_range(table(spark, sf, "part"), p_size=(10, None)).select("p_partkey")._jdf.queryExecution().toString()
    assert "struct<p_partkey:bigint,p_size:int>" in plan
    assert "WindowGroupLimit" in registry.QUERIES["knn_topk"](spark, sf)._jdf.queryExecution().toString()
