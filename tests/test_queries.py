"""Every query with an oracle gives the oracle's rows."""

import os

import duckdb
import pytest
from granary.plans import catalog
from granary.plans.registry import TABLES


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list | tuple):
        return [plain(y) for y in x]
    if x is None or type(x).__name__ == "NAType" or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, int | float) or type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}")
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY.oracles))
def test_query_equals_oracle(spark, con, small, name):
    got, want = catalog.REGISTRY.queries[name](spark, small).toPandas(), con.sql(catalog.REGISTRY.oracles[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.REGISTRY.queries) - set(catalog.REGISTRY.oracles)))
def test_query_runs(spark, small, name):
    assert catalog.REGISTRY.queries[name](spark, small).columns


def test_entry_and_guard(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "item_id", "distance"]
    assert set(e.oracle_sql()) <= set(e.queries())
