"""Registered queries against their SQL oracle on the smallest fixture."""

import math

import duckdb
import pytest

import __spark_entry__ as se
from riskset.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem", "documents", "labels", "embeddings", "part"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


def test_registry_consistent():
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert {"segment", "t", "survival", "ci_low", "ci_high"} <= set(df.columns)
    assert df.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


# Those of the training-data operators are checked in their own folder.
registry.load_all()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = se.queries()[name](spark, SF).toPandas()
    ddf = duck.execute(se.oracle_sql()[name]).fetchdf()
    assert _rows(sdf) == _rows(ddf)
