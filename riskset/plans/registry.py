"""Registry of named queries with their independent SQL oracle.

Each query is a function (spark, sf_dir) -> DataFrame built from the
library's operators; the oracle is plain SQL over the same parquet tables,
written separately (DuckDB dialect). Doubles are rounded to ``DIGITS`` on
both sides at the edge only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` None means rows-only checking."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (edge-only rounding for comparisons)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def load_all() -> None:
    """Import every plan module so that their queries register."""
    from riskset.plans import (  # noqa: F401
        classify_q, cox_q, prepare_q, profile_q, relational_q, select_q, survival_q)
