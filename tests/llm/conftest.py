import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    """Documents, items and conversations of the smallest fixture as Python rows."""
    def rows(name, *columns):
        return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]

    return {"documents": rows("documents", "doc_id", "text"), "benchmark": rows("benchmark", "item_id", "text")}
