"""The stored pipeline from raw profiles to probabilities."""

import math
import statistics

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskset.operators import classify as cl
from riskset.operators import serving

PLAN = serving.ProfilePlan(numeric=["size", "age"], log1p=["size"], ordinal={"grade": ["a", "b", "c"]},
                           onehot_if_binary=["side"], onehot_all=["kind"])
SCHEMA = "id long, size long, age double, grade string, side string, kind string, label int"


def _rows(n=60):
    return [(i, None if i % 7 == 0 else i * 3 % 41, None if i % 11 == 0 else 30.0 + i * 17 % 50, "abc"[i % 3],
             "lr"[i % 2], None if i % 13 == 0 else "xyz"[i * 5 % 3], int(i * 3 % 41 > 20)) for i in range(n)]


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "m")
    cl.save_model(serving.fit_profile_model(spark.createDataFrame(_rows(), SCHEMA), PLAN, "label", trees=5, depth=4), path)
    return cl.load_model(path)


def test_prepared_cells(spark, model):
    """Every prepared cell of the reloaded stages against plain Python."""
    train = _rows()
    cells = {"size": [math.log1p(r[1]) for r in train if r[1] is not None], "age": [r[2] for r in train if r[2] is not None]}
    # The deviation is that of the column as filled with its mean.
    stat = {c: (statistics.mean(v), statistics.stdev(v + [statistics.mean(v)] * (len(train) - len(v)))) for c, v in cells.items()}
    raw = [(1, 4, 50.0, "c", "r", "x", 0), (2, None, None, None, None, None, 0), (3, 0, 31.5, "b", "l", "new", 0)]
    got = {r["id"]: r for r in PipelineModel(model.stages[:-2]).transform(spark.createDataFrame(raw, SCHEMA)).collect()}
    for i, size, age, *_ in raw:
        for c, v in (("size", None if size is None else math.log1p(size)), ("age", age)):
            mean, sd = stat[c]
            assert math.isclose(got[i][c], 0.0 if v is None else (v - mean) / sd, abs_tol=1e-12)
    assert [got[i]["grade"] for i in (1, 2, 3)] == [2.0, 0.0, 1.0]
    assert [got[i]["side_r"] for i in (1, 2, 3)] == [1.0, 0.0, 0.0]
    kinds = [r[5] for r in train if r[5]]
    mode = min(sorted(set(kinds)), key=lambda k: -kinds.count(k))
    assert {k: got[2][f"kind_{k}"] for k in "xyz"} == {k: float(k == mode) for k in "xyz"}
    assert [got[3][f"kind_{k}"] for k in "xyz"] == [0.0, 0.0, 0.0]


def test_absent_columns_extra_columns_and_no_rows(spark, model):
    full = spark.createDataFrame(_rows()[:20], SCHEMA).drop("label")
    absent = full.drop("age", "kind").withColumn("note", F.lit("kept"))
    nulls = full.withColumn("age", F.lit(None).cast("double")).withColumn("kind", F.lit(None).cast("string"))
    one = {r["id"]: r["prob"] for r in cl.score(model, absent, ["id", "note"]).collect()}
    two = {r["id"]: r["prob"] for r in cl.score(model, nulls, ["id"]).collect()}
    assert one == two and len(one) == 20
    assert cl.score(model, full.limit(0), ["id"]).collect() == []


def test_unknown_ordinal_is_an_error(spark, model):
    bad = spark.createDataFrame([(1, 4, 50.0, "z", "r", "x", 0)], SCHEMA)
    with pytest.raises(Exception, match="unknown category in grade"):
        cl.score(model, bad, ["id"]).collect()


def test_constant_column(spark):
    """A column without spread is scaled by 1."""
    rows = [(r[0], 5, *r[2:]) for r in _rows()]
    prepared = serving.fit_preparation(spark.createDataFrame(rows, SCHEMA), PLAN).transform(spark.createDataFrame(rows, SCHEMA))
    assert prepared.agg(F.max(F.abs("size"))).first()[0] < 1e-12


def test_kpi_row(spark):
    cohort = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 0), (4.0, 1)], "duration double, event int")
    scored = spark.createDataFrame([(1, 0.9), (0, 0.2), (0, 0.9)], "label int, prob double")
    row = cl.kpi_row(cohort, scored).first()
    assert (row["n"], row["event_rate"], row["median_survival"], row["n_scored"], row["auc"]) == (4, 0.75, 2.0, 3, 0.75)
    assert cl.kpi_row(cohort, scored.where("label = 0")).first()["auc"] is None
