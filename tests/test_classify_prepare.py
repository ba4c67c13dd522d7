import numpy as np
import pytest
from pyspark.sql import functions as F

from riskset.operators import classify as cl
from riskset.operators import prepare as pp
from riskset.operators import profile as pf

from brute import auc


def test_auc_exact_with_ties(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.random(200) + 0.3 * y, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, prob double")
    got = cl.roc_auc(df).first()["auc"]
    assert abs(got - auc(y, s)) < 1e-12
    flipped = cl.roc_auc(df.withColumn("prob", -F.col("prob"))).first()["auc"]
    assert abs(got + flipped - 1) < 1e-12
    curve = cl.roc_curve(df).toPandas()
    assert curve["tpr"].max() == 1.0 and curve["fpr"].max() == 1.0


def test_split_is_exact_and_stratified(spark):
    rows = [(i, int(i % 3 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, label int")
    out = cl.stratified_split(df, "label", "id", 0.2, 42).groupBy("label", "split").count().collect()
    counts = {(r["label"], r["split"]): r["count"] for r in out}
    n1, n0 = 334, 666
    assert counts[(1, "test")] == round(0.2 * n1) and counts[(0, "test")] == round(0.2 * n0)
    again = cl.stratified_split(df, "label", "id", 0.2, 42).where("split = 'test'").select("id").collect()
    first = cl.stratified_split(df, "label", "id", 0.2, 42).where("split = 'test'").select("id").collect()
    assert sorted(again) == sorted(first)


def test_report_and_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, prediction int")
    rep = {r["label"]: r for r in cl.classification_report(df).collect()}
    assert rep["1"]["precision"] == 0.5 and rep["1"]["recall"] == 0.5
    assert rep["0"]["recall"] == pytest.approx(2 / 3)
    assert rep["accuracy"]["f1"] == 0.6 and rep["accuracy"]["support"] == 5
    zero = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    rz = {r["label"]: r for r in cl.classification_report(zero).collect()}
    assert rz["1"]["precision"] == 0.0 and rz["1"]["f1"] == 0.0


def test_scaler_binarise_encoders(spark):
    df = spark.createDataFrame([(1.0, "0", 0, "a"), (2.0, "H1047R", 1, "b"), (4.0, None, 0, "a")],
                               "x double, mut string, mut_int int, cat string")
    scaled = pp.standardize(df, ["x"]).toPandas()["x"]
    assert abs(scaled.mean()) < 1e-12 and abs(scaled.std(ddof=0) - 1) < 1e-12
    b = pp.binarise_columns(df, ["mut", "mut_int"]).collect()
    assert [r["mut"] for r in b] == [0, 1, None] and [r["mut_int"] for r in b] == [0, 1, 0]
    b1 = pp.binarise_columns(df, ["mut"], null_as=1).collect()
    assert [r["mut"] for r in b1] == [0, 1, 1]
    params = pp.fit_levels(df, ["cat"])
    new = spark.createDataFrame([("a",), ("zzz",)], "cat string")
    oh = pp.one_hot(new, params, ["cat"]).collect()
    assert (oh[0]["cat_a"], oh[0]["cat_b"]) == (1.0, 0.0) and (oh[1]["cat_a"], oh[1]["cat_b"]) == (0.0, 0.0)
    with pytest.raises(Exception):
        new.select(pp.ordinal_encode("cat", ["a", "b"])).collect()


def test_mode_ties_smallest_and_median_impute(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert pp.fit_mode(df, ["c"]).get("c", "impute", "fill") == "a"
    num = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "x double")
    filled = pp.impute(num, pp.fit_median(num, ["x"])).collect()
    assert filled[-1]["x"] == 2.0


def test_profile_helpers(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 1.0), (3.0, None), (100.0, 2.0)], "a double, b double")
    d = pf.describe(df, ["a"]).first()
    assert d["median"] == 2.5 and d["q1"] == pytest.approx(1.75) and d["n"] == 4
    miss = pf.missingness(df).collect()
    assert [(r["column"], r["n_missing"]) for r in miss] == [("b", 2)]
    hist = pf.histogram(df, "a", bins=3).orderBy("bin").collect()
    assert [r["n"] for r in hist] == [3, 0, 1]


def test_one_class_and_empty_give_null(spark):
    from riskset.operators import classify as cl
    from riskset.operators import profile as pf
    one = spark.createDataFrame([(1, 0.2), (1, 0.7)], "label int, prob double")
    assert cl.roc_auc(one).first()["auc"] is None
    assert cl.roc_curve(one).where("threshold is not null and fpr is null").count() == 2
    assert cl.class_weights(one.withColumn("label", cl.F.lit(0)), "label").first()["neg_pos_ratio"] is None
    assert cl.roc_auc(one.limit(0)).first()["auc"] is None
    full = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "g string, x int")
    got = pf.missing_by_group(full, "x", "g").collect()
    assert len(got) == 2 and all(r["chi2"] is None and r["n_missing"] == 0 for r in got)


def test_split_reads_any_class_size(spark):
    from riskset.operators.classify import stratified_split
    rows = [(i, i % 7 == 0) for i in range(500)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, y boolean")
    out = stratified_split(df, "y", "id")
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert counts[(True, "test")] == round(0.2 * 72) and counts[(False, "test")] == round(0.2 * 428)
