import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskset.functions.stats import chi2_sf, chi2_sf_col, norm_sf2
from riskset.operators.prefix import dense_rank, exact_quantiles, running_sums


def test_running_sums_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 400), "t": rng.normal(size=400), "v": rng.integers(0, 5, 400)})
    pdf = pdf.groupby(["k", "t"], as_index=False)["v"].sum()
    df = spark.createDataFrame(pdf)
    got = running_sums(df, ["k"], "t", {"fwd": "v"}, buckets=8).toPandas().sort_values(["k", "t"])
    exp = pdf.sort_values(["k", "t"]).groupby("k")["v"].cumsum()
    assert np.array_equal(got["fwd"].to_numpy(), exp.to_numpy())
    rev = running_sums(df, ["k"], "t", {"rev": "v"}, reverse=True, inclusive=False, totals={"tot": "v"},
                       buckets=8).toPandas().sort_values(["k", "t"])
    s = pdf.sort_values(["k", "t"])
    exp_rev = s.groupby("k")["v"].transform(lambda x: x[::-1].cumsum()[::-1]) - s["v"]
    assert np.array_equal(rev["rev"].to_numpy(), exp_rev.to_numpy())
    assert np.array_equal(rev["tot"].to_numpy(), s.groupby("k")["v"].transform("sum").to_numpy())


def test_running_sums_without_keys(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(100)], "t double, v int")
    got = running_sums(df, [], "t", {"c": "v"}, buckets=4).orderBy("t").toPandas()
    assert got["c"].tolist() == list(range(1, 101))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    vals = np.round(rng.exponential(3, 301), 1).tolist() + [None, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, [], "x", [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]).toPandas().sort_values("prob")
    clean = np.array([v for v in vals if v is not None])
    exp = np.percentile(clean, [0, 10, 25, 50, 75, 99, 100])
    assert np.allclose(got["quantile"].to_numpy(), exp, rtol=0, atol=1e-12)


def test_dense_rank(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (2.0,)], "x double")
    got = sorted(tuple(r) for r in dense_rank(df, [], "x", "r").select("x", "r").collect())
    assert got == [(1.0, 1), (2.0, 2), (3.0, 3), (3.0, 3)]


@pytest.mark.parametrize("x,df,p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05),
                                     (7.814727903251179, 3, 0.05), (9.487729036781154, 4, 0.05),
                                     (6.6348966010212145, 1, 0.01), (20.515, 5, 0.001)])
def test_chi2_tail_known_values(x, df, p):
    assert abs(chi2_sf(x, df) - p) / p < 2e-4


def test_chi2_column_forms_agree(spark):
    rows = [(float(x), d) for x in [0.0, 0.5, 2.0, 9.0, 30.0] for d in range(1, 7)]
    df = spark.createDataFrame(rows, "x double, d int")
    col = df.select("x", "d", chi2_sf_col(F.col("x"), F.col("d")).alias("p")).collect()
    for r in col:
        lit = df.where((F.col("x") == r["x"]) & (F.col("d") == r["d"])).select(
            chi2_sf_col(F.col("x"), r["d"]).alias("p")).first()["p"]
        assert abs(r["p"] - lit) < 1e-12
        assert abs(r["p"] - chi2_sf(r["x"], r["d"])) < 1e-12


def test_erfc_accuracy():
    for z in np.linspace(0, 6, 61):
        assert abs(norm_sf2(z) - math.erfc(z / math.sqrt(2))) <= 1.2e-7 * math.erfc(z / math.sqrt(2)) + 1e-15
