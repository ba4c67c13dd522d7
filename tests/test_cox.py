import numpy as np
import pytest
from pyspark.sql import functions as F

from riskset.operators import cox
from riskset.operators import survival as sv
from riskset.operators.concordance import concordance

from brute import concordance as brute_c
from brute import cox_efron


def _data(spark, n=120, seed=0, p=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    t = np.round(rng.exponential(np.exp(-0.5 * x[:, 0])) * 10)  # rounded: many ties
    e = rng.integers(0, 2, n)
    rows = [(i, float(t[i]), int(e[i]), *map(float, x[i])) for i in range(n)]
    cols = "id long, duration double, event int, " + ", ".join(f"x{j} double" for j in range(p))
    return spark.createDataFrame(rows, cols), t, e, x


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_multivariate_matches_brute_force(spark, ties):
    df, t, e, x = _data(spark)
    fit, table = cox.cox_multivariate(df, ["x0", "x1"], ties=ties)
    beta, se, ll = cox_efron(t, e, x, ties)
    got = {r["variable"]: r for r in table.collect()}
    assert np.allclose([got["x0"]["coef"], got["x1"]["coef"]], beta, atol=1e-8)
    assert np.allclose([got["x0"]["se_coef"], got["x1"]["se_coef"]], se, atol=1e-8)
    assert abs(fit.loglik["model"] - ll) < 1e-6


def test_univariate_batch_equals_single_fits(spark):
    df, t, e, x = _data(spark, seed=1)
    table = {r["variable"]: r for r in cox.cox_univariate(df, ["x0", "x1"]).collect()}
    for j in range(2):
        beta, se, _ = cox_efron(t, e, x[:, j])
        assert abs(table[f"x{j}"]["coef"] - beta[0]) < 1e-8
        assert abs(table[f"x{j}"]["hr"] - np.exp(beta[0])) < 1e-8


def test_score_test_equals_logrank_without_ties(spark):
    rng = np.random.default_rng(4)
    n = 80
    t = rng.permutation(n).astype(float) + 1
    e = rng.integers(0, 2, n)
    g = rng.integers(0, 2, n)
    df = spark.createDataFrame([(float(t[i]), int(e[i]), float(g[i]), str(g[i])) for i in range(n)],
                               "duration double, event int, x double, grp string")
    s = {r["term"]: r["value"] for r in cox.score_at(df, ["x"], [0.0]).collect()}
    lr = sv.logrank(df, "grp").first()["statistic"]
    assert abs(s["U0"] ** 2 / s["I0_0"] - lr) < 1e-9


def test_concordance_matches_pairs_and_symmetry(spark):
    df, t, e, x = _data(spark, n=90, seed=2)
    risk = np.round(x[:, 0], 1)  # ties in risk
    sdf = spark.createDataFrame([(float(t[i]), int(e[i]), float(risk[i])) for i in range(len(t))],
                                "duration double, event int, risk double")
    got = concordance(sdf, "risk").first()
    conc, tied, comp = brute_c(t, e, risk)
    assert (got["concordant"], got["tied_risk"], got["comparable"]) == (conc, tied, comp)
    neg = concordance(sdf.withColumn("risk", -F.col("risk")), "risk").first()
    assert abs(got["c_index"] + neg["c_index"] - 1.0) < 1e-12


def test_schoenfeld_and_ph_test_run(spark):
    df, *_ = _data(spark, seed=3)
    fit, _ = cox.cox_multivariate(df, ["x0", "x1"])
    res = cox.schoenfeld_residuals(df, ["x0", "x1"], fit.beta["model"], id_col="id")
    assert res.count() == df.where("event = 1").count()
    ph = cox.ph_test(df, fit, ["x0", "x1"], id_col="id").collect()
    assert len(ph) == 2 and all(0 <= r["p_value"] <= 1 for r in ph)


def test_efron_chunked_tie_groups_match(spark, monkeypatch):
    # heavy ties: split every tie group into chunks of two events
    df, t, e, x = _data(spark, n=100, seed=5)
    monkeypatch.setattr(cox, "EFRON_CHUNK", 2)
    _, table = cox.cox_multivariate(df, ["x0", "x1"], ties="efron")
    beta, se, _ = cox_efron(t, e, x, "efron")
    got = {r["variable"]: r for r in table.collect()}
    assert np.allclose([got["x0"]["coef"], got["x1"]["coef"]], beta, atol=1e-8)
    assert np.allclose([got["x0"]["se_coef"], got["x1"]["se_coef"]], se, atol=1e-8)


def test_ph_test_per_time_equals_per_event(spark):
    df, *_ = _data(spark, n=150, seed=8)
    fit, _ = cox.cox_multivariate(df, ["x0", "x1"])
    got = {r["variable"]: r["test_statistic"] for r in cox.ph_test(df, fit, ["x0", "x1"], id_col="id").collect()}
    res = cox.schoenfeld_residuals(df, ["x0", "x1"], fit.beta["model"], id_col="id").toPandas()
    g = res["t"].rank(method="average").to_numpy()
    var = fit.covariance("model")
    d = len(res)
    scaled = d * res[["r0", "r1"]].to_numpy() @ var
    gg = g - g.mean()
    for j, name in enumerate(["x0", "x1"]):
        ref = (gg @ scaled[:, j]) ** 2 / (d * var[j, j] * (gg ** 2).sum())
        assert abs(got[name] - ref) < 1e-9 * max(1.0, ref)


def test_efron_residuals_sum_to_the_score(spark):
    df, *_ = _data(spark, n=150, seed=9)
    beta = [0.3, -0.2]
    score = {r["term"]: r["value"] for r in cox.score_at(df, ["x0", "x1"], beta).collect()}
    res = cox.schoenfeld_residuals(df, ["x0", "x1"], beta, id_col="id").agg(F.sum("r0"), F.sum("r1")).first()
    assert np.allclose(res, [score["U0"], score["U1"]], atol=1e-8)


def test_separable_data_raise(spark):
    rows = [(float(i + 1), 1, float(i < 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "duration double, event int, x double")
    with pytest.raises(cox.NotConverged):
        cox.cox_multivariate(df, ["x"])


def test_step_limit_raises(spark):
    df, *_ = _data(spark, seed=1)
    with pytest.raises(cox.NotConverged):
        cox.fit(df, ["x0", "x1"], max_steps=2)


def test_tie_chunks_are_dealt_out(spark):
    df, *_ = _data(spark, n=60)
    ready = cox.prepare(df, ["x0", "x1"])
    plan = cox.step_sums(ready.base, [], ready.xcols, F.lit(0.0) * F.col("x0"), split=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in text


def test_concordance_without_pairs(spark):
    df = spark.createDataFrame([(1.0, 0, 1.0), (2.0, 0, 2.0)], "duration double, event int, risk double")
    assert concordance(df, "risk").first()["c_index"] is None
