"""Block scans of the Cox likelihood and merge counting, cut into many small parts."""

import numpy as np
import pytest

from brute import concordance as brute_c
from brute import cox_efron
from riskset.operators import cox, cox_blocks, merge_count
from riskset.operators.concordance import concordance


def cohort(spark, n, p, seed=0, missing=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    t = np.round(rng.exponential(np.exp(-0.4 * x[:, 0])) * 12, 1)
    t[rng.random(n) < .3] = 4.0                                 # a third of all at one time
    e = rng.integers(0, 2, n)
    x[rng.random((n, p)) < missing] = np.nan
    rows = [(float(t[i]), int(e[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    rows += [(None, 1, *[0.0] * p), (float("nan"), 1, *[0.0] * p), (3.0, None, *[0.0] * p)]
    df = spark.createDataFrame(rows, "duration double, event int, " + ", ".join(f"x{j} double" for j in range(p)))
    return df.repartition(3), t, e, x


@pytest.mark.parametrize("ties", ["efron", "breslow"])
@pytest.mark.parametrize("cells", [1 << 20, 60])
def test_joint_fit_in_blocks(spark, monkeypatch, ties, cells):
    monkeypatch.setattr(cox_blocks, "CELLS", cells)
    df, t, e, x = cohort(spark, 200, 3, missing=.05)
    full = ~np.isnan(x).any(axis=1)
    beta, se, ll = cox_efron(t[full], e[full], x[full], ties)
    fit, table = cox.cox_multivariate(df, ["x0", "x1", "x2"], ties=ties)
    assert np.allclose(fit.beta["model"], beta, atol=1e-8)
    assert np.allclose([r["se_coef"] for r in table.orderBy("variable").collect()], se, atol=1e-8)
    assert abs(fit.loglik["model"] - ll) < 1e-6 and fit.n["model"] == full.sum() and fit.n_events["model"] == e[full].sum()


@pytest.mark.parametrize("most", [cox_blocks.MAX_CELLS, 1])
def test_univariate_batch_in_blocks(spark, monkeypatch, most):
    """Each model takes the rows that have its covariate; without room for blocks the other way gives the same."""
    monkeypatch.setattr(cox_blocks, "CELLS", 100)
    monkeypatch.setattr(cox_blocks, "MAX_CELLS", most)
    df, t, e, x = cohort(spark, 150, 2, seed=2, missing=.1)
    table = {r["variable"]: r for r in cox.cox_univariate(df, ["x0", "x1"]).collect()}
    for j in range(2):
        own = ~np.isnan(x[:, j])
        beta, se, _ = cox_efron(t[own], e[own], x[own, j])
        assert abs(table[f"x{j}"]["coef"] - beta[0]) < 1e-8 and abs(table[f"x{j}"]["se_coef"] - se[0]) < 1e-8


def test_thirty_covariates(spark, monkeypatch):
    monkeypatch.setattr(cox_blocks, "CELLS", 3000)
    df, t, e, x = cohort(spark, 400, 30, seed=5)
    fit = cox.fit(df, [f"x{j}" for j in range(30)])
    beta, se, _ = cox_efron(t, e, x)
    assert np.allclose(fit.beta["model"], beta, atol=1e-7)
    assert np.allclose(np.sqrt(np.diag(fit.covariance("model"))), se, atol=1e-7)


def test_large_tie_group_in_one_time(spark):
    """All subjects die at once: every at-risk set is the tie group itself."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(5.0 if i < 200 else 6.0, 1 if i < 250 else 0, float(x[i])) for i in range(300)],
                               "duration double, event int, x double")
    t, e = np.where(np.arange(300) < 200, 5.0, 6.0), (np.arange(300) < 250).astype(int)
    assert abs(cox.fit(df, ["x"]).beta["model"][0] - cox_efron(t, e, x)[0][0]) < 1e-8


def test_not_converged_in_blocks(spark):
    df = spark.createDataFrame([(float(i), 1, float(-i)) for i in range(20)], "duration double, event int, x double")
    with pytest.raises(cox.NotConverged):
        cox.fit(df, ["x"])
    with pytest.raises(cox.NotConverged):
        cox.fit(df.withColumn("event", df.event * 0), ["x"])


@pytest.mark.parametrize("rows,most", [(1 << 18, 1 << 23), (40, 1 << 23), (40, 41)])
def test_concordance_in_ranges(spark, monkeypatch, rows, most):
    monkeypatch.setattr(merge_count, "ROWS", rows)
    monkeypatch.setattr(merge_count, "MAX_ROWS", most)
    rng = np.random.default_rng(3)
    n = 400
    t, e = np.round(rng.exponential(size=n) * 8), rng.integers(0, 2, n)
    t[:120] = 5.0
    risk = np.round(rng.normal(size=n), 1)
    risk[50:200] = 0.5
    data = [(float(a), int(b), float(c)) for a, b, c in zip(t, e, risk, strict=True)]
    data += [(1.0, 1, float("nan")), (float("nan"), 1, 1.0), (None, 1, 1.0)]
    df = spark.createDataFrame(data, "duration double, event int, risk double").repartition(4)
    got = concordance(df, "risk").first()
    want = brute_c(t, e, risk)
    assert (int(got["concordant"]), int(got["tied_risk"]), int(got["comparable"])) == want


def test_concordance_without_pairs(spark):
    schema = "duration double, event int, risk double"
    assert concordance(spark.createDataFrame([], schema), "risk").first()["c_index"] is None
    one = concordance(spark.createDataFrame([(1.0, 1, 2.0)], schema), "risk").first()
    assert one["c_index"] is None and int(one["comparable"]) == 0


def test_pair_counts_against_all_pairs():
    rng = np.random.default_rng(9)
    for n in (1, 2, 7, 60, 300):
        t, e, risk = rng.integers(0, n // 2 + 1, n), rng.integers(0, 2, n), rng.integers(-n // 3 - 1, n // 3 + 1, n).astype(float)
        for ties in (True, False):
            later = (t[None, :] > t[:, None]) | ((t[None, :] == t[:, None]) & (e[None, :] == 0) & ties)
            later &= (e[:, None] == 1)
            want = tuple(int((later & m).sum()) for m in (risk[None, :] < risk[:, None], risk[None, :] == risk[:, None], True))
            assert merge_count.pair_counts(t.astype(float), e, risk, ties) == want
