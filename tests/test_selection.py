"""Selection, matrix sums and blocks against NumPy."""

import math

import numpy as np
import pandas as pd
import pytest

from riskset.operators import gram, prepare, profile, selection

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def frame(spark, columns, parts=3):
    names = list(columns)
    rows = [tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r) for r in zip(*columns.values())]
    kinds = ", ".join(f"`{c}` {'string' if isinstance(next((x for x in columns[c] if x is not None), 0.0), str) else 'double'}"
                      for c in names)
    return spark.createDataFrame(rows, kinds).repartition(parts)


@pytest.mark.parametrize("limit", [250_000, 40])
def test_summaries_match_numpy(spark, monkeypatch, limit):
    """Continuous, tied, hot, constant, infinite and empty columns; small brackets are cut again."""
    monkeypatch.setattr(selection, "BRACKET_ROWS", limit)
    rng = np.random.default_rng(3)
    n = 30_000
    data = {"a": rng.normal(size=n), "b.c": rng.integers(0, 5, n).astype(float), "hot": np.where(rng.random(n) < .4, 7.0, rng.normal(size=n)),
            "one": np.full(n, 2.5), "far": rng.normal(size=n) * 1e12 + 1e15, "none": np.full(n, np.nan), "end": rng.normal(size=n)}
    data["a"][rng.random(n) < .3] = np.nan
    data["end"][:20] = np.inf
    data["end"][20:50] = -np.inf
    got = {x["column"]: x for x in selection.summaries(frame(spark, {k: v.tolist() for k, v in data.items()}), list(data), PROBS)}
    assert set(got) == set(data) - {"none"}
    for name, x in got.items():
        v = np.sort(data[name][~np.isnan(data[name])])
        assert x["n"] == len(v) and x["min"] == v[0] and x["max"] == v[-1]
        if name != "end":
            assert x["mean"] == pytest.approx(v.mean(), rel=1e-12)
            assert x["m2"] == pytest.approx(((v - v.mean()) ** 2).sum(), rel=1e-9, abs=1e-9)
        for p in PROBS:
            pos = p * (len(v) - 1)
            lo, hi = v[math.floor(pos)], v[math.ceil(pos)]
            want = lo if lo == hi else lo + (pos - math.floor(pos)) * (hi - lo)
            assert x["quantiles"][p] == pytest.approx(want, rel=1e-12)


def test_summaries_by_group(spark):
    rng = np.random.default_rng(5)
    n = 5000
    g = rng.choice(["x", "y", None, "z w"], n, p=[.6, .2, .1, .1]).tolist()
    h = rng.choice(["1", "2"], n).tolist()
    v = rng.exponential(size=n)
    df = frame(spark, {"g": g, "h": h, "v": v.tolist()})
    got = {x["key"]: x for x in selection.summaries(df, ["v"], [0.5], ["g", "h"])}
    want = pd.DataFrame({"g": g, "h": h, "v": v}).dropna().groupby(["g", "h"])["v"]
    assert set(got) == set(want.groups)
    for key, own in want:
        assert got[key]["n"] == len(own) and got[key]["quantiles"][0.5] == pytest.approx(own.median(), rel=1e-12)
    assert selection.summaries(df, ["v"], [0.5], ["g", "h"], limit=3) is None
    assert selection.summaries(df.limit(0), ["v"], [0.5]) == []
    assert selection.summaries(df, [], [0.5]) == []


def test_many_groups_take_the_long_way(spark, monkeypatch):
    monkeypatch.setattr(selection, "groups_of", lambda *a: None)
    df = frame(spark, {"g": ["a", "a", "b", "b", "b"], "v": [1.0, 2.0, 5.0, None, 9.0]})
    got = {r["g"]: r for r in profile.describe(df, ["v"], by=["g"]).collect()}
    assert (got["a"]["median"], got["b"]["median"], got["b"]["n"]) == (1.5, 7.0, 2)


def test_correlations_of_many_columns(spark):
    """700 columns with missing cells, a constant one and far-off means."""
    rng = np.random.default_rng(8)
    p, n = 700, 400
    x = rng.normal(size=(n, p)) + rng.normal(size=(n, 1))
    x[:, 5] = 3.0
    x[:, 6] = x[:, 7] * -2 + 1e9
    x[rng.random((n, p)) < .1] = np.nan
    x[2:, 8] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(p)])).repartition(4)
    rows = profile.correlation_matrix(df, df.columns).toPandas()
    assert len(rows) == p * (p - 1) // 2
    got = {(a, b): r for a, b, r in rows.itertuples(index=False)}
    want = pd.DataFrame(x).corr(min_periods=2).to_numpy()
    for i, j in [(0, 1), (6, 7), (127, 128), (3, 699), (300, 400), *zip(rng.integers(9, 300, 60), rng.integers(300, 700, 60), strict=True)]:
        assert got[f"c{i}", f"c{j}"] == pytest.approx(want[i, j], abs=1e-6)
    assert np.isnan(got["c5", "c6"]) and np.isnan(got["c0", "c5"])
    assert gram.null_counts(df, df.columns) == (n, np.isnan(x).sum(axis=0).tolist())
    back = gram.moments(df, df.columns)
    assert [m[0] for m in back] == (~np.isnan(x)).sum(axis=0).tolist()
    assert np.allclose([m[1] for m in back], np.nanmean(x, axis=0), rtol=1e-10)
    assert back[5][2] == 0.0
    assert len(df.select("c0", "c1").columns) == 2 and profile.correlation_matrix(df.limit(0), ["c0", "c1"]).count() == 0


def test_column_plan_after_imputation(spark):
    """The scaler's parameters are those of the imputed columns."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=501)
    v[rng.random(501) < .3] = np.nan
    df = frame(spark, {"v": v.tolist(), "k": rng.choice(["a", "b"], 501).tolist()})
    params = prepare.fit_columns(df, prepare.ColumnPlan(median_scale=["v"], onehot_if_binary=["k"]))
    filled = np.where(np.isnan(v), np.nanmedian(v), v)
    assert params.get("v", "impute", "fill") == pytest.approx(np.nanmedian(v))
    assert params.get("v", "scale", "mean") == pytest.approx(filled.mean())
    assert params.get("v", "scale", "sd") == pytest.approx(filled.std())
