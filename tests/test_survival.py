import numpy as np
import pytest
from pyspark.sql import functions as F

from riskset.operators import survival as sv

from brute import km, logrank


def _cohort(spark, t, e, g=None):
    rows = [(float(a), int(b), None if g is None else g[i]) for i, (a, b) in enumerate(zip(t, e))]
    return spark.createDataFrame(rows, "duration double, event int, grp string")


def test_km_micro_cases(spark):
    # ties, a time where everyone at risk dies, censoring at an event time
    t = [1, 2, 2, 2, 3, 4, 5, 5]
    e = [1, 1, 1, 0, 0, 1, 1, 1]
    got = sv.kaplan_meier(_cohort(spark, t, e)).orderBy("t").collect()
    exp = km(t, e)
    assert [r["t"] for r in got] == [x[0] for x in exp]
    assert [r["n_at_risk"] for r in got] == [x[1] for x in exp]
    assert np.allclose([r["survival"] for r in got], [x[3] for x in exp], atol=1e-15)
    assert got[-1]["survival"] == 0.0 and got[-1]["ci_low"] is None
    for r in got:
        if r["ci_low"] is not None:
            assert r["ci_low"] <= r["survival"] <= r["ci_high"]


def test_km_all_censored_and_single_subject(spark):
    got = sv.kaplan_meier(_cohort(spark, [3, 1, 2], [0, 0, 0])).collect()
    assert all(r["survival"] == 1.0 and r["ci_low"] is None for r in got)
    one = sv.kaplan_meier(_cohort(spark, [7], [1])).collect()
    assert one[0]["survival"] == 0.0 and one[0]["n_at_risk"] == 1


def test_km_strata_monotone_and_nulls_excluded(spark):
    rng = np.random.default_rng(3)
    t = rng.integers(1, 30, 200)
    e = rng.integers(0, 2, 200)
    g = [None if i % 17 == 0 else "ab"[i % 2] for i in range(200)]
    df = _cohort(spark, t, e, g)
    got = sv.kaplan_meier(df, strata="grp").toPandas()
    assert set(got["grp"]) == {"a", "b"}
    for lv, part in got.groupby("grp"):
        s = part.sort_values("t")["survival"].to_numpy()
        assert (np.diff(s) <= 1e-15).all() and (s >= 0).all() and (s <= 1).all()
        mask = np.array([x == lv for x in g])
        assert np.allclose(s, [x[3] for x in km(t[mask], e[mask])])


def test_median(spark):
    t, e = [1, 2, 3, 4, 5, 6], [1, 1, 1, 1, 0, 0]
    kmdf = sv.kaplan_meier(_cohort(spark, t, e))
    med = sv.median_survival(kmdf).first()
    assert med["median_t"] == 3.0
    never = sv.median_survival(sv.kaplan_meier(_cohort(spark, [1, 2, 3], [1, 0, 0]))).first()
    assert never["median_t"] is None


@pytest.mark.parametrize("k", [2, 3, 4])
def test_logrank_matches_brute_force(spark, k):
    rng = np.random.default_rng(10 + k)
    n = 150
    t = rng.integers(1, 25, n)
    e = rng.integers(0, 2, n)
    g = [f"g{i % k}" for i in range(n)]
    df = _cohort(spark, t, e, g)
    got = sv.logrank(df, "grp").first()
    stat, dof = logrank(t, e, g)
    assert got["dof"] == dof and abs(got["statistic"] - stat) < 1e-9
    relabeled = df.withColumn("grp", F.concat(F.lit("z"), F.col("grp")))
    assert abs(sv.logrank(relabeled, "grp").first()["statistic"] - stat) < 1e-9


def test_logrank_without_a_matrix(spark, monkeypatch):
    """The solve for many levels equals the dense one, for variables of different width at once."""
    rng = np.random.default_rng(21)
    n = 900
    t, e = rng.integers(1, 40, n), rng.integers(0, 2, n)
    wide, narrow = [f"g{x}" for x in rng.integers(0, 60, n)], [f"h{x}" for x in rng.integers(0, 3, n)]
    rows = [(float(a), int(b), g, h) for a, b, g, h in zip(t, e, wide, narrow)]
    # A level that leaves before any event; a null and a NaN time, a null level.
    rows += [(0.5, 0, "early", "h0"), (None, 1, "g1", "h1"), (3.0, 1, None, "h2"), (float("nan"), 1, "g2", "h1")]
    stat, dof = logrank(*zip(*[(a, b, h) for a, b, _, h in rows if a is not None and a == a]))
    df = spark.createDataFrame(rows, "duration double, event int, wide string, narrow string")
    dense = {r["variable"]: r for r in sv.logrank(df, ["wide", "narrow"]).collect()}
    monkeypatch.setattr(sv, "DENSE_LEVELS", 10)
    mixed = {r["variable"]: r for r in sv.logrank(df, ["wide", "narrow"]).collect()}
    sparse = {r["variable"]: r for r in sv.logrank(df, ["wide", "narrow"], dense_levels=0).collect()}
    for v in ("wide", "narrow"):
        for got in (mixed[v], sparse[v]):
            assert (got["n_groups"], got["dof"]) == (dense[v]["n_groups"], dense[v]["dof"])
            assert got["statistic"] == pytest.approx(dense[v]["statistic"], rel=1e-9)
    assert dense["wide"]["n_groups"] == 61
    assert dense["narrow"]["statistic"] == pytest.approx(stat) and dense["narrow"]["dof"] == dof


def test_logrank_without_a_matrix_edges(spark, monkeypatch):
    monkeypatch.setattr(sv, "DENSE_LEVELS", 0)
    one = sv.logrank(_cohort(spark, [1, 2, 3], [1, 0, 1], "aaa"), "grp").first()
    assert (one["n_groups"], one["statistic"], one["dof"]) == (1, None, None)
    none = sv.logrank(_cohort(spark, [1, 2, 3], [0, 0, 0], "aba"), "grp").first()
    assert (none["n_groups"], none["statistic"]) == (2, 0.0)
    assert sv.logrank(spark.createDataFrame([], "duration double, event int, grp string"), "grp").count() == 0
    assert sv.logrank_groups(spark.createDataFrame([], "duration double, event int, grp string"), "grp").count() == 0


def test_logrank_of_very_many_levels(spark):
    """100,000 levels against the low-rank form of the same system: as many unknowns as there are times."""
    k, n, last = 100_000, 150_000, 200
    cohort = spark.range(n).select(
        (1 + F.pmod(F.xxhash64("id"), F.lit(last))).cast("double").alias("duration"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) < 7).cast("int").alias("event"),
        (F.col("id") % k).cast("string").alias("grp"))
    got = sv.logrank(cohort, "grp").first()
    assert got["n_groups"] == k and got["dof"] == k - 1
    rows = cohort.toPandas()
    t, e, g = rows["duration"].to_numpy().astype(int) - 1, rows["event"].to_numpy(), rows["grp"].astype(int).to_numpy()
    total, d = np.bincount(t, minlength=last)[::-1].cumsum()[::-1], np.bincount(t, e, minlength=last)
    w = np.where(total > 1, d * (total - d) / np.maximum(total - 1, 1), 0.0)
    own = np.zeros((k, last))
    np.add.at(own, (g, t), 1.0)
    share = own[:, ::-1].cumsum(axis=1)[:, ::-1] / total
    z = np.bincount(g, e, minlength=k) - share @ d
    use = w > 0
    share, w, diag = share[:, use], w[use], share @ w
    y = z / diag
    inner = np.diag(1 / w) - share.T @ (share / diag[:, None])
    fix = np.linalg.lstsq(inner, share.T @ y, rcond=1e-12)[0]
    assert got["statistic"] == pytest.approx(z @ y + (share.T @ y) @ fix, rel=1e-8)


def test_logrank_groups_observed_equals_expected_in_total(spark):
    rng = np.random.default_rng(5)
    t, e = rng.integers(1, 20, 100), rng.integers(0, 2, 100)
    g = ["abc"[i % 3] for i in range(100)]
    rows = sv.logrank_groups(_cohort(spark, t, e, g), "grp").collect()
    assert sum(r["observed"] for r in rows) == pytest.approx(sum(r["expected"] for r in rows))


def test_ignore_censoring_counts_every_row(spark):
    t = [1, 2, 3, 4, 5, 6]
    e = [1, 0, 0, 1, 0, 0]
    g = ["a", "b", "a", "b", "a", "b"]
    got = sv.logrank(_cohort(spark, t, e, g), "grp", ignore_censoring=True).first()
    stat, _ = logrank(t, [1] * 6, g)
    assert abs(got["statistic"] - stat) < 1e-9


def test_two_group_null_semantics(spark):
    df = spark.createDataFrame([("Positive",), ("Negative",), (None,)], "s string")
    excl = [r[0] for r in df.select(sv.two_group("s", "Positive")).collect()]
    other = [r[0] for r in df.select(sv.two_group("s", "Positive", "other")).collect()]
    assert excl == ["A", "B", None] and other == ["A", "B", "B"]


def test_curve_crossings(spark):
    # a falls early then flattens, b falls late: they cross once
    t = [1, 1, 2, 10, 10, 10, 3, 4, 5, 6, 7, 8]
    e = [1, 1, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1]
    g = ["a"] * 6 + ["b"] * 6
    got = sv.curve_crossings(_cohort(spark, t, e, g), "grp", "a", "b").first()
    assert got["n_crossings"] == 1


def test_empty_cohort_gives_empty_curves(spark):
    empty = spark.createDataFrame([], "duration double, event int, grp string")
    assert sv.kaplan_meier(empty).count() == 0
    assert sv.logrank(empty, "grp").count() == 0


def test_logrank_many_groups_matches_brute(spark):
    rng = np.random.default_rng(12)
    t, e, g = rng.integers(1, 40, 400).astype(float), rng.integers(0, 2, 400), [f"g{k:02d}" for k in rng.integers(0, 25, 400)]
    got = sv.logrank(_cohort(spark, t, e, g), "grp").first()
    stat, dof = logrank(t, e, g)
    assert got["dof"] == dof and abs(got["statistic"] - stat) < 1e-8 * stat
