"""The distributed forest: equal to one grown in memory, sound, and apart from how rows are dealt out."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskset.operators import classify as cl
from riskset.operators import forest

NAMES = ["a", "b", "c", "d"]


def _table(spark, n=900, parts=3, classes=2):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 40, n), rng.integers(0, 2, n), np.full(n, 7.0)])
    y = ((x[:, 0] + x[:, 1] / 20 + rng.normal(size=n) > 1).astype(int) + (x[:, 2] if classes > 2 else 0)).astype(int)
    rows = [(i, *map(float, r), int(t), 1.0 + (i % 3)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label int, weight double").repartition(parts)
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df), x, y


def _nodes(model):
    return [len(t[0]) for t in forest.joined(model.parts.collect())]


def test_wide_nodes_and_parts_give_the_tree_grown_in_memory(spark, monkeypatch):
    """Histogram passes and hung parts against ``grow`` from the root on the same stored rows."""
    df, *_ = _table(spark, n=1500)
    stored = {}
    keep = forest._rows
    monkeypatch.setattr(forest, "_rows", lambda *a: stored.setdefault("rows", keep(*a)))
    monkeypatch.setattr(forest, "LOCAL_CELLS", 1)           # parts of 1024 rows at most
    monkeypatch.setattr(forest, "WIDE_NODES", 3)
    model = forest.fit(df, "label", "weight", trees=7, depth=12, max_bins=16, seed=3)
    tops = {r["tree"]: r["n"] for r in model.parts.where("slot >= 0").groupBy("tree").agg(F.count("*").alias("n")).collect()}
    assert max(tops.values()) > 1
    rows = sorted(stored["rows"].collect(), key=lambda r: r["row"])
    bins = np.frombuffer(b"".join(r["bins"] for r in rows), np.uint8).reshape(-1, 4)
    ids, y, w = (np.array([r[c] for r in rows]) for c in ("row", "y", "w"))
    width = int(bins.max()) + 1
    got = forest.joined(model.parts.collect())
    for t in range(7):
        k = forest.bag(ids, 3, t)
        own = k > 0
        g = forest.grow(bins[own], y[own].astype(np.int64), (w * k)[own], 1, 12, width, 2, 3, t)
        feature, cut, child, prob = got[t]
        ours = prob.reshape(-1, 2)[-1 - child[forest.route(bins, feature, cut, child)]]
        alone = g["prob"][-1 - g["child"][forest.route(bins, g["feature"], g["cut"], g["child"])]]
        assert np.allclose(ours, alone, atol=1e-12)


def test_tree_by_plain_loops():
    """One tree against a recursive search over all cuts."""
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 6, (120, 4)).astype(np.uint8)
    y = (bins[:, 0] + rng.integers(0, 4, 120) > 4).astype(np.int64)
    w = rng.integers(1, 4, 120).astype(float)
    g = forest.grow(bins, y, w, 1, 5, 6, 2, 9, 0)
    at = forest.route(bins, g["feature"], g["cut"], g["child"])
    got = g["prob"][-1 - g["child"][at]]

    def gini(own):
        s = np.array([w[own & (y == c)].sum() for c in (0, 1)])
        return s.sum() - (s ** 2).sum() / s.sum() if s.sum() else 0.0

    def tree(own, heap):
        s = np.array([w[own & (y == c)].sum() for c in (0, 1)])
        leaf = {"guess": s.argmax(), "prob": s / s.sum(), "rows": own}
        if min(s) == 0 or heap.bit_length() > 5:
            return [leaf]
        best = (1e-12, None)
        for f in forest.drawn(np.array([heap]), 4, 9, 0)[0]:
            for b in range(5):
                left, right = own & (bins[:, f] <= b), own & (bins[:, f] > b)
                gain = (gini(own) - gini(left) - gini(right)) / s.sum()
                if left.any() and right.any() and gain > best[0] + 1e-12:
                    best = (gain, (left, right))
        if best[1] is None:
            return [leaf]
        below = [tree(side, 2 * heap + i) for i, side in enumerate(best[1])]
        if len(below[0]) == len(below[1]) == 1 and below[0][0]["guess"] == below[1][0]["guess"]:
            return [leaf]
        return below[0] + below[1]

    want = np.empty_like(got)
    for leaf in tree(np.ones(120, bool), 1):
        want[leaf["rows"]] = leaf["prob"]
    assert np.allclose(got, want)


def test_bootstrap_and_draws():
    rows = np.arange(200_000)
    k = np.array([forest.bag(rows, 42, t) for t in (0, 1)])
    assert abs(k.mean() - 1) < 0.01 and abs(k.var() - 1) < 0.02 and abs(np.corrcoef(k)[0, 1]) < 0.01
    d = forest.drawn(np.arange(1, 5001), 10, 42, 0)
    assert d.shape == (5000, 4) and all(len(set(r)) == 4 for r in d.tolist())
    assert np.abs(np.bincount(d.ravel()) / 5000 - 0.4).max() < 0.03


def test_large_table_is_not_left_to_mllib_and_scores_alike(spark, monkeypatch, tmp_path):
    """Both ways learn the same thing; saved equals reloaded; missing values are scored."""
    df, _, y = _table(spark, n=3000)
    table = df.drop("features")
    small = cl.random_forest(table, NAMES, "label", trees=30, depth=8)
    monkeypatch.setattr(cl, "MLLIB_ROWS", 100)
    large = cl.random_forest(table, NAMES, "label", trees=30, depth=8)
    assert isinstance(large.stages[-1], forest.ForestModel) and not isinstance(small.stages[-1], forest.ForestModel)
    one, two = ({r["id"]: r for r in cl.score(m, table, ["id"]).collect()} for m in (small, large))
    assert len(two) == 3000 and np.corrcoef([one[i]["prob"] for i in one], [two[i]["prob"] for i in one])[0, 1] > 0.95
    assert all((r["prob"] > 0.5) == (r["prediction"] == 1) for r in two.values())
    a, b = (m.stages[-1].featureImportances.toArray() for m in (small, large))
    assert abs(b.sum() - 1) < 1e-9 and b[3] == 0 and np.abs(a - b).max() < 0.1
    cl.save_model(large, str(tmp_path / "m"))
    again = {r["id"]: r for r in cl.score(cl.load_model(str(tmp_path / "m")), table, ["id"]).collect()}
    assert again == two
    gaps = spark.createDataFrame([(1, None, 3.0, 1.0, 7.0)], "id long, a double, b double, c double, d double")
    assert 0 <= cl.score(large, gaps, ["id"]).first()["prob"] <= 1
    assert cl.score(large, gaps.limit(0), ["id"]).collect() == []


def test_three_classes_one_class_and_bad_labels(spark):
    df, _, y = _table(spark, n=400, classes=3)
    got = forest.fit(df, "label", None, trees=5, depth=6).transform(df).select("label", "probability", "prediction").collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and len(r["probability"]) == 3 for r in got)
    assert np.mean([r["prediction"] == r["label"] for r in got]) > 0.7
    one = forest.fit(df.withColumn("label", F.lit(0)), "label", None, trees=2, depth=6)
    assert one.transform(df).agg(F.max("prediction")).first()[0] == 0 and not one.featureImportances.toArray().any()
    for bad in (F.lit(None).cast("int"), F.lit(-1), F.lit(0.5)):
        with pytest.raises(ValueError):
            forest.fit(df.withColumn("label", bad), "label", None, trees=2, depth=6)


def test_wide_nodes_that_cannot_be_split_are_not_dealt_out(spark, monkeypatch):
    """2,400 of 3,000 rows share features and class: leaves of the tops, without a part."""
    monkeypatch.setattr(forest, "LOCAL_CELLS", 1)
    df = spark.range(3000).select(F.when(F.col("id") < 2400, 0.0).otherwise(F.col("id") % 7 + 1.0).alias("a"),
                                  (F.col("id") >= 2400).cast("double").alias("b"),
                                  F.when(F.col("id") < 2400, 0).otherwise(F.col("id") % 2).alias("label"))
    table = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    dealt = []
    keep = forest._subtrees
    monkeypatch.setattr(forest, "_subtrees", lambda rows, tops, *a: dealt.extend(tops) or keep(rows, tops, *a))
    model = forest.fit(table, "label", None, trees=4, depth=8)
    assert sum(len(t.leaves) for t in dealt) == 4
    assert {r["slot"] >= 0 for r in model.parts.where("slot >= 0 and not leaf").collect()} <= {True}
    got = model.transform(table).where("a = 0").select("probability").distinct().collect()
    assert len(got) == 1 and got[0][0][1] == 0.0


def test_cuts(spark):
    df, x, _ = _table(spark, n=2000)
    cuts = forest.find_cuts(df.selectExpr("array(a, b, c, d) as x"), 4, 32)
    assert cuts[2].tolist() == [0.5] and cuts[3].tolist() == []
    share = np.searchsorted(np.sort(x[:, 0]), cuts[0]) / 2000
    assert len(cuts[0]) == 31 and np.abs(share - np.arange(1, 32) / 32).max() < 0.004
    rare = spark.createDataFrame([(float(i == 7),) for i in range(5000)], "v double").selectExpr("array(v) as x")
    assert forest.find_cuts(rare, 1, 32)[0].tolist() == [0.5]
