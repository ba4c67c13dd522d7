"""The stratified split and column examples on awkward rows."""

import hashlib
import math
import random

import pytest

from riskset.operators import classify, profile


def allocated(rows, fraction=0.2, seed=42):
    """Test rows per class by sorting whole classes."""
    out = set()
    for y in {r[1] for r in rows}:
        own = sorted((hashlib.md5((("\x00no id" if i is None else str(i)) + f"-{seed}").encode()).hexdigest(), str(i), i)
                     for i, c in rows if c == y)
        k = math.floor(fraction * len(own) + 0.5)
        if k:
            cut = own[k - 1][:2]
            out |= {(x[2], y) for x in own if x[:2] <= cut}
    return out


@pytest.mark.parametrize("few,bands", [(50_000, 256), (3, 4)])
def test_split_matches_sorting(spark, monkeypatch, few, bands):
    """Nulls, repeated ids, null classes and hot ids; refinement goes down to single hashes."""
    monkeypatch.setattr(classify, "CUT_ROWS", few)
    monkeypatch.setattr(classify, "BANDS_OF_HASH", bands)
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 1, None])) for i in range(600)] + [(None, 1)] * 95 + [(7, 0)] * 40
    df = spark.createDataFrame(rows, "id long, y int").repartition(3)
    got = classify.stratified_split(df, "y", "id").collect()
    assert len(got) == len(rows)
    assert {(r["id"], r["y"]) for r in got if r["split"] == "test"} == allocated(rows)
    assert not {(r["id"], r["y"]) for r in got if r["split"] == "train"} & allocated(rows)


def test_split_edges(spark):
    schema = "id long, y int"
    assert classify.stratified_split(spark.createDataFrame([], schema), "y", "id").count() == 0
    only = classify.stratified_split(spark.createDataFrame([(None, 0)] * 100, schema), "y", "id")
    assert only.where("split = 'test'").count() == 100          # nothing tells them apart
    one = classify.stratified_split(spark.createDataFrame([(1, 0), (None, None)], schema), "y", "id")
    assert one.where("split = 'train'").count() == 2


def test_split_refuses_ids_as_labels(spark, monkeypatch):
    monkeypatch.setattr(classify, "CLASS_LIMIT", 5)
    with pytest.raises(ValueError):
        classify.stratified_split(spark.range(9).selectExpr("id", "id as y"), "y", "id")


def test_examples_are_the_smallest_distinct(spark):
    df = spark.createDataFrame([(i % 50, f"v{i % 9}é" if i % 3 else None, None) for i in range(500)], "a int, `b c` string, n double")
    got = {}
    for r in profile.examples(df.repartition(7), df.columns, 4).collect():
        got.setdefault(r["column"], []).append((r["rank"], r["value"], r["dtype"]))
    assert [x[1] for x in sorted(got["a"])] == ["0", "1", "10", "11"] and got["a"][0][2] == "int"
    assert [x[1] for x in sorted(got["b c"])] == [f"v{i}é" for i in (1, 2, 4, 5)]
    assert "n" not in got and profile.examples(df.limit(0), ["a"]).count() == 0
