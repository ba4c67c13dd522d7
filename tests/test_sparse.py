"""One-hot places and feature vectors without a column per level."""

import math
import random

import pytest

from riskset.operators import prepare, select


def test_many_levels_encode(spark):
    """15,000 levels in one of two columns; binary columns drop their first level; unknown levels have no place."""
    rows = [(i, f"L{i % 15000}é", "ab"[i % 2], None if i % 5 else "x") for i in range(15500)]
    df = spark.createDataFrame(rows, "id long, big string, two string, one string").repartition(4)
    cols = ["big", "two", "one"]
    dictionary = prepare.level_dictionary(df, cols, drop="if_binary")
    known = {(r["column"], r["level"]): r["index"] for r in dictionary.collect()}
    levels = sorted({r[1] for r in rows})
    want = {("big", v): i for i, v in enumerate(levels)} | {("two", "b"): 15000, ("one", "x"): 15001}
    assert known == want and dictionary.first()["size"] == 15002
    new = df.union(spark.createDataFrame([(-1, "never", "zz", "x"), (-2, None, None, None)], df.schema))
    got = {r["id"]: r["places"] for r in prepare.one_hot_sparse(new, dictionary, cols).collect()}
    for i, *own in rows:
        assert got[i] == sorted(want[c, v] for c, v in zip(cols, own, strict=True) if (c, v) in want)
    assert got[-1] == [15001] and got[-2] == []
    with pytest.raises(ValueError, match="big has 15000 levels"):
        prepare.fit_levels(df, ["two", "big"])


def test_short_and_empty_levels_keep_their_order(spark):
    levels = ["", "a", "a\x00", "a ", "aa", "b", "é", "\x00", "zz", "z"]
    df = spark.createDataFrame([(v,) for v in levels], "v string")
    got = sorted((r["index"], r["level"]) for r in prepare.level_dictionary(df, ["v"]).collect())
    assert [v for _, v in got] == sorted(levels, key=str.encode)
    assert prepare.level_dictionary(df.limit(0), ["v"]).count() == 0


def test_vectors_of_many_features(spark):
    """10,000 features: each vector holds the subject's cells at the features' numbers, NaN elsewhere."""
    rng = random.Random(6)
    cells = {(s, f"g{rng.randrange(10000)}"): rng.random() for s in range(4) for _ in range(600)}
    extra = [(9, f"g{i}", 1.0) for i in range(10000)]
    long = spark.createDataFrame([(s, f, v) for (s, f), v in cells.items()] + extra + [(8, "g1", None), (9, "g1", 0.5)],
                                 "id long, feature string, value double").repartition(5)
    vectors, numbers = select.feature_vectors(long, long.select("feature"), "id")
    at = {r["feature"]: r["index"] for r in numbers.collect()}
    assert [f for f, _ in sorted(at.items(), key=lambda x: x[1])] == sorted({f for f, *_ in ((r[1],) for r in extra)})
    got = {r["id"]: r["features"].toArray() for r in vectors.collect()}
    assert set(got) == {0, 1, 2, 3, 9} and all(len(v) == 10000 for v in got.values())
    for (s, f), v in cells.items():
        assert got[s][at[f]] == v
    assert got[9][at["g1"]] == 0.5
    assert sum(not math.isnan(x) for x in got[2]) == sum(s == 2 for s, _ in cells)


def test_vectors_equal_the_wide_table(spark):
    long = spark.createDataFrame([(s, f"f{i}", float(s * 10 + i)) for s in range(5) for i in range(6) if (s + i) % 4],
                                 "id long, feature string, value double")
    chosen = spark.createDataFrame([("f1",), ("f4",), ("f5",)], "feature string")
    wide = {r["id"]: r[1:] for r in select.assemble_wide(long, chosen, "id").select("id", "f_f1", "f_f4", "f_f5").collect()}
    vectors, _ = select.feature_vectors(long, chosen, "id")
    got = {r["id"]: [None if math.isnan(x) else x for x in r["features"].toArray()] for r in vectors.collect()}
    assert got == {k: list(v) for k, v in wide.items()}
