"""Preparation estimators with a fit / transform split.

``fit_*`` runs one aggregate job and returns a small parameter table
(``Params``: column, step, param, value) that can be stored, inspected and
applied to any other DataFrame (train-only fitting, serving). ``transform``
is a single narrow ``select`` - no shuffle, no Python on rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskset.operators import gram, selection
from riskset.operators.prefix import BROADCAST_ROW_LIMIT, keys_bounded
from riskset.session import materialize


@dataclass
class Params:
    """Fitted parameters: rows of (column, step, param, value)."""
    rows: list[tuple[str, str, str, object]] = field(default_factory=list)

    def get(self, column: str, step: str, param: str, default=None):
        for c, s, p, v in self.rows:
            if c == column and s == step and p == param:
                return v
        return default

    def levels(self, column: str, step: str) -> list:
        return [v for c, s, p, v in self.rows if c == column and s == step and p == "level"]

    def merge(self, other: "Params") -> "Params":
        return Params(self.rows + other.rows)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, s, p, None if v is None else str(v)) for c, s, p, v in self.rows],
                                     "column string, step string, param string, value string")

    @staticmethod
    def from_frame(df: DataFrame) -> "Params":
        rows = []
        for r in df.collect():
            v = r["value"]
            if r["param"] in ("mean", "sd", "median", "fill") and v is not None:
                try:
                    v = float(v)
                except ValueError:
                    pass
            rows.append((r["column"], r["step"], r["param"], v))
        return Params(rows)


MAX_LEVELS = 10000   # wide one-hot columns per input column
ROUNDING = 1e-13     # relative to the mean: below it a spread is a rounding error


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# ------------------------------------------------------------------ E1, E2

def log1p_columns(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """log(1 + x) on skewed columns (in place, or as ``col+suffix``)."""
    out = [F.log1p(_c(c).cast("double")).alias(c + suffix) for c in cols]
    keep = [_c(c) for c in df.columns if suffix or c not in cols]
    return df.select(*keep, *out)


def binarise(col: str, null_as: int | None = None) -> Column:
    """E2: '0' -> 0, anything else -> 1, compared as text.

    ``null_as=None`` keeps nulls null; ``null_as=1`` reproduces the
    reference, whose lambda maps a missing cell to 1.
    """
    c = _c(col).cast("string")
    expr = F.when(c.isNull(), F.lit(null_as).cast("int")).when(c == "0", F.lit(0)).otherwise(F.lit(1))
    return expr.alias(col)


def binarise_columns(df: DataFrame, cols: Sequence[str], null_as: int | None = None) -> DataFrame:
    """E2 over many columns in one ``select``."""
    cset = set(cols)
    return df.select(*[binarise(c, null_as) if c in cset else _c(c) for c in df.columns])


# ------------------------------------------------------------------ E3, E4

def fit_median(df: DataFrame, cols: Sequence[str]) -> Params:
    """E3 fit: exact medians (interpolated) by distributed selection."""
    return Params([(x["column"], "impute", "fill", x["quantiles"][0.5]) for x in selection.summaries(df, cols, [0.5])])


def fit_mode(df: DataFrame, cols: Sequence[str]) -> Params:
    """E4 fit: most frequent value; ties go to the smallest value.

    (column, value) counts are partial-aggregated, then one row per column
    is kept by ``min_by`` over (-count, value) - no group is ever buffered.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value"))
                                         for c in cols])).alias("_p")).select("_p.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v"))).alias("mode"))
    return Params([(r["column"], "impute", "fill", r["mode"]) for r in best.collect()])


def mode_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, mode, n) as a DataFrame; same rule as :func:`fit_mode`."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value"))
                                         for c in cols])).alias("_p")).select("_p.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v")))
        .alias("_m")).select("column", F.col("_m.value").alias("mode"), F.col("_m.n").alias("n"))


def impute(df: DataFrame, params: Params) -> DataFrame:
    """Apply E3/E4 fills with ``coalesce`` (types of the input are kept)."""
    fills = {c: v for c, s, p, v in params.rows if s == "impute" and p == "fill"}
    types = dict(df.dtypes)
    cols = []
    for c in df.columns:
        if c in fills and fills[c] is not None:
            cols.append(F.coalesce(_c(c), F.lit(fills[c]).cast(types[c])).alias(c))
        else:
            cols.append(_c(c))
    return df.select(*cols)


# ------------------------------------------------------------------ E5, E11

def fit_scaler(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> Params:
    """E5/E11 fit: mean and sd (population for ddof=0, sample for ddof=1), one
    scan with the same plan for any number of columns."""
    rows = []
    for c, (n, mean, m2) in zip(cols, gram.moments(df, cols), strict=True):
        rows += [(c, "scale", "mean", mean), (c, "scale", "sd", math.sqrt(m2 / (n - ddof)) if n > ddof else None)]
    return Params(rows)


def scale(df: DataFrame, params: Params, suffix: str = "") -> DataFrame:
    """(x - mean) / sd with a zero (or undefined) sd treated as 1. An sd within
    the mean's rounding error is that of a constant column: zero."""
    cols = {c for c, s, _, _ in params.rows if s == "scale"}
    out = []
    for c in df.columns:
        if c in cols:
            mean = params.get(c, "scale", "mean")
            sd = params.get(c, "scale", "sd")
            sd = 1.0 if sd is None or sd <= ROUNDING * abs(mean) else sd
            expr = ((_c(c).cast("double") - F.lit(mean)) / F.lit(sd)).alias(c + suffix)
            out.append(expr)
            if suffix:
                out.append(_c(c))
        else:
            out.append(_c(c))
    return df.select(*out)


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> DataFrame:
    """E5: fit on ``df`` and apply in one call (use fit/scale to split)."""
    return scale(df, fit_scaler(df, cols, ddof))


def fill_with_means(profiles: DataFrame, params: Params, cols: Sequence[str]) -> DataFrame:
    """Fill unspecified profile features with the training means."""
    out = []
    for c in profiles.columns:
        if c in cols:
            out.append(F.coalesce(_c(c).cast("double"), F.lit(params.get(c, "scale", "mean"))).alias(c))
        else:
            out.append(_c(c))
    return profiles.select(*out)


# ------------------------------------------------------------------ E6-E8

def ordinal_encode(col: str, categories: Sequence[str], strict: bool = True) -> Column:
    """Position of the value in a fixed category order (0-based).

    ``strict`` raises on a value outside the list (the reference's default
    'error' behaviour) through ``raise_error`` inside the plan.
    """
    cats = F.array(*[F.lit(c) for c in categories])
    pos = F.array_position(cats, _c(col).cast("string"))
    if strict:
        return F.when(_c(col).isNull(), F.lit(None).cast("double")).when(
            pos > 0, (pos - 1).cast("double")).otherwise(
            F.raise_error(F.concat(F.lit(f"unknown category in {col}: "), _c(col).cast("string")))
            .cast("double")).alias(col)
    return F.when(pos > 0, (pos - 1).cast("double")).alias(col)


def level_dictionary(df: DataFrame, cols: Sequence[str], drop: str | None = None) -> DataFrame:
    """E7/E8 fit: (column, level, index, size), a row per level that gets a place.

    Places are numbered from 0 over all columns, in the order of ``cols`` and
    then of the level; ``size`` is their number. ``drop='if_binary'`` gives the
    first level of a two-level column no place (its rows are all zeros).
    Levels stay in a table: a column's levels are numbered inside the ranges of
    their first two bytes, so no task orders all of them and none come to the
    driver, but for one count a column and range.
    """
    names = {c: i for i, c in enumerate(cols)}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), _c(c).cast("string").alias("level"))
                                         for c, i in names.items()])).alias("_p")).select("_p.*").where(F.col("level").isNotNull())
    head = F.conv(F.hex(F.substring(F.encode("level", "UTF-8"), 1, 2)), 16, 10).cast("int")
    short = F.length(F.encode("level", "UTF-8")) < 2               # of one byte: before all that begin with it
    part = F.coalesce(F.when(short, head * 256).otherwise(head), F.lit(-1))
    levels = materialize(long.distinct().withColumn("part", part))
    ranges = sorted(tuple(r) for r in levels.groupBy("at", "part").agg(F.count(F.lit(1))).collect())
    sizes: dict[int, int] = {}
    for at, _, n in ranges:
        sizes[at] = sizes.get(at, 0) + n
    starts, base, total = [], {}, 0
    for at, n in sorted(sizes.items()):
        skipped = int(drop == "if_binary" and n == 2)
        base[at], place = total, total - skipped
        for own, count in ((p, k) for a, p, k in ranges if a == at):
            starts.append((at, own, place, base[at]))
            place += count
        total += n - skipped
    side = df.sparkSession.createDataFrame(starts, "at int, part int, start long, base long")
    order = Window.partitionBy("at", "part").orderBy("level")
    numbered = levels.join(F.broadcast(side), ["at", "part"]).withColumn(
        "index", F.col("start") + F.row_number().over(order) - 1).where(F.col("index") >= F.col("base"))
    column = F.create_map(*[x for c, i in names.items() for x in (F.lit(i), F.lit(c))])[F.col("at")]
    return numbered.select(column.alias("column"), "level", F.col("index").cast("int").alias("index"), F.lit(total).alias("size"))


def one_hot_sparse(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], out: str = "places") -> DataFrame:
    """E7/E8 for any number of levels: the places of a row's ones, ascending, as an array.

    Each column's levels are joined to its part of the dictionary (a broadcast
    if it is counted to be small); unknown, dropped and null levels have no place.
    """
    dictionary = materialize(dictionary)
    got = df
    for i, c in enumerate(cols):
        own = dictionary.where(F.col("column") == c).select(F.col("level").alias(f"_l{i}"), F.col("index").alias(f"_i{i}"))
        own = F.broadcast(own) if keys_bounded(own, [f"_l{i}"], BROADCAST_ROW_LIMIT) else own
        got = got.join(own, _c(c).cast("string") == F.col(f"_l{i}"), "left")
    places = F.array_sort(F.array_compact(F.array(*[F.col(f"_i{i}") for i in range(len(cols))])))
    return got.select(*[_c(c) for c in df.columns if c not in cols], places.alias(out))


def fit_levels(df: DataFrame, cols: Sequence[str]) -> Params:
    """Levels per column, ascending, for wide one-hot columns. A column with more
    than ``MAX_LEVELS`` is refused by name (encode it by :func:`one_hot_sparse`)."""
    dictionary = materialize(level_dictionary(df, cols))
    for r in dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect():
        if r["n"] > MAX_LEVELS:
            raise ValueError(f"{r['column']} has {r['n']} levels: more than {MAX_LEVELS} columns, use one_hot_sparse")
    rows = sorted((r["column"], r["level"]) for r in dictionary.select("column", "level").collect())
    return Params([(c, "onehot", "level", lv) for c, lv in rows])


def one_hot(df: DataFrame, params: Params, cols: Sequence[str], drop: str | None = None) -> DataFrame:
    """One 0/1 double column per level named ``<col>_<level>``.

    ``drop='if_binary'`` drops the first level of two-level columns (E7);
    ``None`` keeps all levels (E8). Unknown or null values give all zeros.
    """
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(_c(c))
            continue
        levels = params.levels(c, "onehot")
        if drop == "if_binary" and len(levels) == 2:
            levels = levels[1:]
        for lv in levels:
            out.append(F.when(_c(c).cast("string") == F.lit(lv), 1.0).otherwise(0.0).alias(f"{c}_{lv}"))
    return df.select(*out)


# ------------------------------------------------------------------ E9

@dataclass
class ColumnPlan:
    """Which columns get which treatment, and how unlisted ones pass."""
    median_scale: Sequence[str] = ()
    ordinal: Mapping[str, Sequence[str]] = field(default_factory=dict)
    onehot_if_binary: Sequence[str] = ()
    onehot_all: Sequence[str] = ()
    passthrough: Sequence[str] = ()


def fit_columns(df: DataFrame, plan: ColumnPlan) -> Params:
    """Fit every step of the plan: medians, modes, scaler, levels.

    Only the plan's columns are read; a derived input is kept while its scans
    last. The scaler's mean and spread after imputation follow from the moments
    of the present values and the number of filled ones, without another scan.
    """
    cat = list(plan.ordinal) + list(plan.onehot_if_binary) + list(plan.onehot_all)
    with selection.reused(df.select(*[_c(c) for c in dict.fromkeys([*plan.median_scale, *cat])])) as own:
        params = Params()
        if plan.median_scale:
            rows = own.count()
            for x in selection.summaries(own, plan.median_scale, [0.5]):
                fill, n, missing = x["quantiles"][0.5], x["n"], rows - x["n"]
                mean = (x["mean"] * n + fill * missing) / (n + missing)
                m2 = x["m2"] + n * (x["mean"] - mean) ** 2 + missing * (fill - mean) ** 2
                params.rows += [(x["column"], "impute", "fill", fill), (x["column"], "scale", "mean", mean),
                                (x["column"], "scale", "sd", math.sqrt(m2 / (n + missing)))]
        if cat:
            params = params.merge(fit_mode(own, cat))
        if plan.onehot_if_binary or plan.onehot_all:
            params = params.merge(fit_levels(own, list(plan.onehot_if_binary) + list(plan.onehot_all)))
    return params


def transform_columns(df: DataFrame, plan: ColumnPlan, params: Params) -> DataFrame:
    """Apply a fitted plan in one projection; unlisted columns are dropped
    unless named in ``passthrough`` (the reference's ColumnTransformer)."""
    filled = impute(df, params)
    scaled = scale(filled, Params([r for r in params.rows if r[1] == "scale"]))
    cols = []
    for c in plan.median_scale:
        cols.append(_c(c))
    for c, cats in plan.ordinal.items():
        cols.append(ordinal_encode(c, cats, strict=True))
    staged = scaled.select(*cols, *[_c(c) for c in list(plan.onehot_if_binary) + list(plan.onehot_all)],
                           *[_c(c) for c in plan.passthrough])
    staged = one_hot(staged, params, list(plan.onehot_if_binary), drop="if_binary")
    staged = one_hot(staged, params, list(plan.onehot_all), drop=None)
    return staged


def verify_no_missing(df: DataFrame) -> DataFrame:
    """E9 verification: total null cells after transform (expected 0)."""
    return df.agg(sum((F.sum(_c(c).isNull().cast("long")) for c in df.columns), F.lit(0)).alias("n_missing"))
