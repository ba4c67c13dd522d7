"""Cohort profiling (A1-A23): shapes, types, summaries, quantiles, outliers,
missingness, correlations, counts and histograms.

Statistics of many columns come from scans over Arrow batches whose plans do
not grow with the number of columns: exact quantiles and moments by distributed
selection (:mod:`riskset.operators.selection`), correlations and null counts by
matrix sums (:mod:`riskset.operators.gram`). Groups too many for the driver
(``selection.GROUP_LIMIT``) are counted in long form instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskset.functions.stats import chi2_sf_col, round_half_up_col
from riskset.operators import gram, selection
from riskset.operators.prefix import attach_one_row, quantile_columns
from riskset.session import materialize

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def melt(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), value_type: str = "double",
         name: str = "column", value: str = "value") -> DataFrame:
    """Wide -> long: (keys..., column, value), one row per cell."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), _c(c).cast(value_type).alias(value)) for c in cols])
    return df.select(*[_c(k) for k in keys], F.explode(pairs).alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")


def shape(df: DataFrame) -> DataFrame:
    """A1: (n_rows, n_columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"))


def column_info(df: DataFrame) -> DataFrame:
    """A2: (column, dtype, non_null) from one scan of null flags."""
    rows, nulls = gram.null_counts(df, df.columns)
    return df.sparkSession.createDataFrame([(c, t, rows - n) for (c, t), n in zip(df.dtypes, nulls, strict=True)],
                                           "column string, dtype string, non_null long")


def _spread(own: dict) -> float | None:
    return math.sqrt(own["m2"] / (own["n"] - 1)) if own["n"] > 1 else None


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A3/A4: n, mean, sd (sample), min, q1, median, q3, max per column
    (and per group). Quantiles are exact (linear interpolation); columns
    without a value, and null groups, have no row."""
    keys = list(by)
    found = selection.summaries(df, cols, list(QUARTILES.values()), keys)
    if found is None:
        return _describe_long(df, cols, keys)
    rows = [(*x["key"], x["column"], x["n"], x["mean"], _spread(x), x["min"],
             *(x["quantiles"][p] for p in QUARTILES.values()), x["max"]) for x in found]
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys] + [
        T.StructField("column", T.StringType()), T.StructField("n", T.LongType()),
        *(T.StructField(c, T.DoubleType()) for c in ("mean", "sd", "min", *QUARTILES, "max"))]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def _describe_long(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """:func:`describe` for groups too many for the driver."""
    long = melt(df, cols, keys).where(F.col("value").isNotNull() & ~F.isnan("value"))
    for k in keys:
        long = long.where(F.col(k).isNotNull())
    stats = long.groupBy(*keys, "column").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    qs = quantile_columns(long, [*keys, "column"], "value", QUARTILES)
    return stats.join(qs, [*keys, "column"]).select(
        *keys, "column", "n", "mean", "sd", "min", "q1", "median", "q3", "max")


def examples(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """A5: type and up to ``k`` example values per column (smallest distinct
    values as text, so the choice is deterministic).

    A task keeps the ``k`` smallest distinct texts it has seen of each column
    and sends on those only; one merge a column takes the smallest of them.
    """
    cols = list(cols)
    types = dict(df.dtypes)
    schema = pa.schema([("at", pa.int32()), ("value", pa.string())])

    def smallest(values: pa.Array) -> pa.Array:
        own = pc.drop_null(values).unique()
        return own.take(pc.array_sort_indices(own)[:k])         # UTF-8 byte order, as Spark sorts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.array([], pa.string())] * len(cols)
        for batch in batches:
            for i in range(len(cols)):
                held[i] = smallest(pa.concat_arrays([held[i], batch.column(i).cast(pa.string())]))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, h in enumerate(held) for _ in h], pa.int32()), pa.concat_arrays(held)],
                                         schema=schema)

    def merge(table: pa.Table) -> pa.Table:
        own = smallest(table["value"].combine_chunks())
        i, n = table["at"][0].as_py(), len(own)
        return pa.table([pa.array([cols[i]] * n, pa.string()), pa.array([types[cols[i]]] * n, pa.string()),
                         pa.array(range(1, n + 1), pa.int32()), own], names=["column", "dtype", "rank", "value"])

    texts = df.select(*[_c(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    return texts.mapInArrow(run, "at int, value string").groupBy("at").applyInArrow(
        merge, "column string, dtype string, rank int, value string")


def event_summary(cohort: DataFrame, duration: str = "duration", event: str = "event") -> DataFrame:
    """Event / censor counts and shares, median and max follow-up."""
    e = F.col(event).cast("long")
    base = cohort.where(F.col(duration).isNotNull() & F.col(event).isNotNull())
    counts = base.agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("n_event"),
                      F.max(F.col(duration).cast("double")).alias("max_follow_up"))
    found = selection.summaries(base, [duration], [0.5])
    median = F.lit(found[0]["quantiles"][0.5] if found else None).cast("double")
    return counts.select(
        "n", "n_event", (F.col("n") - F.col("n_event")).alias("n_censor"),
        F.try_divide(100.0 * F.col("n_event"), F.col("n")).alias("pct_event"),
        F.try_divide(100.0 * (F.col("n") - F.col("n_event")), F.col("n")).alias("pct_censor"),
        median.alias("median_follow_up"), "max_follow_up")


def iqr_fence(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> DataFrame:
    """(column, q1, q3, iqr, upper_fence = q3 + k*iqr, lower_fence)."""
    rows = [(x["column"], x["quantiles"][0.25], x["quantiles"][0.75]) for x in selection.summaries(df, cols, [0.25, 0.75])]
    q = df.sparkSession.createDataFrame(rows, "column string, q1 double, q3 double")
    iqr = F.col("q3") - F.col("q1")
    return q.select("column", "q1", "q3", iqr.alias("iqr"), (F.col("q3") + k * iqr).alias("upper_fence"),
                    (F.col("q1") - k * iqr).alias("lower_fence"))


def outlier_counts(df: DataFrame, rules: Mapping[str, Column],
                   thresholds: Mapping[str, Column | str] | None = None) -> DataFrame:
    """(rule, n_outliers, pct, threshold) with all rows as denominator
    (a null value is not an outlier but still counts in the total).
    ``thresholds`` are report texts (literal or computed, e.g. a fence)."""
    thresholds = dict(thresholds or {})
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.sum(F.coalesce(pred, F.lit(False)).cast("long")).alias(f"_o{i}") for i, pred in enumerate(rules.values())]
    aggs += [F.first(F.lit(t) if isinstance(t, str) else t).cast("string").alias(f"_t{i}")
             for i, t in enumerate(thresholds.get(n) for n in rules) if t is not None]
    wide = df.agg(*aggs)
    has = [thresholds.get(n) is not None for n in rules]
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_o{i}").alias("n_outliers"),
                              (F.col(f"_t{i}") if has[i] else F.lit(None).cast("string")).alias("threshold"))
                     for i, name in enumerate(rules)])
    return wide.select("_n", F.inline(rows)).select(
        "rule", "n_outliers", (100.0 * F.col("n_outliers") / F.col("_n")).alias("pct"), "threshold")


def variable_summary(df: DataFrame, specs: Sequence[tuple[str, str, Column | None, Column | str | None]]) -> DataFrame:
    """One row per variable: N, mean +/- sd, median (q1 - q3), range and
    outliers, as numbers and as report text.

    ``specs``: (column, label, outlier predicate or None, threshold text).
    """
    cols = [s[0] for s in specs]
    desc = describe(df, cols)
    rules = {s[0]: s[2] for s in specs if s[2] is not None}
    thresholds = {s[0]: s[3] for s in specs if s[2] is not None and s[3] is not None}
    labels = F.create_map(*[x for s in specs for x in (F.lit(s[0]), F.lit(s[1]))])
    if rules:
        res = desc.join(outlier_counts(df, rules, thresholds).withColumnRenamed("rule", "column"), "column", "left")
    else:
        res = desc.select("*", F.lit(None).cast("long").alias("n_outliers"), F.lit(None).cast("double").alias("pct"),
                          F.lit(None).cast("string").alias("threshold"))
    outl = F.when(F.col("n_outliers").isNull(), F.lit("-")).otherwise(
        F.concat(F.format_string("%d (%.1f%%)", F.col("n_outliers"), F.col("pct")),
                 F.when(F.col("threshold").isNotNull(), F.concat(F.lit(" > "), F.col("threshold")))
                 .otherwise(F.lit(""))))
    return res.select(
        "column", labels[F.col("column")].alias("variable"), "n", "mean", "sd", "median", "q1", "q3", "min", "max",
        "n_outliers",
        F.format_string("%.2f ± %.2f", F.col("mean"), F.col("sd")).alias("mean_sd"),
        F.format_string("%.2f (%.2f - %.2f)", F.col("median"), F.col("q1"), F.col("q3")).alias("median_iqr"),
        F.format_string("%.1f - %.1f", F.col("min"), F.col("max")).alias("range"),
        outl.alias("outliers"))


def missingness(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True) -> DataFrame:
    """A10: (column, n_missing, pct_missing), only columns with missing values,
    sorted by count (descending) then name."""
    cols = list(cols or df.columns)
    n, nulls = gram.null_counts(df, cols)
    rows = [(c, k, 100.0 * k / n if n else None) for c, k in zip(cols, nulls, strict=True) if k or not only_missing]
    out = df.sparkSession.createDataFrame(rows, "column string, n_missing long, pct_missing double")
    return out.orderBy(F.desc("n_missing"), "column")


def total_missing(df: DataFrame) -> DataFrame:
    """Total number of missing cells."""
    return df.sparkSession.createDataFrame([(sum(gram.null_counts(df, df.columns)[1]),)], "n_missing_cells long")


def missing_by_group(df: DataFrame, col: str, group: str) -> DataFrame:
    """Missing rate of ``col`` per group plus a chi-square test of
    independence on the (group x missing) table (SURVEY D11)."""
    base = df.where(_c(group).isNotNull()).select(_c(group).alias("group"), _c(col).isNull().cast("long").alias("m"))
    per = base.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("n_missing"))
    # Totals come from the per-group rows; a margin of 0 leaves the test undefined.
    per = materialize(per)
    tot = per.agg(F.sum("n").alias("_tn"), F.sum("n_missing").alias("_tm"), F.count(F.lit(1)).alias("_g"))
    exp_m = F.col("n") * F.col("_tm") / F.col("_tn")
    exp_p = F.col("n") * (F.col("_tn") - F.col("_tm")) / F.col("_tn")
    cell = F.try_divide((F.col("n_missing") - exp_m) ** 2, exp_m) + F.try_divide(
        ((F.col("n") - F.col("n_missing")) - exp_p) ** 2, exp_p)
    chi = attach_one_row(per, attach_one_row(per, tot).agg(F.sum(cell).alias("chi2"), F.first("_g").alias("_g")))
    return chi.select("group", "n", "n_missing", (100.0 * F.col("n_missing") / F.col("n")).alias("pct_missing"),
                      "chi2", (F.col("_g") - 1).cast("int").alias("dof"),
                      chi2_sf_col(F.col("chi2"), (F.col("_g") - 1).cast("int")).alias("p_value"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_a, col_b, corr), Pearson's r of every pair over pairwise-complete
    rows; null for fewer than two rows or a constant column."""
    return gram.correlation_rows(df, cols)


def group_mean(df: DataFrame, by: str, col: str, digits: int = 2) -> DataFrame:
    """Mean per group, rounded; null keys dropped (pandas default)."""
    return df.where(_c(by).isNotNull()).groupBy(_c(by).alias(by)).agg(
        round_half_up_col(F.avg(_c(col)), digits).alias(f"mean_{col}"))


def group_median(df: DataFrame, by: str, col: str, digits: int = 2) -> DataFrame:
    """Exact median per group, rounded."""
    found = selection.summaries(df, [col], [0.5], [by])
    if found is None:
        q = quantile_columns(df.where(_c(by).isNotNull()), [by], col, {"median": 0.5})
    else:
        fields = [T.StructField(by, df.schema[by].dataType), T.StructField("median", T.DoubleType())]
        q = df.sparkSession.createDataFrame([(x["key"][0], x["quantiles"][0.5]) for x in found], T.StructType(fields))
    return q.select(by, round_half_up_col(F.col("median"), digits).alias(f"median_{col}"))


def value_counts(df: DataFrame, col: str, by_key: bool = False) -> DataFrame:
    """(value, n, share) with nulls excluded; order by count or key."""
    counts = df.where(_c(col).isNotNull()).groupBy(_c(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    out = attach_one_row(counts, total).select("value", "n", (100.0 * F.col("n") / F.col("_total")).alias("pct"))
    return out.orderBy("value") if by_key else out.orderBy(F.desc("n"), "value")


def histogram(df: DataFrame, col: str, bins: int = 30, label: str | None = None) -> DataFrame:
    """Equal-width histogram; the last bin is right-closed; empty bins
    are kept with a zero count. (series, bin, lo, hi, n)"""
    x = _c(col).cast("double")
    base = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    rng = base.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counted = attach_one_row(base, rng).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counted, "bin", "left").select(
        F.lit(label or col).alias("series"), "bin", (F.col("lo") + F.col("bin") * w).alias("lo"),
        (F.col("lo") + (F.col("bin") + 1) * w).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def skewness_table(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """(series, skewness) - Spark's population skewness g1 per named column."""
    aggs = [F.skewness(c).alias(f"_s{i}") for i, c in enumerate(cols.values())]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("series"), F.col(f"_s{i}").alias("skewness")) for i, n in enumerate(cols)])
    return wide.select(F.inline(rows))


def before_after(df: DataFrame, col: str, transformed: Column, bins: int = 30) -> DataFrame:
    """Histograms of a column before and after a transform, with skewness."""
    t = df.select(_c(col).cast("double").alias("before"), transformed.alias("after"))
    hist = histogram(t, "before", bins, "before").unionByName(histogram(t, "after", bins, "after"))
    sk = skewness_table(t, {"before": F.col("before"), "after": F.col("after")})
    return hist.join(F.broadcast(sk), "series")


def block_summary(df: DataFrame, blocks: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per block: n_columns, n_cells, n_missing; plus a 'Total' row (rollup)."""
    long = to_long(df, blocks)
    per = long.rollup("block").agg(
        F.countDistinct("feature").alias("n_columns"), F.count(F.lit(1)).alias("n_cells"),
        F.sum(F.col("value").isNull().cast("long")).alias("n_missing"))
    return per.select(F.coalesce("block", F.lit("Total")).alias("block"), "n_columns", "n_cells", "n_missing")


def to_long(df: DataFrame, blocks: Mapping[str, Sequence[str]], id_col: str | None = None,
            suffix_block: tuple[str, str] | None = None, rest_block: str | None = None) -> DataFrame:
    """Block-labelled wide-to-long reshape (id, block, feature, value).

    Blocks are explicit lists; ``suffix_block=(name, suffix)`` collects
    columns by name suffix and ``rest_block`` takes everything left over.
    Values are cast to double. Raises if a column lands in two blocks.
    """
    assigned: dict[str, str] = {}
    for b, cols in blocks.items():
        for c in cols:
            if c in assigned:
                raise ValueError(f"column {c} in blocks {assigned[c]} and {b}")
            assigned[c] = b
    others = [c for c in df.columns if c not in assigned and c != id_col]
    if suffix_block:
        for c in others:
            if c.endswith(suffix_block[1]):
                assigned[c] = suffix_block[0]
    if rest_block:
        for c in others:
            if c not in assigned:
                assigned[c] = rest_block
    order = [c for c in df.columns if c in assigned]
    pairs = F.array(*[F.struct(F.lit(assigned[c]).alias("block"), F.lit(c).alias("feature"),
                               _c(c).cast("double").alias("value")) for c in order])
    keep = [_c(id_col)] if id_col else []
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*( [id_col] if id_col else []), "_p.*")


def class_balance(df: DataFrame, label: str, names: Mapping[int, str] | None = None) -> DataFrame:
    """(label, name, n, pct, positive_rate); names attached by value."""
    names = names or {0: "negative", 1: "positive"}
    nmap = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    counts = df.where(_c(label).isNotNull()).groupBy(_c(label).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    tot = counts.agg(F.sum("n").alias("_t"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("_p"))
    return attach_one_row(counts, tot).select(
        "label", nmap[F.col("label")].alias("name"), "n", (100.0 * F.col("n") / F.col("_t")).alias("pct"),
        (F.col("_p") / F.col("_t")).alias("positive_rate"))


def split_summary(df: DataFrame, split: str, label: str) -> DataFrame:
    """Per split: n, positives, negatives, positive rate."""
    y = _c(label).cast("long")
    return df.groupBy(_c(split).alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_positive"), F.sum(1 - y).alias("n_negative"),
        F.avg(y.cast("double")).alias("positive_rate"))


