"""Kaplan-Meier curves, confidence bands, medians and log-rank tests.

Canonical input: a cohort DataFrame with a duration column, a 0/1 event
column and optional stratum columns, one row per subject. All curves of all
strata come out of one job: rows are reduced to (stratum, t) counts first,
then at-risk counts and products are running sums over t
(:func:`riskset.operators.prefix.running_sums`), which split a large stratum
into time buckets instead of ordering it in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskset.functions.stats import Z95, chi2_sf_col
from riskset.operators import logrank_sparse
from riskset.operators.prefix import BROADCAST_ROW_LIMIT, assign_buckets, default_buckets, keys_bounded, running_sums
from riskset.session import materialize

BLOCK_CELLS = 1 << 21  # cells of a time x level block in a task's memory
DENSE_LEVELS = 512     # more levels of a variable are tested without a level x level matrix


def _strata(strata: str | Sequence[str] | None) -> list[str]:
    if strata is None:
        return []
    return [strata] if isinstance(strata, str) else list(strata)


def event_table(cohort: DataFrame, duration: str = "duration", event: str = "event",
                strata: str | Sequence[str] | None = None) -> DataFrame:
    """(strata..., t, n_at_risk, n_event, n_censor) at each distinct time.

    Subjects with a null duration, event or stratum are left out (the app's
    equality masks, SURVEY D5).
    """
    keys = _strata(strata)
    rows = cohort.select(*keys, F.col(duration).cast("double").alias("t"),
                         F.col(event).cast("int").alias("_e"))
    cond = F.col("t").isNotNull() & F.col("_e").isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    per_t = rows.where(cond).groupBy(*keys, "t").agg(
        F.sum("_e").cast("long").alias("n_event"), F.count(F.lit(1)).alias("_m"))
    at_risk = running_sums(per_t, keys, "t", {"n_at_risk": "_m"}, reverse=True, few_keys=True)
    return at_risk.select(*keys, "t", "n_at_risk", "n_event",
                          (F.col("_m") - F.col("n_event")).alias("n_censor"))


def kaplan_meier(cohort: DataFrame, duration: str = "duration", event: str = "event",
                 strata: str | Sequence[str] | None = None, z: float = Z95) -> DataFrame:
    """Product-limit survival with Greenwood variance and log-log band.

    Returns (strata..., t, n_at_risk, n_event, n_censor, survival, ci_low,
    ci_high); the curve equals 1 before the first row. The band is
    exp(-exp(log(-log S) -/+ z sqrt(V) / log S)) and null where S is 0 or 1.
    """
    keys = _strata(strata)
    ev = event_table(cohort, duration, event, keys)
    n = F.col("n_at_risk").cast("double")
    d = F.col("n_event").cast("double")
    alive = d < n
    terms = ev.select(
        "*",
        F.when(alive, F.log1p(-d / n)).otherwise(F.lit(0.0)).alias("_log"),
        F.when(alive, d / (n * (n - d))).otherwise(F.lit(0.0)).alias("_gw"),
        F.when(alive, F.lit(0)).otherwise(F.lit(1)).alias("_zero"))
    acc = running_sums(terms, keys, "t", {"_cum_log": "_log", "_cum_gw": "_gw", "_cum_zero": "_zero"},
                       few_keys=True)
    return acc.select(*keys, "t", "n_at_risk", "n_event", "n_censor",
                      *survival_band(F.col("_cum_log"), F.col("_cum_gw"), F.col("_cum_zero"), z))


def survival_band(cum_log: Column, cum_gw: Column, cum_zero: Column, z: float = Z95) -> list[Column]:
    """survival, ci_low, ci_high from running log-survival and Greenwood sums."""
    surv = F.when(cum_zero > 0, F.lit(0.0)).otherwise(F.exp(cum_log))
    inner = (cum_zero == 0) & (cum_log < 0)
    shift = F.lit(z) * F.sqrt(cum_gw) / cum_log          # negative when defined
    lo = F.exp(-F.exp(F.log(-cum_log) - shift))
    hi = F.exp(-F.exp(F.log(-cum_log) + shift))
    return [surv.alias("survival"),
            F.when(inner, lo).alias("ci_low"),
            F.when(inner, hi).alias("ci_high")]


def survival_quantile(km: DataFrame, strata: str | Sequence[str] | None = None,
                      q: float = 0.5, out: str = "median_t") -> DataFrame:
    """First time where the curve falls to ``q`` or below; null if never."""
    keys = _strata(strata)
    agg = F.min(F.when(F.col("survival") <= q, F.col("t"))).alias(out)
    return km.groupBy(*keys).agg(agg) if keys else km.agg(agg)


def median_survival(km: DataFrame, strata: str | Sequence[str] | None = None,
                    time_per_year: float = 365.25) -> DataFrame:
    """Median survival time and the same value in years (K4)."""
    keys = _strata(strata)
    med = survival_quantile(km, keys, 0.5, "median_t")
    return med.select(*keys, "median_t", (F.col("median_t") / time_per_year).alias("median_years"))


def group_counts(cohort: DataFrame, duration: str = "duration", event: str = "event",
                 strata: str | Sequence[str] | None = None) -> DataFrame:
    """Group sizes with event and censor counts (K5)."""
    keys = _strata(strata)
    cond = F.col(duration).isNotNull() & F.col(event).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    e = F.col(event).cast("long")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(e).alias("n_event"),
            F.sum(1 - e).alias("n_censor")]
    rows = cohort.where(cond)
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def risk_table(cohort: DataFrame, times: Sequence[float], duration: str = "duration",
               strata: str | Sequence[str] | None = None) -> DataFrame:
    """Number still at risk (duration >= x) at each requested time (K5)."""
    keys = _strata(strata)
    cond = F.col(duration).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    rows = cohort.where(cond)
    aggs = [F.sum(F.when(F.col(duration) >= F.lit(float(x)), 1).otherwise(0)).cast("long")
            .alias(f"at_risk_{i}") for i, x in enumerate(times)]
    wide = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(float(x)).alias("time"), F.col(f"at_risk_{i}").alias("n_at_risk"))
                      for i, x in enumerate(times)])
    return wide.select(*keys, F.inline(pairs))


# ---------------------------------------------------------------- log-rank

def _melt_strata(cohort: DataFrame, variables: Sequence[str], duration: str, event: str,
                 ignore_censoring: bool) -> DataFrame:
    e = F.lit(1) if ignore_censoring else F.col(event).cast("int")
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level"))
                      for v in variables])
    return (cohort.select(F.col(duration).cast("double").alias("t"), e.alias("_e"),
                          F.explode(pairs).alias("_p"))
            .select("t", "_e", "_p.variable", "_p.level")
            .where(F.col("t").isNotNull() & ~F.isnan("t") & F.col("_e").isNotNull() & F.col("level").isNotNull()))


def _logrank_counts(cohort: DataFrame, variables: Sequence[str], duration: str, event: str,
                    ignore_censoring: bool) -> DataFrame:
    """Counts per (variable, level, t), kept once: one pass over the cohort."""
    long = _melt_strata(cohort, variables, duration, event, ignore_censoring)
    return materialize(long.groupBy("variable", "level", "t").agg(
        F.sum("_e").cast("double").alias("_d"), F.count(F.lit(1)).cast("double").alias("_m")))


def _wide_variables(counts: DataFrame, dense_levels: int) -> list[str]:
    """The variables with more than ``dense_levels`` levels."""
    per = counts.select("variable", "level").distinct().groupBy("variable").agg(F.count(F.lit(1)).alias("n"))
    return [r["variable"] for r in per.where(F.col("n") > dense_levels).collect()]


def _logrank_blocks(reduced: DataFrame, n_variables: int):
    """The (variable, level, t) counts cut into time buckets, what each bucket
    has later in time, and the numbered levels.

    Everything is linear in the rows and the levels: a bucket's at-risk
    counts are its own reverse sums plus one vector per bucket.
    """
    order = Window.partitionBy("variable").orderBy("level")        # one row per level
    levels = materialize(reduced.select("variable", "level").distinct().withColumn(
        "_g", F.row_number().over(order) - 1))
    small = keys_bounded(levels, ["variable", "level"], BROADCAST_ROW_LIMIT)
    few = n_variables * default_buckets(reduced) <= BROADCAST_ROW_LIMIT   # a row of cut points a variable
    rows = assign_buckets(reduced, ["variable"], "t", few_keys=few, verified=True).join(
        F.broadcast(levels) if small else levels, ["variable", "level"]).drop("level")
    totals = rows.groupBy("variable", "_b", "_g").agg(F.sum("_m").alias("_m"))
    later = totals.groupBy("variable").applyInPandas(_later, "variable string, _b int, _later array<double>")
    return rows, later, levels


def _later(totals: pd.DataFrame) -> pd.DataFrame:
    """Per bucket, the subjects of each level in the buckets after it."""
    buckets = np.unique(totals["_b"])
    own = np.zeros((len(buckets), int(totals["_g"].max()) + 1))
    own[np.searchsorted(buckets, totals["_b"]), totals["_g"]] = totals["_m"]
    after = own[::-1].cumsum(axis=0)[::-1] - own
    return pd.DataFrame({"variable": totals["variable"].iloc[0], "_b": buckets, "_later": list(after)})


def _blocks(rows: pd.DataFrame, later: pd.DataFrame):
    """Times, events and at-risk counts (time x level) of a bucket, latest
    times first, in blocks of bounded size."""
    risk = np.array(later["_later"].iloc[0])
    times, at = np.unique(rows["t"], return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, g = at[order], rows["_g"].to_numpy()[order]
    d, m = rows["_d"].to_numpy()[order], rows["_m"].to_numpy()[order]
    step = max(1, BLOCK_CELLS // len(risk))
    for hi in range(len(times), 0, -step):
        lo = max(0, hi - step)
        a, b = np.searchsorted(at, [lo, hi])
        events, own = np.zeros((hi - lo, len(risk))), np.zeros((hi - lo, len(risk)))
        events[at[a:b] - lo, g[a:b]] = d[a:b]
        own[at[a:b] - lo, g[a:b]] = m[a:b]
        n = own[::-1].cumsum(axis=0)[::-1] + risk
        risk = n[0]
        yield times[lo:hi], events, own, n


def _partial_sums(rows: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
    """A bucket's observed, expected and covariance sums."""
    if not len(rows):
        return pd.DataFrame({"variable": [], "size": [], "observed": [], "expected": [], "cov": []})
    k = len(later["_later"].iloc[0])
    size, observed, expected, cov = np.zeros(k), np.zeros(k), np.zeros(k), np.zeros((k, k))
    for _, events, own, n in _blocks(rows, later):
        total, d = n.sum(axis=1), events.sum(axis=1)
        w = np.where(total > 1, d * (total - d) / np.maximum(total - 1, 1), 0.0)
        share = n / total[:, None]
        size += own.sum(axis=0)
        observed += events.sum(axis=0)
        expected += d @ share
        cov += np.diag(w @ share) - (share * w[:, None]).T @ share
    return pd.DataFrame({"variable": [rows["variable"].iloc[0]], "size": [size], "observed": [observed],
                         "expected": [expected], "cov": [cov.ravel()]})


def _grid_rows(rows: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
    parts = [pd.DataFrame({"variable": [], "_g": [], "t": [], "n_at_risk": [], "n_event": []})]
    for times, events, _, n in _blocks(rows, later) if len(rows) else ():
        k = n.shape[1]
        parts.append(pd.DataFrame({"variable": rows["variable"].iloc[0], "_g": np.tile(np.arange(k), len(times)),
                                   "t": np.repeat(times, k), "n_at_risk": n.ravel(), "n_event": events.ravel()}))
    return pd.concat(parts[1:] or parts)


def _solve_statistic(batches):
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            k = len(row.observed)
            if k < 2:
                out.append((row.variable, k, None, None))
                continue
            z = (np.array(row.observed) - np.array(row.expected))[:-1]
            cov = np.array(row.cov).reshape(k, k)[:-1, :-1]
            try:
                stat = float(z @ np.linalg.solve(cov, z))
            except np.linalg.LinAlgError:
                stat = float(z @ np.linalg.pinv(cov) @ z)
            out.append((row.variable, k, stat, k - 1))
        yield pd.DataFrame(out, columns=["variable", "n_groups", "statistic", "dof"])


def _logrank_sums(counts: DataFrame, n_variables: int):
    """(variable, size, observed, expected, cov) arrays summed over the buckets, and the levels."""
    rows, later, levels = _logrank_blocks(counts, n_variables)
    names = ["size", "observed", "expected", "cov"]
    parts = rows.groupBy("variable", "_b").cogroup(later.groupBy("variable", "_b")).applyInPandas(
        _partial_sums, "variable string, " + ", ".join(f"{c} array<double>" for c in names))
    # Element-wise sums, map-side first: no task holds all buckets' matrices.
    def entries(c: str) -> Column:
        return F.transform(c, lambda x, i: F.struct(F.lit(c).alias("what"), i.alias("i"), x.alias("x")))

    cells = parts.select("variable", F.explode(F.concat(*map(entries, names))).alias("_c")).select("variable", "_c.*").groupBy("variable", "what", "i").agg(F.sum("x").alias("x"))
    arrays = [F.transform(F.sort_array(F.collect_list(F.when(F.col("what") == c, F.struct("i", "x")))),
                          lambda s: s["x"]).alias(c) for c in names]
    return cells.groupBy("variable").agg(*arrays), levels


def logrank(cohort: DataFrame, by: str | Sequence[str], duration: str = "duration",
            event: str = "event", ignore_censoring: bool = False, dense_levels: int | None = None) -> DataFrame:
    """k-sample log-rank test for one or many stratum variables (K6-K8).

    Returns (variable, n_groups, statistic, dof, p_value). With
    ``ignore_censoring=True`` every row counts as an event, reproducing the
    reference's mis-keyed k-sample call (SURVEY D2). Rows with a null or NaN
    duration, or a null event or level, are left out. Up to ``dense_levels``
    (``DENSE_LEVELS``) levels the k x k covariance is a sum of one matrix product per time bucket;
    beyond, the same system is solved without a matrix (``logrank_sparse``).
    """
    variables = _strata(by)
    counts = _logrank_counts(cohort, variables, duration, event, ignore_censoring)
    wide = _wide_variables(counts, DENSE_LEVELS if dense_levels is None else dense_levels)
    schema = T.StructType([T.StructField("variable", T.StringType()),
                           T.StructField("n_groups", T.IntegerType()),
                           T.StructField("statistic", T.DoubleType()),
                           T.StructField("dof", T.IntegerType())])
    parts = []
    if len(wide) < len(variables):
        sums, _ = _logrank_sums(counts.where(~F.col("variable").isin(wide)) if wide else counts, len(variables))
        parts.append(sums.mapInPandas(_solve_statistic, schema))
    if wide:
        # Read once for each product with the matrix: the other variables' rows stay out.
        own = counts if len(wide) == len(variables) else materialize(counts.where(F.col("variable").isin(wide)))
        parts.append(logrank_sparse.statistics(own, len(wide)))
    tested = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return tested.select("variable", "n_groups", "statistic", "dof",
                         chi2_sf_col(F.col("statistic"), F.col("dof")).alias("p_value"))


def logrank_groups(cohort: DataFrame, by: str | Sequence[str], duration: str = "duration",
                   event: str = "event", ignore_censoring: bool = False) -> DataFrame:
    """Per-group size, observed and expected events (variable, level, n, observed, expected)."""
    variables = _strata(by)
    counts = _logrank_counts(cohort, variables, duration, event, ignore_censoring)
    sums, _ = logrank_sparse.level_sums(counts, len(variables))
    return sums.select("variable", "level", F.col("size").cast("long").alias("n"),
                       F.col("observed").cast("long").alias("observed"), "expected")


def logrank_grid(cohort: DataFrame, by: str | Sequence[str], duration: str = "duration",
                 event: str = "event") -> DataFrame:
    """The time x group grid behind the test (J3): for every pooled time and
    every level, the level's at-risk and event counts
    (variable, level, t, n_at_risk, n_event)."""
    variables = _strata(by)
    rows, later, levels = _logrank_blocks(_logrank_counts(cohort, variables, duration, event, False), len(variables))
    grid = rows.groupBy("variable", "_b").cogroup(later.groupBy("variable", "_b")).applyInPandas(
        _grid_rows, "variable string, _g int, t double, n_at_risk double, n_event double")
    return grid.join(levels, ["variable", "_g"]).select(
        "variable", "level", "t", F.col("n_at_risk").cast("long").alias("n_at_risk"),
        F.col("n_event").cast("long").alias("n_event"))


def two_group(col: str | Column, value, null_group: str = "exclude") -> Column:
    """Two-sample group label: 'A' where col == value, 'B' otherwise.

    ``null_group='exclude'`` drops null statuses (the app's behaviour);
    ``'other'`` puts them in B (the notebook's ``~mask``), i.e.
    ``NOT (col <=> value)``.
    """
    c = F.col(col) if isinstance(col, str) else col
    if null_group == "other":
        return F.when(c.eqNullSafe(F.lit(value)), F.lit("A")).otherwise(F.lit("B"))
    return F.when(c.isNull(), F.lit(None).cast("string")) \
        .when(c == F.lit(value), F.lit("A")).otherwise(F.lit("B"))


# ---------------------------------------------------------------- crossing

def curve_crossings(cohort: DataFrame, stratum: str, level_a: str, level_b: str,
                    duration: str = "duration", event: str = "event") -> DataFrame:
    """Do two KM curves cross? (K9)

    Both step functions are evaluated on the union of their times: the log
    of each curve is a running sum of per-time log terms that are zero where
    the group has no row, so no forward-fill window is needed. Sign changes
    of S_a - S_b are found by numbering the non-zero differences and joining
    each to its predecessor on that number.
    Returns (level_a, level_b, n_crossings, first_crossing_t).
    """
    ev = event_table(cohort.where(F.col(stratum).isin(level_a, level_b)), duration, event, [stratum])
    n = F.col("n_at_risk").cast("double")
    d = F.col("n_event").cast("double")
    alive = d < n
    a = F.col(stratum) == F.lit(level_a)
    terms = ev.select(
        "t",
        F.when(a & alive, F.log1p(-d / n)).otherwise(F.lit(0.0)).alias("_la"),
        F.when(a & ~alive, 1).otherwise(0).alias("_za"),
        F.when(~a & alive, F.log1p(-d / n)).otherwise(F.lit(0.0)).alias("_lb"),
        F.when(~a & ~alive, 1).otherwise(0).alias("_zb"),
    ).groupBy("t").agg(*[F.sum(c).alias(c) for c in ["_la", "_za", "_lb", "_zb"]])
    acc = running_sums(terms, [], "t", {"_cla": "_la", "_cza": "_za", "_clb": "_lb", "_czb": "_zb"})
    sa = F.when(F.col("_cza") > 0, 0.0).otherwise(F.exp("_cla"))
    sb = F.when(F.col("_czb") > 0, 0.0).otherwise(F.exp("_clb"))
    diff = acc.select("t", F.signum(F.round(sa - sb, 12)).alias("sgn")).where(F.col("sgn") != 0)
    numbered = running_sums(diff, [], "t", {"_i": F.lit(1)})
    prev = numbered.select((F.col("_i") + 1).alias("_i"), F.col("sgn").alias("_prev"))
    flips = numbered.join(prev, "_i").where(F.col("sgn") != F.col("_prev"))
    return flips.agg(F.count(F.lit(1)).alias("n_crossings"), F.min("t").alias("first_crossing_t")) \
        .select(F.lit(level_a).alias("level_a"), F.lit(level_b).alias("level_b"),
                "n_crossings", "first_crossing_t")
