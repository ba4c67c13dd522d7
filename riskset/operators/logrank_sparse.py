"""k-sample log-rank for any number of levels, without a matrix.

With shares p_t = n_t / N_t and weights w_t = d_t (N_t - d_t) / (N_t - 1), the
covariance is V = sum_t w_t (diag(p_t) - p_t p_t'). Neither V nor the time x
level counts are formed. For a vector x over the levels, with a_t = w_t / N_t,

    s_t = (sum of x over the subjects at risk at t) / N_t
    (V x)_g = sum over the subjects i of g of  x_g A(T_i) - B(T_i),

where A and B are running sums over time of a_t and a_t s_t: two running sums of
one number per time and two joins of the (level, t) counts. The statistic
z' V^- z comes from conjugate gradients with the first part of V's diagonal as
preconditioner; vectors are tables of one row per level, and the driver holds
two numbers per variable. Work and memory are linear in the (level, t) counts.

Levels that leave before the first weighted time have a zero row in V and no
residual; they count as groups. No weighted time at all gives a statistic of 0.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.operators.prefix import BROADCAST_ROW_LIMIT, assign_buckets, default_buckets, running_sums
from riskset.session import materialize

KEY = ["variable", "level"]
TOLERANCE = 1e-20            # of the residual's squared norm; the statistic's error is of this order
MAX_STEPS = 1000


def _along(times: DataFrame, sums: Mapping[str, Column], few: bool, reverse: bool = False) -> DataFrame:
    """Running sums over the times of each variable, in the buckets they have."""
    return running_sums(times.withColumn("_b", F.col("bucket")), ["variable"], "t", sums, reverse=reverse,
                        bucket_col="_b", few_keys=few, keys_verified=True)


def _per_variable(values: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("variable")]


def _sums(state: DataFrame, value: Column) -> dict[str, float]:
    """One number per variable."""
    rows = state.groupBy("variable").agg(F.sum(value).alias("x")).collect()
    return {r["variable"]: r["x"] or 0.0 for r in rows}


def level_sums(counts: DataFrame, n_variables: int) -> tuple[DataFrame, DataFrame]:
    """(variable, level, t, _d, _m) -> stored (variable, level, size, observed, expected, diag) and
    (variable, t, bucket, n, a), the weighted times."""
    few = n_variables * default_buckets(counts) <= BROADCAST_ROW_LIMIT
    per_time = materialize(counts.groupBy("variable", "t").agg(F.sum("_d").alias("d"), F.sum("_m").alias("m")))
    times = assign_buckets(per_time, ["variable"], "t", out="bucket", few_keys=few, verified=True)
    risk = _along(times, {"n": F.col("m")}, few, reverse=True)
    weight = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    risk = risk.withColumn("a", weight / F.col("n"))
    times = materialize(_along(risk, {"_h": F.col("d") / F.col("n"), "_a": F.col("a")}, few))
    found = counts.join(times.select("variable", "t", "_h", "_a"), ["variable", "t"]).groupBy(*KEY).agg(
        F.sum("_m").alias("size"), F.sum("_d").alias("observed"),
        F.sum(F.col("_m") * F.col("_h")).alias("expected"), F.sum(F.col("_m") * F.col("_a")).alias("diag"))
    return materialize(found), times.select("variable", "t", "bucket", "n", "a")


def _times_matrix(counts: DataFrame, times: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """Stored ``state`` with ``q`` = V p for its column ``p``."""
    own = counts.join(state.select(*KEY, "p"), KEY).groupBy("variable", "t").agg(F.sum(F.col("_m") * F.col("p")).alias("c"))
    later = _along(times.join(own, ["variable", "t"]), {"s": F.col("c")}, few, reverse=True)
    shares = later.select("variable", "t", "bucket", (F.col("a") * F.col("s") / F.col("n")).alias("as"))
    until = _along(shares, {"b": F.col("as")}, few).select("variable", "t", "b")
    product = counts.join(until, ["variable", "t"]).groupBy(*KEY).agg(F.sum(F.col("_m") * F.col("b")).alias("_mb"))
    return materialize(state.join(product, KEY).withColumn("q", F.col("diag") * F.col("p") - F.col("_mb")).drop("_mb"))


def statistics(counts: DataFrame, n_variables: int) -> DataFrame:
    """(variable, level, t, _d, _m), stored -> (variable, n_groups, statistic, dof)."""
    spark = counts.sparkSession
    few = n_variables * default_buckets(counts) <= BROADCAST_ROW_LIMIT
    sums, times = level_sums(counts, n_variables)
    groups = {r["variable"]: r["n"] for r in sums.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).collect()}

    def scaled(c: str) -> Column:
        return F.when(F.col("diag") > 0, F.col(c) / F.col("diag")).otherwise(0.0)

    state = sums.select(*KEY, "diag", (F.col("observed") - F.col("expected")).alias("r")).withColumn("p", scaled("r"))
    rho = _sums(state, F.col("r") * F.col("p"))
    floor = {v: x * TOLERANCE for v, x in rho.items()}
    total = dict.fromkeys(rho, 0.0)
    for _ in range(MAX_STEPS):
        going = [v for v, x in rho.items() if x > floor[v]]
        if not going:
            break
        state = _times_matrix(counts.where(F.col("variable").isin(going)), times, state, few)
        curve = _sums(state, F.col("p") * F.col("q"))
        step = {v: rho[v] / curve[v] if curve.get(v, 0.0) > 0 else 0.0 for v in going}
        for v in going:
            total[v] += step[v] * rho[v]
        state = state.withColumn("r", F.col("r") - _per_variable(step) * F.col("q")).drop("q")
        after = _sums(state, F.col("r") * scaled("r"))
        turn = {v: after[v] / rho[v] for v in going}
        state = state.withColumn("p", scaled("r") + _per_variable(turn) * F.col("p"))
        # A direction without curvature is the null space: what is left there is rounding.
        rho = {v: after[v] if step[v] else 0.0 for v in going}
    else:
        raise ValueError(f"the log-rank solve did not converge in {MAX_STEPS} steps for {going}")
    rows = [(v, n, total[v] if n > 1 else None, n - 1 if n > 1 else None) for v, n in groups.items()]
    return spark.createDataFrame(rows, "variable string, n_groups int, statistic double, dof int")
