"""Running sums, ranks and exact quantiles without a single-task window.

A window with ``partitionBy(keys).orderBy(t)`` sends every row of one key to
one task. Survival statistics need running sums over time inside a stratum,
and one stratum can hold a third of all rows, so the ordered domain is split
first:

1. per key, approximate quantile cut points of the order column
   (``percentile_approx`` is a mergeable sketch, partial-aggregated);
2. every row gets a bucket index from the cut points (no shuffle);
3. per (key, bucket) totals -> a small table -> offsets by a window over
   buckets (a few dozen rows per key);
4. the running sum inside (key, bucket) plus the bucket offset.

The result is exact: cut points only decide how the work is split, never
what is summed. Callers reduce rows to one per (key, order value) first
(``groupBy(key, t)``), which is where most of the data volume disappears.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskset.session import materialize

DEFAULT_BUCKETS = 64
_ACCURACY = 10000
_CONST_KEY = "_rs_all"
# Per-key side tables (cut points, bucket offsets) are broadcast only when
# the number of keys is checked to be at most this many.
BROADCAST_KEY_LIMIT = 4096
BROADCAST_ROW_LIMIT = 1 << 18    # rows of a side table: keys x buckets


def keys_bounded(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """True when ``df`` has at most ``limit`` distinct key tuples; by default as
    many as keep keys x buckets within ``BROADCAST_ROW_LIMIT`` rows.

    The check reads at most ``limit + 1`` distinct keys, so its cost does
    not grow with the data beyond one pass over an already reduced table.
    """
    if limit is None:
        limit = min(BROADCAST_KEY_LIMIT, BROADCAST_ROW_LIMIT // default_buckets(df))
    return df.select(*keys).distinct().limit(limit + 1).count() <= limit


def _with_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    keys = list(keys)
    if keys:
        return df, keys, False
    return df.withColumn(_CONST_KEY, F.lit(0)), [_CONST_KEY], True


def default_buckets(df: DataFrame) -> int:
    """Buckets per key: twice the shuffle partitions, clamped to [64, 4096]
    (``riskset.buckets`` in the session config overrides)."""
    conf = df.sparkSession.conf
    explicit = conf.get("riskset.buckets", None)
    if explicit:
        return int(explicit)
    parts = int(conf.get("spark.sql.shuffle.partitions", "200"))
    return max(DEFAULT_BUCKETS, min(4096, 2 * parts))


def bucket_of(cuts: Column, value: Column, n_cuts: int) -> Column:
    """Number of cut points below ``value`` (a lower bound) by binary search
    over the sorted ``cuts`` array: log2(n) steps instead of n comparisons."""
    steps = max(1, math.ceil(math.log2(n_cuts + 1)))

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        go_right = F.element_at(cuts, mid + 1) < value
        nxt = F.when(go_right, F.struct((mid + 1).alias("lo"), hi.alias("hi"))) \
            .otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))
        return F.when(lo < hi, nxt).otherwise(acc)

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["lo"])


def assign_buckets(df: DataFrame, keys: Sequence[str], order: str,
                   buckets: int | None = None, out: str = "_b", few_keys: bool = False,
                   verified: bool = False) -> DataFrame:
    """Add a bucket index (0..buckets-1) that is monotone in ``order`` within keys.

    Cut points are approximate quantiles per key, so buckets are roughly
    equal in size; they never influence results, only how work is split.
    """
    buckets = buckets or default_buckets(df)
    fractions = [i / buckets for i in range(1, buckets)]
    if not list(keys):
        # One key: the cut points are one bounded array, inlined as a literal.
        cuts = df.agg(F.percentile_approx(order, fractions, _ACCURACY).alias("_cuts")).first()["_cuts"] or []
        lit_cuts = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
        return df.withColumn(out, bucket_of(lit_cuts, F.col(order), len(cuts)))
    keys = list(keys)
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(order, fractions, _ACCURACY).alias("_cuts"))
    # One row per key: broadcast only a checked small key set (strata levels,
    # model variables, classes); beyond the limit AQE picks the join.
    if few_keys and not verified:
        few_keys = keys_bounded(df, keys)
    cuts = F.broadcast(cuts) if few_keys else cuts
    return (df.join(cuts, keys)
            .withColumn(out, bucket_of(F.col("_cuts"), F.col(order), buckets - 1))
            .drop("_cuts"))


def running_sums(df: DataFrame, keys: Sequence[str], order: str,
                 sums: Mapping[str, str | Column], *, reverse: bool = False,
                 inclusive: bool = True, totals: Mapping[str, str | Column] | None = None,
                 buckets: int | None = None, bucket_col: str | None = None,
                 materialized: bool = False, few_keys: bool = False,
                 keys_verified: bool = False, shared_cuts: bool = False) -> DataFrame:
    """Add running sums ordered by ``order`` within ``keys``.

    ``df`` must hold at most one row per (keys, order value). ``sums`` maps an
    output name to a column (name or expression) to accumulate; ``reverse``
    sums from the largest order value down (at-risk counts), ``inclusive``
    includes the current row. ``totals`` maps output names to columns whose
    per-key grand total is attached as well. ``bucket_col`` names an existing
    bucket column from :func:`assign_buckets` (reused across iterations).

    The input is read three times (cut points, bucket totals, final window),
    so it is checkpointed once first unless ``materialized`` says it already
    is; otherwise each read would re-run the scan and aggregation behind it
    (column pruning makes the three partial aggregates differ, so Spark
    cannot reuse one exchange for them).

    ``few_keys`` asks for broadcast side tables; it is honoured after a
    bounded distinct-key check, or directly when ``keys_verified`` says the
    caller holds the key list on the driver (model variables, levels).
    ``shared_cuts`` uses one set of cut points for all keys (many keys on a
    common axis, e.g. tree nodes): no per-key sketch table is built.
    """
    totals = dict(totals or {})
    base_cols = [c for c in df.columns if c != bucket_col]
    src = {out: (F.col(c) if isinstance(c, str) else c) for out, c in sums.items()}
    src.update({f"_tot_src_{out}": (F.col(c) if isinstance(c, str) else c)
                for out, c in totals.items()})
    keep = [bucket_col] if bucket_col else []
    df = df.select(*base_cols, *keep, *[col.alias(f"_v_{out}") for out, col in src.items()])
    if not materialized:
        df = materialize(df)
    if few_keys and keys and not keys_verified:
        # The caller expects few keys; broadcast only if that is verified.
        few_keys = keys_bounded(df, keys)
    if bucket_col:
        df = df.withColumnRenamed(bucket_col, "_b")
    elif shared_cuts:
        df = assign_buckets(df, [], order, buckets)
    else:
        df = assign_buckets(df, keys, order, buckets, few_keys=few_keys, verified=True)
    df, keys, const = _with_keys(df, keys)

    per_bucket = df.groupBy(*keys, "_b").agg(
        *[F.sum(f"_v_{out}").alias(f"_bt_{out}") for out in src])
    wb = Window.partitionBy(*keys).orderBy("_b")
    before = (wb.rowsBetween(1, Window.unboundedFollowing) if reverse
              else wb.rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys, "_b",
        *[F.coalesce(F.sum(f"_bt_{out}").over(before), F.lit(0)).alias(f"_off_{out}")
          for out in sums],
        *[F.sum(f"_bt__tot_src_{out}").over(whole).alias(out) for out in totals])
    # One key: as many rows as buckets. More keys: keys x buckets rows, checked
    # by the callers' key list or by keys_bounded above.
    offsets = F.broadcast(offsets) if few_keys or const else offsets

    joined = df.join(offsets, keys + ["_b"])
    wr = Window.partitionBy(*keys, "_b").orderBy(order)
    if reverse:
        frame = wr.rowsBetween(0 if inclusive else 1, Window.unboundedFollowing)
    else:
        frame = wr.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out_cols = [(F.coalesce(F.sum(f"_v_{out}").over(frame), F.lit(0)) + F.col(f"_off_{out}")).alias(out)
                for out in sums]
    return joined.select(*base_cols, *out_cols, *[F.col(out) for out in totals])


def dense_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """1-based dense rank of ``value`` within ``keys`` without a global sort task."""
    distinct = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    ranked = running_sums(distinct, keys, value, {out: F.lit(1)})
    return df.join(ranked, list(keys) + [value], "left")


def value_counts_table(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., _x, _n): non-null values as double with their multiplicity."""
    keys = list(keys)
    return (df.select(*keys, F.col(value).cast("double").alias("_x"))
            .where(F.col("_x").isNotNull() & ~F.isnan("_x"))
            .groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n")))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float], out: str = "quantile", keys_verified: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles (same definition as pandas,
    DuckDB ``quantile_cont`` and Spark ``percentile``) per key.

    Spark's exact ``percentile`` buffers every distinct value of a group in
    one task; this version reduces to (key, value, count), finds ranks with
    :func:`running_sums` and picks the two neighbours of each rank position.
    Returns (keys..., prob, ``out``). Nulls are ignored.
    """
    return quantiles_from_counts(value_counts_table(df, keys, value), keys, probs, out,
                                 keys_verified=keys_verified)


def quantiles_from_counts(counts: DataFrame, keys: Sequence[str], probs: Sequence[float],
                          out: str = "quantile", materialized: bool = False,
                          keys_verified: bool = False) -> DataFrame:
    """:func:`exact_quantiles` on a (keys..., _x, _n) table of value counts.
    ``keys_verified``: the key values are a driver-held list (column names)."""
    keys = list(keys)
    ranked = running_sums(counts, keys, "_x", {"_cum": "_n"}, totals={"_tot": "_n"}, few_keys=True,
                          materialized=materialized, keys_verified=keys_verified)
    probs_col = F.array(*[F.lit(float(p)) for p in probs])
    first = F.col("_cum") - F.col("_n")          # 0-based first rank of the value
    last = F.col("_cum") - 1                     # 0-based last rank of the value

    def pos(p):
        return p * (F.col("_tot") - 1)

    def hit(r):
        return (r >= first) & (r <= last)

    needed = ranked.where(F.exists(probs_col, lambda p: hit(F.floor(pos(p))) | hit(F.ceil(pos(p)))))
    exploded = needed.select(*keys, "_x", "_cum", "_n", "_tot", F.explode(probs_col).alias("prob"))
    lo, hi = F.floor(pos(F.col("prob"))), F.ceil(pos(F.col("prob")))
    picked = exploded.groupBy(*keys, "prob").agg(
        F.max(F.when(hit(lo), F.col("_x"))).alias("_lo"),
        F.max(F.when(hit(hi), F.col("_x"))).alias("_hi"),
        F.first(pos(F.col("prob")) - lo).alias("_frac"))
    return picked.select(*keys, "prob", (F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))).alias(out))


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str,
                     named: Mapping[str, float], keys_verified: bool = False) -> DataFrame:
    """Exact quantiles pivoted to one column per name: (keys..., name...)."""
    q = exact_quantiles(df, keys, value, list(named.values()), keys_verified=keys_verified)
    aggs = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name)
            for name, p in named.items()]
    if keys:
        return q.groupBy(*keys).agg(*aggs)
    return q.agg(*aggs)


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate (exactly one row, a proven bound)
    to every row of ``df`` as typed literals.

    The row is read once on the driver; inlining avoids a cartesian join,
    and the consumer stays a narrow projection.
    """
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one row, got {len(rows)}")
    row = rows[0]
    cols = [F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in one_row.schema.fields]
    return df.select("*", *cols)
