"""Harrell's concordance index without a self-join (C4).

A pair (i, j) is comparable when i has the event and j is still under
observation after it: t_j > t_i, or t_j = t_i with j censored. It is
concordant when risk_i > risk_j, tied when the risks are equal.

Subjects are cut into time and risk ranges, and pairs are counted inside the
ranges' tasks and from a table of range counts (:mod:`merge_count`): nothing but
the subjects themselves is shuffled, once by each axis.

Where so many subjects share a time or a risk that a range would not fit a task,
:func:`_by_levels` counts with rows alone: risks are dense-ranked and each subject is placed on the log2(R) levels of a binary tree over ranks:
a pair with rank_j < rank_i separates at exactly one level, where j sits in
the left child and i in the right child of the same node. Per (level, node,
t) the table holds left-side counts and right-side events; one reverse
running sum over t per (level, node) yields the concordant count. Rows grow
as n log2(R); all running sums are bucketed (no single-task window).
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.operators import merge_count
from riskset.operators.prefix import dense_rank, running_sums
from riskset.operators.selection import reused
from riskset.session import materialize


# Pair counts pass 2**63 at some four billion subjects.
COUNT = "decimal(38,0)"


def _pairs(events: str, others: Column) -> Column:
    return F.col(events).cast("decimal(19,0)") * others.cast("decimal(19,0)")


def concordance(df: DataFrame, risk: str, duration: str = "duration", event: str = "event") -> DataFrame:
    """(concordant, discordant, tied_risk, comparable, c_index) for a risk score
    where a higher value predicts an earlier event; the counts are decimals,
    and the index is null where no pair is comparable. Rows with a null or NaN
    are left out."""
    t, r = F.col("t"), F.col("risk")
    base = df.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e"),
                     F.col(risk).cast("double").alias("risk")).where(
        t.isNotNull() & ~F.isnan(t) & F.col("e").isNotNull() & r.isNotNull() & ~F.isnan(r))
    with reused(base) as kept:
        counted = merge_count.count(kept)
    if counted is None:
        return _index(_by_levels(base))
    return _index(df.sparkSession.createDataFrame([tuple(map(Decimal, counted))], ", ".join(f"{n} {COUNT}" for n in NAMES)))


NAMES = ["concordant", "tied_risk", "comparable"]


def _by_levels(base: DataFrame) -> DataFrame:
    """One row of counts by dyadic levels of the risk."""
    base = materialize(base)          # read by three branches below
    ranked = materialize(dense_rank(base, [], "risk", "rank").select("t", "e", (F.col("rank") - 1).alias("rank")))

    # comparable pairs: per t, events x (later subjects + censored at t)
    per_t = base.groupBy("t").agg(F.count(F.lit(1)).alias("m"),
                                  F.sum("e").cast("long").alias("d"))
    later = running_sums(per_t, [], "t", {"later": "m"}, reverse=True, inclusive=False)
    comparable = later.agg(F.sum(_pairs("d", F.col("later") + F.col("m") - F.col("d"))).alias("comparable"))

    # tied risks: same computation inside each rank
    per_rt = ranked.groupBy("rank", "t").agg(F.count(F.lit(1)).alias("m"),
                                             F.sum("e").cast("long").alias("d"))
    # one key per distinct risk on a common time axis: shared cut points
    later_r = running_sums(per_rt, ["rank"], "t", {"later": "m"}, reverse=True, inclusive=False,
                           shared_cuts=True)
    tied = later_r.agg(F.sum(_pairs("d", F.col("later") + F.col("m") - F.col("d"))).alias("tied_risk"))

    # concordant: dyadic levels; the level count comes from the rank range.
    max_rank = ranked.agg(F.max("rank")).collect()[0][0] or 0
    levels = max(1, math.ceil(math.log2(max_rank + 1))) if max_rank > 0 else 1
    lv = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    tree = per_rt.select("t", "m", "d", "rank", lv).select(
        "level", "t", "m", "d",
        F.expr("shiftright(rank, level + 1)").alias("node"),
        F.expr("shiftright(rank, level) & 1").alias("side"))
    left, right = F.col("side") == 0, F.col("side") == 1
    per_node = tree.groupBy("level", "node", "t").agg(
        F.sum(F.when(left, F.col("m")).otherwise(0)).cast("long").alias("m0"),
        F.sum(F.when(left, F.col("m") - F.col("d")).otherwise(0)).cast("long").alias("c0"),
        F.sum(F.when(right, F.col("d")).otherwise(0)).cast("long").alias("d1"))
    # one key per tree node on a common time axis: shared cut points split the
    # large nodes near the root; the offsets table has one row per non-empty
    # (node, bucket), never more than the node table itself
    later_left = running_sums(per_node, ["level", "node"], "t", {"later0": "m0"}, reverse=True, inclusive=False,
                              shared_cuts=True)
    concordant = later_left.agg(F.sum(_pairs("d1", F.col("later0") + F.col("c0"))).alias("concordant"))

    # three one-row aggregates combined by a one-row union + max (no join)
    null = F.lit(None).cast(COUNT)
    parts = None
    for one, own in ((concordant, "concordant"), (tied, "tied_risk"), (comparable, "comparable")):
        row = one.select(*[(F.col(own).cast(COUNT) if n == own else null).alias(n) for n in NAMES])
        parts = row if parts is None else parts.unionByName(row)
    return parts.agg(*[F.coalesce(F.max(n), F.lit(0).cast(COUNT)).alias(n) for n in NAMES])


def _index(tot: DataFrame) -> DataFrame:
    c, tie, comp = (F.col(n).cast("double") for n in NAMES)
    return tot.select(
        "concordant",
        (F.col("comparable") - F.col("concordant") - F.col("tied_risk")).cast(COUNT).alias("discordant"),
        "tied_risk", "comparable", F.try_divide(c + 0.5 * tie, comp).alias("c_index"))
