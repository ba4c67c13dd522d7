"""Counting ordered pairs in two dimensions without listing them.

Subjects are cut into ranges of time and into ranges of risk. A pair lies

* in one time range: counted inside the range's task, whatever the risks;
* in different time ranges and one risk range: counted inside the risk range's
  task, where the time range stands for the time;
* in different ranges of both: known from the counts of (time range, risk
  range), a table of at most ``RANGES`` squared rows.

Inside a task, risks are bits of a binary tree and subjects are kept in time
order under every node; a running count per level finds, for each event, the
later subjects with a smaller risk. That is n log n work on arrays, and nothing
is written out per level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskset.operators.prefix import bucket_of

ROWS = 1 << 18              # subjects a range is aimed at
MAX_ROWS = 1 << 23          # and may have at most, with ties
RANGES = 512


def _later(starts: np.ndarray, ends: np.ndarray, node_start: np.ndarray, all_: np.ndarray, censored: np.ndarray) -> np.ndarray:
    """For each row: subjects of its node at later times, and censored ones at its own time."""
    sums, ties = (np.concatenate([[0], np.cumsum(v)]) for v in (all_, censored))
    return sums[starts] - sums[node_start] + ties[ends] - ties[starts]


def _spans(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last row of each row's run."""
    first = np.flatnonzero(change)
    run = np.cumsum(change) - 1
    return first[run], np.append(first[1:], len(change))[run]


def pair_counts(t: np.ndarray, e: np.ndarray, risk: np.ndarray, ties_count: bool = True) -> tuple[int, int, int]:
    """(concordant, tied risk, comparable) pairs: an event and a subject at a later time, or censored at the same.

    ``ties_count=False`` compares strictly later times only.
    """
    if not len(t):
        return 0, 0, 0
    order = np.argsort(-t, kind="stable")
    t, e = t[order], e[order].astype(np.int64)
    _, rank = np.unique(risk[order], return_inverse=True)
    censored = (1 - e) if ties_count else np.zeros(len(e), np.int64)
    one = np.ones(len(t), np.int64)
    zero = np.zeros(len(t), np.int64)

    def new_time(t: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        change = np.ones(len(t), bool)
        change[1:] = node[1:] != node[:-1]
        starts, _ = _spans(change)
        change[1:] |= t[1:] != t[:-1]
        return change, starts

    change, root = new_time(t, zero)
    comparable = int((e * _later(*_spans(change), root, one, censored)).sum())
    concordant = 0
    for level in range(int(rank.max()).bit_length() - 1, -1, -1):
        # Rows are in order of (node, time); a node's left half has the smaller risks.
        node, left = rank >> (level + 1), ((rank >> level) & 1) == 0
        change, root = new_time(t, node)
        found = _later(*_spans(change), root, left.astype(np.int64), np.where(left, censored, 0))
        concordant += int((np.where(left, 0, e) * found).sum())
        down = np.argsort(rank >> level, kind="stable")
        t, e, rank, censored = t[down], e[down], rank[down], censored[down]
    # Leaves hold equal risks.
    change, root = new_time(t, rank)
    tied = int((e * _later(*_spans(change), root, one, censored)).sum())
    return concordant, tied, comparable


def across(counts: np.ndarray, events: np.ndarray) -> tuple[int, int]:
    """(concordant, comparable) pairs in different time and risk ranges, and in different time ranges."""
    later = np.zeros_like(counts)
    later[:-1] = np.cumsum(counts[::-1], axis=0)[::-1][1:]
    smaller = np.zeros_like(counts)
    smaller[:, 1:] = np.cumsum(later, axis=1)[:, :-1]
    whole = later.sum(axis=1).astype(object)
    return int((events.astype(object) * smaller).sum()), int((events.sum(axis=1).astype(object) * whole).sum())


def count(base: DataFrame) -> tuple[int, int, int] | None:
    """(concordant, tied risk, comparable) of (t, e, risk) rows without nulls; None where a range would be too large."""
    n = base.count()
    if not n:
        return 0, 0, 0
    ranges = min(RANGES, max(1, -(-n // ROWS)))
    axes: list[list[float]] = [[], []]
    if n // ranges > MAX_ROWS:
        return None
    if ranges > 1:
        fractions = [i / ranges for i in range(1, ranges)]
        found = base.agg(F.percentile_approx("t", fractions, 10000), F.percentile_approx("risk", fractions, 10000)).first()
        for axis, own in enumerate(found):
            # Repeated cut points mean tied values.
            if n // ranges * (1 + int(np.unique(own, return_counts=True)[1].max())) > MAX_ROWS:
                return None
            axes[axis] = sorted(set(own))

    def ranged(name: str, cuts: list[float]):
        return bucket_of(F.array(*[F.lit(c) for c in cuts]), F.col(name), len(cuts)) if cuts else F.lit(0)

    rows = base.select("t", "e", "risk", ranged("t", axes[0]).cast("int").alias("b"), ranged("risk", axes[1]).cast("int").alias("k"))

    def inside(time: str, ties_count: bool):
        def run(table: pa.Table) -> pa.Table:
            t, e, risk = (table[c].to_numpy().astype(np.float64) for c in (time, "e", "risk"))
            own = pair_counts(t, e, risk, ties_count)
            return pa.table([pa.array([x], pa.int64()) for x in own], names=["concordant", "tied", "comparable"])

        return run

    schema = "concordant long, tied long, comparable long"
    total = np.zeros(3, object)
    for key, time, ties_count in (("b", "t", True), ("k", "b", False)):
        if key == "k" and ranges == 1:
            break
        found = rows.groupBy(key).applyInArrow(inside(time, ties_count), schema).collect()      # a row for each range
        own = np.array([sum(r[i] for r in found) for i in range(3)], object)
        total = total + (own if key == "b" else np.array([own[0], own[1], 0], object))
    if ranges > 1:
        table = rows.groupBy("b", "k").agg(F.count(F.lit(1)).alias("m"), F.sum("e").alias("d")).collect()
        counts, events = np.zeros((ranges, ranges), np.int64), np.zeros((ranges, ranges), np.int64)
        for r in table:
            counts[r["b"], r["k"]], events[r["b"], r["k"]] = r["m"], r["d"]
        concordant, comparable = across(counts, events)
        total = total + np.array([concordant, 0, comparable], object)
    return tuple(int(x) for x in total)
