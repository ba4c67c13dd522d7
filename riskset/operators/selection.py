"""Exact quantiles and moments of many columns by distributed selection.

No cell value is sorted, shuffled or copied but the few that lie near a wanted
rank:

1. a scan sketches every column (per group): count, mean, squared deviations,
   range, and a bounded sample whose quantiles become cut points;
2. a second scan counts values per bracket between cut points, values equal to
   a cut point apart, so that a value held by any share of the rows is a
   bracket of its own;
3. the brackets that hold a wanted rank are known from the counts; only their
   values are brought together, a bracket a group, and sorted. A bracket with
   more than ``BRACKET_ROWS`` values is cut again by steps 1 and 2 first.

Each scan works on Arrow batches, column by column, so plans do not grow with
the number of columns; what leaves a task is one row per column and group.
The driver holds cut points, bracket counts and results: (columns x groups)
times a constant, and groups are checked to be few (``GROUP_LIMIT``).
Null and NaN cells are ignored; null groups are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRACKETS = 256              # between the cut points of a column
SAMPLE = 512                # values a task keeps of a column for the cut points, up to twice as many
BRACKET_ROWS = 250_000      # values sorted at once
GROUP_LIMIT = 16_384        # columns x groups


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a derived frame while several scans read it; lost blocks are computed again."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


@dataclass
class Slot:
    """Values of one column and group between two bounds, both left out; None is no bound."""
    group: int
    column: int
    low: float | None = None
    high: float | None = None
    below: int = 0                                  # values of the column and group that come before
    ranks: list[int] = field(default_factory=list)  # wanted, from 0, of the whole column
    rows: int = 0                                   # values inside

    def values(self, v: np.ndarray) -> np.ndarray:
        v = v if self.low is None else v[v > self.low]
        return v if self.high is None else v[v < self.high]


class Sketch:
    """Count, moments, range and a thinned sample of values."""

    def __init__(self) -> None:
        self.n, self.mean, self.m2, self.low, self.high = 0, 0.0, 0.0, math.inf, -math.inf
        self.total = 0.0
        self.kept, self.step, self.carry = np.zeros(0), 1, 0

    def add(self, v: np.ndarray) -> None:
        if not len(v):
            return
        with np.errstate(invalid="ignore", over="ignore"):
            mean = float(v.mean())
            self._merge(len(v), mean, float(((v - mean) ** 2).sum()))
            # One value after the other, as SQL engines sum, so that means agree to the last bit where rounding shows it.
            self.total = float(np.cumsum(np.concatenate([[self.total], v]))[-1])
        self.low, self.high = min(self.low, float(v.min())), max(self.high, float(v.max()))
        taken = v[self.carry::self.step]
        self.carry = (self.carry - len(v)) % self.step
        self.kept = np.concatenate([self.kept, taken])
        while len(self.kept) > 2 * SAMPLE:
            self.kept = np.sort(self.kept)[self.step & 1::2]
            self.step *= 2
            self.carry = 0

    def _merge(self, n: int, mean: float, m2: float) -> None:
        both = self.n + n
        delta = mean - self.mean
        self.m2 += m2 + delta * delta * self.n * n / both
        self.mean += delta * n / both
        self.n = both

    def row(self) -> tuple:
        return self.n, self.mean, self.m2, self.total, self.low, self.high, self.step, self.kept

    @staticmethod
    def merged(rows: list[tuple]) -> tuple:
        """(n, mean, m2, low, high, cut points) of sketches of parts."""
        out = Sketch()
        for n, mean, m2, total, low, high, _, _ in rows:
            with np.errstate(invalid="ignore"):
                out._merge(n, mean, m2)
            out.total += total
            out.low, out.high = min(out.low, low), max(out.high, high)
        values = np.concatenate([r[7] for r in rows])
        weights = np.concatenate([np.full(len(r[7]), float(r[6])) for r in rows])
        order = np.argsort(values, kind="stable")
        reach = np.cumsum(weights[order])
        at = np.searchsorted(reach, reach[-1] * np.arange(1, BRACKETS) / BRACKETS)
        return out.n, out.total / out.n, out.m2, out.low, out.high, np.unique(values[order][at])


class Scan:
    """One pass over the columns at a time, each task's findings merged per slot."""

    def __init__(self, df: DataFrame, columns: Sequence[str], by: Sequence[str], groups: list[tuple], slots: list[Slot]):
        names = [f"v{i}" for i in range(len(columns))]
        keys = [f"k{i}" for i in range(len(by))]
        self.frame = df.select(*[_c(b).cast("string").alias(k) for b, k in zip(by, keys)],
                               *[_c(c).cast("double").alias(v) for c, v in zip(columns, names)])
        self.keys, self.groups = keys, {g: i for i, g in enumerate(groups)}
        own: dict[tuple[int, int], list[int]] = {}
        for i, s in enumerate(slots):
            own.setdefault((s.group, s.column), []).append(i)
        self.slots, self.own = slots, own

    def __getstate__(self) -> dict:
        return self.__dict__ | {"frame": None}                  # tasks know what to look for, not the frame

    def _cells(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(slot, values) of a batch."""
        if self.keys:
            code = np.zeros(batch.num_rows, np.int64)
            parts: list[list] = []
            for k in self.keys:
                coded = batch.column(k).dictionary_encode()
                parts.append(coded.dictionary.to_pylist())
                at = coded.indices.fill_null(len(parts[-1])).to_numpy(zero_copy_only=False)
                code = code * (len(parts[-1]) + 1) + at
            kinds, code = np.unique(code, return_inverse=True)
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(kinds) + 1))
            rows = []
            for j, kind in enumerate(kinds.tolist()):
                name: list = []
                for values in reversed(parts):
                    kind, at = divmod(kind, len(values) + 1)
                    name.append(values[at] if at < len(values) else None)
                group = self.groups.get(tuple(reversed(name)))
                if group is not None:
                    rows.append((group, order[cuts[j]:cuts[j + 1]]))
        else:
            rows = [(0, None)]
        for column in range(batch.num_columns - len(self.keys)):
            cells = batch.column(len(self.keys) + column)
            v = cells.to_numpy(zero_copy_only=False)            # null cells become NaN
            for group, some in rows:
                slots = self.own.get((group, column))
                if slots:
                    own = v if some is None else v[some]
                    own = own[~np.isnan(own)]
                    for i in slots:
                        yield i, self.slots[i].values(own)

    def sketches(self) -> dict[int, tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, Sketch] = {}
            for batch in batches:
                for i, v in self._cells(batch):
                    held.setdefault(i, Sketch()).add(v)
            rows = [(i, *s.row()) for i, s in held.items() if s.n]
            yield _batch(rows, _SKETCH)

        def merge(table: pa.Table) -> pa.Table:
            rows = [tuple(r[c] for c in _SKETCH.names[1:8]) + (np.array(r["kept"]),) for r in table.to_pylist()]
            return pa.Table.from_batches([_batch([(table["slot"][0].as_py(), *Sketch.merged(rows))], _MERGED)])

        rows = self.frame.mapInArrow(run, _ddl(_SKETCH)).groupBy("slot").applyInArrow(merge, _ddl(_MERGED)).toArrow()
        return {r["slot"]: tuple(r[c] for c in _MERGED.names[1:6]) + (np.array(r["cuts"]),) for r in rows.to_pylist()}

    def counts(self, cuts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Values per bracket: 2i between cut points i-1 and i, 2i+1 equal to cut point i."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, v in self._cells(batch):
                    if i in cuts:
                        bracket = np.searchsorted(cuts[i], v, "left") + np.searchsorted(cuts[i], v, "right")
                        own = np.bincount(bracket, minlength=2 * len(cuts[i]) + 1)
                        held[i] = held[i] + own if i in held else own
            yield _batch(list(held.items()), _COUNTS)

        def merge(table: pa.Table) -> pa.Table:
            total = table["counts"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
            return pa.Table.from_batches([_batch([(table["slot"][0].as_py(), total)], _COUNTS)])

        rows = self.frame.mapInArrow(run, _ddl(_COUNTS)).groupBy("slot").applyInArrow(merge, _ddl(_COUNTS)).toArrow()
        return {r["slot"]: np.array(r["counts"], np.int64) for r in rows.to_pylist()}

    def picked(self) -> dict[int, dict[int, float]]:
        """The values at the slots' ranks."""
        slots = self.slots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, v) for i, v in self._cells(batch) if len(v)]
                if rows:
                    yield _batch(rows, _VALUES)

        def pick(table: pa.Table) -> pa.Table:
            slot = slots[table["slot"][0].as_py()]
            v = np.sort(table["counts"].combine_chunks().flatten().to_numpy())
            ranks = sorted(set(slot.ranks))
            return pa.table([pa.array([table["slot"][0].as_py()] * len(ranks), pa.int32()), pa.array(ranks, pa.int64()),
                             pa.array(v[np.array(ranks) - slot.below])], names=["slot", "rank", "value"])

        rows = self.frame.mapInArrow(run, _ddl(_VALUES)).groupBy("slot").applyInArrow(
            pick, "slot int, rank long, value double").toArrow()
        out: dict[int, dict[int, float]] = {}
        for r in rows.to_pylist():
            out.setdefault(r["slot"], {})[r["rank"]] = r["value"]
        return out


_MOMENTS = [("slot", pa.int32()), ("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64())]
_RANGE = [("low", pa.float64()), ("high", pa.float64())]
_SKETCH = pa.schema([*_MOMENTS, ("total", pa.float64()), *_RANGE, ("step", pa.int64()), ("kept", pa.list_(pa.float64()))])
_MERGED = pa.schema([*_MOMENTS, *_RANGE, ("cuts", pa.list_(pa.float64()))])
_COUNTS = pa.schema([("slot", pa.int32()), ("counts", pa.list_(pa.int64()))])
_VALUES = pa.schema([("slot", pa.int32()), ("counts", pa.list_(pa.float64()))])
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.list_(pa.int64()): "array<long>",
        pa.list_(pa.float64()): "array<double>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def groups_of(df: DataFrame, by: Sequence[str], limit: int) -> tuple[list[tuple], list[tuple]] | None:
    """Texts and values of the groups, or None if there are more than ``limit``."""
    if not by:
        return [()], [()]
    some = df
    for b in by:
        some = some.where(_c(b).isNotNull())
    rows = some.select(*[_c(b) for b in by], *[_c(b).cast("string").alias(f"_k{i}") for i, b in enumerate(by)]) \
        .distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return [tuple(r[len(by):]) for r in rows], [tuple(r[:len(by)]) for r in rows]


def summaries(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              limit: int = GROUP_LIMIT) -> list[dict] | None:
    """Per group and column with values: ``key`` (tuple), ``column``, ``n``, ``mean``, ``m2``, ``min``, ``max`` and
    ``quantiles`` (prob -> exact, linearly interpolated). None if there are too many groups for the driver."""
    columns, by = list(columns), list(by)
    if not columns:
        return []
    known = groups_of(df, by, max(1, limit // len(columns)))
    if known is None:
        return None
    groups, values = known
    slots = [Slot(g, c) for g in range(len(groups)) for c in range(len(columns))]
    found = Scan(df, columns, by, groups, slots).sketches()
    at: dict[tuple[int, int], dict[int, float]] = {}
    todo, sketched = [], []
    for i, s in enumerate(slots):
        if i in found:
            n = found[i][0]
            at[s.group, s.column] = {}
            s.ranks = sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
            if s.ranks:
                todo.append(s)
                sketched.append(found[i])
    while todo:
        scan = Scan(df, columns, by, groups, todo)
        cuts = {i: own[5] for i, own in enumerate(sketched)}
        onward: list[Slot] = []
        for i, count in scan.counts(cuts).items():
            s, reach = todo[i], np.cumsum(count)
            for r in s.ranks:
                b = int(np.searchsorted(reach, r - s.below, "right"))
                if b & 1:
                    at[s.group, s.column][r] = float(cuts[i][b // 2])
                    continue
                low = float(cuts[i][b // 2 - 1]) if b >= 2 else s.low
                high = float(cuts[i][b // 2]) if b // 2 < len(cuts[i]) else s.high
                below = s.below + int(reach[b] - count[b])
                same = [x for x in onward if (x.group, x.column, x.below) == (s.group, s.column, below)]
                if same:
                    same[0].ranks.append(r)
                else:
                    onward.append(Slot(s.group, s.column, low, high, below, [r], int(count[b])))
        few = [s for s in onward if s.rows <= BRACKET_ROWS]
        todo = [s for s in onward if s.rows > BRACKET_ROWS]
        if few:
            for i, own in Scan(df, columns, by, groups, few).picked().items():
                at[few[i].group, few[i].column].update(own)
        if todo:
            again = Scan(df, columns, by, groups, todo).sketches()
            sketched = [again[i] for i in range(len(todo))]
    out = []
    for i, s in enumerate(slots):
        if i in found:
            n, mean, m2, low, high, _ = found[i]
            own, quantiles = at[s.group, s.column], {}
            for p in probs:
                lo, hi = own[math.floor(p * (n - 1))], own[math.ceil(p * (n - 1))]
                share = p * (n - 1) - math.floor(p * (n - 1))
                quantiles[p] = lo if lo == hi else lo + share * (hi - lo)
            out.append({"key": values[s.group], "column": columns[s.column], "n": n, "mean": mean, "m2": m2, "min": low,
                        "max": high, "quantiles": quantiles})
    return out
