"""One evaluation of the Cox partial likelihood over blocks of the time axis.

The cohort is packed once: a row per block with its subjects sorted by time and
their covariates as one matrix. An evaluation then needs no shuffle.

With r = exp(beta'x), S0 and S1 the sums of r and r x over those at risk, D0 and
D1 over the tied events of a time, and phi = l/d for the l-th of d tied events
(Efron; 0 for Breslow), let for each event time

    c = sum 1/s,  E = sum phi/s,  A = sum 1/s^2,  B = sum phi/s^2,  C = sum phi^2/s^2,   s = S0 - phi D0.

The score is sum over events of x, less X'w, and the information is
X' diag(w) X less S1' diag(A) S1 - S1' diag(B) D1 - D1' diag(B) S1 + D1' diag(C) D1,
where w_i = r_i (sum of c up to t_i, less E(t_i) for an event). So ties are sums of
scalars, and all matrices come from matrix products; no p x p sum is ever taken
per time. A block needs S0 and S1 of what comes later, from a first pass over
the blocks' totals, and its rows' share of the c of earlier blocks is settled on
the driver, which holds a few numbers and a p x p matrix per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CELLS = 1 << 20             # covariate values a block is aimed at
MAX_CELLS = 1 << 24         # and may have at most, with ties
MAX_BLOCKS = 4096

SCHEMA = "b int, t array<double>, e array<int>, x array<double>"


def blocks_for(rows: int, width: int) -> int:
    return max(1, -(-rows * max(1, width) // CELLS))


def fits(rows: int, width: int, cuts: list[float], blocks: int) -> bool:
    """Do blocks between these quantiles stay in memory? Repeated cut points mean tied times."""
    most = 1 + max(np.unique(cuts, return_counts=True)[1], default=0)
    return rows * max(1, width) // blocks * int(most) <= MAX_CELLS


def pack(rows: DataFrame, width: int, blocks: int) -> DataFrame:
    """(_b, t, e, x array) rows -> a row per block, sorted by time."""
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["t"].to_numpy(), kind="stable")
        x = _flat(table["x"]).reshape(-1, width)[order]
        return pa.table([table["_b"][:1], pa.array([table["t"].to_numpy()[order]], pa.list_(pa.float64())),
                         pa.array([table["e"].to_numpy()[order].astype(np.int32)], pa.list_(pa.int32())),
                         pa.array([x.ravel()], pa.list_(pa.float64()))], names=["b", "t", "e", "x"])

    return rows.repartition(blocks, "_b").groupBy("_b").applyInArrow(run, SCHEMA)


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


class Block:
    """Subjects of a block for one model: times, events, covariates."""

    def __init__(self, t: np.ndarray, e: np.ndarray, x: np.ndarray):
        self.t, self.e, self.x = t, e, x
        self.starts = np.flatnonzero(np.diff(t, prepend=np.nan) != 0) if len(t) else np.zeros(0, np.int64)

    def per_time(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.starts, axis=0)

    def totals(self, beta: np.ndarray) -> np.ndarray:
        """Sums of r and r x."""
        r = np.exp(self.x @ beta)
        return np.concatenate([[r.sum()], self.x.T @ r])

    def evaluate(self, beta: np.ndarray, later: np.ndarray, ties: str) -> dict[str, np.ndarray]:
        p = self.x.shape[1]
        lin = self.x @ beta
        r, e = np.exp(lin), self.e.astype(np.float64)
        rx = r[:, None] * self.x
        s0 = later[0] + np.cumsum(self.per_time(r)[::-1])[::-1]
        s1 = later[1:] + np.cumsum(self.per_time(rx)[::-1], axis=0)[::-1]
        d = self.per_time(self.e.astype(np.int64))
        at = np.flatnonzero(d > 0)
        s0, s1, d = s0[at], s1[at], d[at]
        d0, d1 = self.per_time(e * r)[at], self.per_time(e[:, None] * rx)[at]
        if ties == "breslow":
            c, a = d / s0, d / s0 ** 2
            ee = b = cc = np.zeros(len(at))
            logs = float((d * np.log(s0)).sum())
        else:
            event = np.repeat(np.arange(len(at)), d)
            phi = (np.arange(len(event)) - np.repeat(np.cumsum(d) - d, d)) / d[event]
            s = s0[event] - phi * d0[event]
            c, ee, a, b, cc = (np.bincount(event, v, len(at)) for v in (1 / s, phi / s, 1 / s ** 2, phi / s ** 2, (phi / s) ** 2))
            logs = float(np.log(s).sum())
        everywhere = np.zeros((2, len(self.starts)))
        everywhere[0, at], everywhere[1, at] = c, ee
        time = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.t))))
        w = r * (np.cumsum(everywhere[0])[time] - e * everywhere[1][time])
        cross = s1.T @ (b[:, None] * d1)
        means = s1.T @ (a[:, None] * s1) - cross - cross.T + d1.T @ (cc[:, None] * d1)
        return {"n": np.array([len(e)]), "n_events": np.array([e.sum()]), "ll": np.array([float(e @ lin) - logs]),
                "u": self.x.T @ (e - w), "i": (self.x.T @ (w[:, None] * self.x) - means).ravel(),
                "c": np.array([c.sum()]), "t1": self.x.T @ r, "t2": (self.x.T @ rx).ravel()} | {"p": np.array([p])}


def _models(row: dict, width: int, univariate: bool) -> Iterator[tuple[int, Block]]:
    """The block for each model: one with all covariates, or one for each with the rows that have it."""
    t, e = np.array(row["t"], np.float64), np.array(row["e"], np.int64)
    x = np.array(row["x"], np.float64).reshape(-1, width)
    if not univariate:
        yield 0, Block(t, e, x)
        return
    for j in range(width):
        some = ~np.isnan(x[:, j])
        if some.any():
            yield j, Block(t[some], e[some], x[some, j:j + 1])


PARTS = ("n", "n_events", "ll", "u", "i", "c", "t1", "t2")


def evaluate(packed: DataFrame, width: int, univariate: bool, betas: list[np.ndarray], ties: str,
             single: bool) -> dict[int, dict[str, np.ndarray]]:
    """Per model: n, n_events, ll, u (score) and i (information) at its beta."""
    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].values.to_numpy() if c != "b" else batch.column(c)[i].as_py() for c in ("b", "t", "e", "x")}

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows(batch):
                for model, block in _models(row, width, univariate):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["b"]], pa.int32()), pa.array([model], pa.int32()),
                         pa.array([block.totals(betas[model])], pa.list_(pa.float64()))], names=["b", "model", "sums"])

    schema = "b int, model int, sums array<double>"
    later: dict[tuple[int, int], np.ndarray] = {}
    if not single:
        found = sorted(((r["model"], r["b"], np.array(r["sums"])) for r in packed.mapInArrow(total, schema).collect()),
                       key=lambda r: (r[0], -r[1]))
        for k, (model, b, sums) in enumerate(found):
            above = found[k - 1] if k and found[k - 1][0] == model else None
            later[b, model] = later[above[1], model] + above[2] if above else np.zeros_like(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows(batch):
                for model, block in _models(row, width, univariate):
                    own = later.get((row["b"], model), np.zeros(block.x.shape[1] + 1))
                    out = block.evaluate(betas[model], own, ties)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["b"]], pa.int32()), pa.array([model], pa.int32()),
                         pa.array([np.concatenate([out[k] for k in PARTS])], pa.list_(pa.float64()))], names=["b", "model", "sums"])

    out: dict[int, dict[str, np.ndarray]] = {}
    earlier: dict[int, float] = {}
    for r in sorted(packed.mapInArrow(run, schema).collect(), key=lambda r: r["b"]):
        p = 1 if univariate else width
        sizes = np.cumsum([1, 1, 1, p, p * p, 1, p])
        one = dict(zip(PARTS, np.split(np.array(r["sums"]), sizes), strict=True))
        c = earlier.get(r["model"], 0.0)
        one["u"], one["i"] = one["u"] - c * one["t1"], (one["i"] + c * one["t2"]).reshape(p, p)
        earlier[r["model"]] = c + float(one["c"][0])
        sums = {"n": float(one["n"][0]), "n_events": float(one["n_events"][0]), "ll": float(one["ll"][0]), "u": one["u"], "i": one["i"]}
        held = out.get(r["model"])
        out[r["model"]] = sums if held is None else {k: held[k] + sums[k] for k in sums}
    return out
