"""Random forest whose cost does not grow with passes times nodes (M4).

Splits are chosen among the quantile bins of each feature, by Gini impurity
over a random sqrt(features) of them, on a Poisson bootstrap, as in MLlib's
forest. What differs is the way there. A node that holds more than
``LOCAL_CELLS`` cells is split by histograms that Spark sums over all rows;
rows of a node below that are shuffled to one task by (tree, node), which
grows the rest of that tree in memory. So a forest takes a few passes over the
rows instead of one per level, and no task or group holds more than a bounded
part of a tree. A model is a table of such parts, not a graph on the driver.

Draws are hashes of (seed, tree, row) and (seed, tree, node, feature): every
pass and every retry sees the same bootstrap, and trees do not depend on how
rows are dealt out once they have their numbers.

Defined cases: a missing value (NaN) lies above every cut; a feature with one
value is never split; leaves under one node that predict the same class are
merged, as in MLlib.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params as MLParams, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskset.session import materialize

LOCAL_CELLS = 1 << 19   # rows x features of a node that one task grows to its end
WIDE_NODES = 8192       # nodes whose histograms one pass over the rows sums
NODES_A_GROUP = 64      # of them in one group of the sum
STEP_ROWS = 4096        # rows that a task routes through all trees at once
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
_PARTS = ("tree int, slot int, feature binary, cut binary, child binary, prob binary, gains binary, stats binary, leaf boolean")


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: a bijection whose bits all depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _seeded(seed: int, tree: int) -> np.uint64:
    return _mixed(np.array([seed * 1_000_003 + tree + 1], np.int64).astype(np.uint64))[0]


def bag(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in the tree's bootstrap: Poisson(1) from the row's number."""
    u = (_mixed(_mixed(rows.astype(np.uint64)) ^ _seeded(seed, tree)) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, u, side="right")


def drawn(nodes: np.ndarray, features: int, seed: int, tree: int) -> np.ndarray:
    """The features tried at each node (numbered as in a heap): ceil(sqrt(features)) of them."""
    m = math.ceil(math.sqrt(features))
    own = _mixed(nodes.astype(np.uint64) ^ _seeded(~seed, tree))
    h = _mixed(own[:, None] + np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.argpartition(h, m - 1, axis=1)[:, :m] if m < features else np.tile(np.arange(features), (len(nodes), 1))


def _gini(s: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Impurity times weight."""
    return total - np.divide((s * s).sum(-1), total, out=np.zeros_like(total), where=total > 0)


def best_cut(hist: np.ndarray) -> tuple[np.ndarray, ...]:
    """(nodes, tried, bins, classes + 1) sums -> place, bin, gain and the left sums of the best cut.

    The last channel counts rows. A cut at bin b sends bins up to b to the left.
    """
    cum = hist.cumsum(2)
    whole = cum[:, :, -1:]
    left, right = cum[:, :, :-1], whole - cum[:, :, :-1]
    wl, wr, w = left[..., :-1].sum(-1), right[..., :-1].sum(-1), whole[..., :-1].sum(-1)
    lost = (_gini(whole[..., :-1], w) - _gini(left[..., :-1], wl) - _gini(right[..., :-1], wr)) / np.where(w > 0, w, 1.0)
    gain = np.where((left[..., -1] > 0) & (right[..., -1] > 0), lost, -1.0)
    flat = gain.reshape(len(hist), -1)
    at = flat.argmax(1)
    place, b = np.divmod(at, gain.shape[2])
    rows = np.arange(len(hist))
    return place, b, flat[rows, at], left[rows, place, b]


LEAST_GAIN = 1e-12      # below it a gain is rounding


def histogram(bins: np.ndarray, node: np.ndarray, tried: np.ndarray, nodes: int, width: int, label: np.ndarray,
              weight: np.ndarray, classes: int) -> np.ndarray:
    """(nodes, tried, width, classes + 1) sums over rows; ``tried`` lists each row's node's features."""
    out = np.empty((nodes, tried.shape[1], width, classes + 1))
    flat, base = bins.ravel(), np.arange(len(node)) * bins.shape[1]
    for j in range(tried.shape[1]):
        at = node * width + flat[base + tried[node, j]]
        out[:, j, :, :classes] = np.bincount(at * classes + label, weight, nodes * width * classes).reshape(nodes, width, classes)
        out[:, j, :, classes] = np.bincount(at, minlength=nodes * width).reshape(nodes, width)
    return out


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, root: int, depth: int, width: int, classes: int,
         seed: int, tree: int) -> dict:
    """A subtree below heap node ``root`` as arrays, level after level; pruned."""
    feature, cut, child, stats, gains = [], [], [], [], []
    node, heap, offset = np.zeros(len(label), np.int64), np.array([root], np.int64), 0
    level = int(root).bit_length() - 1
    while len(heap):
        n = len(heap)
        s = np.bincount(node * classes + label, weight, n * classes).reshape(n, classes)
        f, c, to, g = np.zeros(n, np.int32), np.zeros(n, np.uint8), np.full(n, -1, np.int64), np.zeros(n)
        open_ = np.flatnonzero(((s > 0).sum(1) > 1) & (level < depth))
        if len(open_):
            rank = np.full(n, -1)
            rank[open_] = np.arange(len(open_))
            own = rank[node]
            held = own >= 0
            bins, label, weight, node = bins[held], label[held], weight[held], own[held]
            tried = drawn(heap[open_], bins.shape[1], seed, tree)
            place, b, gain, _ = best_cut(histogram(bins, node, tried, len(open_), width, label, weight, classes))
            good = np.flatnonzero(gain > LEAST_GAIN)
            split = open_[good]
            f[split], c[split] = tried[good, place[good]], b[good]
            to[split] = offset + n + 2 * np.arange(len(good))
            g[split] = gain[good] * s[split].sum(1)
            rank = np.full(len(open_), -1)
            rank[good] = np.arange(len(good))
            own = rank[node]
            held = own >= 0
            bins, label, weight, own = bins[held], label[held], weight[held], own[held]
            right = bins[np.arange(len(own)), f[split][own]] > c[split][own]
            node = 2 * own + right
            heap = (2 * heap[split][:, None] + np.arange(2)).ravel()
        else:
            heap = heap[:0]
        feature.append(f), cut.append(c), child.append(to), stats.append(s), gains.append(g)
        offset, level = offset + n, level + 1
    return pruned(*map(np.concatenate, (feature, cut, child, stats, gains)))


def pruned(feature: np.ndarray, cut: np.ndarray, child: np.ndarray, stats: np.ndarray, gains: np.ndarray) -> dict:
    """Merges leaves of one parent and one prediction, from the bottom, and drops what is not reached."""
    guess = stats.argmax(1)
    child = child.copy()
    # Children lie behind their parents: settled level by level, deepest first.
    inner = np.flatnonzero(child >= 0)
    while len(inner):
        kids = child[inner]
        same = (child[kids] < 0) & (child[kids + 1] < 0) & (guess[kids] == guess[kids + 1])
        if not same.any():
            break
        child[inner[same]] = -1
        inner = inner[~same]
    reached = np.zeros(len(child), bool)
    front = np.zeros(1, np.int64)
    while len(front):
        reached[front] = True
        kids = child[front[child[front] >= 0]]
        front = np.concatenate([kids, kids + 1])
    place = np.cumsum(reached) - 1
    leaf = child < 0
    kept = np.flatnonzero(reached)
    ends = kept[leaf[kept]]
    to = np.where(leaf, 0, place[np.where(leaf, 0, child)])
    to[ends] = -1 - np.arange(len(ends))
    total = stats[ends].sum(1, keepdims=True)
    prob = np.divide(stats[ends], total, out=np.full((len(ends), stats.shape[1]), 1.0 / stats.shape[1]), where=total > 0)
    return {"feature": feature[kept], "cut": cut[kept], "child": to[kept].astype(np.int32), "prob": prob,
            "gains": (feature[kept][~leaf[kept]], gains[kept][~leaf[kept]]), "stats": stats[0], "leaf": bool(leaf[0])}


def route(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The node at which each row ends (a negative child)."""
    at, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
    flat, wide = bins.ravel(), bins.shape[1]
    while len(live):
        own = at[live]
        to = child[own]
        inner = to >= 0
        live, own, to = live[inner], own[inner], to[inner]
        at[live] = to + (flat[live * wide + feature[own]] > cut[own])
    return at


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each cell: how many cuts lie below it; NaN is above all."""
    out = np.empty(values.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, values[:, j], side="left")
    return out


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), features)


def find_cuts(values: DataFrame, features: int, max_bins: int) -> list[np.ndarray]:
    """At most ``max_bins - 1`` cuts per feature of all rows of ``values`` (array column ``x``):
    between neighbours of few distinct values, else at quantiles (rank error 0.001)."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * features
        for batch in batches:
            m = _matrix(batch.column(0), features)
            for j in range(features):
                if len(seen[j]) <= max_bins:
                    seen[j] = np.union1d(seen[j], m[~np.isnan(m[:, j]), j])[:max_bins + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(features), [len(s) for s in seen]).astype(np.int32)),
             pa.array(np.concatenate(seen) if seen else np.zeros(0))], names=["j", "v"])

    found = (values.select("x").mapInArrow(few, "j int, v double").distinct().groupBy("j")
             .agg(F.slice(F.array_sort(F.collect_set("v")), 1, max_bins + 1).alias("v")).collect())
    distinct = {r["j"]: np.array(r["v"]) for r in found}
    cuts = [distinct.get(j, np.zeros(0)) for j in range(features)]
    many = [j for j, c in enumerate(cuts) if len(c) > max_bins]
    cuts = [(c[1:] + c[:-1]) / 2 for c in cuts]
    for a in range(0, len(many), 64):
        some = many[a:a + 64]
        wide = values.select(*[F.col("x")[j].alias(f"x{j}") for j in some])
        found = wide.approxQuantile([f"x{j}" for j in some], [k / max_bins for k in range(1, max_bins)], 0.001)
        for j, q in zip(some, found, strict=True):
            cuts[j] = np.unique(q)
    return cuts


def _blob(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _part(tree: int, slot: int, g: dict, features: int) -> tuple:
    where, gains = g["gains"]
    return (tree, slot, _blob(g["feature"], "<i4"), _blob(g["cut"], "u1"), _blob(g["child"], "<i4"), _blob(g["prob"], "<f8"),
            _blob(np.bincount(where, gains, features), "<f8"), _blob(g["stats"], "<f8"), g["leaf"])


class _Top:
    """The upper nodes of one tree while it grows, on the driver: nodes of more than ``LOCAL_CELLS`` cells and their children."""

    def __init__(self, wide: bool):
        self.heap, self.feature, self.cut, self.child, self.gain = [1], [0], [0], [-1], [0.0]
        self.wide, self.stats, self.leaves = [wide], [None], []

    def settle(self, at: int, whole: np.ndarray) -> None:
        """A leaf however many rows it holds: none of them is dealt out."""
        self.stats[at] = whole
        self.leaves.append(at)

    def split(self, at: int, f: int, b: int, gain: float, whole: np.ndarray, sides: list[tuple[np.ndarray, bool]]) -> None:
        self.feature[at], self.cut[at], self.child[at], self.stats[at] = f, b, len(self.heap), whole
        self.gain[at] = gain * whole.sum()
        for right, (stats, wide) in enumerate(sides):
            self.heap.append(2 * self.heap[at] + right)
            self.feature.append(0), self.cut.append(0), self.child.append(-1), self.gain.append(0.0)
            self.wide.append(wide), self.stats.append(stats)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.int64), np.array(self.cut), np.array(self.child, np.int64)


def _rows(train: DataFrame, label: str, weight: str | None, cuts: list[np.ndarray]) -> DataFrame:
    """row, bins, label, weight of all training rows, stored: what every later pass reads."""
    held = train.sparkSession.sparkContext.broadcast(cuts)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, features = TaskContext.get().partitionId() << 40, len(held.value)
        for batch in batches:
            b = binned(_matrix(batch.column("x"), features), held.value)
            bins = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(
                (np.arange(len(batch) + 1) * features).astype(np.int32)), pa.py_buffer(b.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(batch))), bins, batch.column("y"), batch.column("w")],
                                             names=["row", "bins", "y", "w"])
            at += len(batch)

    spread = train.select("x", F.col(label).cast("int").alias("y"), w.alias("w")).repartition(_tasks(train.sparkSession))
    return materialize(spread.mapInArrow(run, "row long, bins binary, y int, w double"))


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _steps(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, ...]]:
    for whole in batches:
        for a in range(0, len(whole), STEP_ROWS):
            batch = whole.slice(a, STEP_ROWS)
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(batch), features)
            yield batch.column("row").to_numpy(), bins, batch.column("y").to_numpy().astype(np.int64), batch.column("w").to_numpy()


def _wide_pass(rows: DataFrame, tops: list[_Top], wide: list[tuple[int, int]], features: int, width: int, classes: int,
               seed: int) -> dict:
    """(tree, node) -> feature, bin, gain, left sums and all sums, from histograms over all rows."""
    spark, m = rows.sparkSession, math.ceil(math.sqrt(features))
    plan, number = {}, 0
    for t in sorted({t for t, _ in wide}):
        own = np.array([n for u, n in wide if u == t])
        plan[t] = (tops[t].arrays(), own, drawn(np.array([tops[t].heap[n] for n in own]), features, seed, t), number)
        number += len(own)
    names = [(t, int(n)) for t, (_, own, _, _) in plan.items() for n in own]
    tried = np.concatenate([d for _, _, d, _ in plan.values()])
    held, shape = spark.sparkContext.broadcast(plan), (m, width, classes + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((number, *shape))
        for row, bins, y, w in _steps(batches, features):
            for t, (top, own, draws, first) in held.value.items():
                k = bag(row, seed, t)
                place = np.full(len(top[0]), -1)
                place[own] = np.arange(len(own))
                at = place[route(bins, *top)]
                ok = (at >= 0) & (k > 0)
                total[first:first + len(own)] += histogram(bins[ok], at[ok], draws, len(own), width, y[ok], (w * k)[ok], classes)
        some = np.flatnonzero(total.reshape(number, -1).any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array((some // NODES_A_GROUP).astype(np.int32)), pa.array(some.astype(np.int32)),
             pa.array([total[i].tobytes() for i in some], pa.binary())], names=["bunch", "node", "hist"])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(group["node"], return_inverse=True)
        total = np.zeros((len(names), *shape))
        for i, h in zip(at, group["hist"], strict=True):
            total[i] += np.frombuffer(h).reshape(shape)
        place, b, gain, left = best_cut(total)
        whole = total[:, 0].sum(1)
        return pd.DataFrame({"node": names, "place": place, "cut": b, "gain": gain, "own_left": [x.tolist() for x in left],
                             "whole": [x.tolist() for x in whole]})

    found = rows.mapInArrow(count, "bunch int, node int, hist binary").groupBy("bunch").applyInPandas(
        choose, "node int, place int, cut int, gain double, own_left array<double>, whole array<double>").collect()
    return {names[r["node"]]: (int(tried[r["node"], r["place"]]), r["cut"], r["gain"], np.array(r["own_left"]), np.array(r["whole"]))
            for r in found}


def _subtrees(rows: DataFrame, tops: list[_Top], features: int, width: int, classes: int, depth: int, seed: int) -> DataFrame:
    """The part of each tree below each last node of its top, grown where that node's rows meet."""
    held = rows.sparkSession.sparkContext.broadcast([(t.arrays(), np.array(t.heap), t.leaves) for t in tops])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, bins, y, w in _steps(batches, features):
            out: list[tuple] = []
            for t, (top, _, leaves) in enumerate(held.value):
                k = bag(row, seed, t)
                ok = np.flatnonzero(k)
                at = route(bins[ok], *top)
                for slot in np.setdiff1d(at, leaves).tolist():
                    own = ok[at == slot]
                    out.append((t, slot, bins[own].tobytes(), _blob(y[own], "<i4"), _blob((w * k)[own], "<f8")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate([pa.int32(), pa.int32()] + [pa.binary()] * 3)],
                names=["tree", "slot", "bins", "y", "w"])

    def finish(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree, slot = int(key[0]), int(key[1])
        bins = np.frombuffer(b"".join(group["bins"]), np.uint8).reshape(-1, features)
        y = np.frombuffer(b"".join(group["y"]), "<i4").astype(np.int64)
        w = np.frombuffer(b"".join(group["w"]), "<f8")
        g = grow(bins, y, w, int(held.value[tree][1][slot]), depth, width, classes, seed, tree)
        return pd.DataFrame([_part(tree, slot, g, features)], columns=[c.split()[0] for c in _PARTS.split(", ")])

    dealt = rows.mapInArrow(deal, "tree int, slot int, bins binary, y binary, w binary")
    return dealt.repartition(_tasks(rows.sparkSession), "tree", "slot").groupBy("tree", "slot").applyInPandas(finish, _PARTS)


def fit(train: DataFrame, label: str, weight: str | None, trees: int = 200, depth: int = 30, max_bins: int = 32,
        seed: int = 42, features_col: str = "features") -> "ForestModel":
    """Forest on the vectors of ``features_col``; labels are 0, 1, ..."""
    values = train.withColumn("x", vector_to_array(features_col))
    first = values.select(F.size("x").alias("p")).first()
    top_label = train.agg(F.max(label), F.min(label), F.count(F.lit(1)), F.count(label),
                          F.max(F.col(label) != F.floor(label))).first()
    if first is None or top_label[2] != top_label[3] or top_label[1] < 0 or top_label[4]:
        raise ValueError(f"{label} must hold 0, 1, ... in every row, and there must be rows")
    features, classes = first["p"], max(2, int(top_label[0]) + 1)
    cuts = find_cuts(values, features, max_bins)
    rows = _rows(values, label, weight, cuts)
    width = max(2, max(len(c) for c in cuts) + 1)
    most = max(1024, LOCAL_CELLS // features)
    tops = [_Top(top_label[2] > most) for _ in range(trees)]
    while wide := [(t, n) for t, top in enumerate(tops) for n, w in enumerate(top.wide) if w]:
        for a in range(0, len(wide), WIDE_NODES):
            some = wide[a:a + WIDE_NODES]
            found = _wide_pass(rows, tops, some, features, width, classes, seed)
            for t, n in some:
                top = tops[t]
                f, b, gain, left, whole = found[t, n]
                top.wide[n], right = False, whole - left
                if gain <= LEAST_GAIN or top.heap[n].bit_length() > depth:
                    top.settle(n, whole[:-1])
                    continue
                top.split(n, f, b, gain, whole[:-1], [(s[:-1], bool(s[-1] > most)) for s in (left, right)])
    parts = materialize(_subtrees(rows, tops, features, width, classes, depth, seed))
    return _finished(parts, tops, cuts, classes)


def _finished(parts: DataFrame, tops: list[_Top], cuts: list[np.ndarray], classes: int) -> "ForestModel":
    """Tops pruned like parts, importances, and one table of both (slot -1: a tree's top)."""
    spark, features = parts.sparkSession, len(cuts)
    roots = {(r["tree"], r["slot"]): r for r in parts.select("tree", "slot", "gains", "stats", "leaf").collect()}
    total = np.zeros(features)
    rows, gone = [], []
    for t, top in enumerate(tops):
        feature, cut, child = top.arrays()
        own, dropped = np.zeros(features), set()
        settled: dict[int, np.ndarray] = {}     # leaves: parts of one node, and merged top nodes
        for n in reversed(range(len(child))):
            r = roots.get((t, n))
            if child[n] < 0:
                if r is None or r["leaf"]:
                    # A node without a part was settled above, or its tree drew no rows.
                    settled[n] = np.frombuffer(r["stats"]) if r else top.stats[n] if n in top.leaves else np.zeros(classes)
                continue
            a, b = int(child[n]), int(child[n]) + 1
            if a in settled and b in settled and settled[a].argmax() == settled[b].argmax():
                settled[n], child[n] = top.stats[n], -1
                dropped |= {a, b}
            else:
                own[feature[n]] += top.gain[n]
        for n in range(len(child)):
            if child[n] < 0 and n not in dropped:
                if (t, n) in roots:
                    own += np.frombuffer(roots[t, n]["gains"])
                else:
                    s = settled[n]
                    prob = s / s.sum() if s.sum() > 0 else np.full(classes, 1.0 / classes)
                    rows.append((t, n, _blob(np.zeros(1), "<i4"), _blob(np.zeros(1), "u1"), _blob(np.array([-1]), "<i4"),
                                 _blob(prob, "<f8"), _blob(np.zeros(features), "<f8"), _blob(s, "<f8"), True))
        gone += [(t, n) for n in dropped if (t, n) in roots]
        empty = _blob(np.zeros(0), "<f8")
        rows.append((t, -1, _blob(feature, "<i4"), _blob(cut, "u1"), _blob(child, "<i4"), empty, empty, empty, False))
        if own.sum() > 0:
            total += own / own.sum()
    if gone:
        parts = parts.join(F.broadcast(spark.createDataFrame(gone, "tree int, slot int")), ["tree", "slot"], "left_anti")
    importances = total / total.sum() if total.sum() > 0 else total
    table = materialize(parts.unionByName(spark.createDataFrame(rows, _PARTS)))
    model = ForestModel()._set(cuts=json.dumps([c.tolist() for c in cuts]), classes=classes, importances=importances.tolist())
    model.parts = table
    return model


def joined(parts: list) -> list[tuple[np.ndarray, ...]]:
    """Per tree (in order): feature, cut, child and leaf probabilities, the parts hung below its top."""
    by_tree: dict[int, list] = {}
    for r in parts:
        by_tree.setdefault(r["tree"], []).append(r)
    out = []
    for t in sorted(by_tree):
        top, *below = sorted(by_tree[t], key=lambda r: r["slot"])
        feature, cut, child = [np.frombuffer(top["feature"], "<i4").copy()], [np.frombuffer(top["cut"], "u1").copy()], \
            [np.frombuffer(top["child"], "<i4").copy()]
        at, leaves, probs = len(feature[0]), 0, []
        for r in below:
            f, c, to = np.frombuffer(r["feature"], "<i4"), np.frombuffer(r["cut"], "u1"), np.frombuffer(r["child"], "<i4")
            to = np.where(to >= 0, to + at, to - leaves).astype(np.int32)
            feature[0][r["slot"]], cut[0][r["slot"]], child[0][r["slot"]] = f[0], c[0], to[0]
            feature.append(f), cut.append(c), child.append(to)
            probs.append(np.frombuffer(r["prob"], "<f8"))
            at, leaves = at + len(f), leaves + int((to < 0).sum())
        out.append((*map(np.concatenate, (feature, cut, child)), np.concatenate(probs)))
    return out


class ForestModel(Model, MLReadable, MLWritable):
    """Fitted forest: mean leaf probabilities over the trees, and the class with the greatest."""
    featuresCol = Param(MLParams._dummy(), "featuresCol", "column of vectors", TypeConverters.toString)
    cuts = Param(MLParams._dummy(), "cuts", "cuts of each feature, as JSON", TypeConverters.toString)
    classes = Param(MLParams._dummy(), "classes", "number of classes", TypeConverters.toInt)
    importances = Param(MLParams._dummy(), "importances", "importance of each feature", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features")
        self.parts: DataFrame | None = None
        self._held = None

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.getOrDefault(self.importances))

    def _transform(self, df: DataFrame) -> DataFrame:
        classes = self.getOrDefault(self.classes)
        if self._held is None:
            cuts = [np.array(c) for c in json.loads(self.getOrDefault(self.cuts))]
            trees = joined(self.parts.select("tree", "slot", "feature", "cut", "child", "prob").collect())
            self._held = df.sparkSession.sparkContext.broadcast((cuts, trees))
        held = self._held

        def vote(x: pd.Series) -> pd.Series:
            cuts, trees = held.value
            bins = binned(np.stack(x.to_numpy()).astype(float).reshape(len(x), len(cuts)), cuts)
            total = np.zeros((len(x), classes))
            for feature, cut, child, prob in trees:
                total += prob.reshape(-1, classes)[-1 - child[route(bins, feature, cut, child)]]
            total /= len(trees)
            total[:, 0] = 1.0 - total[:, 1:].sum(1)     # so that they sum to 1 and the cut at a half is exact
            return pd.Series(list(total))

        voted = F.pandas_udf(vote, "array<double>")(vector_to_array(self.getOrDefault(self.featuresCol)))
        out = df.withColumn("probability", array_to_vector(voted))
        p = vector_to_array("probability")
        return out.withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double"))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.parts.write.parquet(f"{path}/parts")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.parts = self.sparkSession.read.parquet(f"{path}/parts")
        return model
