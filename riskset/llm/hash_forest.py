"""Nearest neighbours by largest inner product with a hash-prefix forest.

Every vector gets, for each of ``TREES`` trees, a string of ``BITS`` hyperplane
signs. A tree is the sorted array of these strings: all strings that share a
prefix stand side by side, so a tree's node is a range of the array. The arrays
are cut into blocks; a directory (first and last string and size of each block,
bounded by ``TREES * MAX_BLOCKS`` rows) is all that any task holds of them.

A query descends in every tree at once to its place in the sorted array, where
the longest matching prefixes are, and then ascends in all trees
synchronously, one bit at a time, until the nodes hold ``budget`` vectors
together and one of them holds more than ``k``. Counting those takes one pass
over the strings (each block counts for the queries whose place it is, the
directory adds the blocks that lie wholly inside a node). All vectors of the
nodes are then scored, by matrix products of a block with the queries that
reach it. A query that ascends to the root is sent to one tree only, as each
tree holds every vector.

``budget`` is fitted: ``SAMPLE_QUERIES`` queries, chosen by a hash, are
compared with all vectors, and the smallest budget at which the forest finds
``recall`` of their neighbours is taken. Nothing caps a node: ranges that span
many blocks are scored in all of them.

Inner products rank like angles once each vector carries one more component,
sqrt(M^2 - |x|^2) with M the largest norm, and queries a zero there.

Of equal vectors only the ``k + 1`` smallest ids can be among anyone's ``k``
nearest, so further copies are left out of the arrays (they still ask).

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without an id; shorter vectors count as
zero in the components they lack; repeated rows (same id and vector) are one;
rows that share an id but not the vector are separate, and each has its own
ranks; equal scores go by the smaller id; a query's own row is no candidate;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskset.llm.common import stored

TREES = 32
BITS = 62
BLOCK = 4096                # vectors a block is aimed at
MAX_BLOCKS = 8192           # blocks a tree has at most; beyond that they grow
SAMPLE_VECTORS = 1 << 16    # expected size of the sample that places the block borders
SAMPLE_QUERIES = 96         # expected number of queries the budget is fitted on
ASKS = 20_000               # queries of a block that one task answers
CELLS = 1 << 22             # scores held at once
STEP = 2048                 # vectors hashed at once
RECALL = 0.95
SEED = 20


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    element = vectors.schema[embedding].dataType.elementType
    kept = element if isinstance(element, (T.FloatType, T.DoubleType)) else T.DoubleType()
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                          F.col(embedding).cast(T.ArrayType(kept)).alias("vector"))

    def sound(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
                      & F.forall("vector", sound) & F.exists("vector", lambda x: x != 0))


def _padded(rows: DataFrame, dim: int) -> DataFrame:
    zero = F.lit(0).cast(rows.schema["vector"].dataType.elementType)
    lacking = F.lit(dim) - F.size("vector")
    return rows.withColumn("vector", F.when(lacking > 0, F.concat("vector", F.array_repeat(zero, lacking)))
                           .otherwise(F.col("vector")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Hasher:
    """Sign strings of vectors, most significant bit first."""

    def __init__(self, dim: int, largest: float, trees: int, seed: int):
        self.dim, self.largest, self.trees, self.seed = dim, largest, trees, seed
        self.planes = None

    def __call__(self, x: np.ndarray, asking: bool) -> np.ndarray:
        """(rows, trees) strings as non-negative longs."""
        if self.planes is None:
            self.planes = self._planes()
        out = np.empty((len(x), self.trees), np.int64)
        for a in range(0, len(x), STEP):
            part = x[a:a + STEP] / self.largest
            lift = np.zeros(len(part)) if asking else np.sqrt(np.maximum(0, 1 - (part * part).sum(axis=1)))
            signs = (np.column_stack([part, lift]) @ self.planes > 0).reshape(len(part), self.trees, BITS)
            padded = np.zeros((len(part), self.trees, 64), np.uint8)
            padded[:, :, 64 - BITS:] = signs
            out[a:a + STEP] = np.packbits(padded, axis=2).view(">u8")[:, :, 0].astype(np.int64)
        return out

    def _planes(self) -> np.ndarray:
        """Random directions; those of a tree are at right angles as far as the dimension allows."""
        random, high = np.random.default_rng(self.seed), self.dim + 1
        own = []
        for _ in range(self.trees):
            sets = [np.linalg.qr(random.standard_normal((high, high)))[0] for _ in range(-(-BITS // high))]
            own.append(np.column_stack(sets)[:, :BITS])
        return np.column_stack(own)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"planes": None}


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two strings."""
    differ = np.bitwise_xor(a, b)
    return np.where(differ == 0, BITS, BITS - 1 - np.floor(np.log2(np.maximum(differ, 1) + 0.5)).astype(np.int64))


def node(h: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """First and last string that begin with the first ``depth`` bits of ``h``."""
    span = (np.int64(1) << (BITS - np.asarray(depth, np.int64))) - 1
    return h & ~span, h | span


class Directory:
    """First and last string, size and running size of each block, tree by tree."""

    def __init__(self, rows: list, trees: int):
        own: list[list] = [[] for _ in range(trees)]
        for r in sorted(rows, key=lambda r: (r["tree"], r["block"])):
            own[r["tree"]].append((r["block"], r["first"], r["last"], r["n"]))
        self.trees = [np.array(x, np.int64).reshape(-1, 4) for x in own]

    def home(self, tree: int, h: np.ndarray) -> np.ndarray:
        """Block at whose strings the query's place is."""
        d = self.trees[tree]
        return d[np.maximum(np.searchsorted(d[:, 1], h, "right") - 1, 0), 0]

    def reached(self, tree: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the tree's rows whose blocks have a string between lo and hi."""
        d = self.trees[tree]
        return np.searchsorted(d[:, 2], lo, "left"), np.searchsorted(d[:, 1], hi, "right")

    def wholly(self, tree: int, block: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Vectors in blocks, other than ``block``, that lie between lo and hi as a whole."""
        d = self.trees[tree]
        before = np.concatenate([[0], np.cumsum(d[:, 3])])
        a, b = np.searchsorted(d[:, 1], lo, "left"), np.searchsorted(d[:, 2], hi, "right")
        at = int(np.searchsorted(d[:, 0], block))
        own = np.where((a <= at) & (at < b), d[at, 3], 0)
        return np.where(b > a, before[b] - before[a], 0) - own


def _cut_points(sample: np.ndarray, blocks: int) -> list[np.ndarray]:
    """Borders between the blocks of each tree; equal strings may lie across several."""
    if not len(sample):
        return [np.zeros(0, np.int64)] * sample.shape[1]
    at = (np.arange(1, blocks) * len(sample)) // blocks
    return [np.sort(sample[:, t])[at] for t in range(sample.shape[1])]


def _forest(hasher: Hasher, cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                h = hasher(_matrix(part.column("vector"), hasher.dim), asking=False)
                turn = part.column("rid").to_numpy() * 0x9E3779B1 >> 7
                for t in range(hasher.trees):
                    low, high = (np.searchsorted(cuts[t], h[:, t], side) for side in ("left", "right"))
                    block = low + turn % (high - low + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(h), t, np.int32)), pa.array(block.astype(np.int32)), pa.array(h[:, t]),
                         part.column("rid"), part.column("vec_id"), part.column("vector")],
                        names=["tree", "block", "h", "rid", "vec_id", "vector"])

    return run


def _places(hasher: Hasher, directory: Directory):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hasher(_matrix(batch.column("vector"), hasher.dim), asking=True)
            for t in range(hasher.trees):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), t, np.int32)), pa.array(directory.home(t, h[:, t]).astype(np.int32)),
                     batch.column("qid"), pa.array(h[:, t])], names=["tree", "block", "qid", "h"])

    return run


def _deal(entries: DataFrame, asks: DataFrame):
    """Blocks with their queries; a block with many queries is dealt out in parts."""
    parts = F.broadcast(asks.groupBy("tree", "block").agg(
        F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("parts")))         # a row for each block at most
    key = ["tree", "block", "part"]
    left = entries.join(parts, ["tree", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = asks.join(parts, ["tree", "block"]).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
    return left.drop("parts").groupBy(*key).cogroup(right.drop("parts").groupBy(*key))


def _counted(directory: Directory):
    """(tree, qid, h, counts): vectors under the query's node at each depth from 0 to BITS."""
    schema = pa.schema([("tree", pa.int32()), ("qid", pa.int64()), ("h", pa.int64()), ("counts", pa.list_(pa.int64()))])

    def run(entries: pa.Table, asks: pa.Table) -> pa.Table:
        if not asks.num_rows or not entries.num_rows:
            return schema.empty_table()
        own, h = np.sort(entries["h"].to_numpy()), asks["h"].to_numpy()
        tree, block = entries["tree"][0].as_py(), entries["block"][0].as_py()
        counts = np.empty((len(h), BITS + 1), np.int64)
        for depth in range(BITS + 1):
            lo, hi = node(h, depth)
            counts[:, depth] = (np.searchsorted(own, hi, "right") - np.searchsorted(own, lo, "left")
                                + directory.wholly(tree, block, lo, hi))
        offsets = pa.array(np.arange(len(h) + 1, dtype=np.int32) * (BITS + 1))
        # A block with several parts counts once: every part holds all its strings.
        return pa.table([asks["tree"], asks["qid"], asks["h"],
                         pa.ListArray.from_arrays(offsets, pa.array(counts.ravel()))], schema=schema)

    return run


def stops(counts: np.ndarray, budget: int, need: int) -> np.ndarray:
    """Deepest level at which the nodes hold the budget and one of them ``need`` vectors; (queries, trees, levels)."""
    enough = (counts.sum(axis=1) >= budget) & (counts.max(axis=1) >= need)
    enough[:, 0] = True
    return BITS - np.argmax(enough[:, ::-1], axis=1)


def _levels(batch: pa.RecordBatch, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings and counts of the queries of a batch, by tree."""
    at = batch.column("at").flatten()
    tree = at.field("tree").to_numpy()
    order = np.argsort(np.repeat(np.arange(batch.num_rows), trees) * trees + tree, kind="stable")
    h = at.field("h").to_numpy()[order].reshape(-1, trees)
    counts = at.field("counts").flatten().to_numpy().reshape(-1, BITS + 1)[order]
    return h, counts.reshape(-1, trees, BITS + 1)


def _routes(directory: Directory, trees: int, budget: int, need: int):
    """(tree, block, qid, query_id, lo, hi, vector) for every block that a query's nodes reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, counts = _levels(batch, trees)
            depth = stops(counts, budget, need)
            rooted = depth == 0                         # one tree's root holds them all
            for t in range(trees):
                own = np.flatnonzero(~rooted) if t else np.arange(len(h))
                lo, hi = node(h[own, t], depth[own])
                a, b = directory.reached(t, lo, hi)
                n = np.maximum(b - a, 0)
                row = np.repeat(np.arange(len(own)), n)
                block = directory.trees[t][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[row], 0]
                for s in range(0, len(row), STEP):
                    r, taken = row[s:s + STEP], pa.array(own[row[s:s + STEP]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(r), t, np.int32)), pa.array(block[s:s + STEP].astype(np.int32)),
                         batch.column("qid").take(taken), batch.column("query_id").take(taken),
                         pa.array(lo[r]), pa.array(hi[r]), batch.column("vector").take(taken)],
                        names=["tree", "block", "qid", "query_id", "lo", "hi", "vector"])

    return run


def nearest_rows(x: np.ndarray, ids: np.ndarray, rids: np.ndarray, q: np.ndarray, own_id: int, rough: np.ndarray,
                 k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and exact scores of the ``k`` best for one query; ``rough`` scores may be off by ``slack``."""
    keep = np.arange(len(x))
    if len(x) > k + 1:
        keep = np.flatnonzero(rough >= np.partition(rough, len(x) - k - 1)[len(x) - k - 1] - slack)
    own = ids[keep] == own_id
    if own.any():
        own[own] = (x[keep[own]] == q).all(axis=1)
        keep = keep[~own]
    # One order of summation whatever the block: equal vectors get equal scores.
    score = (x[keep] * q).sum(axis=1)
    order = np.lexsort((rids[keep], ids[keep], -score))[:k]
    return keep[order], score[order]


def _scored(dim: int, k: int):
    schema = pa.schema([("qid", pa.int64()), ("query_id", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()),
                        ("score", pa.float64())])

    def run(entries: pa.Table, asks: pa.Table) -> pa.Table:
        if not asks.num_rows or not entries.num_rows:
            return schema.empty_table()
        entries = entries.sort_by("h")
        h, rids, ids = (entries[c].to_numpy() for c in ("h", "rid", "vec_id"))
        x, q = _matrix(entries["vector"], dim), _matrix(asks["vector"], dim)
        asker, asker_id = asks["qid"].to_numpy(), asks["query_id"].to_numpy()
        a = np.searchsorted(h, asks["lo"].to_numpy(), "left")
        b = np.searchsorted(h, asks["hi"].to_numpy(), "right")
        slack = 1e-13 * dim * np.sqrt((x * x).sum(axis=1).max()) * np.sqrt((q * q).sum(axis=1))
        # Queries of one node share a matrix product.
        order = np.lexsort((b, a))
        order = order[b[order] > a[order]]
        if not len(order):
            return schema.empty_table()
        cuts = np.flatnonzero((np.diff(a[order], prepend=-1) != 0) | (np.diff(b[order], prepend=-1) != 0))
        out: list[tuple] = []
        for s, e in zip(cuts, [*cuts[1:], len(order)], strict=True):
            lo, hi = a[order[s]], b[order[s]]
            height = max(1, CELLS // (hi - lo))
            for p in range(s, e, height):
                rows = order[p:min(e, p + height)]
                rough = q[rows] @ x[lo:hi].T
                for i, r in enumerate(rows):
                    at, score = nearest_rows(x[lo:hi], ids[lo:hi], rids[lo:hi], q[r], asker_id[r], rough[i], k, slack[r])
                    out.append((np.full(len(at), asker[r]), np.full(len(at), asker_id[r]), rids[lo + at], ids[lo + at],
                                score))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run


def _truth(hasher: Hasher, qids: np.ndarray, own_ids: np.ndarray, q: np.ndarray, k: int):
    """(qid, score, vec_id, rid, bits): each task's nearest of the sample's queries, with their longest shared prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = hasher(q, asking=True)
        kept: list[list] = [[] for _ in qids]
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                x = _matrix(part.column("vector"), hasher.dim)
                ids, rids = part.column("vec_id").to_numpy(), part.column("rid").to_numpy()
                rough = q @ x.T
                for i in range(len(qids)):
                    at, score = nearest_rows(x, ids, rids, q[i], own_ids[i], rough[i], k, 1e-9)
                    bits = shared_bits(hasher(x[at], asking=False), asked[i]).max(axis=1) if len(at) else at
                    kept[i] = sorted([*kept[i], *zip(-score, ids[at], rids[at], bits, strict=True)])[:k]
        rows = [(int(qids[i]), -float(s), int(v), int(r), int(b)) for i in range(len(qids)) for s, v, r, b in kept[i]]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(["qid", "score", "vec_id", "rid", "bits"],
                                                      map(list, zip(*rows, strict=True)), strict=True)))

    return run


def _fitted_budget(sample: DataFrame, candidates: DataFrame, levels: DataFrame, hasher: Hasher, k: int, need: int,
                   recall: float, size: int) -> int:
    """Smallest budget at which the sample's queries find ``recall`` of their neighbours."""
    asked = sample.toArrow()
    if not asked.num_rows:
        return 0
    qids = asked["qid"].to_numpy()
    q = _matrix(asked["vector"], hasher.dim)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid")
    truth = (candidates.select("rid", "vec_id", "vector")
             .mapInArrow(_truth(hasher, qids, asked["query_id"].to_numpy(), q, k),
                         "qid long, score double, vec_id long, rid long, bits long")
             .withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("qid", "bits").toArrow())
    got = levels.where(F.col("qid").isin([int(x) for x in qids])).select("qid", "at").toArrow().combine_chunks()
    batch = got.to_batches()[0]
    _, counts = _levels(batch, hasher.trees)
    place = {v: i for i, v in enumerate(batch.column("qid").to_pylist())}
    row = np.array([place[v] for v in truth["qid"].to_pylist()], np.int64)
    bits = truth["bits"].to_numpy()
    budget = k
    while budget < hasher.trees * size:
        if not len(row) or np.mean(bits >= stops(counts, budget, need)[row]) >= recall:
            return budget
        budget = max(budget + 1, int(budget * 1.25))
    return budget


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, recall: float = RECALL,
           vec_id: str = "vec_id", embedding: str = "embedding", seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the largest inner products."""
    base = _usable(vectors, vec_id, embedding).dropDuplicates(["vec_id", "vector"])
    copies = Window.partitionBy("vector").orderBy("vec_id")
    candidates = stored(base.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n")
                        .withColumn("rid", F.monotonically_increasing_id()), "vectors")
    asking = stored(_usable(queries, vec_id, embedding).dropDuplicates(["vec_id", "vector"])
                    .select(F.col("vec_id").alias("query_id"), "vector")
                    .withColumn("qid", F.monotonically_increasing_id()), "queries")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    size, dim, largest = candidates.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(norm)).first()
    n_asking, asking_dim = asking.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not size or not n_asking:
        return candidates.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), "vec_id",
                                          F.lit(0.0).alias("score"))
    dim = max(dim, asking_dim)
    candidates, asking = _padded(candidates, dim), _padded(asking, dim)
    hasher = Hasher(dim, largest if np.isfinite(largest) else np.finfo(np.float64).max, trees, seed)

    # Block borders from a sample of vectors: they place the work only.
    every = max(1, size // SAMPLE_VECTORS)
    seen = candidates.where(F.pmod(F.xxhash64("rid"), F.lit(every)) == 0).select("vector").toArrow()
    blocks = int(min(MAX_BLOCKS, max(1, -(-size // BLOCK))))
    cuts = _cut_points(hasher(_matrix(seen["vector"], dim), asking=False), blocks)
    forest = stored(candidates.select("rid", "vec_id", "vector").mapInArrow(
        _forest(hasher, cuts), T.StructType([
            T.StructField("tree", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("h", T.LongType()),
            T.StructField("rid", T.LongType()), T.StructField("vec_id", T.LongType()), candidates.schema["vector"]])), "forest")
    directory = Directory(forest.groupBy("tree", "block").agg(
        F.min("h").alias("first"), F.max("h").alias("last"), F.count(F.lit(1)).alias("n")).collect(), trees)

    places = stored(asking.select("qid", "vector").mapInArrow(
        _places(hasher, directory), "tree int, block int, qid long, h long"), "places")
    counted = _deal(forest.select("tree", "block", "h"), places).applyInArrow(
        _counted(directory), "tree int, qid long, h long, counts array<long>")
    levels = stored(counted.groupBy("qid").agg(F.collect_list(F.struct("tree", "h", "counts")).alias("at")), "levels")

    need = min(k + 1, size)
    every = max(1, n_asking // SAMPLE_QUERIES)
    sample = asking.where(F.pmod(F.xxhash64("qid", F.lit(seed)), F.lit(every)) == 0)
    budget = _fitted_budget(sample, candidates, levels, hasher, k, need, recall, size)
    routes = stored(asking.join(levels, "qid").mapInArrow(
        _routes(directory, trees, budget, need), T.StructType([
            T.StructField("tree", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("qid", T.LongType()),
            T.StructField("query_id", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()),
            asking.schema["vector"]])), "routes")
    found = _deal(forest, routes).applyInArrow(
        _scored(dim, k), "qid long, query_id long, rid long, vec_id long, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid")
    return (found.repartition("qid").dropDuplicates(["qid", "rid"]).withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
