"""Near-duplicates: MinHash bands, odd sketches, exact confirmation, components.

A document's set is its distinct five-word shingles. Texts with equal sets are
one node, so a group of copies costs one node whatever its size. Each node has
``BANDS * ROWS`` MinHash values. Nodes that agree on all rows of a band meet in
a bucket; at similarity s a pair is missed by all bands with probability
(1 - s**ROWS)**BANDS, 3e-10 for 0.85 and 3e-7 for 0.8.

The values are also folded into an odd sketch, a bitmap in which bit
``hash(i, value_i)`` is flipped once per value. The population count of the
XOR of two sketches estimates their similarity, most precisely when it is
high; pairs are verified only if the estimate is at most ``MARGIN`` below the
threshold, more than five standard deviations.

Buckets are not expanded into pairs. First every node is compared with the
smallest node of its bucket; links that full sets confirm give components.
Then, where a bucket still holds several components, its nodes are dealt out
with their sets in blocks of bounded size. Inside a task, pairs from different
components that pass the estimate are confirmed on the sets, best estimate
first, in the block of the first band they share; a confirmed link joins two
components, so a block gives fewer links than it has nodes. Pairs inside one
component need no link.

A node is the 128-bit digest of its set. Its name is one half of it; where two
sets share that half, both are renamed by the whole digest.

Defined cases: null text, or a text without words, has the empty set, is
linked with nothing and is its own component; fewer words than five are one
shingle; rows with the same doc_id and different texts are separate nodes that
share their doc_id; null doc_ids count as the smallest; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.llm import pieces
from riskset.llm.common import is_small, key_id, plain_id, stored
from riskset.llm.components import components

SHINGLE = 5
KEY = ["doc_id", "_th"]
BANDS, ROWS = 38, 5
SKETCH_BITS = 512
MARGIN = 0.16
BLOCK = 4096                 # nodes of a bucket that are compared in one task
BLOCK_SHINGLES = 2 << 20     # and shingles of them: 16 MB
BASE = 0x9E3779B97F4A7C15
_RNG = np.random.default_rng(20240607)
FLIP = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
TIMES = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
SLICE = 1024                 # shingles hashed at once: their values stay in the processor's cache


def max_odd_bits(estimate: float) -> int:
    """Odd bits that two sketches have at the estimated similarity."""
    samples = BANDS * ROWS
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * samples * (1 - estimate) / SKETCH_BITS)))


def sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    values, counts = pieces.split_words(texts, lower=True)
    words = pieces.word_hashes(values)
    factors = [np.uint64(pow(BASE, k, 1 << 64)) for k in range(shingle)]
    total = np.zeros(max(0, len(words) - shingle + 1), np.uint64)
    for k in range(shingle):
        total += words[k:k + len(total)] * factors[shingle - 1 - k]
    total = pieces.mixed(total)
    at = 0
    for n in counts.tolist():
        if n >= shingle:
            yield np.unique(total[at:at + n - shingle + 1])
        elif n:
            h = np.uint64(n)
            for w in words[at:at + n]:
                h = pieces.mixed(np.array([h ^ w]))[0]
            yield np.array([h], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
        at += n


def minhash(shingles: np.ndarray) -> np.ndarray:
    small = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    values = np.empty((min(SLICE, len(small)), BANDS * ROWS), np.uint32)
    for a in range(0, len(small), SLICE):
        part = small[a:a + SLICE, None]
        own = values[:len(part)]
        np.bitwise_xor(part, FLIP, out=own)
        np.multiply(own, TIMES, out=own)
        np.minimum(best, own.min(axis=0), out=best)
    return best


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in values.reshape(BANDS, ROWS).T:
        keys = pieces.mixed(keys * np.uint64(BASE) ^ r.astype(np.uint64))
    return keys.view(np.int64)


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities as 64-bit words."""
    numbered = values.astype(np.uint64) | (np.arange(len(values), dtype=np.uint64) << np.uint64(32))
    place = pieces.mixed(numbered) % np.uint64(SKETCH_BITS)
    parity = (np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _features(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces.steps(batch):
                size, node, rest, bands, sketch, seen = [], [], [], [], [], {}
                for s in sets(part.column("text"), shingle):
                    size.append(len(s))
                    if not len(s):
                        node.append(None)
                        rest.append(None)
                        bands.append(None)
                        sketch.append(None)
                        continue
                    digest = _digest(s)
                    if digest not in seen:                    # copies within the batch
                        values = minhash(s)
                        seen[digest] = band_keys(values), odd_sketch(values)
                    low, high = _halves(digest)
                    node.append(low)
                    rest.append(high)
                    bands.append(seen[digest][0])
                    sketch.append(seen[digest][1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_th"), pa.array(size, pa.int64()), pa.array(node, pa.int64()),
                     pa.array(rest, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    names=["doc_id", "_th", "n_shingles", "node", "_rest", "bands", "sketch"])
    return run


def _node_sets(shingle: int):
    """(node, text) -> (node, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces.steps(batch):
                own = [s.tobytes() for s in sets(part.column("text"), shingle)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(own, pa.binary())], names=["node", "set"])
    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * common >= percent * (len(p) + len(q) - common)


def _block_links(percent: int, max_odd: int):
    """Links of a block that join different components: a spanning forest of them."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        label, size, node = block["label"].to_numpy(), block["n_shingles"].to_numpy(), block["node"].to_numpy()
        part, ordinal = block["_part"].to_numpy(), int(block["_ordinal"].iloc[0])
        within = part.min() == part.max()
        sketch = np.array(block["sketch"].tolist(), np.int64).reshape(len(block), -1).view(np.uint64)
        bands = np.array(block["bands"].tolist(), np.int64).reshape(len(block), -1)
        sets_ = [np.frombuffer(x, np.uint64) for x in block["set"]]
        # Component of each node, as far as this task knows.
        _, own, counts = np.unique(label, return_inverse=True, return_counts=True)
        links = []
        # Nodes of the largest component are met from the others' side.
        for i in np.flatnonzero(own != counts.argmax()):
            odd = np.bitwise_count(sketch ^ sketch[i]).sum(axis=1)
            near = (odd <= max_odd) & (own != own[i])
            near &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
            near &= (part != part[i]) | within
            close = np.flatnonzero(near)
            close = close[(bands[close] == bands[i]).argmax(axis=1) == ordinal]
            for j in close[np.argsort(odd[close], kind="stable")].tolist():
                if own[j] != own[i] and _similar(sets_[i], sets_[j], percent):
                    links.append((min(node[i], node[j]), max(node[i], node[j])))
                    own[own == own[j]] = own[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")
    return run


def _hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th")


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def _full_sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Stored (node, set) of the wanted nodes, from the text of each node's first document."""
    one = stored(nodes.join(wanted, "node").select("one.*", "node"), "wanted")
    found = texts.join(_hinted(one), KEY).select("node", "text").dropDuplicates(["node"])
    return stored(found.mapInArrow(_node_sets(shingle), "node long, set binary"), "sets")


def _named(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows whose node name several digests share are renamed by the whole digest."""
    side = _hinted(shared).withColumn("_shared", F.lit(True))
    name = F.when(F.col("_shared"), F.xxhash64("node", "_rest")).otherwise(F.col("node"))
    return rows.join(side, "node", "left").withColumn("node", name).drop("_shared", "_rest")


def classes(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, node, _th (hash of the text) and chosen: a row per document.

    ``kept`` goes by the doc_id; ``chosen`` is one (doc_id, _th) of each component.
    """
    texts = docs.select(key_id(), F.col("text").cast("string"), _hash())
    rows = stored(texts.mapInArrow(_features(shingle), "doc_id long, _th long, n_shingles long, node long, _rest long, "
                                   "bands array<long>, sketch array<long>"), "features")
    digests = stored(rows.where("node is not null").groupBy("node", "_rest").agg(
        F.min(F.struct("doc_id", "_th")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch")), "nodes")
    shared = stored(digests.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("node"), "shared")
    nodes, rows = _named(digests, shared), _named(rows, shared)
    max_odd = max_odd_bits(percent / 100 - MARGIN)
    banded = nodes.select("node", "n_shingles", F.posexplode("bands").alias("ordinal", "band"))
    hubs = stored(banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("_last"))
                  .where("hub < _last").drop("_last"), "hubs")
    members = stored(banded.join(_hinted(hubs), "band"), "members")
    stars = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    info = nodes.select("node", "n_shingles", "sketch")
    seen = stars.join(info.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"),
                                  F.col("sketch").alias("sa")), "a").join(
        info.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb")), "b")
    odd = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        odd = odd + F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k]))
    pairs = stored(seen.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (odd <= max_odd))
                   .select("a", "b"), "stars")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = _full_sets(texts, nodes, ends, shingle)
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(
        own.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    links = stored(both.mapInArrow(_confirmed(percent), "a long, b long"), "confirmed")
    # Buckets that still hold several components: links across them.
    labels = stored(components(links), "labels")
    labelled = members.join(_hinted(labels), "node", "left").select(
        "band", "ordinal", "node", "n_shingles", F.coalesce("label", "node").alias("label"))
    split = stored(labelled.groupBy("band").agg(
        F.min("label").alias("_a"), F.max("label").alias("_b"),
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("_blocks"))
        .where("_a < _b").select("band", "_blocks"), "split")
    left = stored(labelled.join(_hinted(split), "band"), "left")
    payload = nodes.select("node", "sketch", "bands").join(
        _full_sets(texts, nodes, left.select("node").distinct(), shingle), "node")
    mine = F.pmod(F.col("node"), F.col("_blocks")).cast("int")
    block = F.explode(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(
        F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))).alias("_block")
    dealt = left.join(payload, "node").select(
        "band", F.col("ordinal").alias("_ordinal"), "node", "label", "n_shingles", "sketch", "bands", "set",
        mine.alias("_part"), block)
    more = dealt.groupBy("band", "_block").applyInPandas(_block_links(percent, max_odd), "a long, b long")
    # Labelled nodes stand for their confirmed links.
    known = labels.select(F.col("label").alias("a"), F.col("node").alias("b"))
    labels = stored(components(known.unionByName(stored(more, "more"))), "labels")
    member = nodes.select("node", "one").join(_hinted(labels), "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    smallest = member.groupBy("label").agg(F.min("one").alias("_one"))
    named = stored(member.join(smallest, "label").select(
        "node", F.col("_one.doc_id").alias("component_id"), F.col("_one._th").alias("_own")), "named")
    out = rows.select(*KEY, "n_shingles", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    same = (F.col("doc_id") == component) & (F.col("_th") == F.coalesce("_own", "_th"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      (F.col("doc_id") == component).alias("kept"), "node", "_th", same.alias("chosen"))


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: null ids as they were."""
    return classes(docs).select(plain_id(), "n_shingles", plain_id("component_id"), "kept")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each component, all columns as they were: the smallest doc_id, of its texts the smallest hash.

    Of rows that agree in this doc_id and in the text one is kept, the first by a digest of all columns.
    """
    judged = stored(classes(docs, percent).select(*KEY, "chosen"), "judged")
    gone = stored(judged.where(~F.col("chosen")).select(*KEY).distinct(), "gone")
    twice = stored(judged.where("chosen").groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                   .select(*KEY, F.lit(True).alias("_twice")), "twice")
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), key_id(), _hash())
    left = packed.join(_hinted(gone), KEY, "left_anti").join(_hinted(twice), KEY, "left")
    once = left.where("_twice is null").select("_row.*")
    first = left.where("_twice").groupBy(*KEY).agg(F.min_by("_row", F.md5(F.to_json("_row"))).alias("_row")).select("_row.*")
    return once.unionByName(first)
