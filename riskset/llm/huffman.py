"""Token files: canonical length-limited Huffman codes over global id counts.

Texts are encoded once and their ids stored; the ids are counted over the
whole corpus, code lengths of at most ``MAX_BITS`` bits are found on the
driver by package-merge (a problem of the vocabulary's size, whatever the
corpus), and documents in ascending doc_id order are written as blocks.

File format, two Parquet tables in one folder:

* ``codebook``: id, bits. Codes are canonical: by (bits, id), counting up.
* ``blocks``: part, block, start (ids before it in its part), doc_ids,
  doc_sizes, payload (the bits, first bit highest), checkpoints (uint16, the
  bits of each ``STRIDE`` ids). Parts ascend in doc_id, blocks in their part.

A block is decoded without any other: each checkpoint starts an independent
lane, and all lanes advance one id a step through a table that is indexed by
the next ``MAX_BITS`` bits. A block holds whole documents.

Defined cases: null and empty texts have the end id only; rows of one doc_id
are neighbours in the file, the longer first, null ids before all; an empty
table gives empty files; an id whose bits would pass the limit is not possible,
as package-merge keeps them (the vocabulary must have at most 2**MAX_BITS ids).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskset.llm import pieces
from riskset.llm.common import shared_path, stored

MAX_BITS = 16
STRIDE = 128
BLOCK_IDS = 1 << 16
STEP_BYTES = 6 << 20         # of text that is encoded at once
WORKER_CACHE = 800_000       # entries of one cache generation
_CACHES: dict[str, pieces.Cache] = {}


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n, ids (little-endian uint16), the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _CACHES.setdefault(path, pieces.Cache(WORKER_CACHE))
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for part in pieces.steps(batch, size=STEP_BYTES):
                strings, index, counts = pieces.chunks(part.column("text"))
                used = np.zeros(len(strings), bool)
                used[index] = True
                found = list(map(cache.get, strings))
                missing = {}
                for i in np.flatnonzero(used).tolist():
                    if found[i] is None:
                        found[i] = cache.find(strings[i])
                        if found[i] is None:
                            missing.setdefault(strings[i], []).append(i)
                for x, ids in pieces.byte_level(list(missing), path, cache):
                    for i in missing[x]:
                        found[i] = ids
                    cache.put(x, ids)
                # The end id is one more piece behind each text's last.
                found.append(end)
                order = np.insert(index, np.cumsum(counts), len(strings))
                taken = pa.array(found, pa.binary()).take(pa.array(order))
                edges = np.concatenate([[0], np.cumsum(counts + 1)])
                offsets = np.frombuffer(taken.buffers()[1], np.int32)[edges]
                tokens = np.diff(offsets) // 2
                binary = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), taken.buffers()[2]])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens.astype(np.int64)), binary],
                                                 names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n long, ids binary")


def _ids(column: pa.Array) -> np.ndarray:
    """All ids of a binary column, one after the other."""
    column = pa.concat_arrays([column]) if column.offset else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[: len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, "<u2")
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view("<u2")


def id_counts(ids: DataFrame) -> dict[int, int]:
    """Global counts: at most one row per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(_ids(batch.column(0)), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in rows.collect()}


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Package-merge: bits of each id, at most ``limit``, with the least total."""
    if len(counts) > 1 << limit:
        raise ValueError(f"{len(counts)} ids do not fit into codes of {limit} bits")
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    n = len(symbols)
    if n < 2:
        return dict.fromkeys(symbols, 1)
    weights = np.array([counts[s] for s in symbols], np.int64)
    levels, merged = [np.ones(n, bool)], weights
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order < n)
        merged = both[order]
    # Walk back: of the cheapest items at a level, each symbol among them gets
    # a bit, and each package opens two items of the level below.
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    return dict(zip(symbols, bits.tolist(), strict=True))


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code and bits by id; id and bits by the next MAX_BITS bits of a stream."""
    code_of, bits_of = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint8)
    id_at, bits_at = np.zeros(1 << MAX_BITS, np.uint16), np.ones(1 << MAX_BITS, np.uint8)
    code, before = 0, 0
    for s, bits in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= bits - before
        before = bits
        code_of[s], bits_of[s] = code, bits
        low, high = code << (MAX_BITS - bits), (code + 1) << (MAX_BITS - bits)
        id_at[low:high], bits_at[low:high] = s, bits
        code += 1
    return code_of, bits_of, id_at, bits_at


def pack(ids: np.ndarray, code_of: np.ndarray, bits_of: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids`` and the bits of each stride."""
    bits = bits_of[ids].astype(np.int64)
    ends = np.cumsum(bits)
    at = ends - bits
    total = int(ends[-1]) if len(ends) else 0
    word = at >> 5
    # Each code fits into the 64 bits that start at its 32-bit word.
    wide = code_of[ids] << (64 - (at & 31) - bits).astype(np.uint64)
    out = np.zeros(total // 32 + 2, np.uint64)
    if len(ids):
        cuts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[cuts]] += np.add.reduceat(wide >> np.uint64(32), cuts)
        out[word[cuts] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), cuts)
    marks = np.append(at[::STRIDE], total)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], np.diff(marks).astype("<u2")


def unpack(payloads: list[bytes], marks: list[np.ndarray], sizes: np.ndarray,
           id_at: np.ndarray, bits_at: np.ndarray) -> np.ndarray:
    """All ids of several blocks: every checkpoint is a lane of its own."""
    if not sizes.sum():
        return np.zeros(0, np.uint16)
    raw = np.frombuffer(b"".join(payloads) + bytes(STRIDE * MAX_BITS // 8 + 8), np.uint8).astype(np.uint32)
    three = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    base = np.cumsum([0] + [8 * len(p) for p in payloads[:-1]])
    lanes = np.concatenate([b + np.cumsum(m, dtype=np.int64) - m for b, m in zip(base, marks, strict=True)])
    left = np.concatenate([np.minimum(STRIDE, n - np.arange(0, n, STRIDE)) for n in sizes.tolist()])
    out = np.empty((STRIDE, len(lanes)), np.uint16)
    for k in range(int(left.max())):
        peek = (three[lanes >> 3] >> (8 - (lanes & 7)).astype(np.uint32)) & 0xFFFF
        out[k] = id_at[peek]
        lanes = np.minimum(lanes + bits_at[peek], 8 * (len(three) - 1))
    return out.T[np.arange(STRIDE)[None, :] < left[:, None]]


def write(ids: DataFrame, path: str) -> None:
    """Write (doc_id, n, ids) to ``path`` in the file format above."""
    spark = ids.sparkSession
    lengths = code_lengths(id_counts(ids))
    spark.createDataFrame([(int(s), int(b)) for s, b in lengths.items()], "id int, bits int").coalesce(1) \
        .write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast(canonical(lengths)[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of, bits_of = book.value
        part, block, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            flat, ends = _ids(batch.column("ids")), np.cumsum(n)
            docs = batch.column("doc_id")
            cuts = np.flatnonzero(np.diff(np.maximum(ends - 1, 0) // BLOCK_IDS)) + 1
            rows: list[tuple] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)], strict=True):
                if a == b:
                    continue
                own = flat[ends[a] - n[a]:ends[b - 1]]
                payload, marks = pack(own, code_of, bits_of)
                rows.append((part, block, start, docs.slice(a, b - a).to_pylist(), n[a:b].tolist(), payload,
                             marks.tobytes()))
                block, start = block + 1, start + len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(),
                     pa.binary()])],
                names=["part", "block", "start", "doc_ids", "doc_sizes", "payload", "checkpoints"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.desc("n"), "ids").mapInArrow(
        run, "part int, block int, start long, doc_ids array<long>, doc_sizes array<long>, payload binary, "
             "checkpoints binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode a written folder: doc_id, start, n_tokens, ids_crc32."""
    book = spark.read.parquet(f"{path}/codebook").collect()          # one row per id of the vocabulary
    tables = spark.sparkContext.broadcast(canonical({r["id"]: r["bits"] for r in book})[2:])
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per part: as many as there were shuffle partitions.
    sizes = blocks.select("part", F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")) \
        .groupBy("part").agg(F.sum("n").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_at, bits_at = tables.value
        for batch in batches:
            for a in range(0, len(batch), 16):
                rows = batch.slice(a, 16).to_pylist()
                n = np.array([sum(r["doc_sizes"]) for r in rows], np.int64)
                ids = unpack([r["payload"] for r in rows], [np.frombuffer(r["checkpoints"], "<u2") for r in rows], n,
                             id_at, bits_at).astype("<u4")
                per = np.array([x for r in rows for x in r["doc_sizes"]], np.int64)
                ends = np.cumsum(per)
                start = np.concatenate([r["start"] + np.cumsum([0, *r["doc_sizes"][:-1]]) for r in rows])
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), per.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for r in rows for x in r["doc_ids"]], pa.int64()), pa.array(start.astype(np.int64)),
                     pa.array(per), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shifted = blocks.join(F.broadcast(before), "part").select(
        "doc_ids", "doc_sizes", "payload", "checkpoints", (F.col("start") + F.col("before")).alias("start"))
    return shifted.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encode, write, read back: a row per document, from the files."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write(stored(tokenize(docs, tokenizer_path, end_id), "ids", compression="zstd"), path)
    return read(spark, path)
