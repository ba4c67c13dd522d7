"""Ranked lexical search with bit-sliced Bloom signatures.

A document's signature sets ``HASHES`` rows for each distinct term, and again
for the term at each of the ``TIERS`` its count reaches (2, 4, 8, ... times),
so that one signature says, never too low, in which range a count lies.
Signatures of documents of like size are stored side by side as a block: a row
of the block is a bitmap over its documents.

For a query, the rows of a term at a tier are intersected; the bitmap marks all
documents that may hold the term so often. Bitmaps, weighted by the terms, are
summed over the query for each tier. With the document's length known, the sum
at a tier times the gain of that tier bounds the score from above: a term's
part is at most what it would be at the greatest count of its range.

The ``FIRST`` documents with the highest bounds are scored exactly; their
``k``-th best score is a threshold that the final ``k``-th best cannot be below.
Every document whose bound reaches the threshold is then scored exactly from
its text, so nothing that could be in the result is missed.

A text (named by 128 bits of hash) is scored once however many documents have
it, and stands for the ``k`` of them with the smallest ids. Signatures and the
statistics of the queries' vocabulary come from one pass over the texts.

Queries are answered in batches of at most ``BATCH_TERMS`` terms, a pass over the
signatures (not the texts) for each.

Defined cases: null text has no terms; a query without terms, or with none that
a document holds, has no rows; equal scores go by doc_id, a missing one last, and
then by text hash; repeated rows are separate documents, each with a rank; queries
that share an id are answered apart; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskset.llm import pieces
from riskset.llm.common import NO_ID, is_small, key_id, lower_az, plain_id, stored, words

# All of ASCII but digits and letters separates terms.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HASHES = 4
ROWS_PER_TERM = 14          # rows of a signature for each of its terms: about a quarter of the bits are set
TIERS = (1, 2, 4, 8, 16, 64)
CELLS = 1 << 22             # rows times documents of a block
FIRST = 30                  # documents with the highest bounds that give the threshold
BATCH_TERMS = 50_000        # query terms answered in one pass

SCORE_UNIT, PART_UNIT = 1_000_000_000, 1000


def _byte_table() -> np.ndarray:
    table = np.full(256, ord(" "), np.uint8)
    for c in (*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)):
        table[c] = c
    table[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


TABLE = _byte_table()


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of each text and their number."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    offsets, data = texts.buffers()[1], texts.buffers()[2]
    plain = TABLE[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)
    kind = pa.string() if texts.type == pa.string() else pa.large_string()
    return pieces.split_words(pa.Array.from_buffers(kind, len(texts), [None, offsets, pa.py_buffer(plain)], offset=texts.offset))


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(text, term, count) of the distinct terms of each text, the batch's terms, and all terms of a text."""
    values, counts = split_terms(texts)
    index, known = pieces.distinct(values)
    key = np.repeat(np.arange(len(counts)), counts) * max(1, len(known)) + index
    key, n = np.unique(key, return_counts=True)
    return key // max(1, len(known)), key % max(1, len(known)), n, known, counts


class _Held:
    """Documents that hold each term of a vocabulary, all documents with a term, and all their terms."""

    def __init__(self, vocabulary: list[str]):
        self.wanted = pa.array(vocabulary, pa.string())
        self.df, self.docs, self.total = np.zeros(len(vocabulary), np.int64), 0, 0

    def add(self, term: np.ndarray, known: list[str], counts: np.ndarray) -> None:
        at = pc.fill_null(pc.index_in(pa.array(known, pa.string()), self.wanted), -1).to_numpy(zero_copy_only=False)[term]
        self.df += np.bincount(at[at >= 0], minlength=len(self.df))
        self.docs, self.total = self.docs + int((counts > 0).sum()), self.total + int(counts.sum())

    def rows(self) -> list[pa.Array]:
        """(term, df, total); all documents have no term."""
        some = np.flatnonzero(self.df)
        return [pa.concat_arrays([self.wanted.take(pa.array(some)), pa.nulls(1, pa.string())]),
                pa.array([*self.df[some].tolist(), self.docs], pa.int64()), pa.array([0] * len(some) + [self.total], pa.int64())]


def _statistics(vocabulary: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(vocabulary)
        for batch in batches:
            for part in pieces.steps(batch):
                _, term, _, known, counts = term_counts(part.column("text"))
                held.add(term, known, counts)
        yield pa.RecordBatch.from_arrays(held.rows(), names=["term", "df", "total"])

    return run


def part_score(tf, m):
    """A term's part of the score, before its weight; 64-bit integers."""
    return (SCORE_UNIT * tf) // (PART_UNIT * tf + 8 * m)


def measure(n, docs: int, total: int):
    """m of a document of n terms."""
    return 100 - 75 + (75 * n * docs) // total


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def rows_of(hashes: np.ndarray, tier: int, height: int) -> np.ndarray:
    """(terms, HASHES) rows that a term sets at a tier."""
    h = pieces.mixed(hashes + np.uint64((tier * 0x9E3779B97F4A7C15) & (2 ** 64 - 1)))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(height)).astype(np.int64)


def _hashes(terms: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in terms), np.uint64, len(terms))


class _Shelf:
    """Documents of one size class that wait to become a block."""

    def __init__(self, size_class: int):
        self.height = ROWS_PER_TERM << size_class
        self.width = max(8, min(4096, CELLS // self.height) // 8 * 8)
        self.docs: list[tuple] = []

    def block(self) -> tuple:
        """(two text hashes, lengths, rows): the rows are bitmaps over the documents."""
        bits = np.zeros((self.height, self.width), bool)
        for column, (_, _, _, hashes, counts) in enumerate(self.docs):
            for tier, least in enumerate(TIERS):
                own = hashes[counts >= least]
                if not len(own):
                    break
                bits[rows_of(own, tier, self.height).ravel(), column] = True
        a, b, n = (np.array([d[i] for d in self.docs], np.int64) for i in range(3))
        self.docs = []
        return a, b, n, np.packbits(bits, axis=1)


BLOCKS = ("height int, width int, a array<long>, b array<long>, lengths array<long>, bits binary, "
          "term string, df long, total long")
COLUMNS = [x.split()[0] for x in BLOCKS.split(", ")]


def _signatures(vocabulary: list[str]):
    """Blocks of signatures and, from the same pass, the statistics of a vocabulary."""
    def row(shelf: _Shelf) -> pa.RecordBatch:
        a, b, n, bits = shelf.block()
        return pa.RecordBatch.from_arrays(
            [pa.array([shelf.height], pa.int32()), pa.array([shelf.width], pa.int32()),
             *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (a, b, n)), pa.array([bits.tobytes()]),
             pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelves: dict[int, _Shelf] = {}
        held = _Held(vocabulary)
        for batch in batches:
            for part in pieces.steps(batch):
                text, term, counts, known, n = term_counts(part.column("text"))
                held.add(term, known, n)
                hashes = _hashes(known)
                a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
                cuts = np.searchsorted(text, np.arange(len(n) + 1))
                for i in np.flatnonzero(n):
                    own, tf = hashes[term[cuts[i]:cuts[i + 1]]], counts[cuts[i]:cuts[i + 1]]
                    entries = sum(int((tf >= least).sum()) for least in TIERS)
                    size_class = max(5, math.ceil(math.log2(entries)))
                    shelf = shelves.setdefault(size_class, _Shelf(size_class))
                    shelf.docs.append((a[i], b[i], n[i], own, tf))
                    if len(shelf.docs) == shelf.width:
                        yield row(shelf)
        for shelf in shelves.values():
            if shelf.docs:
                yield row(shelf)
        stats = held.rows()
        some = len(stats[0])
        kinds = [pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(some, k) for k in kinds), *stats], names=COLUMNS)

    return run


class Queries:
    """A batch of queries: distinct terms with hashes, and each query's terms with weights."""

    def __init__(self, rows: list, docs: int, total: int):
        self.docs, self.total = docs, total
        self.terms = sorted({t["term"] for r in rows for t in r["terms"]})
        place = {t: i for i, t in enumerate(self.terms)}
        self.numbers = [r["item"] for r in rows]
        self.at = [np.array([place[t["term"]] for t in r["terms"]], np.int64) for r in rows]
        self.weights = [np.array([t["n"] * weight(t["df"], docs) for t in r["terms"]], np.int64) for r in rows]
        self.hashes = _hashes(self.terms)

    def tiers(self, row: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each tier: where a term's bitmap is (-1: in no document), bitmaps, and gain of each document."""
        bits = np.frombuffer(row["bits"], np.uint8).reshape(row["height"], row["width"] // 8)
        m = measure(np.array(row["lengths"], np.int64), self.docs, self.total)
        out, before, alive = [], np.zeros(len(m), np.int64), np.arange(len(self.terms))
        for tier, top in enumerate([x - 1 for x in TIERS[1:]] + [None]):
            rows = rows_of(self.hashes[alive], tier, row["height"])
            both = bits[rows[:, 0]]
            for j in range(1, HASHES):
                both &= bits[rows[:, j]]
            some = both.any(axis=1)
            # A term that no document may hold so often is at no higher tier either.
            alive, both = alive[some], both[some]
            if not len(alive):
                break
            place = np.full(len(self.terms), -1)
            place[alive] = np.arange(len(alive))
            best = SCORE_UNIT // PART_UNIT if top is None else part_score(top, m)
            out.append((place, both, best - before))
            before = before + out[-1][2]
        return out

    def bounds(self, row: dict) -> Iterator[tuple[int, np.ndarray]]:
        """Queries and the scores that the documents of a block cannot exceed for them."""
        tiers, used = self.tiers(row), len(row["lengths"])
        for q, (at, w) in enumerate(zip(self.at, self.weights, strict=True)):
            out = None
            for place, both, gain in tiers:
                own = place[at]
                held = own >= 0
                if not held.any():
                    break
                may = np.unpackbits(both[own[held]], axis=1, count=used)
                part = (w[held].astype(np.float64) @ may) * gain
                out = part if out is None else out + part
            if out is not None:
                yield q, out


def _first(queries: Queries, count: int):
    """(item, bound, a, b) of each task's documents with the highest bounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple]] = [[] for _ in queries.numbers]
        for batch in batches:
            for row in batch.to_pylist():
                for q, bound in queries.bounds(row):
                    high = np.flatnonzero(bound > (kept[q][-1][0] if len(kept[q]) == count else 0))
                    if len(high):
                        # Copies of a text have equal bounds and count once.
                        high = high[np.argsort(-bound[high], kind="stable")]
                        both = {*kept[q]}
                        for d in high:
                            both.add((float(bound[d]), row["a"][d], row["b"][d]))
                            if len(both) >= 2 * count:
                                break
                        kept[q] = sorted(both, reverse=True)[:count]
        rows = [(queries.numbers[q], *x) for q, own in enumerate(kept) for x in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
            names=["item", "bound", "a", "b"])

    return run


def _reaching(queries: Queries, threshold: dict[int, int]):
    """(item, a, b) of all texts whose bound is not below the item's threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.array(row[c], np.int64) for c in ("a", "b"))
                for q, bound in queries.bounds(row):
                    item = queries.numbers[q]
                    # A sum of doubles may fall short of the true one by its last bits.
                    d = np.flatnonzero(bound * (1 + 1e-9) >= max(1, threshold.get(item, 1)))
                    if len(d):
                        texts = np.unique(np.column_stack([a[d], b[d]]), axis=0)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(texts), item, np.int64)), pa.array(texts[:, 0].copy()),
                             pa.array(texts[:, 1].copy())], names=["item", "a", "b"])

    return run


def _exact(queries: Queries):
    """(item, a, b, score) of texts with the list of items to score them for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(queries.terms, pa.string())
        number = {x: q for q, x in enumerate(queries.numbers)}
        tf = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for part in pieces.steps(batch):
                text, term, counts, known, n = term_counts(part.column("text"))
                at = pc.fill_null(pc.index_in(pa.array(known, pa.string()), wanted), -1).to_numpy(zero_copy_only=False)[term]
                cuts = np.searchsorted(text, np.arange(len(n) + 1))
                out: list[tuple] = []
                for i, (a, b, items) in enumerate(zip(*(part.column(c).to_pylist() for c in ("a", "b", "items")), strict=True)):
                    own, held = at[cuts[i]:cuts[i + 1]], counts[cuts[i]:cuts[i + 1]]
                    held, own = held[own >= 0], own[own >= 0]
                    tf[own] = held
                    m = measure(int(n[i]), queries.docs, queries.total)
                    for item in items:
                        q = number[item]
                        out.append((item, a, b, int((queries.weights[q] * part_score(tf[queries.at[q]], m)).sum())))
                    tf[own] = 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)],
                                                 names=["item", "a", "b", "score"])

    return run


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def _scores(pairs: DataFrame, texts: DataFrame, keys: DataFrame, queries: Queries, name: str) -> DataFrame:
    """Stored (item, a, b, score) of stored (item, a, b) pairs; one document of each text is read."""
    asked = stored(pairs.groupBy("a", "b").agg(F.collect_set("item").alias("items")), f"{name}-asked")
    lead = keys.join(_hinted(asked.select("a", "b")), ["a", "b"]).groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))
    asked = stored(asked.join(lead, ["a", "b"]), f"{name}-lead")
    scored = texts.join(_hinted(asked), ["a", "b", "doc_id"]).select("a", "b", "items", "text").mapInArrow(
        _exact(queries), "item long, a long, b long, score long")
    return stored(scored.where("score > 0").groupBy("item", "a", "b").agg(F.max("score").alias("score")), name)


def _query_batches(terms: DataFrame) -> Iterator[list]:
    """Queries of at most ``BATCH_TERMS`` terms together, or one longer query."""
    sizes = stored(terms.groupBy("item").agg(F.collect_list(F.struct("term", "n", "df")).alias("terms")), "queries")
    batch, held = [], 0
    for row in sizes.toLocalIterator():
        if batch and held + len(row["terms"]) > BATCH_TERMS:
            yield batch
            batch, held = [], 0
        batch, held = [*batch, row], held + len(row["terms"])
    if batch:
        yield batch


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents that score highest for each item."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), key_id("doc_id"), text.alias("text"))
    named = stored(items.select("item_id", words(lower_az(F.col("text")), SEPARATORS).alias("_words"))
                   .withColumn("item", F.monotonically_increasing_id()), "items")
    terms = stored(named.select("item", F.explode("_words").alias("term")).groupBy("item", "term").agg(
        F.count(F.lit(1)).alias("n")), "terms")
    parts = max(1, -(-terms.count() // BATCH_TERMS))
    vocabulary = stored(terms.select("term").distinct().withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts))), "vocabulary")

    def own(part: int) -> list[str]:
        return [r[0] for r in vocabulary.where(F.col("part") == part).select("term").collect()]

    # Signatures and the statistics of the first part of the vocabulary in one pass; others take one each.
    blocks = stored(texts.select("a", "b", "text").mapInArrow(_signatures(own(0)), BLOCKS), "signatures")
    held = blocks.where("bits is null").select("term", "df", "total")
    docs_n, total = held.where("term is null").agg(F.sum("df"), F.sum("total")).first()
    for part in range(1, parts):
        held = held.unionByName(stored(texts.select("text").mapInArrow(
            _statistics(own(part)), "term string, df long, total long"), "held"))
    found = held.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    terms = terms.join(found, "term")
    blocks = blocks.where("bits is not null").drop("term", "df", "total")
    keys = stored(texts.select("a", "b", "doc_id"), "keys")

    best = Window.partitionBy("item").orderBy(F.desc("bound"), "a", "b")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"))
    result = None
    for batch in _query_batches(terms):
        queries = Queries(batch, docs_n, total)
        first = stored(blocks.mapInArrow(_first(queries, FIRST), "item long, bound double, a long, b long")
                       .dropDuplicates(["item", "a", "b"]).withColumn("_n", F.row_number().over(best))
                       .where(F.col("_n") <= FIRST).select("item", "a", "b"), "first")
        threshold = (_scores(first, texts, keys, queries, "first-scores")
                     .withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") == k).select("item", "score").collect())
        pairs = stored(blocks.mapInArrow(_reaching(queries, {r["item"]: r["score"] for r in threshold}),
                                         "item long, a long, b long").distinct(), "reaching")
        # The k best texts of each item, with all that tie.
        top = (_scores(pairs, texts, keys, queries, "scores").withColumn("_n", F.rank().over(by_score))
               .where(F.col("_n") <= k).drop("_n"))
        result = top if result is None else result.unionByName(top)
    if result is None:
        return named.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                                     F.lit(0).cast("long").alias("score"))
    result = stored(result, "best")
    # Of equal texts the k with the smallest ids can be listed.
    last = F.col("doc_id") == F.lit(NO_ID).cast("long")
    same = Window.partitionBy("a", "b").orderBy(last, "doc_id")
    rows = (keys.join(_hinted(stored(result.select("a", "b").distinct(), "best-texts")), ["a", "b"])
            .withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), last, "doc_id", "a", "b", "copy")
    ranked = result.join(rows, ["a", "b"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", plain_id("doc_id"), "score")
