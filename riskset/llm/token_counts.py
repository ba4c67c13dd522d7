"""Token counts with a two-tier lookup on the map side.

Tier one is a table of the corpus's most frequent pre-tokens with their
lengths in tokens, the same for all tasks: each task keeps a bounded summary
of the words it has seen, the summaries are summed, and the top ``frequent``
words are shipped as two flat arrays (a proven bound: at most so many words
of at most ``MAX_KEY`` bytes). Tier two is a bounded cache in each Python
worker for the words that are missing there. Words are never shuffled; only
the summaries are. The table decides speed, never the counts.

The tokenizer drops white space and works on each word alone, so a text's
tokens are its words' tokens.

Defined cases: null text is empty; empty texts count 0; repeated rows and null
ids are kept as they are; an empty table gives an empty result; texts of any
length are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskset.llm import pieces

FREQUENT = 1 << 15           # words in the shipped table
SUMMARY = 1 << 13            # words that a task reports
MAX_KEY = 64                 # bytes; longer words are left to the caches
WORKER_CACHE = 200_000       # entries of one cache generation
LIMIT = 2048                 # tokens


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}
    for batch in batches:
        for part in pieces.steps(batch):
            values, _ = pieces.split_words(part.column("text"))
            index, words = pieces.distinct(values)
            counts = np.bincount(index, minlength=len(words))
            top = np.argsort(-counts, kind="stable")[: 4 * SUMMARY]
            for i in top.tolist():
                if len(words[i]) <= MAX_KEY // 4:
                    seen[words[i]] = seen.get(words[i], 0) + int(counts[i])
            if len(seen) > 16 * SUMMARY:
                seen = dict(sorted(seen.items(), key=lambda x: -x[1])[: 4 * SUMMARY])
    top = sorted(seen.items(), key=lambda x: -x[1])[:SUMMARY]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()),
                                      pa.array([n for _, n in top], pa.int64())], names=["word", "n"])


def frequent_lengths(docs: DataFrame, path: str, frequent: int = FREQUENT) -> tuple[pa.Array, np.ndarray]:
    """The most frequent words and the number of tokens of each."""
    summed = docs.select("text").mapInArrow(_summaries, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n"))
    words = [r["word"] for r in summed.orderBy(F.desc("n"), "word").limit(frequent).select("word").collect()]
    lengths = np.fromiter(map(len, pieces.encoded(words, path)), np.uint16, len(words))
    return pa.array(words, pa.string()), lengths


def count(docs: DataFrame, path: str, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row per document."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, frequent))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths = table.value
        known = dict(zip(words.to_pylist(), lengths.tolist(), strict=True))
        cache = _worker_cache(path)
        for batch in batches:
            for part in pieces.steps(batch):
                values, counts = pieces.split_words(part.column("text"))
                index, own = pieces.distinct(values)
                found = [known.get(w) or cache.find(w) for w in own]
                missing = [i for i, n in enumerate(found) if n is None]
                for a in range(0, len(missing), 50_000):
                    some = missing[a:a + 50_000]
                    for i, ids in zip(some, pieces.encoded([own[i] for i in some], path), strict=True):
                        found[i] = len(ids)
                        cache.put(own[i], len(ids))
                tokens = pieces.sums(np.array(found, np.int64)[index], counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64()),
                     pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


_CACHES: dict[str, pieces.Cache] = {}


def _worker_cache(path: str) -> pieces.Cache:
    """Kept by the Python worker from task to task."""
    return _CACHES.setdefault(path, pieces.Cache(WORKER_CACHE))
