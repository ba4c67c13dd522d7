"""Substring dedup by level-wise doubling of repeated windows.

Windows that repeat between documents at one length alone are extended to
twice that length; here half of ``length`` words, then ``length``. (Longer
levels would cover no further word: each repeated window of 100 words consists
of repeated windows of 50, so the levels end at the length asked for.)

The first level does not list every position. A window of ``length`` words
holds 26 half windows; the one with the smallest hash is its anchor, and equal
windows have equal anchors at equal offsets. About every thirteenth position
is an anchor of some window, and only anchors are compared between documents:
no repeated window is lost. Windows whose anchor repeats are the candidates of
the second level, which are compared by 96 bits of two polynomial hashes.

Texts that are equal as a whole are one text from the start: the later copies
are covered by the first one. Hot windows are reduced by a partial aggregate
to their smallest document, then joined back, where adaptive execution can
split a window that a third of all documents share.

Defined cases: null text has no words; a null doc_id is smaller than all
others; rows with the same doc_id are not smaller than each other; texts of
fewer than ``length`` words keep all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskset.llm import pieces
from riskset.llm.common import is_small, key_id, later_copies, plain_id, stored

LENGTH = 50
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)     # odd: a changed word always changes the hash
KEY = ["doc_id", "_th"]


def _windows(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``length`` words, joined from windows of 1, 2, 4, ... words."""

    def joined(left: np.ndarray, n: int, right: np.ndarray, m: int) -> np.ndarray:
        size = max(0, len(words) - n - m + 1)
        return left[:size] * np.uint64(pow(base, m, 1 << 64)) + right[n:][:size]

    power, n, done, m = words, 1, None, 0
    while True:
        if length & n:
            done, m = (power, n) if done is None else (joined(done, m, power, n), m + n)
        if 2 * n > length:
            return done
        power, n = joined(power, n, power, n), 2 * n


def _slide(x: np.ndarray, width: int, op: Callable) -> np.ndarray:
    """``op`` over all stretches of ``width`` values."""
    size = 1
    while 2 * size <= width:
        x, size = op(x[:-size], x[size:]) if len(x) > size else x[:0], 2 * size
    rest = width - size
    return op(x[:-rest], x[rest:]) if rest and len(x) > rest else (x[:0] if rest else x)


def _place(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in its row of each word."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - (np.cumsum(counts) - counts)[row]


def anchors(hashes: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors in the words of a batch, and their hashes."""
    half = (length + 1) // 2
    reach = length - half + 1                                 # half windows in a window
    row, place = _place(counts)
    values = pieces.mixed(_windows(hashes, half, BASES[0])) | np.uint64(1)
    least = _slide(values, reach, np.minimum)
    whole = (place + length <= counts[row])[: len(least)]
    least = np.where(whole, least, np.uint64(0))
    # A position is an anchor if one of the windows that hold it has it as its least.
    pad = np.zeros(reach - 1, np.uint64)
    best = _slide(np.concatenate([pad, least, pad]), reach, np.maximum)[: len(values)]
    at = np.flatnonzero((best == values[: len(best)]) & (best > 0))
    return at, values[at]


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces.steps(batch):
                values, counts = pieces.split_words(part.column("text"))
                if not len(values):
                    continue
                at, h = anchors(pieces.word_hashes(values), counts, length)
                row, place = _place(counts)
                own = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), part.column("doc_id").take(own), part.column("_th").take(own),
                     pa.array(place[at].astype(np.int32))], names=["h", "doc_id", "_th", "pos"])
    return run


def _window_rows(length: int, back: int):
    """Hashes of the windows that start at most ``back`` words before a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces.steps(batch):
                values, counts = pieces.split_words(part.column("text"))
                if not len(values):
                    continue
                hashes = pieces.word_hashes(values)
                hits = part.column("hits")
                first = np.cumsum(counts) - counts
                size = np.diff(hits.offsets.to_numpy())
                at = np.repeat(first, size) + hits.flatten().to_numpy()
                row, place = _place(counts)
                edge = np.zeros(len(row) + 1, np.int64)
                np.add.at(edge, np.maximum(at - back, np.repeat(first, size)), 1)
                np.add.at(edge, at + 1, -1)
                start = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (place + length <= counts[row]))
                own = pa.array(row[start])
                a, b = (_windows(hashes, length, base)[start] for base in BASES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pieces.mixed(a).view(np.int64)),
                     pa.array((pieces.mixed(b) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                     part.column("doc_id").take(own), part.column("_th").take(own),
                     pa.array(place[start].astype(np.int32))], names=["a", "b", "doc_id", "_th", "start"])
    return run


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first): what occurs in more than one document. Stored, so that the
    join back has a plain shuffle on both sides and hot keys can be split."""
    return stored(rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                  .where("first < last").drop("last"), "repeated")


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, _th, text) -> stored (doc_id, _th, bounds): the words that a smaller document holds too.

    ``bounds`` are the sorted starts of the first and last window of each run
    of windows that touch or overlap; an empty list means the whole text.
    """
    later = later_copies(texts)
    once = texts.join(_hinted(later), KEY, "left_anti")
    found = stored(once.mapInArrow(_anchor_rows(length), "h long, doc_id long, _th long, pos int"), "anchors")
    again = found.join(_repeated(found, ["h"]), "h")
    hits = stored(again.groupBy(*KEY).agg(F.collect_set("pos").alias("hits")), "hits")
    candidates = once.join(_hinted(hits), KEY)
    half = (length + 1) // 2
    rows = stored(candidates.mapInArrow(_window_rows(length, length - half),
                                        "a long, b int, doc_id long, _th long, start int"), "windows")
    covered = rows.join(_repeated(rows, ["a", "b"]), ["a", "b"]).where("doc_id > first").select(*KEY, "start").distinct()
    # Runs of windows: keep the first and the last start of each.
    order = Window.partitionBy(*KEY).orderBy("start")
    runs = covered.withColumns({"_p": F.lag("start").over(order), "_q": F.lead("start").over(order)})
    first = F.col("_p").isNull() | (F.col("start") - F.col("_p") > length)
    last = F.col("_q").isNull() | (F.col("_q") - F.col("start") > length)
    ends = runs.select(*KEY, F.explode(F.filter(F.array(F.when(first, F.col("start")), F.when(last, F.col("start"))),
                                                lambda x: x.isNotNull())).alias("start"))
    spans = ends.groupBy(*KEY).agg(F.sort_array(F.collect_list("start")).alias("bounds"))
    whole = later.withColumn("bounds", F.array().cast("array<int>"))
    return stored(spans.unionByName(whole), "spans")


def _kept_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces.steps(batch):
                kept, total, gone = [], [], []
                for text, bounds in zip(part.column("text"), part.column("bounds").to_pylist(), strict=True):
                    words = _blank_split(text.as_py() or "")
                    n = len(words)
                    if bounds is not None:
                        drop = np.zeros(n, bool)
                        if not bounds and n >= length:
                            drop[:] = True
                        for a, b in zip(bounds[::2], bounds[1::2], strict=True):
                            drop[a:b + length] = True
                        words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                    kept.append(" ".join(words))
                    total.append(n)
                    gone.append(n - len(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
    return run


def _blank_split(text: str) -> list[str]:
    """Words between ASCII blanks only: bytes, as str.split() knows more blanks."""
    return [w.decode() for w in text.encode().split()]


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the kept words joined by one space."""
    texts = docs.select(key_id(), F.col("text").cast("string"),
                        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th"))
    marked = texts.join(_hinted(repeats(texts, length)), KEY, "left").select("doc_id", "text", "bounds")
    out = marked.mapInArrow(_kept_rows(length), "doc_id long, n_words long, n_removed long, kept string")
    return out.select(plain_id(), "n_words", "n_removed", "kept")
