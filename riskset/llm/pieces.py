"""Arrow and NumPy helpers for the operators that work in Python tasks.

Spark deals the rows out; these functions work on one Arrow batch at a time,
column-wise. Per-string Python runs only over a batch's distinct strings.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash

# Bytes of text that one step works on; longer texts come alone.
STEP_BYTES = 2 << 20


class Cache(dict):
    """A dict of two generations that holds at most ``2 * limit`` entries."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def find(self, key):
        value = self.get(key)
        if value is None and key in self.old:
            value = self[key] = self.old.pop(key)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def steps(batch: pa.RecordBatch, column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of ``column`` pass multiples of ``size``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(lengths):
        return
    group = np.cumsum(lengths, dtype=np.int64) // size
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(lengths)], strict=True):
        yield batch.slice(int(a), int(b - a))


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words between the six ASCII blanks, and the number of them in each text; null has none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    values, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        row = np.repeat(np.arange(len(counts)), counts)[full]
        values, counts = values.filter(pa.array(full)), np.bincount(row, minlength=len(counts))
    return values, counts.astype(np.int64)


def distinct(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Index into the distinct strings for each value, and these strings."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` consecutive values."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def word_hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each word."""
    index, words = distinct(values)
    own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    return own[index]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: a bijection whose bits all depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark has one task per core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoded(strings: list[str], path: str) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch_fast(strings, add_special_tokens=False)]


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself
    if it is printable, else the next one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()
# Fixed value: where a byte-level tokenizer cuts a text before its merges.
CUTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_level(strings: list[str], path: str, cache: Cache) -> Iterator[tuple[str, bytes]]:
    """Each string with its ids as uint16 in the machine's (little-endian) order.

    A run of letters, with or without one space before it, goes straight to
    the tokenizer's merges; other strings are cut into such runs and the rest,
    which are looked up in ``cache`` first. Strings with a special string of
    the tokenizer take the whole way.
    """
    model = tokenizer(path).model
    model._resize_cache(0)      # its own cache of words is locked and copied, and sees no word twice here
    special = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    other = []

    def merged(x: str) -> bytes:
        letters = x.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("H", [t.id for t in model.tokenize(letters)]).tobytes()

    for x in strings:
        if (x[1:] if x[:1] == " " else x).isalpha():
            letters = x.replace(" ", BYTE_LETTERS[ord(" ")]) if x.isascii() else \
                x.encode().decode("latin-1").translate(BYTE_LETTERS)
            yield x, array("H", [t.id for t in model.tokenize(letters)]).tobytes()
        elif any(s in x for s in special):
            other.append(x)
        else:
            ids = []
            for y in CUTS.findall(x):
                own = cache.find(y)
                if own is None:
                    own = merged(y)
                    cache.put(y, own)
                ids.append(own)
            yield x, b"".join(ids)
    for x, ids in zip(other, encoded(other, path), strict=True):
        yield x, array("H", ids).tobytes()


# A byte-level tokenizer of this family starts a new piece at a single space
# between two characters that are not blank; what lies between two such spaces
# is encoded alone. Python's blanks include all that the tokenizer counts.
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


def chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Strings that are encoded apart from each other: (strings, index, counts).

    ``index`` names the strings of all texts in order, ``counts`` of them for
    each text; not all strings need be named. All but a text's first begin
    with the space in front of them.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, " ")
    values, counts = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    coded = values.dictionary_encode()
    index, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    trimmed = pc.binary_length(pc.utf8_trim_whitespace(words)).to_numpy(zero_copy_only=False)
    odd = ((size == 0) | (size != trimmed))[index]
    strings = pc.binary_join_element_wise("", words, " ").to_numpy(zero_copy_only=False).tolist()
    starts = np.cumsum(counts) - counts
    firsts = values.take(pa.array(starts)).dictionary_encode()
    index[starts] = len(strings) + firsts.indices.to_numpy(zero_copy_only=False)
    strings += firsts.dictionary.to_pylist()
    if not odd.any():
        return strings, index, counts
    # Texts with other blanks beside a space: cut by the exact rule.
    rows = np.unique(np.repeat(np.arange(len(counts)), counts)[odd])
    place: dict[str, int] = {}
    parts, new_counts, at = [], counts.copy(), 0
    for r in rows.tolist():
        first, *rest = INNER_SPACE.split(texts[r].as_py())
        own = [first, *(" " + x for x in rest)]
        parts += [index[at:int(starts[r])],
                  np.array([place.setdefault(x, len(strings) + len(place)) for x in own], np.int64)]
        new_counts[r], at = len(own), int(starts[r] + counts[r])
    return [*strings, *place], np.concatenate([*parts, index[at:]]), new_counts
