"""Phrase collocations counted with weighted acyclic automata.

A shard (a task's texts, up to ``SHARD_WORDS`` words at a time) sorts its word
sequences of one to three words and builds a count transducer from each range
of them: a deterministic automaton over (language, word, word, word) whose arcs
carry the count of the sequence that ends there. States with equal arcs are one
state, found level by level from the longest sequences up.

Sequences are dealt out by the range in which the hash of their prefix (the
language and at most two words) lies, so a sequence, and with it every
continuation of its first two words, has one range. A range's shard automata
are united: their paths are listed, sorted, and the weights of equal paths
summed. Sequences below ``min_count`` are dropped after that: they are neither
candidates nor parts of one.

The parts of candidates are looked up by composition: a range sends each part
that it needs once to the part's range, where all requests walk the automaton
together, an arc a step, and the counts come back. A request for the two-word
part of a longer candidate carries that candidate's count, which tells the
part's range whether the part is to be dropped in its favour.

A range sends on its own first ``top`` candidates a language only, which hold
all of the language's first ``top``; they are ranked in two steps. Ranges only
place the work; their number follows the bytes of text.

Defined cases: null text is empty; a null language is ``und`` (one with texts of
that name); rows are texts of their own whatever their ids, so repeated rows
count again; a language without candidates has no rows; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskset.llm import pieces
from riskset.llm.common import is_small, stored

MIN_COUNT = 10
SHARE = 50                  # percent of a phrase's count that a longer candidate must have to replace it
TOP = 2000
UNIT = 1_000_000            # of scores
RANGE_BYTES = 8 << 20       # bytes of text for each prefix range
MAX_RANGES = 1 << 16
SHARD_WORDS = 1 << 20       # words held before their automata are written
BUCKETS = 64                # of ranges, ranked before their languages are

WORD, BLANK, BREAK = 0, 1, 2


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower, kind = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)
    lower[ord("A"):ord("Z") + 1] += 32
    kind[[ord(" "), ord("\t")]] = BLANK
    kind[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = BREAK
    return lower, kind


LOWER, KIND = _tables()


def split_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words in order, the text of each, and a number that changes with every piece."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = KIND[raw]
    word = kind == WORD
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(word & (first[:-1] | ~np.concatenate([[False], word[:-1]])))
    piece = np.cumsum((kind == BREAK) | first[:-1])[starts]
    place = np.cumsum(word)
    ends = np.concatenate([place[starts] - 1, place[-1:]]).astype(np.int32) if len(starts) else np.zeros(1, np.int32)
    values = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[raw][word])])
    return values, np.searchsorted(offsets, starts, "right") - 1, piece


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def ranges_of(lang: np.ndarray, first: np.ndarray, second: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a prefix by the hashes of its symbols; ``second`` is 0 for a single word."""
    h = pieces.mixed(pieces.mixed(lang + np.uint64(1)) + first)
    h = pieces.mixed(h + second * np.uint64(3))
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


# An automaton: sorted words; states' first arcs; an arc's word, weight (0: no
# sequence ends there) and next state (leaf arcs, the last ones, have none).
FIELDS = ["words", "start", "label", "weight", "next"]
CODEC = pa.Codec("zstd", compression_level=3)


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes a value, and the values in as few bytes as the largest needs."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return width, values.astype(f"<u{width}").tobytes()


def pack(automaton: list) -> bytes:
    """One compressed string: numbers in narrow types, next states as steps from the highest so far."""
    words, start, label, weight, follow = automaton
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    text = words.buffers()[2].to_pybytes()[offsets[0]:offsets[-1]] if len(words) and words.buffers()[2] else b""
    highest = np.maximum.accumulate(np.concatenate([[0], follow]))[:-1]
    parts = [_narrow(x) for x in (np.diff(offsets), np.diff(start), label, weight, np.where(follow < 0, 0, highest + 2 - follow))]
    sizes = [len(words), max(0, len(start) - 1), len(label), len(weight), len(follow)]
    head = np.array([*sizes, *(w for w, _ in parts), len(text)], "<i8").tobytes()
    plain = head + b"".join(x for _, x in parts) + text
    return len(plain).to_bytes(8, "little") + CODEC.compress(plain, asbytes=True)


def unpack(packed: bytes) -> dict:
    plain = CODEC.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    head = np.frombuffer(plain, "<i8", 11)
    at, parts = head.nbytes, []
    for size, width in zip(head[:5].tolist(), head[5:10].tolist(), strict=True):
        parts.append(np.frombuffer(plain, f"<u{width}", size, at).astype(np.int64))
        at += size * width
    lengths, counts, label, weight, steps = parts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(plain[at:])])
    return {"words": words, "start": np.concatenate([[0], np.cumsum(counts)]), "label": label, "weight": weight,
            "next": _follows(steps)}


def _follows(steps: np.ndarray) -> np.ndarray:
    """Next states from steps: 0 none, 1 the first new state, s > 1 the one s - 2 below the highest so far."""
    # A new state is always the highest so far and one.
    fresh = np.cumsum(steps == 1)
    return np.where(steps == 0, -1, fresh + 2 - steps - (steps == 1))


def _same_states(parent: np.ndarray, states: int, arcs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each state of a level the number of its class of equal states, and each class's first state.

    Arcs are sorted by state. Equal hashes are compared arc by arc.
    """
    h = np.zeros(len(parent), np.uint64)
    for a in arcs:
        h = pieces.mixed(h + a.astype(np.uint64) + np.uint64(0x9E37))
    counts = np.bincount(parent, minlength=states)
    begin = np.cumsum(counts) - counts
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
    own = pieces.mixed(sums[begin + counts] - sums[begin] + counts.astype(np.uint64))
    _, first, group = np.unique(own, return_index=True, return_inverse=True)
    leader = first[group]
    like = counts == counts[leader]
    at = np.minimum(np.arange(len(parent)) - begin[parent] + begin[leader][parent], max(0, len(parent) - 1))
    differ = np.zeros(len(parent), bool)
    for a in arcs:
        differ |= a != a[at]
    like &= np.bincount(parent[differ], minlength=states) == 0
    leader = np.where(like, leader, np.arange(states))
    kept = np.unique(leader)
    return np.searchsorted(kept, leader), kept


def build(words: pa.Array, path: list[np.ndarray], weight: np.ndarray) -> list:
    """Minimal automaton of sorted distinct paths; symbols are indexes of sorted words, -1 after a path's end.

    Levels are taken from the deepest up; a state is known by its arcs, and
    those by the states they lead to, which are already one for equal ones.
    """
    n, depth = len(weight), len(path)
    change = np.zeros(n, bool)
    change[:1] = True
    nodes, first = [np.zeros(n, np.int64)], [np.zeros(1, np.int64)]
    for symbol in path:
        change = change.copy()
        change[1:] |= symbol[1:] != symbol[:-1]
        # Rows whose path has ended before this level are at no node of it.
        here = symbol >= 0
        start = change & here
        nodes.append(np.cumsum(start) - 1)
        first.append(np.flatnonzero(start))
    levels, state_of = [], None
    for d in range(depth, 0, -1):
        at = first[d]                                   # rows where the arcs of this level begin
        label = path[d - 1][at]
        ended = (path[d][at] < 0) if d < depth else np.ones(len(at), bool)
        own = np.where(ended, weight[at], 0)
        parent = nodes[d - 1][at]
        inner, parent = np.unique(parent, return_inverse=True)      # nodes of the level above with arcs
        arcs = [label, own] + ([state_of] if state_of is not None else [])
        group, kept = _same_states(parent, len(inner), arcs)
        counts = np.bincount(parent, minlength=len(inner))
        take = np.zeros(len(inner), bool)
        take[kept] = True
        levels.append((counts[kept], [a[take[parent]] for a in arcs]))
        # The state that each node of the level above leads to, -1 for none.
        state_of = np.full(len(first[d - 1]), -1)
        state_of[inner] = group
    return _laid_out(words, levels[::-1])


def _laid_out(words: pa.Array, levels: list) -> list:
    """States of all levels in one numbering, the root first."""
    counts = np.concatenate([c for c, _ in levels])
    base = np.cumsum([0] + [len(c) for c, _ in levels])
    start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    label = np.concatenate([a[0] for _, a in levels]).astype(np.int32)
    weight = np.concatenate([a[1] for _, a in levels])
    follow = [np.where(a[2] >= 0, a[2] + base[i + 1], -1) for i, (_, a) in enumerate(levels[:-1])]
    return [words, start, label, weight, np.concatenate(follow).astype(np.int32)]


class Automaton:
    """A stored automaton: list its paths, or walk many requests at once."""

    def __init__(self, row: dict):
        self.words, self.start, self.label, self.weight, follow = (row[c] for c in FIELDS)
        self.next = np.concatenate([follow, np.full(len(self.label) - len(follow), -1, follow.dtype)]).astype(np.int64)
        self.arcs = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)) * len(self.words) + self.label

    def paths(self, depth: int = 4) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """(symbols, weights) of the sequences of each length."""
        state, path = np.zeros(1, np.int64), []
        for _ in range(depth):
            if not len(state) or len(self.start) < 2:
                return
            n = (self.start[state + 1] - self.start[state]).astype(np.int64)
            row = np.repeat(np.arange(len(state)), n)
            arc = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.start[state][row]
            path = [p[row] for p in path] + [self.label[arc].astype(np.int64)]
            own = self.weight[arc] > 0
            yield [p[own] for p in path], self.weight[arc][own]
            onward = self.next[arc] >= 0
            state, path = self.next[arc][onward], [p[onward] for p in path]

    def walk(self, path: list[np.ndarray]) -> np.ndarray:
        """Weights of paths, all of one length; 0 where there is none."""
        state, weight = np.zeros(len(path[0]), np.int64), np.zeros(len(path[0]), np.int64)
        for symbol in path:
            key = state * len(self.words) + symbol
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            held = (state >= 0) & (symbol >= 0) & (self.arcs[arc] == key)
            weight = np.where(held, self.weight[arc], 0)
            state = np.where(held, self.next[arc], -1)
        return weight


def _rows_of(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, Automaton]]:
    for number, packed in zip(table["range"].to_pylist(), table["automaton"].to_pylist(), strict=True):
        yield number, Automaton(unpack(packed))


def summed(lang: np.ndarray, w: list[np.ndarray], weight: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct (lang, first, second, third) with summed weights; -1 stands for no word."""
    pair, at = np.unique((lang * size + w[0]) * (size + 1) + w[1] + 1, return_inverse=True)
    key, group = np.unique(at * (size + 1) + w[2] + 1, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, group, weight)
    own = pair[key // (size + 1)]
    head = own // (size + 1)
    return [head // size, head % size, own % (size + 1) - 1, key % (size + 1) - 1], total


class _Shard:
    """Words of texts until there are enough of them to be counted."""

    def __init__(self, ranges: int):
        self.ranges, self.base = ranges, 0
        self.clear()

    def clear(self) -> None:
        self.values: list[pa.Array] = []
        self.langs: list[np.ndarray] = []
        self.pieces: list[np.ndarray] = []
        self.names: dict[str, int] = {}
        self.held = 0

    def add(self, part: pa.RecordBatch) -> None:
        values, text, piece = split_pieces(part.column("text"))
        names = part.column("lang").to_pylist()
        own = np.array([self.names.setdefault(x, len(self.names)) for x in names], np.int64)
        self.values.append(values)
        self.langs.append(own[text])
        self.pieces.append(piece + self.base)
        self.base += int(piece[-1]) + 1 if len(piece) else 0
        self.held += len(values)

    def automata(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        coded = pa.concat_arrays(self.values).dictionary_encode()
        lang, piece = np.concatenate(self.langs), np.concatenate(self.pieces)
        # Symbols are words and names of languages in byte order.
        symbols = pa.concat_arrays([coded.dictionary, pa.array(list(self.names), pa.string())]).unique()
        order = pc.sort_indices(symbols)
        symbols = symbols.take(order)
        place = pc.index_in(coded.dictionary, symbols).to_numpy(zero_copy_only=False).astype(np.int64)
        named = pc.index_in(pa.array(list(self.names), pa.string()), symbols).to_numpy(zero_copy_only=False).astype(np.int64)
        w, size = place[coded.indices.to_numpy(zero_copy_only=False)], len(symbols)
        lang = named[lang]
        self.clear()

        def heads(first: np.ndarray) -> np.ndarray:
            return (lang[first] * size + w[first]) * (size + 1)

        one, two = np.arange(len(w)), np.flatnonzero(piece[1:] == piece[:-1])
        three = np.flatnonzero(piece[2:] == piece[:-2])
        # Single words are prefixes without a second word; sorted runs are merged.
        single, single_n = np.unique(lang * size + w, return_counts=True)
        pair, at, pair_n = np.unique(heads(two) + w[two + 1] + 1, return_inverse=True, return_counts=True)
        prefix = np.concatenate([single * (size + 1), pair])
        turn = np.argsort(prefix, kind="stable")
        rank = np.empty(len(turn), np.int64)
        rank[turn] = np.arange(len(turn))
        pair_at = np.full(len(one), -1)
        pair_at[two] = rank[len(single):][at]
        triple, triple_n = np.unique(pair_at[three] * (size + 1) + w[three + 2] + 1, return_counts=True)
        del lang, w, piece, one, two, three, at, pair_at, pair, coded
        keys = np.concatenate([np.arange(len(prefix)) * (size + 1), triple])
        weights = np.concatenate([np.concatenate([single_n, pair_n])[turn], triple_n])
        turn = np.argsort(keys, kind="stable")
        keys, weights = keys[turn], weights[turn]
        own = np.sort(prefix)
        head, second = own // (size + 1), own % (size + 1) - 1
        hashes = word_hashes(symbols.to_pylist())
        number = ranges_of(hashes[head // size], hashes[head % size], np.where(second >= 0, hashes[second], 0), self.ranges)
        by_range = np.argsort(number[keys // (size + 1)].astype(np.uint16), kind="stable")
        keys, weights = keys[by_range], weights[by_range]
        cuts = np.searchsorted(number[keys // (size + 1)], np.arange(self.ranges + 1))
        for r in np.flatnonzero(np.diff(cuts)):
            key = keys[cuts[r]:cuts[r + 1]]
            row = key // (size + 1)
            path = [head[row] // size, head[row] % size, second[row], key % (size + 1) - 1]
            packed = pack(compact(symbols, path, weights[cuts[r]:cuts[r + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([packed])], names=["range", "automaton"])


def compact(symbols: pa.Array, path: list[np.ndarray], weight: np.ndarray) -> list:
    """An automaton with only the symbols that its paths hold."""
    used = np.zeros(len(symbols), bool)
    for p in path:
        used[p[p >= 0]] = True
    place = np.cumsum(used) - 1
    return build(symbols.filter(pa.array(used)), [np.where(p >= 0, place[p], -1) for p in path], weight)


def _shards(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(ranges)
        for batch in batches:
            for part in pieces.steps(batch):
                shard.add(part)
                if shard.held >= SHARD_WORDS:
                    yield from shard.automata()
        yield from shard.automata()

    return run


MERGED = "range int, automaton binary, langs array<string>, totals array<long>"


def _united(min_count: int):
    """The union of a range's automata, without rare sequences, and each language's words in the range."""
    schema = pa.schema([("range", pa.int32()), ("automaton", pa.binary()), ("langs", pa.list_(pa.string())),
                        ("totals", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        automata = [a for _, a in _rows_of(table)]
        coded = pa.concat_arrays([a.words for a in automata]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        symbols = coded.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        places, at = rank[coded.indices.to_numpy()], 0
        lists: list[list[np.ndarray]] = [[] for _ in range(5)]
        for a in automata:
            place, at = places[at:at + len(a.words)], at + len(a.words)
            for path, weight in a.paths():
                if len(path) > 1:
                    none = np.full(len(weight), -1)
                    for kept, x in zip(lists, [*(place[p] for p in path), none, none][:4], strict=False):
                        kept.append(x)
                    lists[4].append(weight)
        lang, first, second, third, weight = (np.concatenate(x) for x in lists)
        path, total = summed(lang, [first, second, third], weight, len(symbols))
        alone = path[2] < 0
        words = np.bincount(path[0][alone], weights=total[alone], minlength=len(symbols)).astype(np.int64)
        langs = np.flatnonzero(words)
        some = total >= min_count
        automaton = compact(symbols, [p[some] for p in path], total[some]) if some.any() else [
            pa.array([], pa.string()), np.zeros(1, np.int64), *(np.zeros(0, np.int64) for _ in range(3))]
        return pa.table([table["range"][:1], pa.array([pack(automaton)]), pa.array([symbols.take(pa.array(langs)).to_pylist()]),
                         pa.array([words[langs].tolist()])], schema=schema)

    return run


def _candidates(a: Automaton) -> tuple[tuple, tuple]:
    """Paths and counts of the phrases of two and of three words."""
    found = {len(path) - 1: (path, weight) for path, weight in a.paths()}
    none = ([np.zeros(0, np.int64)] * 4, np.zeros(0, np.int64))
    return found.get(2, none), found.get(3, none)


REQUEST = pa.schema([("target", pa.int32()), ("source", pa.int32()), ("lang", pa.string()), ("first", pa.string()),
                     ("second", pa.string()), ("longer", pa.int64())])
REQUESTS = "target int, source int, lang string, first string, second string, longer long"


def _requests(ranges: int):
    """Each part that a range's candidates have, once, addressed to the part's range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, a in _rows_of(batch):
                (two, _), (three, n) = _candidates(a)
                size = len(a.words)
                if not len(two[0]) and not len(n):
                    continue
                lang = np.concatenate([two[0], two[0], three[0], three[0]])
                word = np.concatenate([two[1], two[2], three[1], three[3]])
                alone = np.unique(lang * size + word)
                pairs = np.concatenate([(three[0] * size + three[i]) * size + three[i + 1] for i in (1, 2)])
                pair, at = np.unique(pairs, return_inverse=True)
                longer = np.zeros(len(pair), np.int64)
                np.maximum.at(longer, at, np.concatenate([n, n]))
                lang = np.concatenate([alone // size, pair // size // size])
                first = np.concatenate([alone % size, pair // size % size])
                second = np.concatenate([np.full(len(alone), -1), pair % size])
                hashes = word_hashes(a.words.to_pylist())
                target = ranges_of(hashes[lang], hashes[first], np.where(second >= 0, hashes[second], 0), ranges)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(target.astype(np.int32)), pa.array(np.full(len(lang), number, np.int32)),
                     a.words.take(pa.array(lang)), a.words.take(pa.array(first)),
                     a.words.take(pa.array(second, mask=second < 0)),
                     pa.array(np.concatenate([np.zeros(len(alone), np.int64), longer]))], schema=REQUEST)

    return run


def _symbols(a: Automaton, table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [pc.fill_null(pc.index_in(table[c].combine_chunks(), a.words), -1).to_numpy().astype(np.int64) for c in names]


def _answers(merged: pa.Table, requests: pa.Table) -> pa.Table:
    """The requested counts for their sources; to the range itself, the greatest count of a longer candidate."""
    schema = pa.schema([("range", pa.int32()), *list(REQUEST)[2:5], ("n", pa.int64()), ("longer", pa.int64())])
    if not merged.num_rows or not requests.num_rows:
        return schema.empty_table()
    number, a = next(_rows_of(merged))
    lang, first, second = _symbols(a, requests, ["lang", "first", "second"])
    single = pc.is_null(requests["second"]).to_numpy()
    n = np.where(single, a.walk([lang, first]), a.walk([lang, first, second]))
    longer = requests["longer"].to_numpy()
    size = len(a.words)
    pair, at = np.unique(((lang * size + first) * size + second)[~single], return_inverse=True)
    most = np.zeros(len(pair), np.int64)
    np.maximum.at(most, at, longer[~single])
    counts = pa.table([requests["source"], requests["lang"], requests["first"], requests["second"], pa.array(n),
                       pa.nulls(len(n), pa.int64())], schema=schema)
    told = pa.table([pa.array(np.full(len(pair), number, np.int32)), a.words.take(pa.array(pair // size // size)),
                     a.words.take(pa.array(pair // size % size)), a.words.take(pa.array(pair % size)),
                     pa.nulls(len(pair), pa.int64()), pa.array(most)], schema=schema)
    return pa.concat_tables([counts, told])


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    order = np.argsort(keys, kind="stable")
    at = np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)
    return np.where(keys[order][at] == wanted, values[order][at], 0)


def weakest_cut(a: np.ndarray, cuts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, r, score) of the lowest-scoring cut, the earliest of equal ones; Python integers, so exact."""
    a2 = UNIT * a.astype(object) ** 2
    scores = [a2 // (left.astype(object) * right) for left, right in cuts]
    l, r, score = cuts[0][0], cuts[0][1], scores[0]
    for (left, right), s in zip(cuts[1:], scores[1:], strict=True):
        lower = (s < score).astype(bool)
        l, r, score = np.where(lower, left, l), np.where(lower, right, r), np.where(lower, s, score)
    return l, r, score.astype(np.int64)


def _scored(top: int, share: int):
    """A range's first ``top`` candidates of each language."""
    schema = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()),
                        ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())])

    def run(merged: pa.Table, answers: pa.Table) -> pa.Table:
        if not merged.num_rows or not answers.num_rows:
            return schema.empty_table()
        number, a = next(_rows_of(merged))
        size = len(a.words)
        lang, first, second = _symbols(a, answers, ["lang", "first", "second"])
        key = (lang * size + first) * (size + 1) + second + 1
        counted = pc.is_valid(answers["n"]).to_numpy()
        n = pc.fill_null(answers["n"], 0).to_numpy()
        longer = pc.fill_null(answers["longer"], 0).to_numpy()

        def count(lang: np.ndarray, first: np.ndarray, second: np.ndarray | int = -1) -> np.ndarray:
            return _looked_up(key[counted], n[counted], (lang * size + first) * (size + 1) + second + 1)

        (two, n2), (three, n3) = _candidates(a)
        most = _looked_up(key[~counted], longer[~counted], (two[0] * size + two[1]) * (size + 1) + two[2] + 1)
        # Only a candidate can replace another; three words are the longest.
        kept = 100 * most < share * n2
        two, n2 = [p[kept] for p in two], n2[kept]
        found = [(two, n2, weakest_cut(n2, [(count(two[0], two[1]), count(two[0], two[2]))])),
                 (three, n3, weakest_cut(n3, [(count(three[0], three[1]), count(three[0], three[2], three[3])),
                                              (count(three[0], three[1], three[2]), count(three[0], three[3]))]))]
        lang, f, l, r, score = (np.concatenate(x) for x in zip(*((p[0], n, *s) for p, n, s in found), strict=True))
        texts = [a.words.take(pa.array(p)) for p in two[1:3]] + [pa.nulls(len(n2), pa.string())]
        texts = [pa.concat_arrays([x, a.words.take(pa.array(y))]) for x, y in zip(texts, three[1:4], strict=True)]
        phrase = pc.binary_join_element_wise(*texts, " ", null_handling="skip")
        best = []
        for own in np.unique(lang):
            at = np.flatnonzero(lang == own)
            at = at[np.lexsort((-f[at], -score[at]))]
            if len(at) > top:
                last = at[top - 1]
                at = at[(score[at] > score[last]) | ((score[at] == score[last]) & (f[at] >= f[last]))]
            best.append(at if len(at) <= top else np.array(sorted(
                at.tolist(), key=lambda i: (-score[i], -f[i], phrase[i].as_py().encode()))[:top], np.int64))
        at = np.concatenate(best)
        return pa.table([pa.array(np.full(len(at), number, np.int32)), a.words.take(pa.array(lang[at])),
                         phrase.take(pa.array(at)), *(pa.array(x[at]) for x in (f, l, r, score))], schema=schema)

    return run


def mine(docs: DataFrame, min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of two or three words of each language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(min(MAX_RANGES, max(1, size // RANGE_BYTES)))
    shards = texts.mapInArrow(_shards(ranges), "range int, automaton binary")
    merged = stored(shards.groupBy("range").applyInArrow(_united(min_count), MERGED), "automata")
    requests = merged.mapInArrow(_requests(ranges), REQUESTS)
    automata = merged.drop("langs", "totals")
    answers = automata.groupBy("range").cogroup(requests.groupBy("target")).applyInArrow(
        _answers, "range int, lang string, first string, second string, n long, longer long")
    found = automata.groupBy("range").cogroup(answers.groupBy("range")).applyInArrow(
        _scored(top, share), "range int, lang string, phrase string, a long, l long, r long, score long")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    found = found.withColumn("bucket", F.pmod("range", F.lit(BUCKETS)))
    for keys in (["lang", "bucket"], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    totals = stored(merged.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(
        F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n")), "words")
    totals = F.broadcast(totals) if is_small(totals) else totals
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
