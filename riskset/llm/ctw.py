"""Context-tree weighting over bytes, and a smoothed word model as the base.

A text is its words in lower case, one space between them and an end byte.
Each byte is eight binary decisions; each decision has a context tree over the
bytes before it, to a depth of ``DEPTH``. A tree's node estimates its bit with
Krichevsky-Trofimov counts and is mixed with its children: P_w = P_e / 2 +
(product of the children's P_w) / 2, so the trained weight of stopping at a
node is P_e / (P_e + product). Prediction follows the context from the deepest
node up and mixes each node's estimate with what is below it; a node that
training never saw says one half.

Training counts are one aggregate over (DEPTH + 1)-byte stretches and words of
all training texts: the shorter contexts' counts are sums of the longest
ones'. Tree nodes are DataFrame rows, a level is one group-by; the longest contexts
are rows with the list of bytes seen after them. Scoring ships
the probabilities of trained stretches as a hash table, in shards of at most
``SHARD`` stretches, a pass over the documents each; stretches that training
never saw are written out per document and answered by joins with the tree.
Words are answered by a shipped table of the ``FREQUENT`` most frequent, the
others by a join per distinct word and document.

Defined cases: null text is empty and consists of the end; rows with the same
doc_id are separate documents (they fall on the same side of the split); a
null doc_id is hashed as an empty text; without training texts every bit has
probability one half and the base knows no token; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.llm import pieces
from riskset.llm.common import is_small, stored

DEPTH = 5
SHARD = 1 << 21              # trained stretches shipped at once: at most 64 MB as a hash table
SCORED_BYTES = 1 << 19       # bytes of text scored at once: some fifteen numbers are held for each
FREQUENT = 1 << 16           # words in the shipped table
MERGE = 16                   # batches of counts held before they are merged
END = b"\n"
END_HASH = 0                 # of the end token; words hash to odd numbers
WORDS, STRETCHES = 0, 1


def _normal(texts: pa.Array) -> pa.Array:
    """Lower-case words joined by one space."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    return pc.binary_join(lists, " ")


def stretches(normal: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The depth + 1 bytes that end at each byte of each text (its end included), and their number a text."""
    pad = END.decode() * depth
    framed = pc.binary_join_element_wise(pad, normal, END.decode(), "")
    framed = pa.concat_arrays([framed]) if framed.offset else framed
    offsets = np.frombuffer(framed.buffers()[1], np.int32)[: len(framed) + 1].astype(np.int64)
    raw = np.frombuffer(framed.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    size = max(0, len(raw) - depth)
    keys = np.zeros(size, np.uint64)
    for k in range(depth + 1):
        keys <<= np.uint64(8)
        keys |= raw[k:k + size]
    # Stretches that end in a text's padding belong to none.
    last = np.ones(len(raw), bool)
    for k in range(depth):
        last[offsets[:-1] - offsets[0] + k] = False
    return keys[last[depth:]], np.diff(offsets) - depth


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    cuts = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0) if len(k) else np.zeros(0, np.int64)
    return k[cuts], np.add.reduceat(n, cuts) if len(k) else n


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index into distinct word hashes, these hashes, and the words of each text."""
    values, counts = pieces.split_words(texts, lower=True)
    index, words = pieces.distinct(values)
    own = np.fromiter((xxhash.xxh64_intdigest(w) | 1 for w in words), np.uint64, len(words))
    return index, own, counts


def _counter(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[list, list]] = {WORDS: ([], []), STRETCHES: ([], [])}

        def add(kind: int, keys: np.ndarray, counts: np.ndarray) -> None:
            k, n = kept[kind]
            k.append(keys)
            n.append(counts.astype(np.int64))
            if len(k) >= MERGE:
                one = _merged(k, n)
                k[:], n[:] = [one[0]], [one[1]]

        for batch in batches:
            for part in pieces.steps(batch):
                index, own, counts = _words(part.column("text"))
                add(WORDS, own, np.bincount(index, minlength=len(own)))
                add(WORDS, np.array([END_HASH], np.uint64), np.array([len(part)]))
                keys, _ = stretches(_normal(part.column("text")), depth)
                add(STRETCHES, *np.unique(keys, return_counts=True))
        for kind, (k, n) in kept.items():
            if k:
                keys, counts = _merged(k, n)
                for a in range(0, len(keys), 100_000):
                    one = keys[a:a + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(one), kind, np.int32)), pa.array(one.view(np.int64)),
                         pa.array(counts[a:a + 100_000])], names=["kind", "key", "n"])
    return run


def _log2_gamma_shift(x: Column) -> Column:
    """log2 of Gamma(x), x at least one half: Stirling's series eight steps up."""
    up = x + 8
    sq = up * up
    series = (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) \
        + (1.0 / 12 - (1.0 / 360 - (1.0 / 1260 - 1.0 / (1680 * sq)) / sq) / sq) / up
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    return (series - F.log(steps)) / math.log(2)


def _log2_kt(n0: Column, n1: Column) -> Column:
    a, b = n0.cast("double"), n1.cast("double")
    return _log2_gamma_shift(a + 0.5) + _log2_gamma_shift(b + 0.5) - _log2_gamma_shift(a + b + 1) \
        - math.log2(math.pi)


def _bits(rows: DataFrame, *more: str) -> DataFrame:
    """key -> key, ctx, node, bit: the eight decisions of its last byte.

    ``node`` is the byte's bits before the decision, behind a leading one.
    """
    step = rows.select("key", *more, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_k"))
    return step.select("key", *more, F.shiftright("key", 8).alias("ctx"),
                       F.expr("cast(shiftright(256 | (key & 255), 8 - _k) as int)").alias("node"),
                       F.expr("cast(shiftright(key, 7 - _k) & 1 as int)").alias("bit"))


def _mask(depth: int) -> Column:
    return F.lit((1 << (8 * depth)) - 1).cast("long")


def contexts(counts: DataFrame, depth: int) -> DataFrame:
    """Stored (near, ctx, next): the bytes seen after each longest context (256 at
    most), with their counts; ``near`` is the context but its farthest byte.

    Contexts of one ``near`` are written together, so that the level above is
    mostly summed before its shuffle.
    """
    rows = counts.select(F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND(255).cast("int").alias("sym"), "n")
    rows = rows.withColumn("near", F.col("ctx").bitwiseAND(_mask(depth - 1))).repartition("near")
    return stored(rows.groupBy("near", "ctx").agg(F.collect_list(F.struct("sym", "n")).alias("next")), "contexts")


def _nodes(batch: pa.RecordBatch):
    """Places (row * 256 + node) of a batch's decisions with their counts, and for
    each byte seen its row, its eight places (as indexes) and bits."""
    lists = batch.column("next")
    flat = lists.flatten()
    sym, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sym", "n"))
    row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
    k = np.arange(8)
    node, bit = (256 | sym[:, None]) >> (8 - k), (sym[:, None] >> (7 - k)) & 1
    place, at = np.unique((row[:, None] * 256 + node).ravel(), return_inverse=True)
    n1 = np.bincount(at, (bit * n[:, None]).ravel(), len(place))
    n0 = np.bincount(at, ((1 - bit) * n[:, None]).ravel(), len(place))
    return place, n0, n1, row, sym, at.reshape(bit.shape), bit


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 2000):
            yield batch.slice(a, 2000)


def _deepest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        place, n0, n1, *_ = _nodes(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column("ctx").take(pa.array(place >> 8)), pa.array((place & 255).astype(np.int32)),
             pa.array(n0.astype(np.int64)), pa.array(n1.astype(np.int64))], names=["ctx", "node", "n0", "n1"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, lp of every trained stretch: its own counts under what stands above."""
    for batch in _slices(batches):
        place, n0, n1, row, sym, at, bit = _nodes(batch)
        above = batch.column("above")
        flat = above.flatten()
        over = np.repeat(np.arange(len(batch)), np.diff(above.offsets.to_numpy())) * 256 + flat.field("node").to_numpy()
        order = np.argsort(over)
        mine = order[np.searchsorted(over[order], place)]
        part, rest = (flat.field(c).to_numpy(zero_copy_only=False)[mine] for c in ("part", "rest"))
        one = part + rest * (n1 + 0.5) / (n0 + n1 + 1)
        lp = np.log2(np.where(bit == 1, one[at], 1 - one[at])).sum(axis=1)
        key = (batch.column("ctx").to_numpy()[row] << 8) | sym
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lp)], names=["key", "lp"])


def tree(seen: DataFrame, depth: int) -> list[DataFrame]:
    """Stored levels, deepest first: ctx, node, n0, n1, stop (the weight of stopping here)."""
    level = seen.select("ctx", "next").mapInArrow(_deepest, "ctx long, node int, n0 long, n1 long")
    own = _log2_kt(F.col("n0"), F.col("n1"))
    levels = [stored(level.withColumns({"pw": own, "stop": F.lit(1.0)}), "level")]
    for d in range(depth - 1, -1, -1):
        up = levels[-1].withColumn("ctx", F.col("ctx").bitwiseAND(_mask(d)))
        level = up.groupBy("ctx", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
                                              F.sum("pw").alias("below"))
        # log2((P_e + below) / 2), around the larger of the two.
        high, low = F.greatest("pe", "below"), F.least("pe", "below")
        level = level.withColumn("pe", own).withColumn("pw", high + F.log2(1 + F.pow(F.lit(2.0), low - high)) - 1)
        stop = F.when(F.col("below") - F.col("pe") > 1000, F.lit(0.0)).otherwise(
            1 / (1 + F.pow(F.lit(2.0), F.col("below") - F.col("pe"))))
        levels.append(stored(level.withColumn("stop", stop).select("ctx", "node", "n0", "n1", "pw", "stop"), "level"))
    return levels


def trained_answers(seen: DataFrame, levels: list[DataFrame], depth: int) -> DataFrame:
    """Stored (key, lp) for every trained stretch.

    From the root down each node gets what the levels to it contribute
    (``part``) and the weight left for the levels below (``rest``); the
    longest contexts meet theirs in one row per context.
    """
    kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    above = None
    for d, level in zip(range(depth), reversed(levels[1:]), strict=True):
        rows = level.select("ctx", "node", (F.col("stop") * kt).alias("_here"), (1 - F.col("stop")).alias("_go"))
        if above is None:
            above = rows.select("ctx", "node", F.col("_here").alias("part"), F.col("_go").alias("rest"))
            continue
        rows = rows.withColumn("_up", F.col("ctx").bitwiseAND(_mask(d - 1)))
        over = above.select(F.col("ctx").alias("_up"), "node", "part", "rest")
        above = stored(rows.join(_hinted(over), ["_up", "node"]).select(
            "ctx", "node", (F.col("part") + F.col("rest") * F.col("_here")).alias("part"),
            (F.col("rest") * F.col("_go")).alias("rest")), "above")
    lists = above.groupBy(F.col("ctx").alias("near")).agg(F.collect_list(F.struct("node", "part", "rest")).alias("above"))
    return stored(seen.join(lists, "near").select("ctx", "next", "above").mapInArrow(
        _answers, "key long, lp double"), "trained")


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def log2_probability(keys: DataFrame, levels: list[DataFrame], depth: int) -> DataFrame:
    """key -> (key, lp): log2 of the last byte's probability after the bytes before it."""
    keys = stored(keys.select("key"), "keys")
    rows = _bits(keys).withColumn("q", F.lit(0.5))
    wanted = stored(keys.select(F.shiftright("key", 8).alias("ctx")).distinct(), "wanted")
    for i, level in enumerate(levels):
        d = depth - i
        mask = _mask(d)
        if not i:                                   # the largest level, of which few contexts are asked for
            level = level.join(_hinted(wanted), "ctx", "left_semi")
        side = level.select(F.col("ctx").alias("_ctx"), F.col("node").alias("_node"),
                            ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)).alias("_kt"),
                            F.col("stop").alias("_stop"))
        rows = rows.withColumn("_c", F.col("ctx").bitwiseAND(mask)).join(
            _hinted(side) if d < depth else side, (F.col("_c") == F.col("_ctx")) & (F.col("node") == F.col("_node")),
            "left")
        mixed = F.col("_stop") * F.col("_kt") + (1 - F.col("_stop")) * F.col("q")
        rows = rows.withColumn("q", F.coalesce(mixed, F.lit(0.5))).select("key", "ctx", "node", "bit", "q")
    p = F.when(F.col("bit") == 1, F.col("q")).otherwise(1 - F.col("q"))
    return rows.groupBy("key").agg(F.sum(F.log2(p)).alias("lp"))


def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing, at most half full; free slots hold the largest key."""
    size = 1 << max(4, (2 * len(keys)).bit_length() - (len(keys) & (len(keys) - 1) == 0))
    slots, own = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(size)
    left, at = np.arange(len(keys)), _slot(keys, size)
    while len(left):
        free = slots[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
        first = np.unique(at[free], return_index=True)[1]
        win = np.flatnonzero(free)[first]
        slots[at[win]], own[at[win]] = keys[left[win]], values[left[win]]
        rest = np.ones(len(left), bool)
        rest[win] = False
        left, at = left[rest], (at[rest] + 1) & (size - 1)
    return slots, own


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, and whether the key is there."""
    slots, own = table
    at = _slot(keys, len(slots))
    held = slots[at]
    found = held == keys
    values = np.where(found, own[at], 0.0)
    todo = np.flatnonzero(~found & (held != np.uint64(0xFFFFFFFFFFFFFFFF)))
    at = at[todo]
    while len(todo):
        at = (at + 1) & (len(slots) - 1)
        held = slots[at]
        hit = held == keys[todo]
        values[todo[hit]], found[todo[hit]] = own[at[hit]], True
        on = ~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))
        todo, at = todo[on], at[on]
    return values, found


def _scorer(tables, words, depth: int, shard: int, shards: int):
    """Rows of kind -1: a document's sums; WORDS and STRETCHES: what is not in the shipped tables.

    A stretch belongs to the shard of its key; words are counted in shard 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (known, logs) = tables.value, words.value
        for batch in batches:
            for part in pieces.steps(batch, size=SCORED_BYTES):
                rid, n = part.column("rid").to_numpy(), len(part)
                keys, size = stretches(_normal(part.column("text")), depth)
                row = np.repeat(np.arange(n), size)
                if shards > 1:
                    mine = pieces.mixed(keys) % np.uint64(shards) == shard
                    keys, row = keys[mine], row[mine]
                values, found = look_up(table, keys)
                score = np.bincount(row, values, n)
                lost = [(STRETCHES, keys[~found], row[~found])]
                tokens, hit, base = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
                if shard == 0:
                    index, own, tokens = _words(part.column("text"))
                    at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                    there = known[at] == own if len(known) else np.zeros(len(own), bool)
                    log = np.where(there, logs[at], 0.0) if len(known) else np.zeros(len(own))
                    word_row = np.repeat(np.arange(n), tokens)
                    seen = there[index]
                    base = np.bincount(word_row, log[index], n)
                    hit = np.bincount(word_row[seen], minlength=n)
                    lost.append((WORDS, own[index[~seen]], word_row[~seen]))
                yield _rows(np.full(n, -1), rid, part.column("doc_id"), part.column("held_out"), tokens, hit, base, score)
                for kind, k, r in lost:
                    order = np.lexsort((k, r))
                    k, r = k[order], r[order]
                    cuts = np.flatnonzero((np.diff(k, prepend=~k[:1]) != 0) | (np.diff(r, prepend=-1) != 0))
                    count = np.diff(np.append(cuts, len(k)))
                    zero = np.zeros(len(cuts))
                    yield _rows(np.full(len(cuts), kind), rid[r[cuts]], pa.array(k[cuts].view(np.int64)),
                                pa.nulls(len(cuts), pa.bool_()), count, np.zeros(len(cuts), np.int64), zero, zero)
    return run


_ROW = "kind int, rid long, key long, held_out boolean, n long, hit long, base double, score double"


def _rows(kind, rid, key, held_out, n, hit, base, score) -> pa.RecordBatch:
    """``key`` is the doc_id in the rows of kind -1."""
    return pa.RecordBatch.from_arrays(
        [pa.array(kind.astype(np.int32)), pa.array(rid), key, held_out, pa.array(n.astype(np.int64)),
         pa.array(hit.astype(np.int64)), pa.array(base), pa.array(score)],
        names=["kind", "rid", "key", "held_out", "n", "hit", "base", "score"])


def score(docs: DataFrame, depth: int = DEPTH, frequent: int = FREQUENT, shard_size: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per document."""
    spark = docs.sparkSession
    side = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (side == 1).alias("held_out"))
    counts = stored(own.where(~F.col("held_out")).select("text").mapInArrow(
        _counter(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where(F.col("kind") == WORDS).select("key", "n")
    trained = counts.where(F.col("kind") == STRETCHES).select("key", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    norm = math.log10(total + 0.5 * (kinds + 1))
    seen = contexts(trained, depth)
    levels = tree(seen, depth)
    known = trained_answers(seen, levels, depth)
    n_known = known.count()
    top = words.where(F.col("key") != END_HASH).orderBy(F.desc("n"), "key").limit(frequent).toArrow()
    top_keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(top_keys)
    logs = np.log10(top.column("n").to_numpy()[order] + 0.5)
    shipped_words = spark.sparkContext.broadcast((top_keys[order], logs))
    numbered = own.withColumn("rid", F.monotonically_increasing_id())
    shards = max(1, -(-n_known // shard_size))
    if shards > 1:                       # each pass must see the same numbers
        numbered = stored(numbered, "numbered")
    parts = []
    for k in range(shards):
        rows = (known if shards == 1 else known.mapInArrow(_of_shard(k, shards), "key long, lp double")).toArrow()
        table = spark.sparkContext.broadcast(hash_table(
            rows.column("key").to_numpy().view(np.uint64), rows.column("lp").to_numpy()))
        parts.append(stored(numbered.select("rid", "doc_id", "held_out", "text").mapInArrow(
            _scorer(table, shipped_words, depth, k, shards), _ROW), "scored"))
        table.unpersist()
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    # Stretches that training never saw, each answered once.
    new = scored.where(F.col("kind") == STRETCHES)
    answers = stored(log2_probability(new.select("key").distinct(), levels, depth), "unseen")
    unseen = new.join(_hinted(answers), "key").groupBy("rid").agg(F.sum(F.col("n") * F.col("lp")).alias("more"))
    # Words beyond the shipped table.
    rare = scored.where(F.col("kind") == WORDS).select("rid", "key", F.col("n").alias("k")).join(
        words, "key", "left").groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare"),
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    unseen, rare = stored(unseen, "unseen"), stored(rare, "rare")
    main = scored.where(F.col("kind") == -1).groupBy("rid").agg(
        F.max("key").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n").alias("words"),
        F.sum("hit").alias("hit"), F.sum("base").alias("base"), F.sum("score").alias("log2p"))
    end = words.where(F.col("key") == END_HASH).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = main.join(_hinted(unseen), "rid", "left").join(_hinted(rare), "rid", "left")
    n_tokens = F.col("words") + 1
    known_tokens = F.col("hit") + F.coalesce("rare_known", F.lit(0)) + F.lit(1 if end else 0)
    base = F.col("base") + F.coalesce("rare", F.lit(0.0)) + F.lit(math.log10(end + 0.5)) - n_tokens * F.lit(norm)
    log2p = F.col("log2p") + F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", n_tokens.alias("n_tokens"), known_tokens.cast("long").alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"),
                      (log2p * F.lit(math.log10(2))).alias("score"))


def _of_shard(k: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = pieces.mixed(batch.column("key").to_numpy().view(np.uint64)) % np.uint64(shards) == k
            yield batch.filter(pa.array(mine))
    return run
